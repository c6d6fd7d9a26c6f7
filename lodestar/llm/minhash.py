"""Near-duplicates by BagMinHash: signatures of weighted Jaccard similarity, bands, and a check of the multisets.

An element of weight w owns a Poisson process on [0, w). Its points carry a register, chosen evenly, and a time; a
register keeps the point of the earliest time. Two documents then agree in a register with the probability of their
weighted Jaccard similarity. Weights are whole numbers, and processes form a hierarchy: [0, 1), [1, 2), [2, 4), [4, 8) ...
are independent roots, and a process on several units is split into its halves at each of its points. The half that has
the point keeps it, the other half draws its own next one, from then on at half the rate. Halves at or above w are
dropped, and a process whose next point is later than all registers is never split or followed further, so an element
of weight 5000 costs little more than one of weight 1. What a process draws depends on its element and its place in the
hierarchy only, so equal elements share points up to the lesser weight, whatever else is signed beside them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm.common import Powers, binaries, fresh, in_slices, mix, row_keys, written
from lodestar.llm.components import components, roots
from lodestar.llm.repeats import NO_ID
from lodestar.llm.substring_dedup import word_hashes

SHINGLE, LEAST = 5, 0.8
#: With these, two documents of similarity 0.8 meet in some band with probability 0.99995.
BANDS, ROWS = 25, 5
REGISTERS = BANDS * ROWS
#: Members compared with one leader in one task.
CHUNK = 512
#: Points made at once.
AT_ONCE = 1 << 17

_BASE = Powers(0xA0761D6478BD642F)
#: A text with a word.
WORDED = r"[^\x20\x09-\x0D]"
_GOLD, _UPPER, _LOWER = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1B54A32D192ED03), np.uint64(0x8CB92BA72F3D8DD7)


def shingles(text: bytes, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """The multiset of word shingles: hashes in rising order, and how often. Fewer words than that are one shingle."""
    words = word_hashes(text)
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    at = np.arange(max(1, n - size + 1))
    return np.unique(_BASE.spans(_BASE.prefix(words), at, np.minimum(at + size, n)), return_counts=True)


def _drawn(seed: np.ndarray, n: np.ndarray, rate: np.ndarray | float) -> tuple[np.ndarray, np.ndarray]:
    """The n-th point of processes: how long after the one before, and its name."""
    u = mix(seed + n * _GOLD)
    return -np.log(((u >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / rate, mix(u ^ _GOLD)


class _Registers:
    """The earliest points of all bags so far."""

    def __init__(self, bags: int, registers: int):
        self.registers = registers
        self.times, self.names = np.full((bags, registers), np.inf), np.zeros((bags, registers), np.uint64)
        self._time, self._name = self.times.reshape(-1), self.names.reshape(-1)

    def put(self, owner: np.ndarray, when: np.ndarray, point: np.ndarray) -> None:
        register = ((point >> np.uint64(32)) * np.uint64(self.registers)) >> np.uint64(32)
        cell = owner * self.registers + register.astype(np.int64)
        sooner = when < self._time[cell]
        cell, when, point = cell[sooner], when[sooner], point[sooner]
        np.minimum.at(self._time, cell, when)
        first = when == self._time[cell]
        self._name[cell[first]] = point[first]

    def latest(self, owner: np.ndarray) -> np.ndarray:
        """For each owner the time after which no point counts."""
        out = np.zeros(len(self.times))
        live = np.unique(owner)
        out[live] = self.times[live].max(1)
        return out[owner]


def _roots(bags: list[tuple[np.ndarray, np.ndarray]]) -> list[np.ndarray]:
    """The root processes of all elements with their first points: seed, owner, low and width of the interval, weight of the
    element, time, point, number of points drawn."""
    ids = np.concatenate([b[0] for b in bags])
    weights = np.concatenate([b[1] for b in bags]).astype(np.int64)
    owners = np.repeat(np.arange(len(bags)), [len(b[0]) for b in bags])
    parts, low, level = [[np.zeros(0, t) for t in (np.uint64, int, int, int, int, float, np.uint64, np.uint64)]], 0, 0
    while len(has := np.flatnonzero(weights > low)):
        width, one = max(1, low), np.ones(len(has), np.int64)
        seed = mix(ids[has] + np.uint64(level * int(_GOLD) % (1 << 64)))
        time, point = _drawn(seed, one.astype(np.uint64), float(width))
        parts.append([seed, owners[has], low * one, width * one, weights[has], time, point, one.astype(np.uint64)])
        low, level = low + width, level + 1
    return [np.concatenate(x) for x in zip(*parts, strict=True)]


def _halves(seed, owner, low, width, weight, time, point, n) -> list[np.ndarray]:
    """Split processes at their points. Halves that an element's weight doesn't reach are dropped."""
    half = width >> 1
    upper = (point & half.astype(np.uint64)) != 0
    sides = []
    for other in (False, True):
        up = upper ^ other
        own, count = mix(seed ^ np.where(up, _UPPER, _LOWER)), np.full(len(seed), int(other), np.uint64)
        step, mark = _drawn(own, count, half.astype(np.float64)) if other else (0.0, point)
        sides.append((own, owner, low + np.where(up, half, 0), half, weight, time + step, mark, count))
    both = [np.concatenate(x) for x in zip(*sides, strict=True)]
    return [x[both[2] < both[4]] for x in both]


def signatures(bags: list[tuple[np.ndarray, np.ndarray]], registers: int = REGISTERS) -> np.ndarray:
    """A row for each bag: the names of the points that its registers keep, zeros for an empty bag. A name is a hash of the
    element, the process and the point's number; no result of floating-point arithmetic enters it, and times are added up
    in one fixed order, so a bag's row doesn't depend on the others. A point's name also holds its register (the upper 32
    bits) and its place within its root process (the lower ones)."""
    best = _Registers(len(bags), registers)
    live = _roots(bags) if bags else [np.zeros(0)] * 8

    def register(processes: list[np.ndarray]) -> None:
        """The points of those that lie within the weight as a whole."""
        whole = processes[2] + processes[3] <= processes[4]
        best.put(*(processes[i][whole] for i in (1, 5, 6)))

    if len(live[0]):
        register(live)
    while len(live[0]):
        still = live[5] <= best.latest(live[1])
        live = [x[still] for x in live]
        wide = live[3] > 1
        halves = _halves(*(x[wide] for x in live))
        register(halves)
        live = [x[~wide] for x in live]
        seed, owner, _, _, _, time, _, n = live
        k = int(np.clip(AT_ONCE // max(1, len(seed)), 1, 64))
        for at in range(0, len(seed), AT_ONCE):  # the next points of units
            u = slice(at, at + AT_ONCE)
            step, points = _drawn(seed[u, None], n[u, None] + np.arange(1, k + 1, dtype=np.uint64), 1.0)
            when = np.cumsum(np.concatenate([time[u, None], step], 1), 1)[:, 1:]  # one after another, for any k
            best.put(np.repeat(owner[u], k), when.ravel(), points.ravel())
            time[u], n[u] = when[:, -1], n[u] + np.uint64(k)
        live = [np.concatenate(x) for x in zip(live, halves, strict=True)]
    return best.names


def band_keys(names: np.ndarray) -> np.ndarray:
    """BANDS keys for each signature."""
    bits = names.reshape(len(names), BANDS, ROWS)
    key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64) * _GOLD, bits.shape[:2]).copy()
    for r in range(ROWS):
        key = mix(key * _GOLD + bits[:, :, r])
    return key.view(np.int64)


def _sign(batches):
    for batch in batches:
        bags = [shingles(t) for t in binaries(batch.column(3))]
        keys = band_keys(signatures(bags)).ravel()
        sizes = np.array([b[1].sum() for b in bags], np.int64)
        rows = np.flatnonzero(sizes)
        lists = pa.ListArray.from_arrays(
            pa.array(np.arange(len(rows) + 1) * BANDS, pa.int32()), pa.array(keys.reshape(-1, BANDS)[rows].ravel())
        )
        kept = [batch.column(i).take(pa.array(rows)) for i in (0, 1, 2)]
        yield pa.RecordBatch.from_arrays([*kept, pa.array(sizes[rows]), lists], ["doc", "k1", "k2", "size", "keys"])


def similarity_at_least(a: tuple, b: tuple, least: float) -> bool:
    """Whether the multisets' weighted Jaccard similarity is that much."""
    (ids_a, n_a), (ids_b, n_b) = a, b
    if not len(ids_a) or not len(ids_b):
        return False
    at = np.minimum(np.searchsorted(ids_a, ids_b), len(ids_a) - 1)
    both = int(np.minimum(np.where(ids_a[at] == ids_b, n_a[at], 0), n_b).sum())
    return both >= least * (int(n_a.sum()) + int(n_b.sum()) - both) - 1e-9


def _compare(least: float):
    def run(batches):
        leader, bag = None, None
        for batch in batches:
            links = []
            for a, b, text in zip(*(batch.column(i).to_pylist() for i in (0, 2)), binaries(batch.column(3)), strict=True):
                if a == b:
                    if leader != a:
                        leader, bag = a, shingles(text)
                elif similarity_at_least(bag, shingles(text), least):
                    links.append((a, b))
            yield _link_batch(links)

    return run


def _verified(pairs: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """Those of pairs(a, b) that are similar. A leader's text goes once to each chunk of its members, before them."""
    pairs = written(pairs, "pairs")
    number = pairs.groupBy("a").agg(F.ceil(F.count("*") / CHUNK).alias("chunks"))
    chunked = pairs.join(number, "a").withColumn("chunk", F.pmod(F.xxhash64("b"), F.col("chunks")))
    members = chunked.join(texts, F.col("b") == F.col("uid")).select("a", "chunk", "b", "text")
    leaders = number.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1))).join(
        texts, F.col("a") == F.col("uid")
    )
    rows = members.unionByName(leaders.select("a", "chunk", F.col("a").alias("b"), "text"))
    ordered = rows.repartition("a", "chunk").sortWithinPartitions("a", "chunk", F.col("a") != F.col("b"))
    return ordered.mapInArrow(in_slices(_compare(least), 3), "a long, b long")


def _placed(rows: DataFrame, parts: DataFrame, by: str, name: str) -> DataFrame:
    """The component of the text in column ``by``; one without links is its own."""
    of = parts.select(F.col("node").alias("part_node"), F.col("component").alias("part_of"))
    found = rows.join(of, F.col(by) == F.col("part_node"), "left")
    return found.withColumn(name, F.coalesce("part_of", by)).drop("part_node", "part_of")


def _joined(parts: DataFrame, links: DataFrame) -> DataFrame:
    """parts (node, component) with the components joined that further links(a, b) connect. Only the links between
    different components go through the rounds of ``components``."""
    ends = _placed(_placed(links, parts, "a", "part_a"), parts, "b", "part_b")
    between = written(ends.where("part_a <> part_b").select(F.col("part_a").alias("a"), F.col("part_b").alias("b")).distinct(), "links")
    if between.isEmpty():
        return parts
    more = components(between).select(F.col("node").alias("was"), F.col("component").alias("now"))
    every = parts.unionByName(more.select(F.col("was").alias("node"), F.col("was").alias("component"))).distinct()
    moved = every.join(more, F.col("component") == F.col("was"), "left")
    return written(moved.select("node", F.coalesce("now", "component").alias("component")), "parts")


def _compare_blocks(least: float):
    """Links between rows of a unit: texts of two blocks that share a bucket and aren't of one component by then."""

    def links(rows: list[tuple]) -> list[tuple[int, int]]:
        of: dict[int, int] = {}

        def find(x: int) -> int:
            while x in of:
                x = of[x]
            return x

        low = min(r[3] for r in rows)
        high = max(r[3] for r in rows)
        a = [r for r in rows if r[3] == low]
        b = [r for r in rows if r[3] == high]
        width = max(len(r[6]) for r in b)
        keys = np.array([r[6] + [r[6][0]] * (width - len(r[6])) for r in b], np.int64)
        sizes = np.array([r[5] for r in b])
        bags: dict[int, tuple] = {}

        def bag(row: tuple) -> tuple:
            if row[4] not in bags:
                bags[row[4]] = shingles(row[8])
            return bags[row[4]]

        out = []
        for x in a:
            near = np.isin(keys, x[6]).any(1) & (sizes >= least * x[5]) & (least * sizes <= x[5])
            for k in np.flatnonzero(near):
                y = b[k]
                if low == high and y[4] <= x[4]:
                    continue
                one, two = find(x[7]), find(y[7])
                if one != two and similarity_at_least(bag(x), bag(y), least):
                    of[one] = two
                    out.append((x[4], y[4]))
        return out

    def run(batches):
        unit: list[tuple] = []
        for batch in batches:
            found = []
            columns = [c.to_pylist() for c in batch.columns[:-1]] + [binaries(batch.columns[-1])]
            for row in zip(*columns, strict=True):
                if unit and unit[0][:3] != row[:3]:
                    found += links(unit)
                    unit = []
                unit.append(row)
            yield _link_batch(found)
        yield _link_batch(links(unit) if unit else [])

    return run


def _link_batch(links: list[tuple[int, int]]) -> pa.RecordBatch:
    columns = list(zip(*links, strict=True)) or [[], []]
    return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns], ["a", "b"])


def _blockwise(mixed: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """Links between texts of different components that share a bucket; mixed(key, uid, size, leader, part): the members of
    buckets with several components.

    Buckets that share texts form a field. A field's texts are dealt to blocks by hash, and every two blocks of a field meet
    in a unit of about 2 * CHUNK texts at most, where pairs are compared until their components are linked."""
    edges = mixed.where("leader <> uid").select(F.col("leader").alias("a"), F.col("uid").alias("b")).distinct()
    nearest = edges.groupBy("b").agg(F.min("a").alias("parent")).select(F.col("b").alias("node"), "parent")
    fields = _joined(roots(nearest), edges)
    rows = mixed.groupBy("uid").agg(
        F.first("size").alias("size"), F.first("part").alias("part"), F.collect_set("key").alias("keys")
    )
    rows = written(_placed(rows, fields, "uid", "field"), "fields")
    sizes = written(rows.groupBy("field").agg(F.ceil(F.count("*") / CHUNK).alias("blocks")), "field-sizes")
    rows = rows.join(sizes, "field").withColumn("block", F.pmod(F.xxhash64("uid"), F.col("blocks")))
    units = rows.join(texts, "uid").withColumn("other", F.explode(F.expr("sequence(0L, blocks - 1)")))
    units = units.select(
        "field",
        F.least("block", "other").alias("one"),
        F.greatest("block", "other").alias("two"),
        *("block", "uid", "size", "keys", "part", "text"),
    )
    ordered = units.repartition("field", "one", "two").sortWithinPartitions("field", "one", "two", "uid")
    return ordered.mapInArrow(in_slices(_compare_blocks(least), 8), "a long, b long")


def near_duplicates(documents: DataFrame, least: float = LEAST) -> DataFrame:
    """Classes of near-duplicates: texts that a chain of pairs of weighted Jaccard similarity ``least`` or more connects.

    documents(doc_id, text); further columns are ignored. A row for each row given: doc_id, class_id (the least doc_id
    of its class), is_kept (doc_id is the class_id), k1 and k2 (128 bits that tell texts apart). The similarity is that of
    the multisets of five-word shingles, words being separated by white space; fewer words are one shingle. Equal texts
    are of one class, and repeated rows too. Null texts, and texts without words, are like no other: their class is their
    own. A null doc_id counts as larger than all others and stays null. Texts of any length are signed and compared whole.
    An empty table gives no rows.

    Equal texts are merged first. Each text is compared with the least one of all its buckets, then with the least one
    of each bucket where that is still in another component, then with the members of its buckets that are, block by
    block, until they are linked. So every link between texts that share a bucket counts, without rows for all pairs.
    Buckets, classes and fields are counted by partial sums and joined back, so a large one is no task's alone.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    key = ["k1", "k2"]
    docs = documents.select(
        F.col("doc_id").cast("long").alias("doc"), *row_keys(F.lit(0), text), text.alias("text"), text.rlike(WORDED).alias("worded")
    )
    signed = docs.select("doc", *key, "text").mapInArrow(
        in_slices(_sign, 3), "doc long, k1 long, k2 long, size long, keys array<long>"
    )
    unique = signed.groupBy(*key).agg(
        F.min(F.coalesce("doc", F.lit(NO_ID))).alias("doc"), F.first("size").alias("size"), F.first("keys").alias("keys")
    )
    unique = written(unique.withColumn("uid", F.monotonically_increasing_id()), "signed")  # numbered once, so for good
    exploded = unique.select("uid", "size", F.explode("keys").alias("key"))
    buckets = exploded.groupBy("key").agg(F.min("uid").alias("leader"), F.max("uid").alias("last")).where("leader < last")
    members = written(exploded.join(written(buckets.drop("last"), "buckets"), "key"), "members")
    wanted = unique.join(members.select("uid").distinct(), "uid").select("uid", "doc", *key)
    rows = docs.select(F.coalesce("doc", F.lit(NO_ID)).alias("doc"), *key, "text")
    texts = written(rows.join(wanted, ["doc", *key]).select("uid", "text").dropDuplicates(["uid"]), "texts")

    near = members.groupBy("uid").agg(F.min("leader").alias("a")).where("a <> uid").select("a", F.col("uid").alias("b"))
    near = written(near, "pairs")
    links = written(_verified(near, texts, least), "links")
    parts = roots(links.select(F.col("b").alias("node"), F.col("a").alias("parent")))  # a < b, and one a for each b
    apart = _placed(_placed(members, parts, "uid", "part"), parts, "leader", "leader_part").where("part <> leader_part")
    stars = apart.select(F.col("leader").alias("a"), F.col("uid").alias("b")).distinct().join(near, ["a", "b"], "left_anti")
    parts = _joined(parts, _verified(stars, texts, least))
    placed = written(_placed(members, parts, "uid", "part"), "placed")
    several = placed.groupBy("key").agg(F.min("part").alias("low"), F.max("part").alias("high")).where("low < high")
    mixed = written(placed.join(written(several.select("key"), "mixed-keys"), "key"), "mixed")
    found = _joined(parts, _blockwise(mixed, texts, least))
    of_text = _placed(unique.select(*key, "uid"), found, "uid", "component").select(*key, "component")
    placed = written(docs.select("doc", *key, "worded").join(written(of_text, "parts"), key, "left"), "classes")
    heads = placed.where("worded").groupBy("component").agg(F.min(F.coalesce("doc", F.lit(NO_ID))).alias("head"))
    head = F.when(F.col("worded"), F.nullif("head", F.lit(NO_ID))).otherwise(F.col("doc"))
    return placed.join(written(heads, "heads"), "component", "left").select(
        F.col("doc").alias("doc_id"), head.alias("class_id"), F.col("doc").eqNullSafe(head).alias("is_kept"), *key
    )


def one_of_each(documents: DataFrame) -> DataFrame:
    """The rows of documents that are kept, columns as they came. Of rows alike in doc_id and text one is kept, if they
    have words."""
    doc, k1, k2, n = (fresh(documents, name) for name in ("kept_doc", "kept_k1", "kept_k2", "kept_rows"))
    found = near_duplicates(documents).where("is_kept")
    found = found.groupBy(F.col("doc_id").alias(doc), F.col("k1").alias(k1), F.col("k2").alias(k2)).agg(F.count("*").alias(n))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    own = row_keys(F.lit(0), text)
    same = F.col("doc_id").cast("long").eqNullSafe(F.col(doc)) & (own[0] == F.col(k1)) & (own[1] == F.col(k2))
    kept = documents.join(found, same)
    again = (F.col(n) > 1) & text.rlike(WORDED)
    once = kept.where(~again).select(*documents.columns)
    return once.unionByName(kept.where(again).dropDuplicates([doc, k1, k2]).select(*documents.columns))
