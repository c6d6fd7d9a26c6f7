"""Repeats of a fixed length across documents, found on winnowed anchors: what two operators share.

A document is a sequence of units (bytes or words). Of every ``length`` consecutive units, winnowing picks the
``gram`` units with the least hash as an anchor, wherever that window stands. So two equal windows have equal anchors at
the same place within, and only anchors whose hash is there twice can lie in a repeat. With an anchor goes the hash of
its context, all units that a window around it may reach: equal contexts need no look at the texts, they are repeats
throughout. Of the rest, one place for each context is cut out of its text, and ``settle`` of an operator finds the
repeats among the contexts of an anchor.

Rows that travel: an anchor's hash, its context's hash, document, key of the row (128 bits), position. They are dealt by the anchor's hash and
sorted, and each task passes over them as a stream, whatever their number. Texts move twice, once to cut out contexts
and once for the result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestar.llm.common import Powers, binaries, in_slices, lists, row_keys, written

#: A document without an id is larger than all others.
NO_ID = (1 << 63) - 1

#: Different contexts of one anchor that are compared in one task as they are; beyond, they are dealt further.
HOT_CONTEXTS = 5_000
RANGES = 8
#: Contexts given on at once.
_CONTEXTS_AT_ONCE = 10_000

#: What tells the rows of documents apart.
ROW = ("k1", "k2")
_KEY = "k1 long, k2 long"
_ANCHORS = f"h long, c long, doc long, {_KEY}, pos int, step int, times int"
_CONTEXTS = f"h long, c long, doc long, {_KEY}, pos int, more int, lead int, context binary"
_SPANS = f"{_KEY}, begin int, finish int"


@dataclass(frozen=True)
class Kind:
    """What an operator calls a repeat."""

    length: int  #: units in a window
    gram: int  #: units in an anchor
    units: Callable[[bytes], np.ndarray]  #: numbers for the units of a text
    cut: Callable[[np.ndarray, int, int], bytes]  #: units as bytes, to travel
    smaller_only: bool  #: a repeat counts if the window is in a smaller document; else if it is anywhere else
    #: (contexts of one anchor as (context's hash, document, lead, bytes)) -> for each, flagged spans from its start
    settle: Callable[[list[tuple[int, int, int, bytes]]], list[list[tuple[int, int]]]]

    @property
    def window(self) -> int:
        """Places for an anchor within a repeat."""
        return self.length - self.gram + 1


_BASE_1, _BASE_2 = Powers(0x9E3779B97F4A7C15), Powers(0xD6E8FEB86659FD93)


def _least(x: np.ndarray, w: int, pick=np.minimum) -> np.ndarray:
    """Least (or greatest) of each w consecutive values."""
    size, n = 1, len(x)
    while size * 2 <= w:
        x = pick(x[:-size], x[size:])
        size *= 2
    rest = n - w + 1
    return pick(x[:rest], x[w - size : w - size + rest])


def anchors(units: np.ndarray, kind: Kind) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions, hashes, and hashes of contexts of the anchors of one document."""
    n, k, w = len(units), kind.gram, kind.window
    if n < kind.length:
        empty = np.zeros(0, np.int64)
        return empty, empty, empty
    sums = _BASE_1.prefix(units)
    at = np.arange(n - k + 1)
    h = _BASE_1.spans(sums, at, at + k)
    least = _least(h, w)
    # a value is an anchor if it is the least of some window that holds it
    padded = np.concatenate([np.zeros(w - 1, np.uint64), least, np.zeros(w - 1, np.uint64)])
    pos = np.flatnonzero(h == _least(padded, w, np.maximum))
    start, end = np.maximum(pos - (w - 1), 0), np.minimum(pos + kind.length, n)
    c = _BASE_2.spans(_BASE_2.prefix(units), start, end) ^ (pos - start).astype(np.uint64)
    return pos, h[pos].view(np.int64), c.view(np.int64)


def _rows(pos: np.ndarray, h: np.ndarray, c: np.ndarray, w: int) -> tuple[np.ndarray, ...]:
    """One row for anchors of a document that are alike, context and all, and lie evenly at short steps, as in periodic
    text: the first position, and the step and number of them."""
    if len(np.unique(h)) == len(h):
        return pos, h, c, np.zeros(len(h)), np.ones(len(h))
    order = np.lexsort((pos, c, h))
    pos, h, c = pos[order], h[order], c[order]
    gap = np.diff(pos)
    same = (h[1:] == h[:-1]) & (c[1:] == c[:-1]) & (gap <= w)
    new = np.concatenate([[True], ~same])
    new[2:] |= same[1:] & same[:-1] & (gap[1:] != gap[:-1])
    first = np.flatnonzero(new)
    times = np.diff(np.append(first, len(pos)))
    step = np.where(times > 1, pos[np.minimum(first + 1, len(pos) - 1)] - pos[first], 0)
    return pos[first], h[first], c[first], step, times


def _find(kind: Kind):
    def run(batches):
        for batch in batches:
            parts = []
            keys = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)]
            for *row, text in zip(*keys, binaries(batch.column(3)), strict=True):
                pos, h, c = anchors(kind.units(text), kind)
                if len(pos):
                    pos, h, c, step, times = _rows(pos, h, c, kind.window)
                    numbers = (x.astype(np.int32) for x in (pos, step, times))
                    parts.append((h, c, *(np.full(len(pos), x) for x in row), *numbers))
            if parts:
                columns = [np.concatenate(x) for x in zip(*parts, strict=True)]
                names = ["h", "c", "doc", *ROW, "pos", "step", "times"]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names)

    return in_slices(run, 3)


def _repeated(found: DataFrame, kind: Kind) -> DataFrame:
    """The anchors whose hash is there twice. ``full``: the whole context is a repeat. ``cut``: the context has to be
    compared with the different ones of its anchor; ``n_cut``: how many those are."""
    by_h, by_c = Window.partitionBy("h"), Window.partitionBy("h", "c")
    rows = found.select(
        "*",
        F.min("c").over(by_h).alias("low"),
        F.max("c").over(by_h).alias("high"),
        F.sum("times").over(by_c).alias("n"),
        F.min("doc").over(by_c).alias("first"),
        F.row_number().over(by_c.orderBy("doc", *ROW, "pos")).alias("nth"),
    ).where("low < high or n > 1")
    if kind.smaller_only:
        full, cut = F.col("doc") > F.col("first"), F.col("doc") == F.col("first")
    else:
        full, cut = F.col("n") > 1, F.col("nth") == 1
    more = (F.col("step") * (F.col("times") - 1)).alias("more")
    cut = (cut & (F.col("low") < F.col("high"))).alias("cut")
    rows = rows.select("h", "c", "doc", *ROW, "pos", more, full.alias("full"), cut)
    return rows.where("full or cut").withColumn("n_cut", F.sum(F.col("cut").cast("long")).over(by_h))


def _cut(kind: Kind, hot: int):
    """Cut contexts out of texts. Those of a hot anchor are dealt further: windows are told apart by how far before
    the anchor they begin, in RANGES ranges, and by the units that all windows of such a range have in common."""
    w, length = kind.window, kind.length
    step = -(-w // RANGES)

    def pieces(units: np.ndarray, pos: int, h: int, n_cut: int) -> Iterator[tuple[int, int, int]]:
        n = len(units)
        if n_cut <= hot:
            yield h, max(0, pos - w + 1), min(n, pos + length)
            return
        for low in range(0, w, step):
            high = min(low + step, w)  # windows that begin ``low`` to ``high - 1`` units before the anchor
            if max(low, pos + length - n) < min(high, pos + 1):
                core = kind.cut(units, pos - low, pos + length - high + 1)
                key = xxhash.xxh64_intdigest(core, (h ^ low) & NO_ID) - (1 << 63)
                yield key, max(0, pos - high + 1), min(n, pos + length - low)

    def run(batches):
        for batch in batches:
            rows = []
            keys = [batch.column(i).to_pylist() for i in range(3)]
            ends, places = lists(batch.column(4))
            wanted = [x.to_numpy(zero_copy_only=False) for x in places.flatten()]
            for k, (*row, text) in enumerate(zip(*keys, binaries(batch.column(3)), strict=True)):
                units = kind.units(text)
                for h, c, pos, more, n_cut in zip(*(x[ends[k] : ends[k + 1]].tolist() for x in wanted), strict=True):
                    for key, start, end in pieces(units, pos, h, n_cut):
                        rows.append((key, c, *row, pos, more, pos - start, kind.cut(units, start, end)))
                if len(rows) >= _CONTEXTS_AT_ONCE:
                    yield _context_batch(rows)
                    rows = []
            yield _context_batch(rows)

    return in_slices(run, 3)


def _context_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [*[pa.int64()] * 5, *[pa.int32()] * 3, pa.binary()]
    columns = list(zip(*rows, strict=True)) or [[]] * len(kinds)
    arrays = [pa.array(x, k) for x, k in zip(columns, kinds, strict=True)]
    return pa.RecordBatch.from_arrays(arrays, ["h", "c", "doc", *ROW, "pos", "more", "lead", "context"])


def _settle(kind: Kind):
    def spans(group: list[tuple]) -> Iterator[tuple]:
        if len(group) > 1:
            found = kind.settle([(c, doc, lead, context) for _, c, doc, *_, lead, context in group])
            for (_, _, _, k1, k2, pos, more, lead, _), flagged in zip(group, found, strict=True):
                for begin, finish in flagged:
                    yield k1, k2, pos - lead + begin, pos - lead + finish + more

    def run(batches):
        group: list[tuple] = []
        for batch in batches:
            out = []
            for row in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if group and group[0][0] != row[0]:
                    out += spans(group)
                    group = []
                group.append(row)
            yield _span_batch(out)
        yield _span_batch(list(spans(group)))

    return in_slices(run, 8)


def _span_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32()]
    columns = list(zip(*rows, strict=True)) or [[]] * 4
    arrays = [pa.array(x, k) for x, k in zip(columns, kinds, strict=True)]
    return pa.RecordBatch.from_arrays(arrays, [*ROW, "begin", "finish"])


def keyed(documents: DataFrame, *more: str) -> DataFrame:
    """doc (NO_ID for null), k1 and k2 (of doc and text), text, and further columns. Rows alike in doc and text are alike."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    doc = F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID))
    return documents.select(doc.alias("doc"), *row_keys(doc, text), text.alias("text"), *more)


def repeats(documents: DataFrame, kind: Kind, hot: int = HOT_CONTEXTS) -> DataFrame:
    """k1, k2, spans: for each document with repeats, the flagged spans of its units (they may overlap, and the last
    may reach beyond the end). An anchor with more than ``hot`` different contexts is dealt to several tasks."""
    docs = keyed(documents)
    found = docs.mapInArrow(_find(kind), _ANCHORS)
    places = written(_repeated(found, kind), "places")
    wanted = (
        places.where("cut")
        .groupBy(*ROW)
        .agg(F.collect_set(F.struct("h", "c", "pos", "more", "n_cut")).alias("places"))
    )
    texts = docs.join(wanted, [*ROW]).select("doc", *ROW, "text", "places")
    contexts = texts.mapInArrow(_cut(kind, hot), _CONTEXTS)
    settled = contexts.repartition("h").sortWithinPartitions("h", "doc", *ROW, "pos").mapInArrow(_settle(kind), _SPANS)
    throughout = places.where("full").select(
        *ROW,
        F.greatest(F.col("pos") - F.lit(kind.window - 1), F.lit(0)).alias("begin"),
        (F.col("pos") + F.col("more") + F.lit(kind.length)).alias("finish"),
    )
    return (
        throughout.unionByName(settled)
        .groupBy(*ROW)
        .agg(F.collect_set(F.struct("begin", "finish")).alias("spans"))
    )


def spans_of(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The begins and the ends of each row's spans."""
    ends, spans = lists(column)
    begin, finish = (x.to_numpy(zero_copy_only=False) for x in spans.flatten())
    for a, b in zip(ends, ends[1:], strict=False):
        yield begin[a:b], finish[a:b]


def kept(n: int, begin: np.ndarray, finish: np.ndarray) -> np.ndarray:
    """Which of n units no span covers."""
    change = np.zeros(n + 1, np.int32)
    np.add.at(change, begin, 1)
    np.add.at(change, np.minimum(finish, n), -1)
    return np.cumsum(change[:n]) == 0


def common_start(a: bytes, b: bytes) -> int:
    """How many bytes two strings begin with alike."""
    n = min(len(a), len(b))
    x = int.from_bytes(a[:n], "big") ^ int.from_bytes(b[:n], "big")
    return n - (x.bit_length() + 7) // 8
