"""Media columns: cropped or edited copies of images, found by local descriptors.

Each image gives corners at several scales; around each, the direction of the intensity's centroid turns a fixed set of
brightness comparisons into a 256-bit descriptor that keeps still under rotation. Descriptors meet in hash tables, each on
some of their bits (two that differ in few bits agree in some table); those that meet within the Hamming distance vote, and
images match if enough of their votes, and more than by chance, agree on one similarity transform.

The queries go in blocks of a bounded number of descriptors. Each task makes the tables of a block and streams its images
past them, so neither descriptors nor table entries are shuffled, and a descriptor that many images have is many rows of
many tasks, not one task's.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm.common import binaries, in_slices, lists, mix, row_keys, written

BITS, TABLES, KEY_BITS = 256, 24, 32
#: The least strength of a corner: some ten times what noise of a deviation of two grey values gives. All corners above it
#: are described, so there are more the larger an image is. Of corners within RIVALS pixels, the strongest counts.
STRENGTH, RIVALS = 5.0, 4
SCALES = (1.0, 1.26, 1.59, 2.0)
PATCH = 12
#: Two descriptors match up to this Hamming distance; two images from this many agreeing matches.
DISTANCE, AGREE = 36, 4
#: Matches that agree on a transform turn by the same angle, give or take this.
TURN = 0.5
#: More matches agree by chance the more there are: an unrelated pair may be linked with this probability at most.
CHANCE = 0.01
#: Descriptors of queries in a block; more of them make more passes over the index.
BLOCK = 1 << 18
#: Corners described at once; transforms tried at once; meetings looked at once.
_CORNERS, _TRIALS, _MEETINGS = 2000, 128, 1 << 20

_RNG = np.random.default_rng(20)
_PAIRS = np.clip(np.round(_RNG.normal(0, PATCH / 2.5, (BITS, 4))), -PATCH, PATCH)
#: For each table, which bits count, and an odd multiplier for each of the four words.
_MASKS = np.stack([np.packbits(np.isin(np.arange(BITS), _RNG.choice(BITS, KEY_BITS, replace=False))).view(np.uint64) for _ in range(TABLES)])
_ODD = _RNG.integers(0, 1 << 63, (TABLES, BITS // 64), np.uint64) * np.uint64(2) + np.uint64(1)
_SPAN = np.arange(-PATCH, PATCH + 1)
_DISC = (_SPAN[:, None] ** 2 + _SPAN**2 <= (PATCH + 0.5) ** 2).astype(float)

_DESCRIBED = "image_id long, places array<float>, bits binary"


def decode(data: bytes | None) -> np.ndarray | None:
    """Grey values of a binary PGM (P5) or PPM (P6) of 8 bits; None for null and for anything else."""
    if not data or data[:2] not in (b"P5", b"P6"):
        return None
    numbers, at = [], 2
    while len(numbers) < 3:
        while at < len(data) and data[at : at + 1].isspace():
            at += 1
        if data[at : at + 1] == b"#":
            at = data.find(b"\n", at) + 1
            if not at:
                return None
            continue
        end = at
        while end - at < 10 and data[end : end + 1].isdigit():
            end += 1
        if end == at or end - at == 10:  # no image is that large
            return None
        numbers.append(int(data[at:end]))
        at = end
    width, height, top = numbers
    depth = 3 if data[1:2] == b"6" else 1
    pixels = np.frombuffer(data, np.uint8, offset=min(at + 1, len(data)))
    if top > 255 or len(pixels) < width * height * depth:
        return None
    grey = pixels[: width * height * depth].reshape(height, width, depth).astype(np.float32)
    return grey.mean(2) if depth == 3 else grey[:, :, 0]


def encode_pgm(grey: np.ndarray) -> bytes:
    h, w = grey.shape
    return f"P5 {w} {h} 255\n".encode() + np.clip(np.round(grey), 0, 255).astype(np.uint8).tobytes()


def resized(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """Bilinear."""
    h, w = image.shape
    y = np.clip((np.arange(height) + 0.5) * h / height - 0.5, 0, h - 1)
    x = np.clip((np.arange(width) + 0.5) * w / width - 0.5, 0, w - 1)
    y0, x0 = np.minimum(y.astype(int), max(h - 2, 0)), np.minimum(x.astype(int), max(w - 2, 0))
    y1, x1 = np.minimum(y0 + 1, h - 1), np.minimum(x0 + 1, w - 1)
    fy, fx = (y - y0)[:, None], (x - x0)[None]
    top = image[y0][:, x0] * (1 - fx) + image[y0][:, x1] * fx
    return top * (1 - fy) + (image[y1][:, x0] * (1 - fx) + image[y1][:, x1] * fx) * fy


def _smooth(image: np.ndarray, rounds: int = 1) -> np.ndarray:
    for _ in range(rounds):
        p = np.pad(image, 1, "edge")
        p = (p[:-2] + 2 * p[1:-1] + p[2:]) / 4
        image = (p[:, :-2] + 2 * p[:, 1:-1] + p[:, 2:]) / 4
    return image


def describe(image: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Corners (x, y, scale, angle) in pixels of the image, and descriptors as rows of bits."""
    found = []
    for scale in SCALES:
        h, w = (int(round(n / scale)) for n in image.shape)
        if min(h, w) < 2 * PATCH:
            continue
        level = _smooth(resized(image, h, w))
        gy, gx = np.gradient(level)
        level = _smooth(level, 3)
        a, b, c = (_smooth(t, 2) for t in (gx * gx, gx * gy, gy * gy))
        strength = a * c - b * b - 0.05 * (a + c) ** 2
        inner = strength.copy()
        edge = 4
        inner[:edge] = inner[-edge:] = 0
        inner[:, :edge] = inner[:, -edge:] = 0
        peak = np.pad(inner, RIVALS)
        peak = np.max([peak[i : i + h] for i in range(2 * RIVALS + 1)], axis=0)
        peak = np.max([peak[:, j : j + w] for j in range(2 * RIVALS + 1)], axis=0)
        y, x = np.nonzero((inner == peak) & (inner > STRENGTH))
        for at in range(0, len(y), _CORNERS):
            i, j = y[at : at + _CORNERS], x[at : at + _CORNERS]
            found.append((inner[i, j], *_at_corners(level, i, j, scale)))
    if not found:
        return np.zeros((0, 4)), np.zeros((0, BITS), bool)
    strength, places, bits = (np.concatenate(f) for f in zip(*found, strict=True))
    order = np.lexsort((places[:, 0], places[:, 1], places[:, 2], -strength))
    return places[order], bits[order]


def _at_corners(level: np.ndarray, i: np.ndarray, j: np.ndarray, scale: float) -> tuple[np.ndarray, np.ndarray]:
    """Places and bits of corners. The direction is that of the centroid of a disc, whose plain mean counts for nothing."""
    h, w = level.shape
    rows, columns = np.clip(i[:, None] + _SPAN, 0, h - 1), np.clip(j[:, None] + _SPAN, 0, w - 1)
    part = level[rows[:, :, None], columns[:, None, :]] * _DISC
    angle = np.arctan2(part.sum(2) @ _SPAN, part.sum(1) @ _SPAN)
    co, si = np.cos(angle)[:, None, None], np.sin(angle)[:, None, None]
    x = _PAIRS[:, (0, 2)] * co - _PAIRS[:, (1, 3)] * si
    y = _PAIRS[:, (0, 2)] * si + _PAIRS[:, (1, 3)] * co
    y = np.clip(np.round(i[:, None, None] + y), 0, h - 1).astype(int)
    v = level[y, np.clip(np.round(j[:, None, None] + x), 0, w - 1).astype(int)]
    places = np.stack([(j + 0.5) * scale, (i + 0.5) * scale, np.full(len(i), scale), angle], 1)
    return places, v[:, :, 0] < v[:, :, 1]


def _rounded(places: np.ndarray) -> np.ndarray:
    """Places to a sixteenth of a pixel and angles to a 64th: few different numbers take little room in Parquet."""
    return (np.round(places * [16, 16, 100, 64]) / [16, 16, 100, 64]).astype(np.float32)


def _describe(batches):
    for batch in batches:
        ids, places, bits = [], [], []
        for image_id, data in zip(batch.column(0).to_pylist(), binaries(batch.column(1)), strict=True):
            image = decode(data)
            if image is not None and min(image.shape) >= 2 * PATCH:
                p, b = describe(image)
                if len(p):
                    ids.append(image_id)
                    places.append(_rounded(p).ravel())
                    bits.append(np.packbits(b, axis=1).tobytes())
        columns = [pa.array(ids, pa.int64()), pa.array(places, pa.list_(pa.float32())), pa.array(bits, pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, ["image_id", "places", "bits"])


def descriptors(images: DataFrame) -> DataFrame:
    """A row for each of images(image_id, media) that has corners: image_id, places (x, y, scale, angle of each corner), bits
    (32 bytes for each corner)."""
    rows = images.select(F.col("image_id").cast("long"), F.col("media").cast("binary"))
    return rows.where("image_id is not null and media is not null").mapInArrow(in_slices(_describe, 1), _DESCRIBED)


def table_keys(words: np.ndarray, table: int) -> np.ndarray:
    """A hash of those bits of each descriptor (rows of four words) that a table looks at."""
    return mix(((words & _MASKS[table]) * _ODD[table]).sum(1, dtype=np.uint64))


class Tables:
    """The Hamming tables of a block of query descriptors: for each table the different keys in order, where the descriptors of
    each stand, and a bit for each value of the keys' upper bits, so that most that aren't there are known at once."""

    UPPER = 22

    def __init__(self, words: np.ndarray):
        self.words = words
        self.tables = []
        for t in range(TABLES):
            keys = table_keys(words, t)
            order = np.argsort(keys, kind="stable")
            there = np.zeros(1 << (self.UPPER - 6), np.uint64)
            at = keys >> np.uint64(64 - self.UPPER)
            np.bitwise_or.at(there, (at >> np.uint64(6)).astype(np.int64), np.uint64(1) << (at & np.uint64(63)))
            different, starts, times = np.unique(keys[order], return_index=True, return_counts=True)
            self.tables.append((different, *(x.astype(np.int32) for x in (starts, times, order)), there))

    def near(self, words: np.ndarray, distance: int) -> np.ndarray:
        """Pairs (number of a query descriptor, row of ``words``) that meet in a table and are within the distance, once each."""
        found = [np.zeros(0, np.int64)]
        for t, (ordered, starts, times, order, there) in enumerate(self.tables):
            keys = table_keys(words, t)
            at = keys >> np.uint64(64 - self.UPPER)
            rows = np.flatnonzero((there[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1))
            at = np.minimum(np.searchsorted(ordered, keys[rows]), max(0, len(ordered) - 1))
            met = ordered[at] == keys[rows] if len(ordered) else np.zeros(0, bool)
            rows, first, n = rows[met], starts[at[met]], times[at[met]]
            done = np.cumsum(n, dtype=np.int64)
            begin = 0
            while begin < len(rows):  # a part of the rows, so that meetings at once are bounded
                end = max(begin + 1, int(np.searchsorted(done, (done[begin - 1] if begin else 0) + _MEETINGS, "right")))
                k = n[begin:end].astype(np.int64)
                inside = np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k)
                mine, theirs = np.repeat(rows[begin:end], k), order[np.repeat(first[begin:end], k) + inside]
                close = np.bitwise_count(self.words[theirs] ^ words[mine]).sum(1) <= distance
                found.append(theirs[close].astype(np.int64) * len(words) + mine[close])
                begin = end
        return np.stack(np.divmod(np.unique(np.concatenate(found)), max(1, len(words))), 1)


def _distinct(places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order of the places that has equal ones together, and where each of them starts."""
    which = np.unique(np.round(places), axis=0, return_inverse=True)[1].ravel()
    order = np.argsort(which, kind="stable")
    return order, np.flatnonzero(np.diff(which[order], prepend=-1))


def agreeing(matches: np.ndarray) -> int:
    """How many of the matches (x, y, scale, angle of one side, then of the other) agree on one similarity transform: the
    most that any single match's own transform brings near to their places and turns alike, those at the same place
    counted once."""
    a, b = matches[:, :4], matches[:, 4:]
    factor, turn = b[:, 2] / a[:, 2], b[:, 3] - a[:, 3]
    reach = _reach(b)
    sides = [_distinct(side[:, :2]) for side in (a, b)]
    best = 0
    for at in range(0, len(a), _TRIALS):
        own = slice(at, at + _TRIALS)
        dx, dy = (a[None, :, k] - a[own, None, k] for k in (0, 1))
        co, si = np.cos(turn[own])[:, None], np.sin(turn[own])[:, None]
        along, across = co * dx - si * dy, si * dx + co * dy
        alike = np.cos(turn[own, None] - turn[None]) >= math.cos(TURN)
        for f in (factor[own], factor[own] * 0.89, factor[own] * 1.12):
            x = b[own, None, 0] + f[:, None] * along - b[None, :, 0]
            y = b[own, None, 1] + f[:, None] * across - b[None, :, 1]
            near = alike & (x * x + y * y <= reach * reach)
            near = near[near.sum(1) > best]  # no more than that can count
            if len(near):
                places = (np.logical_or.reduceat(near[:, order], starts, axis=1).sum(1) for order, starts in sides)
                best = max(best, int(np.minimum(*places).max()))
    return best


def _reach(b: np.ndarray) -> np.ndarray:
    return 3.0 * np.maximum(1.0, b[:, 2])


def by_chance(matches: np.ndarray) -> int:
    """How many of the matches may agree by chance. A transform that means nothing spreads the matches as their places
    are spread at most, so it brings one near to its place as often as places lie within its reach of each other; the number
    of places so met is about Poisson, whose tail (Chernoff's bound) must be under CHANCE for all the transforms tried."""
    b = matches[:, 4:]
    order, starts = _distinct(b[:, :2])
    places, reach = b[order[starts], :2], _reach(b)[order[starts]]
    weight = np.diff(starts, append=len(b))
    mean = 0.0
    for at in range(0, len(places), _TRIALS):
        own = slice(at, at + _TRIALS)
        apart = ((places[own, None] - places[None]) ** 2).sum(2)
        share = (apart <= reach[own, None] ** 2) @ weight / len(b)
        mean += float(np.minimum(1.0, weight[own] * share).sum())
    return _unlikely(mean, len(b))


def _unlikely(mean: float, matches: int) -> int:
    """The least number that a Poisson variable of this mean reaches in one of the transforms tried with a probability of
    CHANCE at most."""
    wanted = math.log(3 * matches / CHANCE)
    n = math.ceil(mean)
    while n * math.log(n / mean) - n + mean < wanted:
        n += 1
    return n  # and the match that gave the transform agrees with itself


#: Fewer matches than this are never more than chance gives, as a match lies within its own reach: a mean of 1.
LEAST_MATCHES = next(n for n in range(1, 100) if n > _unlikely(1.0, n))


def enough_turned_alike(unit: np.ndarray, turn: np.ndarray, least: int) -> np.ndarray:
    """Which of the matches are of units in which some match has ``least`` that turn as it does: in other units no more can
    agree. ``unit`` is sorted."""
    full = 2 * math.pi
    turn = np.mod(turn, full)
    wide = 2 * full  # units lie this far apart on one line, and each match three times on the circle
    base = np.cumsum(np.diff(unit, prepend=unit[:1]) > 0) * (2 * wide)
    line = np.sort(np.concatenate([base + turn, base + turn - full, base + turn + full]))
    n = np.searchsorted(line, base + turn + TURN, "right") - np.searchsorted(line, base + turn - TURN, "left")
    good = np.unique(unit[n >= least])
    return np.isin(unit, good)


def matched(places_1: np.ndarray, places_2: np.ndarray, pairs: np.ndarray) -> np.ndarray:
    """The places of pairs (row of one, row of the other) side by side, equal ones once."""
    return np.unique(np.concatenate([places_1[pairs[:, 0]], places_2[pairs[:, 1]]], 1), axis=0)


def agreed(matches: np.ndarray, agree: int = AGREE) -> int:
    """How many matches agree, if that is enough and more than by chance; else 0."""
    n = agreeing(matches) if len(matches) >= agree else 0
    return n if n >= agree and n > by_chance(matches) else 0


def _arrays(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a batch(image_id, places, bits): ids, and for each descriptor the row it is of, its place, its words."""
    places = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, 4).astype(np.float64)
    data = batch.column(2).to_pylist()
    words = np.frombuffer(b"".join(data), np.uint64).reshape(-1, BITS // 64)
    of = np.repeat(np.arange(len(data)), [len(x) // (BITS // 8) for x in data])
    return batch.column(0).to_numpy(), of, places, words


_made: dict[tuple, Tables] = {}


def _tables(block) -> Tables:
    """Made once in each Python worker; only the last is kept."""
    key = (block.id if hasattr(block, "id") else id(block), getattr(block, "_path", None))
    if key not in _made:
        _made.clear()
        _made[key] = Tables(block.value[3])
    return _made[key]


def _join(block, distance: int, agree: int):
    def run(batches):
        tables = _tables(block)
        asked, asked_of, asked_places, _ = block.value
        for batch in batches:
            ids, of, places, words = _arrays(batch)
            pairs = tables.near(words, distance)
            unit = of[pairs[:, 1]] * len(asked) + asked_of[pairs[:, 0]]  # a unit for each query and image
            order = np.argsort(unit, kind="stable")
            pairs, unit = pairs[order], unit[order]
            turn = places[pairs[:, 1], 3] - asked_places[pairs[:, 0], 3]
            some = enough_turned_alike(unit, turn, max(agree, LEAST_MATCHES))
            pairs, unit = pairs[some], unit[some]
            edges = np.append(np.flatnonzero(np.diff(unit, prepend=-1)), len(unit))
            out = []
            for a, b in zip(edges, edges[1:], strict=False):
                if b - a >= agree:
                    n = agreed(matched(asked_places, places, pairs[a:b]), agree)
                    if n:
                        image, query = divmod(int(unit[a]), len(asked))
                        out.append((asked[query], ids[image], n))
            columns = list(zip(*out, strict=True)) or [[]] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["query_id", "image_id", "agreeing"])

    return in_slices(run, 2)


def links_between(asked: DataFrame, index: DataFrame, distance: int, agree: int, block: int = BLOCK) -> DataFrame:
    """query_id, image_id, agreeing of two tables of descriptors: a pass over the index for each block of queries. What a pass
    finds is written, and its block goes from the executors."""
    spark = index.sparkSession
    total = asked.agg(F.coalesce(F.sum(F.octet_length("bits")), F.lit(0))).first()[0] // (BITS // 8)
    parts = 1 + total // block
    part = F.pmod(F.xxhash64("image_id", "bits"), F.lit(parts))
    found = None
    for k in range(parts):
        got = asked.where(part == k).select("image_id", "places", "bits").toArrow().combine_chunks()
        if not got.num_rows:
            continue
        sent = spark.sparkContext.broadcast(_arrays(got.to_batches()[0]))
        links = index.mapInArrow(_join(sent, distance, agree), "query_id long, image_id long, agreeing long")
        links = written(links, "links")
        sent.unpersist()
        found = links if found is None else found.unionByName(links)
    if found is None:
        return spark.createDataFrame([], "query_id long, image_id long, agreeing long")
    return found.groupBy("query_id", "image_id").agg(F.max("agreeing").alias("agreeing"))


def find_copies(queries: DataFrame, images: DataFrame, distance: int = DISTANCE, agree: int = AGREE) -> DataFrame:
    """The images that a query image is a cropped, scaled, turned or edited copy of: query_id, image_id, class_id, agreeing.

    queries(image_id, media), images(image_id, media); media is binary PGM or PPM; further columns are ignored. Images of
    the same bytes are a class, named by its least image_id. Rows with a query_id link it to a class (image_id is the
    class_id; agreeing: how many matches do); rows without one say which class an image is in, for classes of two and more.
    Null ids and media, other formats, and images too small or too even to have corners link to nothing. Rows alike in
    image_id and media count once; of one image_id with several media, each is asked and found. Every class is in the
    index with all its corners, images of any size. An empty table on either side gives no links.
    """
    image_id, media = F.col("image_id").cast("long"), F.col("media").cast("binary")
    key = ["k1", "k2"]
    whole = images.select(image_id.alias("image_id"), media.alias("media")).where("image_id is not null and media is not null")
    whole = whole.withColumns(dict(zip(key, row_keys(F.lit(0), F.col("media")), strict=True)))
    ids = written(whole.select("image_id", *key).distinct(), "media-ids")
    classes = written(ids.groupBy(*key).agg(F.min("image_id").alias("class_id"), F.count("*").alias("n")), "classes")
    others = ids.join(classes.where("n > 1"), key).where("image_id <> class_id").select("image_id", *key)
    heads = whole.join(written(others, "copies"), ["image_id", *key], "left_anti")
    index = written(descriptors(heads), "index")
    asked = written(descriptors(queries).dropDuplicates(["image_id", "bits"]), "asked")
    links = links_between(asked, index, distance, agree)
    links = links.select("query_id", "image_id", F.col("image_id").alias("class_id"), "agreeing")
    nothing = F.lit(None).cast("long")
    members = ids.join(classes.where("n > 1"), key).select(
        nothing.alias("query_id"), "image_id", "class_id", nothing.alias("agreeing")
    )
    return links.unionByName(members)


def by_query(found: DataFrame, most: int = 1000) -> DataFrame:
    """What ``find_copies`` found with the links of a query in lists: query_id, part, image_ids (sorted), n_links (of the query),
    class_id.

    Groups of near-copies grow with the table, so rows for single links would grow faster than it. A query with more than
    ``most`` links has several lists, dealt by hash (``part``: 0, 1, ...), so no list grows without bound; all links are there.
    The rows that say which class an image is in have no query_id, the image alone in image_ids, and the class_id."""
    links = found.where("query_id is not null")
    number = links.groupBy("query_id").agg(F.count("*").alias("n_links"))
    dealt = links.join(number, "query_id").withColumn(
        "part", F.pmod(F.xxhash64("image_id"), F.ceil(F.col("n_links") / F.lit(most))).cast("int")
    )
    listed = dealt.groupBy("query_id", "part", "n_links").agg(F.sort_array(F.collect_list("image_id")).alias("image_ids"))
    nothing = F.lit(None)
    members = found.where("query_id is null").select(
        nothing.cast("long").alias("query_id"), nothing.cast("int").alias("part"), F.array("image_id").alias("image_ids"),
        nothing.cast("long").alias("n_links"), "class_id",
    )
    listed = listed.select("query_id", "part", "image_ids", "n_links", nothing.cast("long").alias("class_id"))
    return listed.unionByName(members)


# --- images for the query: no table has any, so embeddings are drawn


SIZE = 96
#: Rounds of smoothing of the patterns that a picture is made of: structure of several sizes.
_COARSE = (4, 16, 64)


@lru_cache(maxsize=4)
def _patterns(dim: int, size: int) -> np.ndarray:
    """A fixed smooth random pattern for each coordinate."""
    rng = np.random.default_rng(dim)
    out = np.zeros((dim, size, size), np.float32)
    for i in range(dim):
        for rounds in _COARSE:
            x = _smooth(rng.standard_normal((size, size)), rounds)
            out[i] += x / x.std()
    return out.reshape(dim, -1)


def draw(vector: np.ndarray, size: int = SIZE) -> np.ndarray:
    """A grey picture of a vector: the sum of the patterns of its coordinates, each as strong as the coordinate."""
    picture = (vector @ _patterns(len(vector), size)).reshape(size, size)
    return np.clip(128 + 50 * picture / (float(picture.std()) or 1.0), 0, 255)


def sampled(image: np.ndarray, y: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Bilinear, at any places; beyond the edge as at the edge."""
    h, w = image.shape
    y, x = np.clip(y, 0, h - 1), np.clip(x, 0, w - 1)
    y0, x0 = np.minimum(y.astype(int), max(h - 2, 0)), np.minimum(x.astype(int), max(w - 2, 0))
    y1, x1 = np.minimum(y0 + 1, h - 1), np.minimum(x0 + 1, w - 1)
    fy, fx = y - y0, x - x0
    return (image[y0, x0] * (1 - fx) + image[y0, x1] * fx) * (1 - fy) + (image[y1, x0] * (1 - fx) + image[y1, x1] * fx) * fy


def edited(image: np.ndarray, seed: int) -> np.ndarray:
    """A copy: turned by any angle, cropped to 70 to 90 percent of each side, scaled to another size, brighter or darker, with
    other contrast and noise."""
    rng = np.random.default_rng(seed)
    h, w = image.shape
    keep, factor, turn = rng.uniform(0.7, 0.9), rng.uniform(0.9, 1.2), rng.uniform(0, 2 * np.pi)
    ch, cw = int(h * keep * factor), int(w * keep * factor)
    middle = [(n - 1) / 2 + rng.uniform(-0.5, 0.5) * (1 - keep) * n for n in (h, w)]
    y, x = ((np.arange(n) - (n - 1) / 2) / factor for n in (ch, cw))
    co, si = np.cos(turn), np.sin(turn)
    part = sampled(image, middle[0] + co * y[:, None] + si * x, middle[1] - si * y[:, None] + co * x)
    return np.clip((part - 128) * rng.uniform(0.8, 1.1) + 128 + rng.uniform(-15, 15) + rng.normal(0, 2, part.shape), 0, 255)


def pictures(embeddings: DataFrame, copies: bool = False) -> DataFrame:
    """image_id, media: a picture of each embedding, or an edited copy of it. Null and empty embeddings have none."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                media = []
                for i, v in zip(*(part.column(k).to_pylist() for k in (0, 1)), strict=True):
                    image = draw(np.nan_to_num(np.array([0.0 if x is None else x for x in v], np.float32)))
                    media.append(encode_pgm(edited(image, i & 0xFFFFFFFF) if copies else image))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(media, pa.binary())], ["image_id", "media"])

    rows = embeddings.where("vec_id is not null and size(embedding) > 0")
    return rows.select(F.col("vec_id").cast("long"), "embedding").mapInArrow(run, "image_id long, media binary")
