"""Sharding by Karmarkar-Karp differencing.

Groups that must stay together (equal texts) are dealt by hash into parts of bounded size. Each part bundles its light
groups, in ever smaller bundles towards its end, and hands up every heavier group as it is. One differencing takes the
bundles of all parts as single numbers: the two partial partitions of the largest spread are combined again and again,
the larger sums of one against the smaller sums of the other, until one is left. So a heavy group has the bundles of
all parts against it, and the small bundles level what the large ones leave.
"""

from __future__ import annotations

import heapq
import math

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestar.llm.common import text_key, written

SHARDS = 8
#: Groups in a part, which one task bundles; up to so many in all, each is a bundle. Else bundles hold up to 4 / PART_GROUPS
#: of all bytes, which makes fewer than PART_GROUPS of them, and some 100 small ones a part.
PART_GROUPS = 100_000
#: Rows numbered by one task.
CHUNK_ROWS = 100_000


def differencing(vectors: list[list[int]], k: int = SHARDS) -> list[list[int]]:
    """Combine partial partitions (k sums each): for each vector, the final bin of each of its positions."""
    if not vectors:
        return []
    sums = [list(v) for v in vectors]
    heap = [(min(v) - max(v), i) for i, v in enumerate(sums)]
    heapq.heapify(heap)
    made: list[tuple[int, list[int], int, list[int]]] = []
    while len(heap) > 1:
        _, a = heapq.heappop(heap)
        _, b = heapq.heappop(heap)
        va, vb = sums[a], sums[b]
        falling = sorted(range(k), key=va.__getitem__, reverse=True)
        rising = sorted(range(k), key=vb.__getitem__)
        both = [va[x] + vb[y] for x, y in zip(falling, rising, strict=True)]
        sums[a] = sums[b] = ()
        heapq.heappush(heap, (min(both) - max(both), len(sums)))
        sums.append(both)
        made.append((a, falling, b, rising))
    bins: list[list[int]] = [[0] * k for _ in range(len(sums) - 1)] + [list(range(k))]
    for node in range(len(sums) - 1, len(vectors) - 1, -1):
        a, falling, b, rising = made[node - len(vectors)]
        for r, to in enumerate(bins[node]):
            bins[a][falling[r]] = to
            bins[b][rising[r]] = to
        bins[node] = []
    return bins[: len(vectors)]


def bundled(sizes: list[int], limit: int) -> list[int]:
    """The bundle (0, 1, ...) of each of the falling sizes: no fuller than the limit and than an eighth of what is left,
    or else of one size."""
    left = sum(sizes)
    out: list[int] = []
    bundle, held, most = -1, 0, 0
    for size in sizes:
        if bundle < 0 or held + size > most:
            bundle, held, most = bundle + 1, 0, min(limit, left // 8)
        out.append(bundle)
        held += size
        left -= size
    return out


def _bundle(limit: int):
    def run(batches):
        rows = [
            (-size, bytes(key))
            for batch in batches
            for key, size in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)
        ]
        rows.sort()
        bundles = bundled([-s for s, _ in rows], limit)
        part = TaskContext.get().partitionId()
        for at in range(0, len(rows), 20_000):
            keys, sizes = [x[1] for x in rows[at : at + 20_000]], [-x[0] for x in rows[at : at + 20_000]]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(keys, pa.binary()),
                    pa.array(sizes, pa.int64()),
                    pa.array([part] * len(keys), pa.int32()),
                    pa.array(bundles[at : at + 20_000], pa.int32()),
                ],
                ["group_key", "group_size", "part", "bundle"],
            )

    return run


def _deal(k: int):
    def run(batches):
        rows = sorted(
            (-size, part, bundle)
            for batch in batches
            for part, bundle, size in zip(*(c.to_pylist() for c in batch.columns), strict=True)
        )
        dealt = [b[0] for b in differencing([[-r[0]] + [0] * (k - 1) for r in rows], k)]
        columns = [[r[1] for r in rows], [r[2] for r in rows], dealt]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32()) for c in columns], ["part", "bundle", "shard"])

    return run


def shard(documents: DataFrame, shards: int = SHARDS) -> DataFrame:
    """Deal all documents into ``shards`` shards of nearly equal bytes; equal texts go to one shard.

    documents(doc_id, text); further columns are ignored. A row for each row given: doc_id, size (UTF-8 bytes plus
    1; null text: 1), text_crc32, law (``bytes``), shard, slot (0, 1, ... within the shard, without gaps; by chunk of
    ids, then doc_id; rows alike in all columns are numbered in any order), grown_shard (null: this law moves
    groups freely when a shard is added). Null and empty texts are equal. An empty table gives no rows.
    A group heavier than a shard's share gets a shard mostly to itself; nothing splits it.
    """
    spark = documents.sparkSession
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    sized = written(
        documents.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            (F.octet_length(text) + F.lit(1)).cast("long").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            text_key(text).alias("group_key"),
        ),
        "sized",
    )
    groups = sized.groupBy("group_key").agg(F.sum("size").alias("group_size"))
    number, total = groups.agg(F.count("*"), F.sum("group_size")).first()
    limit = 0 if number <= PART_GROUPS else 4 * total // PART_GROUPS
    n = max(1, math.ceil(number / PART_GROUPS))
    dealt = written(
        groups.repartition(n, "group_key").mapInArrow(
            _bundle(limit), "group_key binary, group_size long, part int, bundle int"
        ),
        "dealt",
    )
    bundles = dealt.groupBy("part", "bundle").agg(F.sum("group_size").alias("size"))
    places = written(bundles.repartition(1).mapInArrow(_deal(shards), "part int, bundle int, shard int"), "places")
    rows = sized.count()
    chunks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(rows / CHUNK_ROWS))
    placed = (
        sized.join(dealt.drop("group_size").join(places, ["part", "bundle"]), "group_key")
        .drop("part", "bundle", "group_key")
        .withColumn("chunk", F.pmod(F.xxhash64("doc_id", "size"), F.lit(chunks)))
    )
    placed = written(placed, "placed")
    before = Window.partitionBy("shard").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        placed.groupBy("shard", "chunk")
        .agg(F.count("*").alias("n"))
        .select("shard", "chunk", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    )
    inside = Window.partitionBy("shard", "chunk").orderBy("doc_id", "text_crc32")
    return (
        placed.withColumn("nth", F.row_number().over(inside))
        .join(offsets, ["shard", "chunk"])
        .select(
            "doc_id",
            "size",
            "text_crc32",
            F.lit("bytes").alias("law"),
            "shard",
            (F.col("offset") + F.col("nth") - 1).cast("long").alias("slot"),
            F.lit(None).cast("int").alias("grown_shard"),
        )
    )
