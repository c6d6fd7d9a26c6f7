"""Recall of a ranking against the exact one; latency and memory of searches."""

from __future__ import annotations

import math
import os
import re
import time
from collections.abc import Callable, Sequence
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KS = (1, 2, 4, 8, 16, 32, 64)


def _with_k(df: DataFrame, ks: Sequence[int]) -> DataFrame:
    return df.withColumn("k", F.explode(F.array(*(F.lit(k).cast("long") for k in ks)))).where("rk <= k")


def set_recall(found: DataFrame, truth: DataFrame, ks: Sequence[int] = KS) -> DataFrame:
    """k, recall: the share (percent) of the true k best that are among the k found, over all queries."""
    a = _with_k(found.select("query_id", "rk", "vec_id"), ks).select("query_id", "k", "vec_id")
    b = _with_k(truth.select("query_id", "rk", "vec_id"), ks).select("query_id", "k", "vec_id")
    hits = b.join(a.withColumn("hit", F.lit(1.0)), ["query_id", "k", "vec_id"], "left")
    each = hits.groupBy("query_id", "k").agg((F.sum(F.coalesce("hit", F.lit(0.0))) / F.col("k")).alias("recall"))
    return each.groupBy("k").agg((F.avg("recall") * 100).alias("recall"))


def top1(found: DataFrame, truth: DataFrame, ks: Sequence[int] = KS) -> DataFrame:
    """k, top1_in_k: the share (percent) of queries whose true best is among the k found."""
    best = truth.where("rk = 1").select("query_id", F.col("vec_id").alias("best"))
    each = _with_k(found.select("query_id", "rk", "vec_id"), ks).join(best, "query_id")
    each = each.groupBy("query_id", "k").agg(F.max((F.col("vec_id") == F.col("best")).cast("double")).alias("hit"))
    return each.groupBy("k").agg((F.avg("hit") * 100).alias("top1_in_k"))


def summary(methods: dict[str, DataFrame], truth: DataFrame, ks: Sequence[int] = KS) -> DataFrame:
    """method, k, top1_in_k, set_recall, for all methods at once."""
    found = None
    for name, rows in methods.items():
        part = rows.select(F.lit(name).alias("method"), "query_id", F.col("rk").alias("found_rk"), "vec_id")
        found = part if found is None else found.unionByName(part)
    levels = truth.sparkSession.createDataFrame([(int(k),) for k in ks], "k long")
    hits = truth.select("query_id", "rk", "vec_id").join(found, ["query_id", "vec_id"])  # at most a row for each found
    every = truth.where("rk = 1").select("query_id").crossJoin(F.broadcast(levels))
    named = truth.sparkSession.createDataFrame([(name,) for name in methods], "method string")
    counted = hits.join(F.broadcast(levels), (F.col("rk") <= F.col("k")) & (F.col("found_rk") <= F.col("k")))
    counted = counted.groupBy("method", "query_id", "k").agg(F.count("*").alias("both"), F.max((F.col("rk") == 1).cast("double")).alias("first"))
    each = every.crossJoin(F.broadcast(named)).join(counted, ["method", "query_id", "k"], "left")
    recall = F.avg(F.coalesce("both", F.lit(0)) / F.col("k")) * 100
    return each.groupBy("method", "k").agg((F.avg(F.coalesce("first", F.lit(0.0))) * 100).alias("top1_in_k"), recall.alias("set_recall"))


def report(results: DataFrame) -> str:
    """A Markdown table of a summary: a row for each method and k."""
    return markdown(results.columns, [tuple(r) for r in results.orderBy("method", "k").collect()])


def markdown(columns: Sequence[str], rows: Sequence[Sequence]) -> str:
    lines = [columns, ["---"] * len(columns), *([f"{x:.1f}" if isinstance(x, float) else str(x) for x in r] for r in rows)]
    return "\n".join("| " + " | ".join(x) + " |" for x in lines) + "\n"


def timed(searches: dict[str, Callable[[], DataFrame]], queries: int, runs: int = 2) -> dict[str, float]:
    """Milliseconds a query of each search, results fetched: the best of some runs after one to warm up."""
    out = {}
    for name, find in searches.items():
        best = math.inf
        for run in range(1 + runs):
            began = time.perf_counter()
            find().toArrow()
            took = time.perf_counter() - began
            best = min(best, took) if run else best
        out[name] = 1000 * best / queries
    return out


def speed_report(ms: dict[str, float], baseline: str) -> str:
    """A Markdown table: latency, queries a second, and how much faster than the baseline."""
    rows = [(name, x, 1000 / x, ms[baseline] / x) for name, x in ms.items()]
    return markdown(["method", "ms a query", "QPS", "speed-up"], rows)


def peak_memory(spark: SparkSession) -> dict[str, int]:
    """The most memory (MB) that the driver's Python, its JVM, and the JVM's Python workers have held; on Linux. With a
    master of ``local`` these are all there are."""
    jvm = spark._jvm.java.lang.ProcessHandle.current()
    below = [x.pid() for x in jvm.descendants().toArray()]
    return {
        "driver_mb": _peak(os.getpid()),
        "jvm_mb": _peak(jvm.pid()),
        "workers_mb": sum(_peak(pid) for pid in below if pid != os.getpid()),
    }


def _peak(pid: int) -> int:
    try:
        found = re.search(r"VmHWM:\s+(\d+)", Path(f"/proc/{pid}/status").read_text())
    except OSError:  # ended meanwhile
        return 0
    return int(found[1]) // 1024 if found else 0
