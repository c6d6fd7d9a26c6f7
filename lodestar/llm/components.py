"""Connected components on DataFrames: least labels spread along links, with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm.common import forget, written


def components(links: DataFrame) -> DataFrame:
    """links(a long, b long) -> node, component (the least node of it), for the nodes that have links.

    Every round is written to the shared folder; the number of rounds is about the logarithm of the longest path."""
    both = written(
        links.where("a <> b").select("a", "b").unionByName(links.where("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(),
        "links",
    )
    stored = label = written(
        both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("component")),
        "labels",
    )
    while True:
        near = (
            both.join(label, both.b == label.node)
            .groupBy("a")
            .agg(F.min("component").alias("near"))
            .select(F.col("a").alias("node"), "near")
        )
        pointed = label.join(near, "node").select(
            "node", F.col("component").alias("was"), F.least("component", "near").alias("via")
        )
        over = label.select(F.col("node").alias("via"), F.col("component").alias("beyond"))
        moved = written(
            pointed.join(over, "via").select("node", "was", F.least("via", "beyond").alias("component")), "labels"
        )
        forget(stored)
        stored, label = moved, moved.select("node", "component")
        if moved.where("was <> component").isEmpty():
            return label


def roots(pointers: DataFrame) -> DataFrame:
    """pointers(node long, parent long), each node with one parent and none its own ancestor -> node, component: where
    following the parents ends. Roots aren't among the nodes."""
    stored = label = written(pointers.select("node", F.col("parent").alias("component")), "labels")
    while True:
        over = label.select(F.col("node").alias("component"), F.col("component").alias("beyond"))
        moved = written(label.join(over, "component", "left"), "labels")
        forget(stored)
        stored = moved
        label = moved.select("node", F.coalesce("beyond", "component").alias("component"))
        if moved.where("beyond is not null").isEmpty():
            return label
