"""Connected components of a link table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from motifmill.llm import common


def components(links: DataFrame, scratch: common.Scratch, name: str) -> DataFrame:
    """(node, root) for every node with a link; the root is the least node of its component.

    ``links`` has long columns a and b.  Each round hangs nodes on the least node they
    know; the rounds grow with the logarithm of a component's diameter.  Links stay in
    scratch tables, none come to the driver but a count and a checksum.
    """
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    edges = scratch.write(edges, f"{name}-0")
    before, step = None, 0
    while True:
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state[0] == 0 or state == before:
            break
        before = state
        step += 1
        # Large star: greater neighbours hang on the least neighbour.
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = scratch.write(large, f"{name}-{step}-large")
        # Small star: a node and its lesser neighbours hang on the least of them.
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(least, "u")
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(joined.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        edges = scratch.write(small, f"{name}-{step}")
        scratch.drop(f"{name}-{step - 1}", f"{name}-{step}-large")
    roots = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
