"""Connected components by alternating large-star and small-star steps, each cut by a written table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm._spark import checkpoint, discard


def _print(edges: DataFrame) -> tuple:
    """Number of distinct edges and the sum of their hashes: equal for equal tables, and else with a chance of 2^-64."""
    r = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    return r["n"], r["h"]


def components(edges: DataFrame) -> DataFrame:
    """``edges``: two columns of ids of one type. Result: node, component (its least node). Null ends and loops count as no edge."""
    a, b = edges.columns[:2]
    edges = edges.select(F.least(a, b).alias("u"), F.greatest(a, b).alias("v")).where(f"{a} is not null and {b} is not null")
    first = current = checkpoint(edges.where("u <> v").distinct())
    nodes = first.select(F.col("u").alias("node")).union(first.select("v")).distinct()
    seen = _print(current)
    while True:
        both = current.union(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("m").alias("u"), "v").where("u <> v").distinct()
        # large is oriented from the smaller to the larger end; small-star joins each node to its least smaller neighbour
        least = large.groupBy("v").agg(F.min("u").alias("m"))
        small = large.join(least, "v")
        after = small.select(F.col("m").alias("u"), F.col("u").alias("v")).union(small.select(F.col("m").alias("u"), "v")).where("u <> v").distinct()
        after = checkpoint(after)
        if current is not first:
            discard(current)
        current, before, seen = after, seen, _print(after)
        if seen == before:
            break
    root = current.groupBy(F.col("v").alias("node")).agg(F.min("u").alias("component"))
    return nodes.join(root, "node", "left").select("node", F.coalesce("component", "node").alias("component"))
