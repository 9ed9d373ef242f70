"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vectorloom.llm.common import checkpointed


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """Large: each node links its larger neighbours to the least of its neighbourhood. Small: likewise the smaller ones, and itself."""
    both = edges.union(edges.select("v", "u")) if large else edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    joined = both.join(least, "u")
    if large:
        out = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    return out.where("u <> v").distinct()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component): of every node of the edges (u, v), longs, the least node that it reaches.

    Each round is a few aggregations and joins, checkpointed, so that lineage stays short; the number of rounds grows
    with the logarithm of the longest path. Self-loops and repeated edges do no harm; an empty table gives an empty one."""
    now = checkpointed(edges.select(F.col("u").cast("long").alias("u"), F.col("v").cast("long").alias("v")).where("u <> v").distinct())
    mark = None
    for _ in range(rounds):
        now = checkpointed(_stars(_stars(now, True), False))
        then, mark = mark, now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == then or mark[0] == 0:
            break
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select(F.col("v"), F.col("v")).distinct())
