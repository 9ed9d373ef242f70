"""Which clusters a query visits: budgets by count and by share, gap pruning, descent, planes and feedback.

Inputs are (query_id, cluster_id, dist, weight) rows: a query's distance to each cluster and the cluster's rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DEFAULT_ROWS = 500_000
FILTERED_SCAN, FILTERED_PROBE = 0.01, 0.20


def _nearest(by: str = "query_id"):
    return Window.partitionBy(by).orderBy(F.asc("dist"), F.asc("cluster_id"))


def default_count(k_root: int) -> int:
    return max(1, int(2 * math.sqrt(k_root)))


def default_fraction(rows: int) -> float:
    return min(0.5, DEFAULT_ROWS / max(1, rows))


def by_count(scored: DataFrame, n_probe: int, gap: float | None = None) -> DataFrame:
    """The nearest n_probe clusters; with gap, up to the first whose distance exceeds the one before it so many times."""
    w = _nearest()
    out = scored.withColumn("rn", F.row_number().over(w))
    if gap:
        wide = F.coalesce(F.col("dist") > gap * F.lag("dist").over(w), F.lit(False)).cast("int")
        out = out.withColumn("wide", wide).withColumn("stopped", F.max("wide").over(w.rowsBetween(Window.unboundedPreceding, 0))).where("stopped = 0").drop("wide", "stopped")
    return out.where(F.col("rn") <= n_probe).drop("rn")


def by_fraction(scored: DataFrame, fraction: float | Column) -> DataFrame:
    """Nearest first until the weights reach the share of all weights; the cluster that crosses it is included, and
    one at least. The share may be a column, other for each query."""
    w = _nearest()
    share = F.lit(float(fraction)) if isinstance(fraction, (int, float)) else fraction
    before = F.sum("weight").over(w.rowsBetween(Window.unboundedPreceding, 0)) - F.col("weight")
    budget = F.floor(share * F.sum("weight").over(Window.partitionBy("query_id")))
    out = scored.withColumns({"before": before, "budget": budget, "rn": F.row_number().over(w)})
    return out.where((F.col("before") < F.col("budget")) | (F.col("rn") == 1)).drop("before", "budget", "rn")


def descend(parents: DataFrame, children: DataFrame, n_probe: int, gap: float | None = None) -> DataFrame:
    """One level down: children (parent_id, query_id, cluster_id, dist, weight) of the chosen parents, pruned alike."""
    chosen = parents.select("query_id", F.col("cluster_id").alias("parent_id"))
    return by_count(children.join(chosen, ["query_id", "parent_id"], "left_semi"), n_probe, gap)


def by_plane(member_scores: DataFrame, leaves: DataFrame, fraction: float, keep: float | None = None, centroid_dist: DataFrame | None = None) -> DataFrame:
    """Leaves by their best member: (query_id, leaf_id, score) rows are reduced to a leaf's maximum and taken from the
    best down until the weights reach fraction of all, less half a row. With keep, only the leaves nearest by centroid
    up to that share of the weights take part."""
    best = member_scores.groupBy("query_id", "leaf_id").agg(F.max("score").alias("score"))
    if keep is not None and centroid_dist is not None:
        near = centroid_dist.select("query_id", F.col("leaf_id").alias("cluster_id"), "dist", "weight")
        best = best.join(by_fraction(near, keep).select("query_id", F.col("cluster_id").alias("leaf_id")), ["query_id", "leaf_id"], "left_semi")
    total = leaves.agg(F.sum("weight").alias("total"))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("leaf_id"))
    rows = best.join(leaves.select("leaf_id", "weight"), "leaf_id").join(F.broadcast(total), F.lit(True))
    before = F.sum("weight").over(w.rowsBetween(Window.unboundedPreceding, 0)) - F.col("weight")
    return rows.withColumns({"before": before, "rn": F.row_number().over(w)}).where((F.col("before") < fraction * F.col("total") - 0.5) | (F.col("rn") == 1)).select("query_id", "leaf_id", "weight", "score")


def resolve(rows: int, k_root: int, n_probe: int = 0, fraction: float | None = None, baked: float | None = None, exhaustive: bool = False) -> tuple[str, float]:
    """The rule in force: everything, an explicit count, the call's share, the index's share, or the default count."""
    if exhaustive:
        return "all", 1.0
    if n_probe > 0:
        return "count", float(min(n_probe, k_root))
    if fraction is not None and fraction > 0:
        return "fraction", min(1.0, fraction)
    if baked:
        return "fraction", baked
    return "count", float(min(default_count(k_root), k_root))


def strategy(selectivity: float | None) -> str:
    """How a filtered query runs: so few rows that all of them are measured, so few that every cluster which may hold
    one is visited, or by distance like an unfiltered one."""
    if selectivity is None:
        return "route"
    if 0 < selectivity < FILTERED_SCAN:
        return "scan"
    return "visit_matching" if selectivity <= FILTERED_PROBE else "route"


def replayed(blocks: DataFrame, rule: str, amount: float, k: int, min_blocks: int = 1) -> DataFrame:
    """How many blocks a stopping rule visits. Blocks: (query_id, block, weight, entered, kth), in visiting order, with
    how many rows of the block entered the top k and the k-th distance after it.

    fixed: a share of the weights; stall: after ``amount`` blocks in a row from which nothing entered; kth: after
    ``amount`` blocks in a row that left the k-th distance as it was."""
    w = Window.partitionBy("query_id").orderBy("block")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    total = F.sum("weight").over(Window.partitionBy("query_id"))
    out = blocks.withColumns({"total": total, "seen": F.sum("weight").over(upto), "at": F.row_number().over(w)})
    if rule == "fixed":
        stop = F.col("seen") >= F.floor(amount * F.col("total"))
    elif rule in ("stall", "kth"):
        idle = F.col("entered") == 0 if rule == "stall" else F.coalesce(F.col("kth") >= F.lag("kth").over(w), F.lit(False))
        out = out.withColumn("idle", idle)
        last = F.coalesce(F.max(F.when(~F.col("idle"), F.col("at"))).over(upto), F.lit(0))
        stop = F.col("at") - last >= amount
    else:
        raise ValueError(f"unknown rule {rule!r}")
    out = out.withColumn("stop", stop & (F.col("at") >= min_blocks))
    first = F.min(F.when(F.col("stop"), F.col("at"))).over(Window.partitionBy("query_id"))
    visited = out.withColumn("first", first).where(F.col("first").isNull() | (F.col("at") <= F.col("first")))
    return visited.groupBy("query_id").agg(F.count("*").alias("blocks"), (F.sum("weight") / F.first("total")).alias("fraction"))
