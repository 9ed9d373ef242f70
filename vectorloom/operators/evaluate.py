"""Evaluation: recall, filtered recall, proximity, ties, containment, distortion and sweeps.

Results and truths are (query_id, rank, row_id, dist) tables.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def recall_at_k(results: DataFrame, truth: DataFrame, k: int) -> DataFrame:
    """Hits anywhere in the results among the first k of the truth, over queries times k."""
    first = truth.where(F.col("rank") <= k)
    hits = first.join(results.select("query_id", "row_id").distinct(), ["query_id", "row_id"], "left_semi")
    n = truth.select("query_id").distinct().agg(F.count("*").alias("n"))
    return hits.agg(F.count("*").alias("hits")).join(n, F.lit(True)).select((F.col("hits") / (F.col("n") * k)).alias("recall"))


def filtered_recall(results: DataFrame, truth: DataFrame, passing: DataFrame, k: int) -> DataFrame:
    """Mean over queries of the share of the filtered truth's k first rows that the results' k first hold; queries
    without any such row are left out. passing: the row ids that satisfy the filter."""
    kept = truth.join(passing.select("row_id").distinct(), "row_id", "left_semi")
    kept = kept.withColumn("at", F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))).where(F.col("at") <= k)
    got = results.where(F.col("rank") <= k).select("query_id", "row_id", F.lit(1).alias("hit")).distinct()
    each = kept.join(got, ["query_id", "row_id"], "left").groupBy("query_id").agg((F.sum(F.coalesce("hit", F.lit(0))) / F.count("*")).alias("share"))
    return each.agg(F.avg("share").alias("recall"))


def proximity(results: DataFrame, truth: DataFrame, k: int) -> DataFrame:
    """Share of results that lie no farther than the true k-th neighbour."""
    kth = truth.where(F.col("rank") == k).select("query_id", F.col("dist").alias("kth"))
    return results.join(kth, "query_id").agg(F.avg((F.col("dist") <= F.col("kth")).cast("double")).alias("in_band"))


def ties_at_k(truth: DataFrame, k: int) -> DataFrame:
    """Per query, how many of its listed rows lie exactly at the k-th distance."""
    kth = truth.where(F.col("rank") == k).select("query_id", F.col("dist").alias("kth"))
    return truth.join(kth, "query_id").where("dist = kth").groupBy("query_id").agg(F.count("*").alias("ties"))


def containment(truth: DataFrame, homes: DataFrame, order: DataFrame, share: float, k: int) -> DataFrame:
    """Share of the truth's k first rows with a home leaf in the first ``share`` of a query's leaf order.

    homes: (row_id, leaf_id); order: (query_id, cluster_id, dist, weight)."""
    from vectorloom.operators.routing import by_fraction

    visited = by_fraction(order, share).select("query_id", F.col("cluster_id").alias("leaf_id"))
    first = truth.where(F.col("rank") <= k).select("query_id", "row_id")
    found = first.join(homes, "row_id").join(visited, ["query_id", "leaf_id"], "left_semi").select("query_id", "row_id").distinct()
    return first.join(found.withColumn("hit", F.lit(1.0)), ["query_id", "row_id"], "left").agg(F.avg(F.coalesce("hit", F.lit(0.0))).alias("contained"))


def distortion(measured: DataFrame) -> DataFrame:
    """Median of |1 - estimate / distance| over (dist, estimate) rows with a positive distance."""
    return measured.where("dist > 0").agg(F.percentile(F.abs(1 - F.col("estimate") / F.col("dist")), F.lit(0.5)).alias("distortion"))


def correlation(measured: DataFrame) -> DataFrame:
    return measured.agg(F.corr("dist", "estimate").alias("correlation"))


def sweep(run: Callable[..., DataFrame], truth: DataFrame, k: int, grid: Iterable[dict]) -> DataFrame:
    """One row of recall a configuration of the grid."""
    out = None
    for config in grid:
        row = recall_at_k(run(**config), truth, k).withColumn("config", F.lit(",".join(f"{a}={b}" for a, b in sorted(config.items())))).select("config", "recall")
        out = row if out is None else out.unionByName(row)
    return out


def zipf_queries(base: DataFrame, n: int, exponent: float = 1.0) -> DataFrame:
    """A skewed stream of n queries over a table's rows, the same on every run: row ranks by a hash, drawn with
    probability falling as a power of the rank."""
    count = base.count()
    order = base.withColumn("at", F.row_number().over(Window.orderBy(F.xxhash64("row_id"), "row_id")))
    u = (F.pmod(F.xxhash64("query_id", F.lit("zipf")), F.lit(1 << 53)) + 0.5) / float(1 << 53)
    at = F.pow(F.lit(float(count + 1)), u) if exponent == 1.0 else F.pow(u * (float(count + 1) ** (1 - exponent) - 1) + 1, F.lit(1 / (1 - exponent)))
    drawn = base.sparkSession.range(n).withColumnRenamed("id", "query_id").withColumn("at", F.least(F.floor(at).cast("int"), F.lit(count)))
    return drawn.join(order, "at").select("query_id", "row_id", "embedding")
