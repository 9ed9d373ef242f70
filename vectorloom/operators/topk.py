"""Ranking: one total order, replica removal, shortlists and their adaptive cut.

Rows are (query_id, row_id, dist); the order is (dist ascending, row_id descending).
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

ORDER = (F.asc, F.desc)


def _window(*extra):
    return Window.partitionBy("query_id").orderBy(F.asc("dist"), F.desc("row_id"), *extra)


def ranked(rows: DataFrame, k: int) -> DataFrame:
    """The k best of each query with ``rank`` from 1. Spark limits each task's rows before the shuffle."""
    return rows.withColumn("rank", F.row_number().over(_window())).where(F.col("rank") <= k)


def deduplicated(rows: DataFrame) -> DataFrame:
    """One row a query and row id, the closest of its replicas."""
    return rows.groupBy("query_id", "row_id").agg(F.min("dist").alias("dist"))


def shortlist_width(k: int, width: int | None = None, selectivity: float | None = None) -> int:
    """How many scan results are kept for reranking; filters widen it by the inverse of what they let through."""
    w = max(width or 1000, k)
    if selectivity is None:
        return w
    return max(w, int(2 * k / selectivity) if selectivity > 0.001 else 200 * k, 10 * k)


def adaptive_cut(rows: DataFrame, k: int, tau: float, width: int | None = None) -> DataFrame:
    """Keeps the k best and all behind them until a gap: the first row whose distance lies more than tau mean top-k
    gaps beyond the k-th ends the list. With k = 1 there is no mean gap, and the list is a plain top 1."""
    if k <= 1:
        return ranked(rows, k)
    numbered = ranked(rows, width) if width else rows.withColumn("rank", F.row_number().over(_window()))
    whole = Window.partitionBy("query_id")
    first, kth = F.min("dist").over(whole), F.max(F.when(F.col("rank") == k, F.col("dist"))).over(whole)
    far = (F.col("rank") > k) & (F.col("dist") - F.col("kth") > tau * F.greatest((F.col("kth") - F.col("first")) / (k - 1), F.lit(1e-12)))
    marked = numbered.withColumns({"first": first, "kth": kth}).withColumn("far", F.coalesce(far, F.lit(False)).cast("int"))
    upto = Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return marked.withColumn("ended", F.max("far").over(upto)).where("ended = 0").drop("first", "kth", "far", "ended")


def auto_tau(code_bytes: int) -> float:
    """Fine codes order neighbours well and need less slack."""
    return 2.5 if code_bytes >= 288 else 5.0


def width_sweep(scanned: DataFrame, widths: Iterable[int], k: int) -> DataFrame:
    """Top k for several shortlist widths out of one scan: (query_id, row_id, scan_key, dist) rows are cut by
    (scan_key, row_id) at each width, then replicas are dropped and the rest is ranked by dist."""
    widths = sorted(set(widths))
    by_scan = Window.partitionBy("query_id").orderBy(F.asc("scan_key"), F.asc("row_id"))
    numbered = scanned.withColumn("scan_rank", F.row_number().over(by_scan)).where(F.col("scan_rank") <= widths[-1])
    each = numbered.withColumn("width", F.explode(F.array(*map(F.lit, widths)))).where("scan_rank <= width")
    best = each.groupBy("width", "query_id", "row_id").agg(F.min("dist").alias("dist"))
    order = Window.partitionBy("width", "query_id").orderBy(F.asc("dist"), F.desc("row_id"))
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
