"""The demonstration corpus: embeddings with filter columns derived from the id, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: name: (Spark expression, DuckDB expression), both over vec_id
DERIVED = {
    "year": ("CAST(2000 + vec_id % 50 AS INT)", "CAST(2000 + vec_id % 50 AS INTEGER)"),
    "category": ("CASE WHEN vec_id = 123 THEN 'rare_zz' ELSE concat('cat_', vec_id % 10) END",) * 2,
    "tags": (
        "filter(array(concat('tag_', vec_id % 3), CASE WHEN vec_id % 5 = 0 THEN 'x5' END, CASE WHEN vec_id = 77 THEN 'rare_tag' END), t -> t IS NOT NULL)",
        "list_filter([concat('tag_', vec_id % 3), CASE WHEN vec_id % 5 = 0 THEN 'x5' END, CASE WHEN vec_id = 77 THEN 'rare_tag' END], lambda t: t IS NOT NULL)",
    ),
    "lat": ("CAST(37.0D + CAST(vec_id % 90 AS DOUBLE) * 0.1D AS FLOAT)", "CAST(37.0::DOUBLE + CAST(vec_id % 90 AS DOUBLE) * 0.1::DOUBLE AS FLOAT)"),
    "lng": ("CAST(-122.0D + CAST(floor(vec_id / 90) % 90 AS DOUBLE) * 0.1D AS FLOAT)", "CAST(-122.0::DOUBLE + CAST((vec_id // 90) % 90 AS DOUBLE) * 0.1::DOUBLE AS FLOAT)"),
    "big_id": ("18014398509481984 + (vec_id % 4) * 2",) * 2,
    "flag": ("vec_id % 2 = 0",) * 2,
    "year_n": ("CASE WHEN vec_id % 7 <> 3 THEN CAST(2000 + vec_id % 50 AS INT) END", "CASE WHEN vec_id % 7 <> 3 THEN CAST(2000 + vec_id % 50 AS INTEGER) END"),
    "category_n": ("CASE WHEN vec_id % 11 <> 5 THEN concat('cat_', vec_id % 10) END",) * 2,
}
FILTERS = list(DERIVED)

#: A common table expression with the corpus as ``base`` and every fiftieth vector as ``queries``.
SQL_BASE = (
    "base AS (SELECT vec_id AS row_id, embedding, label, "
    + ", ".join(f"{sql} AS {name}" for name, (_, sql) in DERIVED.items())
    + ", concat('payload_', vec_id) AS payload FROM embeddings), queries AS (SELECT vec_id AS query_id, embedding AS q FROM embeddings WHERE vec_id % 50 = 0)"
)


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet")


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = embeddings(spark, sf_dir)
    return df.select(F.col("vec_id").alias("row_id"), "embedding", "label", *[F.expr(e).alias(n) for n, (e, _) in DERIVED.items()], F.expr("concat('payload_', vec_id)").alias("payload"))


def queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fiftieth vector, as a stated query set."""
    return embeddings(spark, sf_dir).where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding")


def l2(a: str, b: str) -> str:
    return f"list_sum(list_transform(list_zip({a}, {b}), lambda p: (CAST(p[1] AS DOUBLE) - CAST(p[2] AS DOUBLE)) * (CAST(p[1] AS DOUBLE) - CAST(p[2] AS DOUBLE))))"


def dot(a: str, b: str) -> str:
    return f"list_sum(list_transform(list_zip({a}, {b}), lambda p: CAST(p[1] AS DOUBLE) * CAST(p[2] AS DOUBLE)))"


def knn_sql(k: int = 10, where: str = "TRUE", dist: str | None = None, tail: str = "") -> str:
    """Ranked neighbours of all queries as ``knn``."""
    d = dist or l2("q", "embedding")
    return f"""WITH {SQL_BASE}, measured AS (SELECT query_id, row_id, {d} AS dist FROM base, queries WHERE {where}),
      knn AS (SELECT query_id, CAST(rn AS INTEGER) AS rank, row_id, dist FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY dist, row_id DESC) AS rn FROM measured) WHERE rn <= {k})
      {tail or 'SELECT query_id, rank, row_id, dist FROM knn'}"""
