"""The engine's queries over the demonstration corpus, and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vectorloom.functions.predicates import Op, Predicate, matches, parse
from vectorloom.functions.vectors import IP, L2, distance, normalized
from vectorloom.operators import evaluate, explore, quantizers, routing, stats, summary, topk, training
from vectorloom.operators.exact import exact_knn, nearest, within
from vectorloom.operators.index import BuildOptions, Index, IndexBuilder, SearchOptions
from vectorloom.plans.corpus import FILTERS, SQL_BASE, corpus, dot, embeddings, knn_sql, l2, queries as query_set
from vectorloom.sources import files
from vectorloom.sources.workspace import checkpointed, fresh

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}
K = 10


def register(name: str, sql: str | None = None):
    def wrap(f):
        _QUERIES[name] = f
        if sql:
            _SQL[name] = sql
        return f

    return wrap


def queries() -> dict:
    return dict(_QUERIES)


def oracle_sql() -> dict:
    return dict(_SQL)


# --- exact neighbours ----------------------------------------------------------------------------------------------


@register("exact_knn_l2", knn_sql())
def exact_knn_l2(spark, sf):
    return exact_knn(query_set(spark, sf), corpus(spark, sf), K)


@register("exact_knn_ip", knn_sql(dist=f"-({dot('q', 'embedding')})"))
def exact_knn_ip(spark, sf):
    return exact_knn(query_set(spark, sf), corpus(spark, sf), K, IP)


@register("exact_knn_self_excluded", knn_sql(where="row_id <> query_id"))
def exact_knn_self_excluded(spark, sf):
    return exact_knn(query_set(spark, sf), corpus(spark, sf), K, exclude_self=True)


@register("range_scan_expressions", f"WITH {SQL_BASE} SELECT query_id, row_id, {l2('q', 'embedding')} AS dist FROM base, queries WHERE {l2('q', 'embedding')} <= 1.2")
def range_scan_expressions(spark, sf):
    return within(query_set(spark, sf), corpus(spark, sf), 1.2)


@register(
    "normalize_rows",
    f"WITH n AS (SELECT vec_id, embedding, sqrt({dot('embedding', 'embedding')}) AS norm FROM embeddings) SELECT vec_id AS row_id, round(list_sum(list_transform(embedding, lambda x: CAST(CAST(CAST(x AS DOUBLE) / norm AS FLOAT) AS DOUBLE))), 9) AS total FROM n",
)
def normalize_rows(spark, sf):
    rows = embeddings(spark, sf).select(F.col("vec_id").alias("row_id"), normalized(F.col("embedding")).alias("unit"))
    return rows.select("row_id", F.round(F.aggregate("unit", F.lit(0.0), lambda t, x: t + x.cast("double")), 9).alias("total"))


# --- predicates ----------------------------------------------------------------------------------------------------

P = Predicate
_HAV = "(sin((radians(CAST(lat AS DOUBLE)) - radians(40.0)) / 2) ** 2 + cos(radians(CAST(lat AS DOUBLE))) * cos(radians(40.0)) * sin((radians(CAST(lng AS DOUBLE)) - radians(-121.8)) / 2) ** 2)"
_RADIUS = f"2 * 6371.0 * atan2(sqrt({_HAV}), sqrt(greatest(0.0, 1 - {_HAV}))) <= 150.0"

FILTER_CASES: dict[str, tuple[list[Predicate], str]] = {
    "eq_int": ([P("year", Op.EQ, 2007)], "year = 2007"),
    "eq_int_rounded": ([P("year", Op.EQ, 2006.5)], "year = 2007"),
    "eq_float32": ([P("lat", Op.EQ, 37.1)], "lat = CAST(37.1 AS FLOAT)"),
    "eq_string": ([P("category", Op.EQ, "cat_3")], "category = 'cat_3'"),
    "eq_bool": ([P("flag", Op.EQ, True)], "flag"),
    "eq_big_int": ([P("big_id", Op.EQ, 18014398509481986)], "big_id = 18014398509481986"),
    "ne_int": ([P("year_n", Op.NE, 2007)], "year_n <> 2007"),
    "ne_string": ([P("category_n", Op.NE, "cat_3")], "category_n <> 'cat_3'"),
    "ne_bool": ([P("flag", Op.NE, True)], "NOT flag"),
    "lt": ([P("year_n", Op.LT, 2010)], "year_n < 2010"),
    "le": ([P("lat", Op.LE, 38.4)], "lat <= CAST(38.4 AS FLOAT)"),
    "gt": ([P("lat", Op.GT, 44.3)], "lat > CAST(44.3 AS FLOAT)"),
    "ge": ([P("big_id", Op.GE, 18014398509481988)], "big_id >= 18014398509481988"),
    "lt_beyond_range": ([P("year_n", Op.LT, 1e12)], "year_n IS NOT NULL"),
    "between": ([P("year_n", Op.BETWEEN, 2010, 2015)], "year_n BETWEEN 2010 AND 2015"),
    "prefix": ([P("category", Op.PREFIX, "rare")], "starts_with(category, 'rare')"),
    "in_int": ([P("year", Op.IN, values=("2001", "2003", "no number", "2005"))], "year IN (2001, 2003, 2005)"),
    "in_string": ([P("category", Op.IN, values=("cat_1", "rare_zz"))], "category IN ('cat_1', 'rare_zz')"),
    "not_in_int": ([P("year_n", Op.NOT_IN, values=(2001, 2003))], "year_n NOT IN (2001, 2003)"),
    "not_in_string": ([P("category_n", Op.NOT_IN, values=("cat_1", "cat_2"))], "category_n NOT IN ('cat_1', 'cat_2')"),
    "not_in_nothing": ([P("category_n", Op.NOT_IN)], "category_n IS NOT NULL"),
    "set_contains": ([P("tags", Op.CONTAINS, "x5")], "list_contains(tags, 'x5')"),
    "set_any": ([P("tags", Op.CONTAINS_ANY, values=("rare_tag", "tag_1"))], "list_has_any(tags, ['rare_tag', 'tag_1'])"),
    "set_all": ([P("tags", Op.CONTAINS_ALL, values=("x5", "tag_2"))], "list_has_all(tags, ['x5', 'tag_2'])"),
    "set_all_of_nothing": ([P("tags", Op.CONTAINS_ALL)], "tags IS NOT NULL"),
    "geo_box": ([P("lat", Op.GEO_BOX, lng_column="lng", geo=(38.0, 41.0, -121.95, -121.65))], "CAST(lat AS DOUBLE) BETWEEN 38.0 AND 41.0 AND CAST(lng AS DOUBLE) BETWEEN -121.95 AND -121.65"),
    "geo_radius": ([P("lat", Op.GEO_RADIUS, lng_column="lng", geo=(40.0, -121.8, 150.0))], _RADIUS),
    "is_null": ([P("year_n", Op.IS_NULL)], "year_n IS NULL"),
    "is_not_null": ([P("category_n", Op.IS_NOT_NULL)], "category_n IS NOT NULL"),
    "conjunction": ([P("year", Op.GE, 2010), P("category", Op.NE, "cat_3"), P("tags", Op.CONTAINS, "tag_1"), P("flag", Op.EQ, False)], "year >= 2010 AND category <> 'cat_3' AND list_contains(tags, 'tag_1') AND NOT flag"),
}


def _register_filters() -> None:
    for name, (predicates, where) in FILTER_CASES.items():

        def rows(spark, sf, predicates=predicates):
            return matches(corpus(spark, sf), predicates).select("row_id")

        def knn(spark, sf, predicates=predicates):
            return exact_knn(query_set(spark, sf), corpus(spark, sf), K, predicates=predicates)

        register(f"filter_{name}", f"WITH {SQL_BASE} SELECT row_id FROM base WHERE {where}")(rows)
        register(f"filtered_knn_{name}", knn_sql(where=where))(knn)


_register_filters()


@register("filter_parsed", f"WITH {SQL_BASE} SELECT row_id FROM base WHERE year BETWEEN 2010 AND 2030 AND category IN ('cat_1', 'cat_2') AND CAST(lat AS DOUBLE) BETWEEN 37.5 AND 44.0 AND CAST(lng AS DOUBLE) BETWEEN -122.5 AND -121.0")
def filter_parsed(spark, sf):
    df = corpus(spark, sf)
    return matches(df, [parse(t, df.schema) for t in ("year:between:2010:2030", "category:in:cat_1,cat_2", "lat:lng:geo_box:37.5:44:-122.5:-121")]).select("row_id")


# --- statistics ----------------------------------------------------------------------------------------------------


@register("freq_string", f"WITH {SQL_BASE} SELECT category_n AS value, count(*) AS count FROM base WHERE category_n IS NOT NULL GROUP BY 1")
def freq_string(spark, sf):
    return stats.frequencies(corpus(spark, sf), "category_n")


@register("freq_set_elements", f"WITH {SQL_BASE} SELECT value, count(*) AS count FROM (SELECT unnest(tags) AS value FROM base) GROUP BY 1")
def freq_set_elements(spark, sf):
    return stats.frequencies(corpus(spark, sf), "tags")


@register("hist_numeric", f"WITH {SQL_BASE} SELECT year_n AS value, count(*) AS count FROM base WHERE year_n IS NOT NULL GROUP BY 1")
def hist_numeric(spark, sf):
    return stats.frequencies(corpus(spark, sf), "year_n")


@register("hist_binned_4096", "WITH r AS (SELECT min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem) SELECT CAST(least(floor((l_extendedprice - lo) / (hi - lo) * 4096), 4095) AS INTEGER) AS bin, count(*) AS count FROM lineitem, r GROUP BY 1")
def hist_binned_4096(spark, sf):
    return stats.binned(spark.read.parquet(f"{sf}/lineitem.parquet"), "l_extendedprice")


@register("freq_capped", f"WITH {SQL_BASE}, f AS (SELECT year AS value, count(*) AS count FROM base GROUP BY 1) SELECT value, count, (SELECT count(*) FROM f) > 20 AS overflowed FROM f ORDER BY count DESC, value LIMIT 20")
def freq_capped(spark, sf):
    return stats.capped(stats.frequencies(corpus(spark, sf), "year"), 20)


_CASES = ("eq_string", "eq_int", "lt", "between", "set_contains", "in_string", "ne_int", "prefix", "is_null", "eq_bool", "not_in_int")


@register(
    "selectivity_tracked",
    f"""WITH {SQL_BASE}, n AS (SELECT CAST(count(*) AS DOUBLE) AS n FROM base) SELECT * FROM (
      SELECT 'eq_string' AS name, round(count(*) FILTER (category = 'cat_3') / n, 9) AS share FROM base, n GROUP BY n
      UNION ALL SELECT 'eq_int', round(count(*) FILTER (year = 2007) / n, 9) FROM base, n GROUP BY n
      UNION ALL SELECT 'lt', round(count(*) FILTER (year_n < 2010) / n, 9) FROM base, n GROUP BY n
      UNION ALL SELECT 'between', round(count(*) FILTER (year_n BETWEEN 2010 AND 2015) / n, 9) FROM base, n GROUP BY n
      UNION ALL SELECT 'set_contains', round(count(*) FILTER (list_contains(tags, 'x5')) / n, 9) FROM base, n GROUP BY n
      UNION ALL SELECT 'in_string', round(count(*) FILTER (category IN ('cat_1', 'rare_zz')) / n, 9) FROM base, n GROUP BY n)
      UNION ALL SELECT unnest(['ne_int', 'prefix', 'is_null', 'eq_bool', 'not_in_int']), 1.0""",
)
def selectivity_tracked(spark, sf):
    s = stats.collect(corpus(spark, sf).select(*FILTERS), "on")
    return spark.createDataFrame([(c, round(stats.selectivity(FILTER_CASES[c][0][0], s), 9)) for c in _CASES], "name string, share double")


@register("selectivity_untracked", f"WITH {SQL_BASE} SELECT unnest(['eq_string', 'lt']) AS name, unnest([round(1.0::DOUBLE / count(*), 9), 1.0::DOUBLE]) AS share FROM base")
def selectivity_untracked(spark, sf):
    s = stats.collect(corpus(spark, sf).select(*FILTERS), "off")
    return spark.createDataFrame([(c, round(stats.selectivity(FILTER_CASES[c][0][0], s), 9)) for c in ("eq_string", "lt")], "name string, share double")


@register("hll_distinct")
def hll_distinct(spark, sf):
    """Estimates against exact counts, and merged partial sketches against whole ones."""
    df = spark.read.parquet(f"{sf}/lineitem.parquet")
    exact = df.agg(F.count_distinct("l_partkey").alias("exact")).first()[0]
    whole = stats.distinct_estimate(df, "l_partkey")
    parts = stats.merged(stats.sketches(df, "l_partkey", ["l_returnflag"])).first()[0]
    return spark.createDataFrame([("l_partkey", abs(whole - exact) <= 0.05 * exact, abs(parts - whole) <= 0.05 * whole)], "name string, within_five_percent boolean, merge_agrees boolean")


# --- summaries -----------------------------------------------------------------------------------------------------

_SETS = "list_sort(list(DISTINCT {c}) FILTER ({c} IS NOT NULL))"


@register(
    "leaf_summary",
    f"WITH {SQL_BASE} SELECT label, count(*) AS rows, min(year_n) AS year_n__min, max(year_n) AS year_n__max, min(lat) AS lat__min, max(lat) AS lat__max, array_to_string({_SETS.format(c='category_n')}, ',') AS category_n__set, (SELECT array_to_string(list_sort(list(DISTINCT t)), ',') FROM (SELECT unnest(tags) AS t FROM base b WHERE b.label = base.label)) AS tags__set FROM base GROUP BY label",
)
def leaf_summary(spark, sf):
    rows = corpus(spark, sf).select("label", "year_n", "lat", "category_n", "tags")
    out = summary.leaf_summaries(rows, ["label"])
    return out.withColumns({c: F.array_join(c, ",") for c in ("category_n__set", "tags__set")})


@register("leaf_summary_parents", f"WITH {SQL_BASE} SELECT label % 3 AS parent, count(*) AS rows, min(year_n) AS year_n__min, max(year_n) AS year_n__max, array_to_string({_SETS.format(c='category_n')}, ',') AS category_n__set FROM base GROUP BY 1")
def leaf_summary_parents(spark, sf):
    leaves = summary.leaf_summaries(corpus(spark, sf).select("label", "year_n", "category_n"), ["label"]).withColumn("parent", F.col("label") % 3)
    return summary.parent_summaries(leaves.drop("label"), "parent").withColumn("category_n__set", F.array_join("category_n__set", ","))


@register(
    "leaf_prune",
    f"""WITH {SQL_BASE}, leaf AS (SELECT row_id // 25 AS leaf_id, min(year) AS y0, max(year) AS y1, min(lat) AS a0, max(lat) AS a1, list(DISTINCT category) AS cs, flatten(list(tags)) AS ts FROM base GROUP BY 1)
    SELECT 'between' AS name, leaf_id FROM leaf WHERE y0 <= 2015 AND y1 >= 2010 UNION ALL SELECT 'eq_float32', leaf_id FROM leaf WHERE a0 <= CAST(37.1 AS FLOAT) AND a1 >= CAST(37.1 AS FLOAT)
    UNION ALL SELECT 'prefix', leaf_id FROM leaf WHERE len(list_filter(cs, lambda c: starts_with(c, 'rare'))) > 0 UNION ALL SELECT 'set_any', leaf_id FROM leaf WHERE list_has_any(ts, ['rare_tag', 'tag_1'])
    UNION ALL SELECT 'ne_string', leaf_id FROM leaf""",
)
def leaf_prune(spark, sf):
    df = corpus(spark, sf).withColumn("leaf_id", F.floor(F.col("row_id") / 25).cast("long"))
    leaves = checkpointed(summary.leaf_summaries(df.select("leaf_id", "year", "lat", "category", "tags"), ["leaf_id"]))
    cases = {"between": P("year", Op.BETWEEN, 2010, 2015), "eq_float32": P("lat", Op.EQ, 37.1), "prefix": P("category", Op.PREFIX, "rare"), "set_any": P("tags", Op.CONTAINS_ANY, values=("rare_tag", "tag_1")), "ne_string": P("category", Op.NE, "cat_3")}
    out = None
    for name, p in cases.items():
        rows = summary.surviving(leaves, [p], df.schema).select(F.lit(name).alias("name"), "leaf_id")
        out = rows if out is None else out.unionByName(rows)
    return out


# --- routing over clusters that the data defines ---------------------------------------------------------------------

_CENTRES = f"dims AS (SELECT label, generate_subscripts(embedding, 1) AS i, CAST(unnest(embedding) AS DOUBLE) AS x FROM base), mean AS (SELECT label, i, round(avg(x), 6) AS m FROM dims GROUP BY 1, 2), weights AS (SELECT label, count(*) AS weight FROM base GROUP BY 1), centres AS (SELECT label AS cluster_id, list(m ORDER BY i) AS c, any_value(weight) AS weight FROM mean JOIN weights USING (label) GROUP BY 1), scored AS (SELECT query_id, cluster_id, weight, {l2('q', 'c')} AS dist FROM centres, queries)"


def label_centres(spark, sf) -> DataFrame:
    """Clusters by label: (cluster_id, weight, centroid), components rounded so that the order of adding doesn't show."""
    rows = corpus(spark, sf).select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg(F.round(F.avg(F.col("x").cast("double")), 6).alias("m"))
    c = rows.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda t: t["m"]).alias("centroid"))
    return c.join(corpus(spark, sf).groupBy("label").agg(F.count("*").alias("weight")), "label").withColumnRenamed("label", "cluster_id")


def label_scores(spark, sf) -> DataFrame:
    q = F.broadcast(query_set(spark, sf).withColumnRenamed("embedding", "query"))
    return label_centres(spark, sf).join(q, F.lit(True)).select("query_id", "cluster_id", "weight", distance(F.col("query"), F.col("centroid"), L2).alias("dist"))


@register("probe_count", f"WITH {SQL_BASE}, {_CENTRES} SELECT query_id, cluster_id FROM scored QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY dist, cluster_id) <= 3")
def probe_count(spark, sf):
    return routing.by_count(label_scores(spark, sf), 3).select("query_id", "cluster_id")


@register(
    "probe_fraction",
    f"WITH {SQL_BASE}, {_CENTRES}, w AS (SELECT *, sum(weight) OVER (PARTITION BY query_id ORDER BY dist, cluster_id ROWS UNBOUNDED PRECEDING) - weight AS before, row_number() OVER (PARTITION BY query_id ORDER BY dist, cluster_id) AS rn, floor(0.3 * sum(weight) OVER (PARTITION BY query_id)) AS budget FROM scored) SELECT query_id, cluster_id FROM w WHERE before < budget OR rn = 1",
)
def probe_fraction(spark, sf):
    return routing.by_fraction(label_scores(spark, sf), 0.3).select("query_id", "cluster_id")


@register(
    "probe_gap",
    f"WITH {SQL_BASE}, {_CENTRES}, w AS (SELECT *, row_number() OVER o AS rn, CASE WHEN dist > 1.05 * lag(dist) OVER o THEN 1 ELSE 0 END AS wide FROM scored WINDOW o AS (PARTITION BY query_id ORDER BY dist, cluster_id)), s AS (SELECT *, max(wide) OVER (PARTITION BY query_id ORDER BY rn ROWS UNBOUNDED PRECEDING) AS stopped FROM w) SELECT query_id, cluster_id FROM s WHERE stopped = 0 AND rn <= 8",
)
def probe_gap(spark, sf):
    return routing.by_count(label_scores(spark, sf), 8, gap=1.05).select("query_id", "cluster_id")


@register(
    "probe_descent",
    f"WITH {SQL_BASE}, {_CENTRES}, top AS (SELECT query_id, cluster_id % 3 AS parent_id, min(dist) AS dist FROM scored GROUP BY 1, 2), chosen AS (SELECT * FROM top QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY dist, parent_id) <= 2) SELECT s.query_id, s.cluster_id FROM scored s JOIN chosen c ON s.query_id = c.query_id AND s.cluster_id % 3 = c.parent_id QUALIFY row_number() OVER (PARTITION BY s.query_id ORDER BY s.dist, s.cluster_id) <= 3",
)
def probe_descent(spark, sf):
    scored = label_scores(spark, sf).withColumn("parent_id", F.col("cluster_id") % 3)
    tops = scored.groupBy("query_id", F.col("parent_id").alias("cluster_id")).agg(F.min("dist").alias("dist"), F.sum("weight").alias("weight"))
    return routing.descend(routing.by_count(tops, 2), scored, 3).select("query_id", "cluster_id")


@register(
    "probe_plane",
    f"""WITH {SQL_BASE}, member AS (SELECT query_id, label AS leaf_id, max({dot('q', 'embedding')}) AS score FROM base, queries GROUP BY 1, 2), weights AS (SELECT label AS leaf_id, count(*) AS weight FROM base GROUP BY 1),
    w AS (SELECT m.*, weight, sum(weight) OVER (PARTITION BY query_id ORDER BY score DESC, leaf_id ROWS UNBOUNDED PRECEDING) - weight AS before, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, leaf_id) AS rn, (SELECT sum(weight) FROM weights) AS total FROM member m JOIN weights USING (leaf_id)) SELECT query_id, leaf_id FROM w WHERE before < 0.25 * total - 0.5 OR rn = 1""",
)
def probe_plane(spark, sf):
    df = corpus(spark, sf)
    members = nearest(query_set(spark, sf), df, 1, IP, group="label").select("query_id", F.col("label").alias("leaf_id"), (-F.col("dist")).alias("score"))
    leaves = df.groupBy(F.col("label").alias("leaf_id")).agg(F.count("*").alias("weight"))
    return routing.by_plane(members, leaves, 0.25).select("query_id", "leaf_id")


@register("closure_replicas", f"WITH {SQL_BASE}, {_CENTRES}, d AS (SELECT row_id, cluster_id, {l2('embedding', 'c')} AS dist FROM base, centres) SELECT row_id, cluster_id FROM d QUALIFY dist - min(dist) OVER (PARTITION BY row_id) <= 0.05")
def closure_replicas(spark, sf):
    pairs = corpus(spark, sf).select("row_id", "embedding").join(F.broadcast(label_centres(spark, sf)), F.lit(True))
    return training.closure_by_distance(pairs.select("row_id", "cluster_id", distance(F.col("embedding"), F.col("centroid"), L2).alias("dist")), 0.05).select("row_id", "cluster_id")


@register("leaf_chunks", f"WITH {SQL_BASE} SELECT label, row_id, (row_number() OVER (PARTITION BY label ORDER BY row_id) - 1) // 16 AS chunk FROM base")
def leaf_chunks(spark, sf):
    rn = F.row_number().over(Window.partitionBy("label").orderBy("row_id")) - 1
    return corpus(spark, sf).select("label", "row_id", F.floor(rn / 16).cast("long").alias("chunk"))


@register(
    "uniform_ruler_codes",
    "WITH dims AS (SELECT vec_id, generate_subscripts(embedding, 1) AS i, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings), ruler AS (SELECT i, round(avg(x), 6) AS m, round(stddev_pop(x), 6) AS s FROM dims GROUP BY 1) SELECT vec_id AS row_id, CAST(sum(least(15, greatest(0, floor((x - (m - 2.7 * s)) / greatest(5.4 * s / 15, 1e-8) + 0.5)))) AS BIGINT) AS code_sum FROM dims JOIN ruler USING (i) GROUP BY 1",
)
def uniform_ruler_codes(spark, sf):
    """16 even levels a dimension over mean +- 2.7 deviations, as column expressions; the sum of a row's codes."""
    dims = embeddings(spark, sf).select(F.col("vec_id").alias("row_id"), F.posexplode("embedding").alias("i", "x")).withColumn("x", F.col("x").cast("double"))
    ruler = dims.groupBy("i").agg(F.round(F.avg("x"), 6).alias("m"), F.round(F.stddev_pop("x"), 6).alias("s"))
    code = F.least(F.lit(15), F.greatest(F.lit(0), F.floor((F.col("x") - (F.col("m") - 2.7 * F.col("s"))) / F.greatest(F.lit(5.4) * F.col("s") / 15, F.lit(1e-8)) + 0.5)))
    return dims.join(F.broadcast(ruler), "i").groupBy("row_id").agg(F.sum(code).cast("long").alias("code_sum"))


# --- ranking -------------------------------------------------------------------------------------------------------

_CUT = """, first AS (SELECT query_id, min(dist) AS d0, max(dist) FILTER (rank = 10) AS dk FROM knn GROUP BY 1), m AS (SELECT knn.*, CASE WHEN rank > 10 AND dist - dk > 1.5 * greatest((dk - d0) / 9, 1e-12) THEN 1 ELSE 0 END AS far FROM knn JOIN first USING (query_id)),
  e AS (SELECT *, max(far) OVER (PARTITION BY query_id ORDER BY rank ROWS UNBOUNDED PRECEDING) AS ended FROM m) SELECT query_id, rank, row_id, dist FROM e WHERE ended = 0"""


@register("adaptive_cut", knn_sql(60, tail=_CUT).replace("WHERE rn <= 60)\n      ,", "WHERE rn <= 60),"))
def adaptive_cut(spark, sf):
    rows = exact_knn(query_set(spark, sf), corpus(spark, sf), 60).drop("rank")
    return topk.adaptive_cut(rows, K, 1.5).select("query_id", "rank", "row_id", "dist")


@register("dedup_replicas", knn_sql(30, tail=", twice AS (SELECT query_id, row_id, dist + extra AS dist FROM knn, (SELECT unnest([0.0::DOUBLE, 0.25::DOUBLE]) AS extra)) SELECT query_id, row_id, min(dist) AS dist FROM twice GROUP BY 1, 2").replace("WHERE rn <= 30)\n      ,", "WHERE rn <= 30),"))
def dedup_replicas(spark, sf):
    rows = exact_knn(query_set(spark, sf), corpus(spark, sf), 30)
    return topk.deduplicated(rows.withColumn("extra", F.explode(F.array(F.lit(0.25), F.lit(0.0)))).select("query_id", "row_id", (F.col("dist") + F.col("extra")).alias("dist")))


_SWEEP = f"""WITH {SQL_BASE}, s AS (SELECT query_id, row_id, round({l2('q', 'embedding')}, 1) AS scan_key, {l2('q', 'embedding')} AS dist FROM base, queries), n AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY scan_key, row_id) AS sr FROM s),
  e AS (SELECT width, query_id, row_id, min(dist) AS dist FROM n, (SELECT unnest([10, 20, 50]) AS width) WHERE sr <= width GROUP BY 1, 2, 3) SELECT CAST(width AS INTEGER) AS width, query_id, CAST(row_number() OVER (PARTITION BY width, query_id ORDER BY dist, row_id DESC) AS INTEGER) AS rank, row_id, dist FROM e QUALIFY row_number() OVER (PARTITION BY width, query_id ORDER BY dist, row_id DESC) <= 10"""


@register("w_sweep", _SWEEP)
def w_sweep(spark, sf):
    scanned = nearest(query_set(spark, sf), corpus(spark, sf), 50, digits=1, newest=False).withColumn("scan_key", F.round("dist", 1))
    return topk.width_sweep(scanned, [10, 20, 50], K).select("width", "query_id", "rank", "row_id", "dist")


# --- evaluation ----------------------------------------------------------------------------------------------------

_HALF = "half AS (SELECT query_id, row_id, dist, row_number() OVER (PARTITION BY query_id ORDER BY dist, row_id DESC) AS rank FROM measured WHERE row_id % 3 <> 1)"


def _half(spark, sf) -> DataFrame:
    """Results of an engine that has lost a third of the rows."""
    return exact_knn(query_set(spark, sf), corpus(spark, sf).where("row_id % 3 <> 1"), K)


@register("recall_at_k", knn_sql(tail=f", {_HALF} SELECT (SELECT count(*) FROM knn SEMI JOIN (SELECT * FROM half WHERE rank <= 10) h USING (query_id, row_id)) / (SELECT count(DISTINCT query_id) * 10.0::DOUBLE FROM knn) AS recall").replace("WHERE rn <= 10)\n      ,", "WHERE rn <= 10),"))
def recall_at_k(spark, sf):
    return evaluate.recall_at_k(_half(spark, sf), exact_knn(query_set(spark, sf), corpus(spark, sf), K), K)


@register(
    "filtered_recall",
    knn_sql(100, tail=f", {_HALF}, ft AS (SELECT knn.query_id, knn.row_id FROM knn JOIN base USING (row_id) WHERE year >= 2025 QUALIFY row_number() OVER (PARTITION BY knn.query_id ORDER BY knn.rank) <= 10), e AS (SELECT ft.query_id, sum(CASE WHEN h.row_id IS NULL THEN 0 ELSE 1 END) / count(*)::DOUBLE AS share FROM ft LEFT JOIN (SELECT * FROM half WHERE rank <= 10) h USING (query_id, row_id) GROUP BY 1) SELECT round(avg(share), 9) AS recall FROM e").replace("WHERE rn <= 100)\n      ,", "WHERE rn <= 100),"),
)
def filtered_recall(spark, sf):
    df = corpus(spark, sf)
    out = evaluate.filtered_recall(_half(spark, sf), exact_knn(query_set(spark, sf), df, 100), df.where("year >= 2025").select("row_id"), K)
    return out.select(F.round("recall", 9).alias("recall"))


@register("proximity_in_band", knn_sql(tail=f", {_HALF}, kth AS (SELECT query_id, dist AS kth FROM knn WHERE rank = 10) SELECT round(avg(CASE WHEN half.dist <= kth THEN 1.0 ELSE 0.0 END), 9) AS in_band FROM half JOIN kth USING (query_id) WHERE rank <= 10").replace("WHERE rn <= 10)\n      ,", "WHERE rn <= 10),"))
def proximity_in_band(spark, sf):
    return evaluate.proximity(_half(spark, sf), exact_knn(query_set(spark, sf), corpus(spark, sf), K), K).select(F.round("in_band", 9).alias("in_band"))


@register("ties_at_k", knn_sql(50, dist=f"round({l2('q', 'embedding')}, 1)", tail=", kth AS (SELECT query_id, dist AS kth FROM knn WHERE rank = 10) SELECT query_id, count(*) AS ties FROM knn JOIN kth USING (query_id) WHERE dist = kth GROUP BY 1").replace("WHERE rn <= 50)\n      ,", "WHERE rn <= 50),"))
def ties_at_k(spark, sf):
    rounded = nearest(query_set(spark, sf), corpus(spark, sf), 50, digits=1).withColumn("dist", F.round("dist", 1))
    return evaluate.ties_at_k(topk.ranked(rounded, 50), K)


@register(
    "routing_containment",
    f"WITH {SQL_BASE}, {_CENTRES}, w AS (SELECT *, sum(weight) OVER (PARTITION BY query_id ORDER BY dist, cluster_id ROWS UNBOUNDED PRECEDING) - weight AS before, row_number() OVER (PARTITION BY query_id ORDER BY dist, cluster_id) AS rn, floor(0.4 * sum(weight) OVER (PARTITION BY query_id)) AS budget FROM scored), v AS (SELECT query_id, cluster_id FROM w WHERE before < budget OR rn = 1), t AS (SELECT query_id, row_id, label FROM base, queries QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY {l2('q', 'embedding')}, row_id DESC) <= 10) SELECT round(avg(CASE WHEN v.cluster_id IS NULL THEN 0.0 ELSE 1.0 END), 9) AS contained FROM t LEFT JOIN v ON t.query_id = v.query_id AND t.label = v.cluster_id",
)
def routing_containment(spark, sf):
    df = corpus(spark, sf)
    out = evaluate.containment(exact_knn(query_set(spark, sf), df, K), df.select("row_id", F.col("label").alias("leaf_id")), label_scores(spark, sf), 0.4, K)
    return out.select(F.round("contained", 9).alias("contained"))


@register("zipf_queries", None)
def zipf_queries(spark, sf):
    return evaluate.zipf_queries(corpus(spark, sf), 200).groupBy("row_id").agg(F.count("*").alias("drawn"))


_BLOCKS = "blocks AS (SELECT o_custkey % 20 AS query_id, row_number() OVER (PARTITION BY o_custkey % 20 ORDER BY o_orderkey) AS block, 1 + o_orderkey % 5 AS weight, CASE WHEN o_orderkey % 7 < 4 THEN 1 ELSE 0 END AS entered FROM orders)"


@register(
    "trace_replay",
    f"WITH {_BLOCKS}, a AS (SELECT *, sum(weight) OVER (PARTITION BY query_id) AS total, sum(weight) OVER o AS seen, row_number() OVER o AS pos, coalesce(max(CASE WHEN entered > 0 THEN block END) OVER o, 0) AS last FROM blocks WINDOW o AS (PARTITION BY query_id ORDER BY block ROWS UNBOUNDED PRECEDING)), "
    "f AS (SELECT query_id, 'fixed' AS rule, min(pos) FILTER (seen >= floor(0.25 * total)) AS halt FROM a GROUP BY 1 UNION ALL SELECT query_id, 'stall', min(pos) FILTER (pos - last >= 3 AND pos >= 5) FROM a GROUP BY 1) "
    "SELECT rule, a.query_id, count(*) AS blocks, round(sum(weight) / any_value(total)::DOUBLE, 9) AS fraction FROM a JOIN f USING (query_id) WHERE halt IS NULL OR pos <= halt GROUP BY 1, 2",
)
def trace_replay(spark, sf):
    o = spark.read.parquet(f"{sf}/orders.parquet")
    w = Window.partitionBy("query_id").orderBy("o_orderkey")
    blocks = o.withColumn("query_id", F.col("o_custkey") % 20).select("query_id", F.row_number().over(w).alias("block"), (1 + F.col("o_orderkey") % 5).alias("weight"), F.when(F.col("o_orderkey") % 7 < 4, 1).otherwise(0).alias("entered"), F.lit(None).cast("double").alias("kth"))
    runs = [routing.replayed(blocks, "fixed", 0.25, K).withColumn("rule", F.lit("fixed")), routing.replayed(blocks, "stall", 3, K, min_blocks=5).withColumn("rule", F.lit("stall"))]
    return runs[0].unionByName(runs[1]).select("rule", "query_id", "blocks", F.round("fraction", 9).alias("fraction"))


# --- the index -----------------------------------------------------------------------------------------------------

SMALL = {"leaf_capacity": 40, "k_root": 8, "passes": 3, "pca_dims": 16}
EXHAUSTIVE = SearchOptions(exhaustive=True, width=1 << 20)


def built(spark, sf, **options) -> Index:
    """An index of the demonstration corpus with several small leaves."""
    return Index.build(corpus(spark, sf), fresh(spark, "index"), BuildOptions(**{**SMALL, **options}), payload="payload")


def _register_families() -> None:
    for name in quantizers.FAMILIES:

        def exhaustive(spark, sf, name=name):
            index = built(spark, sf, quantizer=name, m=16 if "pq" in name else None, bits=4)
            return index.search(query_set(spark, sf), K, options=EXHAUSTIVE)

        register(f"ann_exhaustive_{name}", knn_sql())(exhaustive)


_register_families()


@register("ann_exhaustive_depth3_ip", knn_sql(dist=f"-({dot('q', 'embedding')})"))
def ann_exhaustive_depth3_ip(spark, sf):
    return built(spark, sf, metric=IP, depth=3, k_top=4).search(query_set(spark, sf), K, options=EXHAUSTIVE)


@register("ann_filtered_exhaustive", knn_sql(where=FILTER_CASES["conjunction"][1]))
def ann_filtered_exhaustive(spark, sf):
    return built(spark, sf, statistics="on").search(query_set(spark, sf), K, FILTER_CASES["conjunction"][0], EXHAUSTIVE)


@register("ann_filter_directed", knn_sql(where="year BETWEEN 2010 AND 2014"))
def ann_filter_directed(spark, sf):
    """A filter that lets a tenth through: every leaf whose summary matches is visited."""
    return built(spark, sf, statistics="on").search(query_set(spark, sf), K, [P("year", Op.BETWEEN, 2010, 2014)], SearchOptions(width=1 << 20))


@register("ann_filter_scan", knn_sql(where="category = 'rare_zz'"))
def ann_filter_scan(spark, sf):
    """A filter that lets one row through: the rows are measured directly."""
    return built(spark, sf, statistics="on").search(query_set(spark, sf), K, [P("category", Op.EQ, "rare_zz")])


@register("ann_per_query_filters", f"WITH {SQL_BASE}, m AS (SELECT query_id, row_id, {l2('q', 'embedding')} AS dist FROM base, queries WHERE (query_id = 50 AND year >= 2030) OR (query_id = 100) OR (query_id NOT IN (50, 100) AND flag)) SELECT query_id, CAST(rn AS INTEGER) AS rank, row_id, dist FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY dist, row_id DESC) AS rn FROM m) WHERE rn <= 10")
def ann_per_query_filters(spark, sf):
    own = SearchOptions(exhaustive=True, width=1 << 20, per_query={50: [P("year", Op.GE, 2030)], 100: []})
    return built(spark, sf).search(query_set(spark, sf), K, [P("flag", Op.EQ, True)], own)


@register("payload_fetch", knn_sql(tail="SELECT query_id, rank, row_id, dist, concat('payload_', row_id) AS payload FROM knn"))
def payload_fetch(spark, sf):
    found = built(spark, sf).search(query_set(spark, sf), K, options=SearchOptions(exhaustive=True, width=1 << 20, with_payload=True))
    return found.withColumn("payload", F.col("payload").cast("string"))


@register("vector_fetch", knn_sql(tail="SELECT knn.query_id, rank, knn.row_id, dist, round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE))), 9) AS total FROM knn JOIN base USING (row_id)"))
def vector_fetch(spark, sf):
    found = built(spark, sf).search(query_set(spark, sf), K, options=SearchOptions(exhaustive=True, width=1 << 20, with_vectors=True))
    return found.select("query_id", "rank", "row_id", "dist", F.round(F.aggregate("vector", F.lit(0.0), lambda t, x: t + x.cast("double")), 9).alias("total"))


@register("delete_rows", knn_sql(where="row_id % 4 <> 1"))
def delete_rows(spark, sf):
    index, _ = built(spark, sf).delete(corpus(spark, sf).where("row_id % 4 = 1").select("row_id"))
    return index.vacuum().search(query_set(spark, sf), K, options=EXHAUSTIVE)


@register("insert_rows", knn_sql())
def insert_rows(spark, sf):
    """An index of half the rows takes the others; crowded leaves are split."""
    df = corpus(spark, sf)
    index = Index.build(df.where("row_id % 2 = 0"), fresh(spark, "index"), BuildOptions(**SMALL), payload="payload")
    index.insert(df.where("row_id % 2 = 1").withColumn("payload", F.col("payload").cast("binary")))
    return index.search(query_set(spark, sf), K, options=EXHAUSTIVE)


@register("push_build", knn_sql())
def push_build(spark, sf):
    b = IndexBuilder(spark, fresh(spark, "index"), BuildOptions(**SMALL), payload="payload")
    for part in range(3):
        b.push(corpus(spark, sf).where(f"row_id % 3 = {part}"))
    return b.finish().search(query_set(spark, sf), K, options=EXHAUSTIVE)


@register("index_check", "SELECT unnest(['members_without_leaf', 'leaf_counts', 'rows_without_member', 'members_without_row', 'repeated_in_leaf', 'repeated_rows', 'repeated_leaves']) AS test, CAST(0 AS BIGINT) AS problems")
def index_check(spark, sf):
    index, _ = built(spark, sf).delete(corpus(spark, sf).where("row_id < 20").select("row_id"))
    return index.compact().check()


@register("live_rows", "SELECT count(*) AS rows, TRUE AS replicas_counted FROM embeddings")
def live_rows(spark, sf):
    return built(spark, sf).counts().select("rows", (F.col("slots") >= F.col("rows")).alias("replicas_counted"))


@register("ann_default_probe", None)
def ann_default_probe(spark, sf):
    """Recall of searches that visit a part of the index."""
    df, q = corpus(spark, sf), query_set(spark, sf)
    truth, index = checkpointed(exact_knn(q, df, K)), built(spark, sf)
    return evaluate.sweep(lambda **o: index.search(q, K, options=SearchOptions(**o)), truth, K, [{"n_probe": 2}, {"n_probe": 6}, {"fraction": 0.3}, {"fraction": 0.7, "rerank": "decoded"}])


@register("ann_plane_routed", None)
def ann_plane_routed(spark, sf):
    df, q = corpus(spark, sf), query_set(spark, sf)
    truth, index = checkpointed(exact_knn(q, df, K)), built(spark, sf, plane="level")
    return evaluate.sweep(lambda **o: index.search(q, K, options=SearchOptions(**o)), truth, K, [{"fraction": 0.3, "plane_keep": None}, {"fraction": 0.3, "plane_keep": 0.6}, {"fraction": 0.3, "use_plane": False}])


@register("feedback_probing", None)
def feedback_probing(spark, sf):
    """How much of the index three stopping rules visit on the traces of its own clusters."""
    blocks = checkpointed(built(spark, sf).feedback_blocks(query_set(spark, sf), K))
    out = None
    for rule, amount in (("fixed", 0.5), ("stall", 2), ("kth", 2)):
        part = routing.replayed(blocks, rule, amount, K, 2).agg(F.avg("blocks").alias("blocks"), F.avg("fraction").alias("fraction")).select(F.lit(rule).alias("rule"), "blocks", "fraction")
        out = part if out is None else out.unionByName(part)
    return out


@register("quantizer_distortion", None)
def quantizer_distortion(spark, sf):
    """Median relative error of decoded distances over the true ten nearest, and their correlation, by code size."""
    df, q = corpus(spark, sf), query_set(spark, sf)
    truth = checkpointed(exact_knn(q, df, K))
    out = None
    for m in (8, 16, 32):
        index = built(spark, sf, quantizer="pq", m=m, bits=4)
        decoded = index.estimates(truth, q).groupBy("query_id", "row_id").agg(F.min("estimate").alias("estimate"))
        both = truth.join(decoded, ["query_id", "row_id"])
        row = evaluate.distortion(both).join(evaluate.correlation(both), F.lit(True)).select(F.lit(m).alias("m"), "distortion", "correlation")
        out = row if out is None else out.unionByName(row)
    return out


@register("code_sizes", None)
def code_sizes(spark, sf):
    return explore.code_report(corpus(spark, sf), [(8, 4), (16, 4), (32, 4), (16, 6)], bound=0.08)


@register("search_stats", "SELECT count(*) FILTER (vec_id % 50 = 0) AS queries, TRUE AS each_leaf_once, TRUE AS rows_fit FROM embeddings")
def search_stats(spark, sf):
    """What an exhaustive search of all queries reads: every leaf once, every slot for each query."""
    index = built(spark, sf)
    s = index.search_stats(query_set(spark, sf), EXHAUSTIVE)
    n = index.info()
    return s.select("queries", (F.col("leaves") == n["leaves"]).alias("each_leaf_once"), (F.col("rows") == n["live"] * F.col("queries")).alias("rows_fit"))


# --- sources -------------------------------------------------------------------------------------------------------

_ALL = "SELECT vec_id AS row_id, round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE))), 9) AS total FROM embeddings"


def _totals(df: DataFrame) -> DataFrame:
    return df.select("row_id", F.round(F.aggregate("embedding", F.lit(0.0), lambda t, x: t + x.cast("double")), 9).alias("total"))


def _local(spark, name: str) -> str:
    import os

    path = fresh(spark, name).removeprefix("file:")
    os.makedirs(path)
    return path


@register("fbin_scan", _ALL)
def fbin_scan(spark, sf):
    path = _local(spark, "fbin")
    files.write_fbin(corpus(spark, sf).select("row_id", "embedding"), f"{path}/all.fbin")
    return _totals(files.read_vectors(spark, f"{path}/*.fbin", rows_per_task=64))


@register("truth_file", knn_sql(tail="SELECT query_id // 50 AS query_id, rank, row_id, CAST(CAST(dist AS FLOAT) AS DOUBLE) AS dist FROM knn"))
def truth_file(spark, sf):
    path = f"{_local(spark, 'truth')}/t.gtmm"
    files.write_truth(exact_knn(query_set(spark, sf), corpus(spark, sf), K), path)
    return files.read_truth(spark, path)


@register("truth_lists", knn_sql(tail="SELECT query_id, rank, row_id FROM knn"))
def truth_lists(spark, sf):
    knn = exact_knn(query_set(spark, sf), corpus(spark, sf), K)
    lists = knn.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "row_id"))), lambda x: x["row_id"]).alias("neighbors_id"))
    return files.truth_from_lists(lists)


@register("positional_label_join", "SELECT p_partkey AS row_id, p_partkey, p_brand FROM part")
def positional_label_join(spark, sf):
    part = files.with_positions(spark.read.parquet(f"{sf}/part.parquet"))
    return files.positional_join(part.select("row_id", "p_partkey"), part.select("row_id", "p_brand"), ["p_brand"])


@register("converted_file", "WITH h AS (SELECT vec_id, (vec_id::HUGEINT * 2654435761 % 4294967296)::BIGINT AS h FROM embeddings) SELECT vec_id AS row_id, concat('cat_', h % 16) AS category, CAST(2015 + (h // 16) % 10 AS INTEGER) AS year, CAST(h / 4294967296.0::DOUBLE AS FLOAT) AS score FROM h")
def converted_file(spark, sf):
    """A counted file turned into Parquet with fixed-length vectors and demonstration columns, and read again."""
    path = _local(spark, "convert")
    files.write_fbin(corpus(spark, sf).select("row_id", "embedding"), f"{path}/all.fbin")
    files.vectors_to_parquet(spark, f"{path}/all.fbin", f"{path}/parquet", fixed=True)
    return spark.read.parquet(f"{path}/parquet").select("row_id", "category", "year", "score")


@register("parquet_fixed_bytes", _ALL)
def parquet_fixed_bytes(spark, sf):
    """Vectors stored as bytes, with filter columns and a payload, in several files."""
    path = fresh(spark, "fixed")
    corpus(spark, sf).repartitionByRange(3, "row_id").sortWithinPartitions("row_id").transform(files.to_fixed).drop("row_id").write.parquet(path)
    return _totals(files.read_parquet(spark, path, payload="payload"))
