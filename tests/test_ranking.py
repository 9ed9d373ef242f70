import numpy as np
import pytest
from pyspark.sql import functions as F

from vectorloom.operators import evaluate, exact, routing, stats, summary, topk
from vectorloom.functions.predicates import Op, Predicate as P, matches

RNG = np.random.default_rng(3)


@pytest.fixture(scope="module")
def data(spark):
    x = RNG.normal(size=(300, 12)).astype(np.float32)
    x[200:210] = x[100]  # ties
    base = spark.createDataFrame([(i, v.tolist(), i % 5) for i, v in enumerate(x)], "row_id long, embedding array<float>, label int").repartition(5).cache()
    queries = spark.createDataFrame([(i, x[i].tolist()) for i in (0, 7, 100, 250)], "query_id long, embedding array<float>")
    return x.astype(np.float64), base, queries


def brute(x, q, k, metric="l2", keep=lambda i: True):
    d = ((x - x[q]) ** 2).sum(1) if metric == "l2" else -(x @ x[q])
    return sorted((i for i in range(len(x)) if keep(i)), key=lambda i: (round(d[i], 9), -i))[:k]


@pytest.mark.parametrize("metric", ["l2", "ip"])
def test_exact_neighbours(data, metric, monkeypatch):
    x, base, queries = data
    monkeypatch.setattr(exact, "BLOCK_BYTES", 200)  # several blocks
    for k in (1, 10, 400):
        got = exact.exact_knn(queries, base, k, metric).collect()
        for q in (0, 7, 100, 250):
            assert [r.row_id for r in sorted(got, key=lambda r: r["rank"]) if r.query_id == q] == brute(x, q, k, metric)


def test_filters_and_self_exclusion(data):
    x, base, queries = data
    got = exact.exact_knn(queries, base, 5, predicates=[P("label", Op.EQ, 2)], exclude_self=True).collect()
    for q in (0, 7, 100, 250):
        assert [r.row_id for r in sorted(got, key=lambda r: r["rank"]) if r.query_id == q] == brute(x, q, 5, keep=lambda i: i % 5 == 2 and i != q)
    assert exact.exact_knn(queries.limit(0), base, 5).count() == 0 and exact.exact_knn(queries, base.limit(0), 5).count() == 0


def test_cut_without_a_gap_scale(spark):
    rows = spark.createDataFrame([(1, i, float(i)) for i in range(8)] + [(2, i, 1.0) for i in range(8)], "query_id long, row_id long, dist double")
    assert topk.adaptive_cut(rows, 1, 2.0).groupBy("query_id").count().count() == topk.adaptive_cut(rows, 1, 2.0).count() == 2
    assert {r.query_id: r["count"] for r in topk.adaptive_cut(rows, 3, 2.5).groupBy("query_id").count().collect()} == {1: 5, 2: 8}
    assert topk.shortlist_width(10) == 1000 and topk.shortlist_width(10, 50, 0.0001) == 2000 and topk.shortlist_width(10, 50, 0.01) == 2000


def test_budgets():
    assert routing.resolve(10**6, 64) == ("count", 16.0) and routing.resolve(10**6, 64, 3, 0.5) == ("count", 3.0)
    assert routing.resolve(10**6, 64, 0, 0.5, 0.1) == ("fraction", 0.5) and routing.resolve(10**6, 64, 0, None, 0.1) == ("fraction", 0.1)
    assert routing.resolve(1, 1, exhaustive=True)[0] == "all" and routing.default_fraction(10**7) == 0.05
    assert [routing.strategy(s) for s in (None, 0.005, 0.1, 0.5, 0.0)] == ["route", "scan", "visit_matching", "route", "visit_matching"]


def test_fraction_takes_the_crossing_cluster(spark):
    rows = spark.createDataFrame([(1, c, float(c), w) for c, w in enumerate((10, 20, 30, 40))], "query_id long, cluster_id int, dist double, weight long")
    chosen = lambda f: {r.cluster_id for r in routing.by_fraction(rows, f).collect()}
    assert chosen(0.0) == {0} and chosen(0.10) == {0} and chosen(0.11) == {0, 1} and chosen(0.31) == {0, 1, 2} and chosen(1.0) == {0, 1, 2, 3}
    assert {r.cluster_id for r in routing.by_count(rows, 4, gap=1.9).collect()} == {0}


def test_pruning_loses_no_row(spark):
    data = [(i, i // 20, i if i % 9 else None, f"c{i // 10}", [f"t{i // 30}"], 10 + i / 10, 20 + i / 7) for i in range(200)]
    rows = spark.createDataFrame(data, "row_id long, leaf_id int, year int, category string, tags array<string>, lat float, lng double").cache()
    leaves = summary.leaf_summaries(rows.drop("row_id"), ["leaf_id"]).cache()
    cases = [P("year", Op.EQ, 33.4), P("year", Op.LT, 30), P("year", Op.GE, 150), P("year", Op.BETWEEN, 40, 45), P("category", Op.IN, values=("c3", "c19")), P("category", Op.PREFIX, "c1"), P("tags", Op.CONTAINS_ALL, values=("t2",)), P("tags", Op.CONTAINS_ANY, values=("t0", "t6")), P("lat", Op.EQ, 10.1), P("lat", Op.GEO_BOX, lng_column="lng", geo=(12, 14, 0, 25)), P("lat", Op.GEO_RADIUS, lng_column="lng", geo=(20.0, 35.0, 300.0)), P("year", Op.IS_NULL), P("category", Op.NE, "c1")]
    for p in cases:
        left = {r.leaf_id for r in summary.surviving(leaves, [p], rows.schema).collect()}
        need = {r.leaf_id for r in matches(rows, [p]).select("leaf_id").distinct().collect()}
        assert need <= left, p
        if p.op not in (Op.IS_NULL, Op.NE):
            assert len(left) < 10, p
    assert 0 < summary.root_estimate(leaves, [cases[1]], rows.schema) < 1


def test_statistics(spark):
    rows = spark.range(2000).selectExpr("cast(id % 50 as int) year", "concat('k', id) name", "concat('c', id % 4) category", "cast(id as double) / 3 x").cache()
    s = stats.collect(rows, "on,name=auto", cap=100, auto_rows=1000)
    assert s.columns["name"].mode is stats.Mode.REJECTED and s.columns["x"].bins and s.columns["year"].counts[3] == 40
    assert stats.selectivity(P("category", Op.EQ, "c1"), s) == 0.25 and stats.selectivity(P("category", Op.EQ, "zz"), s) == 0
    assert abs(stats.selectivity(P("x", Op.BETWEEN, 100.0, 300.0), s) - 0.3) < 0.01 and abs(stats.selectivity(P("name", Op.EQ, "k1"), s) - 1 / 2000) < 1e-4
    assert stats.combined([P("category", Op.EQ, "c1"), P("year", Op.LT, 25)], s) == 0.125 and stats.combined([P("category", Op.EQ, "zz")], s) == 1e-4
    assert stats.policies("auto,b=off", ["a", "b"]) == {"a": stats.Mode.AUTO, "b": stats.Mode.OFF}
    with pytest.raises(ValueError):
        stats.policies("zz=on", ["a"])


def test_recall(spark):
    truth = spark.createDataFrame([(q, r, 10 * q + r, float(r)) for q in (1, 2) for r in (1, 2, 3)], "query_id long, rank int, row_id long, dist double")
    results = truth.where("rank <= 2")
    assert evaluate.recall_at_k(results, truth, 3).first()[0] == pytest.approx(2 / 3)
    assert evaluate.proximity(results, truth, 2).first()[0] == 1.0
    assert evaluate.filtered_recall(results, truth, truth.where("row_id in (11, 13)").select("row_id"), 2).first()[0] == 0.5


def test_rounded_distances_rank_as_in_spark(spark, monkeypatch):
    """A task keeps the k best by rounded distance and id, few rows of all, and no number of queries is refused."""
    monkeypatch.setattr(exact, "QUERIES", 7)
    rng = np.random.default_rng(5)
    x = (rng.integers(-4, 5, (900, 6)) / 8).astype(np.float32)  # squares end in .x5 and tie
    base = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "row_id long, embedding array<float>").repartition(3)
    queries = spark.createDataFrame([(i, x[i].tolist()) for i in range(0, 900, 45)], "query_id long, embedding array<float>")
    from vectorloom.functions.vectors import distance

    small = queries.withColumnRenamed("embedding", "query")
    every = base.join(small).select("query_id", "row_id", distance(F.col("query"), F.col("embedding"), "l2").alias("dist")).withColumn("key", F.round("dist", 1)).collect()
    for newest in (True, False):
        found = exact.nearest(queries, base, 7, digits=1, newest=newest).collect()
        assert len(found) <= 7 * 20 * spark.sparkContext.defaultParallelism
        for q in range(0, 900, 45):
            order = lambda r: (r.key if "key" in r else float(f"{exact.half_up(np.array([r.dist]), 1)[0] / 10}"), -r.row_id if newest else r.row_id)
            want, got = (sorted((r for r in rows if r.query_id == q), key=order)[:7] for rows in (every, found))
            assert [(r.row_id, r.dist) for r in got] == [(r.row_id, r.dist) for r in want]
    d = np.array([0.25, 0.35, 1.05, 2.675, 0.15, 0.1, -0.25, -0.34999999999999998, 123.449999999999989])
    rounded = spark.createDataFrame([(i, float(v)) for i, v in enumerate(d)], "i int, d double").select("i", F.round("d", 1).alias("r")).collect()
    assert [r.r for r in sorted(rounded)] == [v / 10 for v in exact.half_up(d, 1)]


def test_pairs_within_a_distance(spark, data):
    x, base, queries = data
    many = spark.range(10_500).select(F.col("id").alias("query_id"), F.expr("transform(sequence(1, 12), i -> cast(100 as float))").alias("embedding"))
    assert exact.within(many, base, 1.0).count() == 0
    got = {(r.query_id, r.row_id) for r in exact.within(queries, base, 9.0).collect()}
    assert got == {(q, i) for q in (0, 7, 100, 250) for i in range(300) if ((x[i] - x[q]) ** 2).sum() <= 9.0}


@pytest.mark.parametrize("metric", ["l2", "ip"])
def test_best_of_each_group(data, metric):
    x, base, queries = data
    got = exact.nearest(queries, base, 3, metric, group="label").collect()
    for q in (0, 7, 100, 250):
        for g in range(5):
            mine = sorted((r for r in got if (r.query_id, r.label) == (q, g)), key=lambda r: (round(r.dist, 9), -r.row_id))
            assert [r.row_id for r in mine[:3]] == brute(x, q, 3, metric, keep=lambda i: i % 5 == g)


def test_few_rows_a_query_leave_a_sweep(spark, small):
    """What ranks pairs of all rows gets no more than some rows a query and task."""
    from vectorloom.plans import catalog

    for name in ("ties_at_k", "w_sweep", "probe_plane"):
        plan = catalog.queries()[name](spark, small)._jdf.queryExecution().optimizedPlan().toString()
        assert "MapInArrow" in plan and "zip_with" not in plan, name
