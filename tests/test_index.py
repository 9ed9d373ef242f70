import numpy as np
import pytest

from vectorloom.functions.predicates import InvalidPredicate, Op, Predicate as P
from vectorloom.operators import evaluate, quantizers
from vectorloom.operators.exact import exact_knn, nearest
from vectorloom.operators.index import BuildOptions, Index, IndexBuilder, SearchOptions
from vectorloom.streaming.serve import Server, ingest

ALL = SearchOptions(exhaustive=True, width=1 << 20)
SMALL = {"leaf_capacity": 60, "k_root": 6, "passes": 2, "pca_dims": 8}


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(23)
    centres = rng.uniform(-10, 10, (8, 16))
    data = [(i, (centres[i % 8] + rng.normal(0, 0.5, 16)).astype(np.float32).tolist(), 2000 + i % 50, f"cat_{i % 10}", [f"tag_{i % 3}"], f"payload_{i}") for i in range(600)]
    return spark.createDataFrame(data, "row_id long, embedding array<float>, year int, category string, tags array<string>, payload string").cache()


@pytest.fixture(scope="module")
def queries(rows):
    return rows.where("row_id % 60 = 0").selectExpr("row_id query_id", "embedding").cache()


@pytest.fixture(scope="module")
def index(rows, tmp_path_factory):
    return Index.build(rows, str(tmp_path_factory.mktemp("a") / "index"), BuildOptions(**SMALL, statistics="on"), payload="payload")


def listed(df):
    return sorted((r.query_id, r["rank"], r.row_id, r.dist) for r in df.collect())


def test_exhaustive_search_is_exact(spark, rows, queries, index):
    assert listed(index.search(queries, 10, options=ALL)) == listed(exact_knn(queries, rows, 10))
    again = Index.open(spark, index.path)
    assert listed(again.search(queries, 5, [P("year", Op.LT, 2025)], ALL)) == listed(exact_knn(queries, rows, 5, predicates=[P("year", Op.LT, 2025)]))
    info = again.info()
    assert info["rows"] == 600 and info["live"] >= 600 and ("tags", "array<string>") in info["columns"] and not info["plane"]
    with pytest.raises(InvalidPredicate):
        again.search(queries, 5, [P("nope", Op.EQ, 1)])
    with pytest.raises(FileNotFoundError):
        Index.open(spark, index.path + "-none")


def test_batch_is_each_alone(queries, index):
    together = listed(index.search(queries, 5, options=SearchOptions(n_probe=2)))
    alone = []
    for q in (0, 300):
        alone += listed(index.search(queries.where(f"query_id = {q}"), 5, options=SearchOptions(n_probe=2)))
    assert [r for r in together if r[0] in (0, 300)] == sorted(alone)


def test_probing_finds_most(rows, queries, index):
    truth = exact_knn(queries, rows, 10).cache()
    assert evaluate.recall_at_k(index.search(queries, 10, options=SearchOptions(n_probe=3)), truth, 10).first()[0] >= 0.9
    assert evaluate.recall_at_k(index.search(queries, 10, options=SearchOptions(fraction=0.6, rerank="decoded")), truth, 10).first()[0] >= 0.7


def test_changes(spark, rows, queries, tmp_path):
    index = Index.build(rows.where("row_id < 300"), str(tmp_path / "i"), BuildOptions(**SMALL), payload="payload")
    index.insert(rows.where("row_id >= 300").withColumn("payload", rows.payload.cast("binary")))
    assert listed(index.search(queries, 10, options=ALL)) == listed(exact_knn(queries, rows, 10))
    assert index.table("leaves").where(f"weight > {2 * SMALL['leaf_capacity']}").count() == 0
    with pytest.raises(ValueError):
        index.insert(rows.limit(1).withColumn("payload", rows.payload.cast("binary")))
    _, n = index.delete(rows.where("row_id % 3 = 0").selectExpr("row_id").unionByName(spark.createDataFrame([(0,), (10**6,)], "row_id long")))
    assert n == 200 and index.manifest["rows"] == 400
    index.vacuum(statistics=True).compact()
    left = rows.where("row_id % 3 <> 0")
    assert listed(Index.open(spark, index.path).search(queries, 10, options=ALL)) == listed(exact_knn(queries, left, 10))
    assert {r.problems for r in index.check().collect()} == {0}
    assert index.counts().first().rows == 400


def test_plane(rows, queries, tmp_path):
    index = Index.build(rows, str(tmp_path / "p"), BuildOptions(**SMALL, plane="level_scaled", plane_dims=8), payload="payload")
    truth = exact_knn(queries, rows, 10).cache()
    for keep in (None, 0.5):
        assert evaluate.recall_at_k(index.search(queries, 10, options=SearchOptions(fraction=0.4, plane_keep=keep)), truth, 10).first()[0] >= 0.8
    with pytest.raises(ValueError):
        index.attach_plane()
    with pytest.raises(ValueError):
        index.insert(rows)


def test_bad_builds(spark, rows, tmp_path):
    for df, o in ((rows.limit(0), BuildOptions()), (spark.createDataFrame([(1, [1.0]), (2, [1.0, 2.0])], "row_id long, embedding array<float>"), BuildOptions()), (rows, BuildOptions(quantizer="zip")), (rows, BuildOptions(metric="cos")), (rows, BuildOptions(quantizer="scalar_shape", bits=8))):
        with pytest.raises(ValueError):
            Index.build(df, str(tmp_path / "bad"), o)
    b = IndexBuilder(spark, str(tmp_path / "b"), BuildOptions(**SMALL))
    with pytest.raises(ValueError):
        b.push(spark.range(3))
    b.push(rows.drop("payload").where("row_id < 100"))
    assert b.finish().manifest["rows"] == 100
    with pytest.raises(ValueError):
        b.push(rows)


@pytest.mark.parametrize("name", sorted(quantizers.FAMILIES))
def test_codes_keep_neighbours(name):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(600, 32))
    q = quantizers.make(name, 16 if "pq" in name else None, 4)
    q.fit(x)
    back = q.decode_leaf(*q.encode_leaf(x)) if q.local else q.decode(q.encode(x))
    assert back.shape == x.shape and ((x - back) ** 2).mean() < 0.35 * x.var()
    d, e = (((a[:40, None] - b) ** 2).sum(2) for a, b in ((x, x), (x, back)))
    hits = np.mean([len(set(np.argsort(a)[:10]) & set(np.argsort(b)[:10])) / 10 for a, b in zip(d, e)])
    assert hits > {"pq": 0.45, "opq": 0.45, "anisotropic_pq": 0.4, "prq": 0.6, "local_pq": 0.45}.get(name, 0.8)


def test_server(spark, rows, queries, index, tmp_path):
    server = Server(index, 5, options=ALL)
    want = listed(exact_knn(queries, rows, 5))
    assert listed(server.answer(queries)) == want and listed(server.answer(queries)) == want and server.stats["repeats"] == 10
    server.predicates = (P("year", Op.EQ, 2000),)
    assert listed(server.answer(queries)) == listed(exact_knn(queries, rows, 5, predicates=list(server.predicates)))
    queries.write.parquet(str(tmp_path / "q"))
    server.predicates, found = (), []
    stream = server.stream(spark.readStream.schema(queries.schema).parquet(str(tmp_path / "q")), lambda df, n: found.extend(listed(df)), {"availableNow": True}, str(tmp_path / "c"))
    assert stream.awaitTermination(120) and sorted(found) == want
    rows.drop("payload").where("row_id < 120").write.parquet(str(tmp_path / "r"))
    builder = IndexBuilder(spark, str(tmp_path / "s"), BuildOptions(**SMALL))
    assert ingest(spark.readStream.schema(rows.drop("payload").schema).parquet(str(tmp_path / "r")), builder, str(tmp_path / "d")).awaitTermination(120)
    assert builder.finish().manifest["rows"] == 120


def test_feedback_trace(queries, index):
    blocks = index.feedback_blocks(queries, 5).collect()
    by = {}
    for r in sorted(blocks, key=lambda r: (r.query_id, r.block)):
        by.setdefault(r.query_id, []).append(r)
    assert len(by) == 10 and all(b[0].entered == 5 for b in by.values())
    assert all(x.kth is None or y.kth <= x.kth for b in by.values() for x, y in zip(b, b[1:]))


def _by_shortlist(index, queries, k, predicates, width):
    leaves = index.table("leaves")
    return listed(index._shortlisted(queries, k, index._all(queries, leaves), leaves, predicates, width, SearchOptions()))


@pytest.mark.parametrize("quantizer", ["local_scalar", "pq"])
def test_a_search_of_all_leaves_is_that_of_its_shortlist(rows, queries, tmp_path, quantizer):
    """Also where the shortlist is too short for all that is visited, or even for the nearest rows."""
    index = Index.build(rows, str(tmp_path / "w"), BuildOptions(**SMALL, quantizer=quantizer, **({"m": 2, "bits": 2} if quantizer == "pq" else {})), payload="payload")
    for width in (12, 60, 1 << 20):
        for predicates in ([], [P("year", Op.LT, 2025)]):
            got = index.search(queries, 10, predicates, SearchOptions(exhaustive=True, width=width))
            assert listed(got) == _by_shortlist(index, queries, 10, predicates, width), (width, predicates)


def test_a_search_of_all_leaves_forms_no_pairs(queries, index, monkeypatch):
    """No query is listed with each leaf, and no pair of a query and a row is shortlisted, where the width holds all."""
    from vectorloom.operators import index as module

    monkeypatch.setattr(module.Index, "scan", None)
    found = index.search(queries, 10, [P("year", Op.LT, 2025)], ALL)
    assert found.count() == 100 and "askers" not in found._jdf.queryExecution().toString()


def test_a_trace_sends_the_best_of_a_cluster_only(queries, index, monkeypatch):
    from vectorloom.operators import index as module

    sent = []
    monkeypatch.setattr(module, "nearest", lambda *a, **o: sent.append(nearest(*a, **o)) or sent[0])
    index.feedback_blocks(queries, 5).count()
    clusters = index.table("leaves").select("cluster_id").distinct().count()
    assert sent[0].count() <= 10 * 5 * clusters * queries.sparkSession.sparkContext.defaultParallelism


def test_estimates_are_the_decoded_distances(rows, queries, index):
    decoded = {(r.query_id, r.row_id): r.dist for r in index.search(queries, 1 << 20, options=SearchOptions(exhaustive=True, width=1 << 20, rerank="decoded")).collect()}
    pairs = exact_knn(queries, rows, 10)
    least = {}
    for r in index.estimates(pairs, queries).collect():
        least[r.query_id, r.row_id] = min(r.estimate, least.get((r.query_id, r.row_id), np.inf))
    assert len(least) == 100 and all(v == pytest.approx(decoded[p], abs=1e-9) for p, v in least.items())
