import numpy as np
import pytest

from vectorloom.llm import embeddings, graph

SCHEMA = "vec_id long, embedding array<float>, label int, weight string, n int"


def truth(rows, threshold=0.9):
    """Brute force: links and least reachable id."""
    ids = [r[0] for r in rows]
    x = np.array([np.float32(r[1]) for r in rows], np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    close = x @ x.T >= threshold
    np.fill_diagonal(close, False)
    comp = np.array(ids)
    while True:
        new = np.minimum(comp, np.where(close, comp[None, :], np.iinfo(np.int64).max).min(1))
        if (new == comp).all():
            break
        comp = new
    return {i: (int(n), int(c)) for i, n, c in zip(ids, close.sum(1), comp)}


def corpus(seed=1, n=400, groups=20, dim=32):
    rng = np.random.default_rng(seed)
    rows = [rng.normal(size=dim) for _ in range(n)]
    for g in range(groups):
        rows += [rows[g] + rng.normal(size=dim) * 0.3 for _ in range(5)]
    rows += [rows[0] + rng.normal(size=dim) * 0.05 for _ in range(60)] + [rows[5] * 3, rows[5]]
    return [(int(i), [float(v) for v in r], 0, "x", 1) for i, r in zip(rng.permutation(len(rows)), rows)]


@pytest.mark.parametrize("cell", [3000, 10])
def test_against_brute_force(spark, monkeypatch, cell):
    monkeypatch.setattr(embeddings, "CELL", cell)
    rows = corpus()
    want = truth(rows)
    got = {r.vec_id: r for r in embeddings.link(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got.keys() == want.keys()
    assert all(got[i].n_links <= n for i, (n, _) in want.items())
    assert sum(r.n_links for r in got.values()) >= 0.97 * sum(n for n, _ in want.values())
    assert sum(got[i].component_id == c for i, (_, c) in want.items()) >= 0.98 * len(want)
    assert all(r.kept == (r.vec_id == r.component_id) for r in got.values())


def test_cells_do_not_change_results(spark, monkeypatch):
    df = spark.createDataFrame(corpus(3), SCHEMA)
    first = sorted(map(tuple, embeddings.link(df).collect()))
    monkeypatch.setattr(embeddings, "CELL", 7)
    assert sorted(map(tuple, embeddings.link(df).collect())) == first


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0], 0, "", 0), (2, [2.0, 0.0], 0, "", 0), (2, [2.0, 0.0], 0, "", 0), (3, None, 0, "", 0), (4, [0.0, 0.0], 0, "", 0), (5, [1.0, None], 0, "", 0), (6, [nan, 1.0], 0, "", 0), (7, [inf, 1.0], 0, "", 0)]
    rows += [(8, [1.0, 0.0, 0.0], 0, "", 0), (9, [1.0, 0.0, 0.0], 0, "", 0), (None, [1.0, 0.0], 0, "", 0), (10, [-1.0, 0.0], 0, "", 0), (11, [], 0, "", 0)]
    got = embeddings.link(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == len(rows)
    by = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in got}
    assert by == {1: (1, 1, True), 2: (1, 1, False), 8: (1, 8, True), 9: (1, 8, False), None: (0, None, True), **{i: (0, i, True) for i in (3, 4, 5, 6, 7, 10, 11)}}
    assert embeddings.link(spark.createDataFrame([], SCHEMA)).count() == 0


def test_rotations_balance_the_bits():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(3000, 24)) * np.linspace(3, 0.2, 24) + 1
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    coder = embeddings.fit(x, 100_000)
    assert abs(coder.codes(x).mean(0) - 0.5).max() < 0.1
    v = (x - x.mean(0)) @ np.linalg.qr(rng.normal(size=(24, 24)))[0]
    loss = lambda r: ((np.where(v @ r >= 0, 1, -1) - v @ r) ** 2).sum()
    start = np.linalg.qr(np.random.default_rng(0).normal(size=(24, 24)))[0]
    assert loss(embeddings.learn_rotation(v, 0)) < loss(start)


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(300)] + [(1000, 1000 + i) for i in range(1, 200)] + [(5000, 5000), (6001, 6000), (6001, 6000)]
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(301)}, **{1000 + i: 1000 for i in range(200)}, 6000: 6000, 6001: 6000}


def test_recall_just_above_the_threshold(spark, monkeypatch):
    """Pairs of cosine 0.9 to 0.92, by the bits and tables of a hundred million vectors."""
    real = embeddings.fit
    monkeypatch.setattr(embeddings, "fit", lambda x, n, threshold: real(x, 100_000_000, threshold))
    rng = np.random.default_rng(12)
    a = rng.normal(size=(400, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    turn = rng.normal(size=a.shape)
    turn -= (turn * a).sum(1, keepdims=True) * a
    turn /= np.linalg.norm(turn, axis=1, keepdims=True)
    c = rng.uniform(0.9001, 0.92, (400, 1))
    b = c * a + np.sqrt(1 - c * c) * turn
    rows = [(i, v.tolist()) for i, v in enumerate(np.concatenate([a, b]))]
    got = {r.vec_id: r for r in embeddings.link(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()}
    linked = sum(got[400 + i].component_id == i for i in range(400))
    assert linked >= 0.95 * 400
    assert sum(r.n_links for r in got.values()) == 2 * linked
