import zlib

import numpy as np
from docs import ROWS, awkward, empty

from vectorloom.llm import quality


def test_score_is_the_sum_of_table_entries():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 4))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0)).astype(float)  # only an interaction tells
    m = quality.fit(x, y)
    assert ((m.score(x) > 0.5) == y).mean() > 0.9
    for row in x[:20]:
        at = [int((e <= v).sum()) for e, v in zip(m.edges, row)]
        logit = m.base + sum(t[a] for t, a in zip(m.tables, at)) + sum(t[m.coarse[i][at[i]]][m.coarse[j][at[j]]] for i, j, t in m.pairs)
        assert abs(1 / (1 + np.exp(-logit)) - m.score(row[None])[0]) < 1e-9


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    rows = quality.quality_digest(docs, labels).collect()
    assert len(rows) == docs.count() and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    truth = {r.doc_id: r.quality for r in labels.collect()}
    test = [r for r in rows if r.held_out and r.doc_id in truth]
    assert sum(r.predicted == truth[r.doc_id] for r in test) > 0.95 * len(test)


def test_awkward_texts(spark):
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, None), (None, 1)], "doc_id long, quality int")
    rows = quality.quality_digest(awkward(spark), labels).collect()
    assert len(rows) == len(ROWS) and all(0 <= r.score <= 1 for r in rows)
    assert quality.quality_digest(empty(spark), labels).count() == 0
    none = quality.quality_digest(awkward(spark), labels.limit(0)).collect()
    assert {r.score for r in none} == {0.5}
    assert len(quality.measure(" " * 10)) == len(quality.measure("x")) == len(quality.FEATURES)
