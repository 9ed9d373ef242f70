import sys
from pathlib import Path

import pytest
from docs import awkward, empty

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))
corpus_pipeline = pytest.importorskip("corpus_pipeline")


def test_stages_keep_the_columns(spark, tmp_path):
    docs = awkward(spark).drop("length", "ids", "score")
    for source in (docs, empty(spark).drop("length", "ids", "score")):
        for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, source, "/nowhere")
            if i < 4:
                assert out.columns == source.columns == corpus_pipeline.COLUMNS, name
                out.write.mode("overwrite").parquet(f"{tmp_path}/{i}")
                source = spark.read.parquet(f"{tmp_path}/{i}")
            else:
                assert "sequence_id" in out.columns and out.count() >= 0


def test_against_stage_by_stage_truth(spark, small):
    """Each stage's result against what brute force makes of the stage's own input."""
    import test_language
    import test_pii
    import test_simhash
    import test_substrings

    table = spark.read.parquet(f"{small}/documents.parquet")
    planted = spark.createDataFrame([(10**9 + i, t, None, "planted", len(t)) for i, t in enumerate([*test_language.FOREIGN, "12 345 !!"])], table.schema)
    docs = table.unionByName(planted).cache()
    one = corpus_pipeline.identify_language(spark, docs, small).cache()
    kept = {r.doc_id for r in one.collect()}
    assert not any(i >= 10**9 for i in kept) and len(kept) >= 0.995 * table.count()
    two = corpus_pipeline.drop_near_duplicates(spark, one, small).cache()
    rows = [(r.doc_id, r.text) for r in one.collect()]
    assert {r.doc_id for r in two.collect()} == {i for i, c in test_simhash.truth(rows).items() if i == c}
    three = corpus_pipeline.cut_repeated_passages(spark, two, small).cache()
    want = test_substrings.truth([(r.doc_id, r.text) for r in two.collect()])
    stays = {i for i, n, gone, *_ in want if n > gone}
    assert {r.doc_id for r in three.collect()} <= stays and three.count() >= len(stays) - 2
    four = {r.doc_id: r.text for r in corpus_pipeline.replace_personal_data(spark, three, small).collect()}
    plain = test_pii.Plain(corpus_pipeline.pii_key(spark))
    assert four == {r.doc_id: plain.text(r.text)[0] for r in three.collect()}
    final = spark.createDataFrame(list(four.items()), "doc_id long, text string")
    import test_packing

    test_packing.check(corpus_pipeline.pack_sequences(spark, final, small).collect(), list(four.items()))


def test_each_text_is_handled_once(spark, small):
    """Filters on what Python workers give don't make them work twice, with twice the workers."""
    docs = spark.read.parquet(f"{small}/documents.parquet")
    for stage in (corpus_pipeline.identify_language, corpus_pipeline.cut_repeated_passages):
        plan = stage(spark, docs, small)._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("ArrowEvalPython ") == 1, stage.__name__
