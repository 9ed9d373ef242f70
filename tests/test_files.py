import struct

import numpy as np
import pytest

from vectorloom.sources import files


def test_vector_files(spark, tmp_path):
    x = np.arange(60, dtype="<f4").reshape(12, 5)
    for name, part in (("a.fbin", x[:7]), ("b.fbin", x[7:])):
        (tmp_path / name).write_bytes(struct.pack("<II", *part.shape) + part.tobytes())
    got = files.read_vectors(spark, f"{tmp_path}/*.fbin", rows_per_task=3).orderBy("row_id").collect()
    assert [r.row_id for r in got] == list(range(12)) and [list(r.embedding) for r in got] == x.tolist()
    (tmp_path / "c.fvecs").write_bytes(b"".join(struct.pack("<i", 5) + r.tobytes() for r in x))
    assert files.convert_vecs(str(tmp_path / "c.fvecs"), str(tmp_path / "d.fbin")) == 12
    assert (tmp_path / "d.fbin").read_bytes() == struct.pack("<II", 12, 5) + x.tobytes()
    assert [list(r.embedding) for r in files.read_vectors(spark, f"{tmp_path}/c.fvecs").orderBy("row_id").collect()] == x.tolist()
    (tmp_path / "e.fbin").write_bytes(struct.pack("<II", 12, 5) + x.tobytes()[:-1])
    with pytest.raises(ValueError):
        files.layout(str(tmp_path / "e.fbin"))
    (tmp_path / "f.bbin").write_bytes(struct.pack("<II", 2, 3) + bytes([1, 2, 3, 250, 0, 9]))
    assert [list(r.embedding) for r in files.read_vectors(spark, f"{tmp_path}/f.bbin").orderBy("row_id").collect()] == [[1, 2, 3], [250, 0, 9]]


def test_truth_without_distances(spark, tmp_path):
    truth = spark.createDataFrame([(q, r, 100 * q + r, 0.0) for q in (0, 1) for r in (1, 2)], "query_id long, rank int, row_id long, dist double")
    files.write_truth(truth, str(tmp_path / "t"))
    got = files.read_truth(spark, str(tmp_path / "t"))
    assert sorted((r.query_id, r["rank"], r.row_id, r.dist) for r in got.collect()) == [(0, 1, 1, None), (0, 2, 2, None), (1, 1, 101, None), (1, 2, 102, None)]
    (tmp_path / "bad").write_bytes(b"nope")
    with pytest.raises(ValueError):
        files.read_truth(spark, str(tmp_path / "bad"))


def test_sidecar(spark, tmp_path):
    rows = [{"year": 2000 + i, "big": 2**54 + i, "lat": 0.5 * i, "flag": i % 2 == 0, "name": f"é{i}", "tags": ["a"] * (i % 3)} for i in range(5)]
    files.write_sidecar(rows, [("year", "int"), ("big", "bigint"), ("lat", "float"), ("flag", "boolean"), ("name", "string"), ("tags", "set")], str(tmp_path / "s"))
    got = files.read_sidecar(spark, str(tmp_path / "s")).orderBy("row_id").collect()
    assert [{k: v for k, v in r.asDict().items() if k != "row_id"} for r in got] == rows


def test_parquet(spark, tmp_path):
    half = np.arange(6, dtype="<f2").tobytes()
    spark.createDataFrame([(bytearray(half), 1, "x"), (bytearray(half), 2, None)], "v binary, year int, note string").coalesce(1).write.parquet(str(tmp_path / "h"))
    df = files.read_parquet(spark, str(tmp_path / "h"), vector="v", payload="note", half=True, normalize=True)
    a, b = df.orderBy("row_id").collect()
    assert (a.row_id, b.row_id, a.payload, b.payload) == (0, 1, b"x", b"") and abs(sum(x * x for x in a.embedding) - 1) < 1e-6
    assert files.checked_dim(df) == 6
    spark.createDataFrame([([1.0], 1.5, {"a": 1})], "v array<float>, price double, m map<string,int>").write.parquet(str(tmp_path / "m"))
    with pytest.raises(ValueError):
        files.read_parquet(spark, str(tmp_path / "m"), vector="v")
    assert files.read_parquet(spark, str(tmp_path / "m"), vector="price", strict=False).first().embedding == [1.5]
    with pytest.raises(ValueError):
        files.read_parquet(spark, str(tmp_path / "m"), vector="m")
    with pytest.raises(ValueError):
        files.positional_join(df, df.limit(1), ["year"])
    with pytest.raises(ValueError):
        files.checked_dim(df.limit(0))


def test_results_and_metrics(spark, tmp_path):
    rows = spark.createDataFrame([(1, 1, 5, 0.5, bytearray(b"ab"))], "query_id long, rank int, row_id long, dist double, payload binary")
    files.write_results(rows, str(tmp_path / "r"))
    assert spark.read.text(str(tmp_path / "r")).first()[0] == "1\t1\t5\t0.5\t6162\t2"
    m = files.Metrics(str(tmp_path / "m"))
    m.record("lloyd", 1.5, window=2)
    assert '"phase": "lloyd"' in (tmp_path / "m").read_text()
    with pytest.raises(ValueError):
        m.record("nap", 1)
    assert files.from_rows(spark, [{"a": 1}, {"b": "x"}], "a int, b string, c array<string>").collect() == [(1, "", []), (0, "x", [])]
