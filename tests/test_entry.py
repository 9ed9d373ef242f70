import os
import shutil
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry

REPO = Path(__file__).resolve().parents[1]
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SLOW = ("ann_", "push_", "insert_", "delete_", "payload_", "vector_", "index_", "live_", "quantizer_", "feedback_", "search_", "code_")
LIGHT = [n for n in entry._core().oracle_sql() if not n.startswith(SLOW)]


@pytest.fixture(scope="module")
def sql():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '/root/testdata/sf0.001/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", LIGHT + ["ann_exhaustive_local_scalar", "ann_filter_directed"])
def test_query_equals_its_sql(spark, sql, name):
    df = entry.queries()[name](spark, "/root/testdata/sf0.001")
    cols = sorted(df.columns)
    rel = sql.execute(entry.oracle_sql()[name])
    names = [d[0] for d in rel.description]
    assert sorted(names) == cols
    want = sorted((tuple(dict(zip(names, r))[c] for c in cols) for r in rel.fetchall()), key=str)
    assert sorted((tuple(r[c] for c in cols) for r in df.collect()), key=str) == want


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["query_id", "rank", "row_id", "dist"] and df.count() > 0


def test_every_sql_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_works_without_the_optional_parts(tmp_path):
    for part in ("vectorloom", "__spark_entry__.py"):
        (shutil.copytree if (REPO / part).is_dir() else shutil.copy)(REPO / part, tmp_path / part)
    shutil.rmtree(tmp_path / "vectorloom/llm", ignore_errors=True)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'exact_knn_l2' in q and not any(n.startswith('op') or n == 'pipeline' for n in q); e.oracle_sql()"
    subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, check=True, env={**os.environ, "PYTHONPATH": str(tmp_path)})
