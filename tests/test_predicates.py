import math

import pytest
from pyspark.sql import functions as F

from vectorloom.functions.predicates import InvalidPredicate, Op, Predicate as P, matches, parse, typed
from vectorloom.functions.vectors import haversine_km, normalized


@pytest.fixture(scope="module")
def rows(spark):
    nan = float("nan")
    data = [(i, i % 40 if i % 7 != 3 else None, float(i) / 10, nan if i % 5 == 0 else i / 10, f"cat_{i % 5}" if i % 11 != 5 else None, i % 2 == 0, [f"t{i % 3}"] if i % 4 else None, 2**54 + (i % 4) * 2) for i in range(160)]
    return spark.createDataFrame(data, "row_id long, year int, lat float, gap double, category string, flag boolean, tags array<string>, big long").cache()


def ids(rows, *predicates):
    return {r.row_id for r in matches(rows, predicates).select("row_id").collect()}


def test_null_passes_null_tests_only(rows):
    some = {r.row_id: r for r in rows.collect()}
    for op in (Op.EQ, Op.NE, Op.LT, Op.LE, Op.GT, Op.GE):
        assert all(some[i].year is not None for i in ids(rows, P("year", op, 20)))
    assert ids(rows, P("year", Op.IS_NULL)) == {i for i, r in some.items() if r.year is None}
    assert ids(rows, P("tags", Op.CONTAINS_ALL)) == {i for i, r in some.items() if r.tags is not None}
    assert ids(rows, P("category", Op.NOT_IN)) == {i for i, r in some.items() if r.category is not None}


def test_not_a_number(rows):
    numbers = {r.row_id for r in rows.collect() if not math.isnan(r.gap)}
    assert ids(rows, P("gap", Op.GE, -1e9)) == numbers == ids(rows, P("gap", Op.GT, -1e9))
    assert len(ids(rows, P("gap", Op.NE, 3.3))) == 159 and ids(rows, P("gap", Op.EQ, float("nan"))) == set()
    assert len(ids(rows, P("gap", Op.NOT_IN, values=(3.3,)))) == 159


def test_comparands_take_the_columns_type(rows):
    assert ids(rows, P("lat", Op.EQ, 0.1)) == {1}
    assert ids(rows, P("big", Op.EQ, 2**54 + 2)) == {i for i in range(160) if i % 4 == 1}
    assert typed(2.5, rows.schema["year"].dataType) == 3 and typed(-2.5, rows.schema["year"].dataType) == -3
    assert ids(rows, P("year", Op.LT, 1e20)) == ids(rows, P("year", Op.IS_NOT_NULL)) == ids(rows, P("year", Op.BETWEEN, -1e20, 1e20))
    assert ids(rows, P("year", Op.EQ, 1e20)) == set() == ids(rows, P("year", Op.GT, 1e20))
    assert ids(rows, P("year", Op.IN, values=("3", "x", "4.0"))) == {r.row_id for r in rows.collect() if r.year in (3, 4)}


@pytest.mark.parametrize(
    "bad",
    [P("nope", Op.EQ, 1), P("category", Op.LT, "a"), P("flag", Op.IN, values=(True,)), P("tags", Op.EQ, "t1"), P("year", Op.PREFIX, "2"), P("year", Op.EQ), P("year", Op.BETWEEN, 1), P("year", Op.EQ, "x"), P("category", Op.IN), P("lat", Op.GEO_BOX, geo=(1, 2, 3, 4)), P("lat", Op.GEO_RADIUS, lng_column="category", geo=(1, 2, 3)), P("lat", Op.GEO_BOX, lng_column="gap", geo=(1, 2))],
)
def test_bad_predicates_are_errors(rows, bad):
    with pytest.raises(InvalidPredicate):
        matches(rows, [bad])


def test_parser(rows):
    s = rows.schema
    assert parse("category:eq:123", s) == P("category", Op.EQ, "123")
    assert parse("category:eq:a:b", s).value == "a:b"
    assert parse("year:between:1:2", s) == P("year", Op.BETWEEN, 1, 2) and parse("flag:eq:true", s).value is True
    assert parse("lat:gap:geo_radius:1:2:3", s) == P("lat", Op.GEO_RADIUS, lng_column="gap", geo=(1.0, 2.0, 3.0))
    assert parse("tags:contains_any:a,b", s).values == ("a", "b") and parse("year:is_null", s).op is Op.IS_NULL
    for bad in ("year", "year:like:3", "nope:eq:1", "year:eq:x", "year:between:1", "lat:gap:geo_box:1:2"):
        with pytest.raises(InvalidPredicate):
            parse(bad, s)


def test_filters_reach_the_scan(spark, small):
    df = spark.read.parquet(f"{small}/orders.parquet").select("o_orderkey", "o_custkey")
    plan = matches(df, [P("o_custkey", Op.BETWEEN, 5, 9)])._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(o_custkey,5)" in plan and "LessThanOrEqual(o_custkey,9)" in plan


def test_vector_functions(spark):
    df = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],)], "v array<float>")
    assert [[round(x, 6) for x in r[0]] for r in df.select(normalized(F.col("v"))).collect()] == [[0.6, 0.8], [0.0, 0.0]]
    (d,) = spark.range(1).select(haversine_km(F.lit(52.52), F.lit(13.405), 48.8566, 2.3522)).first()
    assert abs(d - 877.5) < 1
