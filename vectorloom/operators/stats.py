"""Column statistics and the selectivity of predicates.

Frequencies, exact and binned histograms and distinct counts are partial and final aggregations; what the estimator
holds on the driver is bounded by ``CAP`` values a column.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from enum import Enum

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vectorloom.functions.predicates import FLAG, NUMBER, SET, TEXT, InvalidPredicate, Op, Predicate, kind_of, typed

CAP, BINS = 1 << 20, 4096
AUTO_ROWS, AUTO_SHARE = 100_000, 0.5


class Mode(str, Enum):
    OFF, ON, AUTO, REJECTED = "off", "on", "auto", "rejected"


def policies(spec: str, columns: list[str]) -> dict[str, Mode]:
    """``on``, ``off`` or ``auto`` for all columns, and ``name`` or ``name=mode`` for one, separated by commas."""
    out = dict.fromkeys(columns, Mode.OFF)
    for item in filter(None, (s.strip() for s in spec.split(","))):
        name, _, mode = item.partition("=")
        if not mode and name in ("on", "off", "auto"):
            out = dict.fromkeys(columns, Mode(name))
        elif name not in out:
            raise InvalidPredicate(f"no column {name!r}")
        elif mode not in ("", "on", "off", "auto"):
            raise InvalidPredicate(f"unknown mode {mode!r}")
        else:
            out[name] = Mode(mode or "on")
    return out


def frequencies(df: DataFrame, column: str) -> DataFrame:
    """(value, count) without NULLs; each element of a set counts."""
    c = F.col(f"`{column}`")
    values = df.select(F.explode(c).alias("value")) if kind_of(df.schema[column].dataType) == SET else df.select(c.alias("value"))
    return values.where("value IS NOT NULL").groupBy("value").agg(F.count("*").alias("count"))


def capped(freq: DataFrame, cap: int = CAP) -> DataFrame:
    """The most frequent values, and whether there were more."""
    top = freq.orderBy(F.desc("count"), "value").limit(cap + 1)
    order = Window.orderBy(F.desc("count"), "value")  # over at most cap + 1 rows
    return top.withColumn("at", F.row_number().over(order)).withColumn("overflowed", F.max("at").over(Window.partitionBy()) > cap).where(F.col("at") <= cap).drop("at")


def binned(df: DataFrame, column: str, bins: int = BINS) -> DataFrame:
    """(bin, count) of equal widths over the exact range; the largest value belongs to the last bin."""
    c = F.col(f"`{column}`").cast("double")
    usable = df.where(c.isNotNull() & ~F.isnan(c)).select(c.alias("x"))
    low, high = usable.agg(F.min("x"), F.max("x")).first()
    if low is None:
        return df.sparkSession.createDataFrame([], "bin int, count long")
    bin_ = F.lit(0) if high == low else F.least(F.floor((F.col("x") - low) / (high - low) * bins), F.lit(bins - 1))
    return usable.groupBy(bin_.cast("int").alias("bin")).agg(F.count("*").alias("count"))


def distinct_estimate(df: DataFrame, column: str) -> int:
    """A HyperLogLog estimate of a column's (or a set's elements') distinct values."""
    c = F.col(f"`{column}`")
    values = df.select(F.explode(c).alias("v")) if kind_of(df.schema[column].dataType) == SET else df.select(c.alias("v"))
    return values.agg(F.coalesce(F.hll_sketch_estimate(F.hll_sketch_agg(F.coalesce(F.col("v").cast("string"), F.lit(None)), F.lit(12))), F.lit(0))).first()[0]


def sketches(df: DataFrame, column: str, by: list) -> DataFrame:
    """Mergeable distinct-count sketches by group; ``merged`` adds them up."""
    return df.groupBy(*by).agg(F.hll_sketch_agg(F.col(f"`{column}`").cast("string"), F.lit(12)).alias("sketch"))


def merged(sketch: DataFrame) -> DataFrame:
    return sketch.agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("distinct"))


@dataclass
class ColumnStats:
    mode: Mode
    kind: str
    dtype: T.DataType
    rows: int
    distinct: int = 0
    low: float | None = None
    high: float | None = None
    counts: dict | None = None
    overflowed: bool = False
    bins: dict[int, int] | None = None

    @property
    def tracked(self) -> bool:
        return self.mode is Mode.ON


@dataclass
class TableStats:
    rows: int
    columns: dict[str, ColumnStats] = field(default_factory=dict)


def collect(df: DataFrame, spec: str = "off", cap: int = CAP, auto_rows: int = AUTO_ROWS) -> TableStats:
    """Statistics of a table's filterable columns under a policy."""
    names = [f.name for f in df.schema if kind_of(f.dataType) in (NUMBER, TEXT, SET, FLAG)]
    modes = policies(spec, names)
    rows = df.count()
    stats = TableStats(rows)
    for name in names:
        kind, mode = kind_of(df.schema[name].dataType), modes[name]
        s = stats.columns[name] = ColumnStats(mode, kind, df.schema[name].dataType, rows)
        if mode is Mode.OFF or kind == FLAG:
            continue
        s.distinct = int(distinct_estimate(df, name))
        if mode is Mode.AUTO:
            s.mode = mode = Mode.REJECTED if rows >= auto_rows and s.distinct > AUTO_SHARE * rows else Mode.ON
            if mode is Mode.REJECTED:
                continue
        if kind == NUMBER:
            c = F.col(f"`{name}`").cast("double")
            s.low, s.high = df.agg(F.min(c), F.max(c)).first()
        freq = frequencies(df, name)
        top = freq.orderBy(F.desc("count"), "value").limit(cap + 1).collect()
        s.overflowed = len(top) > cap
        if kind == NUMBER and s.overflowed:
            s.bins = {r["bin"]: r["count"] for r in binned(df, name).collect()}
        else:
            s.counts = {r["value"]: r["count"] for r in top[:cap]}
    return stats


def _below(s: ColumnStats, x: float, bins: int = BINS) -> float:
    """Rows below x by interpolation within its bin."""
    if s.high == s.low:
        return 0.0 if x <= s.low else float(sum(s.bins.values()))
    at = (x - s.low) / (s.high - s.low) * bins
    whole = math.floor(at)
    return sum(n for b, n in s.bins.items() if b < whole) + s.bins.get(whole, 0) * (at - whole)


def _equal(s: ColumnStats | None, value: object, rows: int) -> float:
    if s is None or not s.tracked or s.counts is None:
        return 1 / s.distinct if s is not None and s.distinct else 1 / max(1, rows)
    if value in s.counts:
        return s.counts[value] / max(1, rows)
    return 1 / max(1, s.distinct) if s.overflowed else 0.0


def _overlap(low: float, high: float, s: ColumnStats | None) -> float:
    """Share of a column's observed range that an interval covers."""
    if s is None or s.low is None or s.high is None:
        return 1.0
    if s.high == s.low:
        return float(low <= s.low <= high)
    return max(0.0, min(high, s.high) - max(low, s.low)) / (s.high - s.low)


def selectivity(p: Predicate, stats: TableStats) -> float:
    """The estimated share of rows that pass one predicate."""
    s = stats.columns.get(p.column)
    if s is None:
        raise InvalidPredicate(f"no column {p.column!r}")
    n = stats.rows
    if p.op in (Op.GEO_BOX, Op.GEO_RADIUS):
        if p.op is Op.GEO_BOX:
            a, b, x, y = p.geo
        else:
            lat, lng, km = p.geo
            half = km / 111.0
            cos = math.cos(math.radians(lat))
            wide = 180.0 if cos < 1e-6 or lat + half >= 90 or lat - half <= -90 else half / cos
            a, b, x, y = lat - half, lat + half, lng - wide, lng + wide
        return _overlap(a, b, s) * _overlap(x, y, stats.columns.get(p.lng_column))
    if s.kind == TEXT and p.op is Op.EQ or s.kind == SET and p.op is Op.CONTAINS:
        return _equal(s, p.value, n)
    if s.kind == TEXT and p.op is Op.IN:
        return min(1.0, sum(_equal(s, v, n) for v in p.values))
    if s.kind == SET and p.op is Op.CONTAINS_ANY:
        return min(1.0, sum(_equal(s, v, n) for v in p.values))
    if s.kind == SET and p.op is Op.CONTAINS_ALL:
        return math.prod(_equal(s, v, n) for v in p.values) if p.values else 1.0
    if s.kind != NUMBER or p.op not in (Op.EQ, Op.LT, Op.LE, Op.GT, Op.GE, Op.BETWEEN):
        return 1.0
    if not s.tracked:
        return _equal(s, None, n) if p.op is Op.EQ else 1.0
    if not n or s.low is None:
        return 1.0
    a = typed(p.value, s.dtype)
    b = typed(p.high, s.dtype) if p.high is not None else None
    if s.bins is not None:
        total = sum(s.bins.values())
        share = {
            Op.EQ: lambda: total / BINS if s.low <= a <= s.high else 0.0,
            Op.LT: lambda: _below(s, min(max(a, s.low), s.high)), Op.LE: lambda: _below(s, min(max(a, s.low), s.high)),
            Op.GT: lambda: total - _below(s, min(max(a, s.low), s.high)), Op.GE: lambda: total - _below(s, min(max(a, s.low), s.high)),
            Op.BETWEEN: lambda: max(0.0, _below(s, min(max(b, s.low), s.high)) - _below(s, min(max(a, s.low), s.high))),
        }[p.op]()
        return share / n
    test = {Op.EQ: lambda v: v == a, Op.LT: lambda v: v < a, Op.LE: lambda v: v <= a, Op.GT: lambda v: v > a, Op.GE: lambda v: v >= a, Op.BETWEEN: lambda v: a <= v <= b}[p.op]
    return sum(c for v, c in s.counts.items() if test(v)) / n


def combined(predicates: list[Predicate], stats: TableStats) -> float:
    """Predicates taken as independent, none under a ten-thousandth."""
    return min(1.0, math.prod(max(selectivity(p, stats), 1e-4) for p in predicates))
