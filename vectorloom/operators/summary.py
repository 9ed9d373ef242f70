"""Zone maps of leaves and their pruning.

A leaf's summary holds, by numeric column, the least and the largest value, and, by text or set column, its distinct
values where they are few. Values are kept as they are, so a summary never claims a value that isn't there, and one
whose values are unknown never prunes.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vectorloom.functions.predicates import NUMBER, SET, TEXT, Op, Predicate, kind_of, typed

DISTINCT = 150


def filter_columns(schema: T.StructType, keys: Iterable[str]) -> list[str]:
    return [f.name for f in schema if f.name not in set(keys) and kind_of(f.dataType) in (NUMBER, TEXT, SET)]


def _columns(rows: DataFrame, keys: list[str], columns: list[str]) -> list[Column]:
    out = [F.count("*").alias("rows")]
    for name in columns:
        c = F.col(f"`{name}`")
        if kind_of(rows.schema[name].dataType) == NUMBER:
            out += [F.min(c).alias(f"{name}__min"), F.max(c).alias(f"{name}__max")]
    return out


def leaf_summaries(rows: DataFrame, keys: list[str], columns: list[str] | None = None) -> DataFrame:
    """One row a leaf: rows, <numeric>__min and __max, <text or set>__set (sorted, NULL beyond DISTINCT values)."""
    columns = filter_columns(rows.schema, keys) if columns is None else columns
    out = rows.groupBy(*keys).agg(*_columns(rows, keys, columns))
    for name in columns:
        kind = kind_of(rows.schema[name].dataType)
        if kind == NUMBER:
            continue
        c = F.col(f"`{name}`")
        values = rows.select(*keys, (F.explode(c) if kind == SET else c).alias("v")).where("v IS NOT NULL").distinct()
        # no more than DISTINCT + 1 values of a leaf are gathered
        few = values.groupBy(*keys).agg(F.count("*").alias("n"))
        kept = values.join(few.where(F.col("n") <= DISTINCT), keys).groupBy(*keys).agg(F.sort_array(F.collect_list("v")).alias("kept"))
        known = few.join(kept, keys, "left").select(*keys, "n", "kept")
        out = out.join(known, keys, "left").withColumn(f"{name}__set", F.when(F.col("n").isNull(), F.array().cast("array<string>")).otherwise(F.col("kept"))).drop("n", "kept")
    return out


def parent_summaries(leaves: DataFrame, parent: str) -> DataFrame:
    """Summaries of inner nodes out of their children's; an unknown set makes the parent's unknown."""
    out = [F.sum("rows").alias("rows")]
    for name in leaves.columns:
        if name.endswith("__min"):
            out.append(F.min(f"`{name}`").alias(name))
        elif name.endswith("__max"):
            out.append(F.max(f"`{name}`").alias(name))
        elif name.endswith("__set"):
            union = F.array_sort(F.array_distinct(F.flatten(F.collect_list(f"`{name}`"))))
            unknown = F.max(F.col(f"`{name}`").isNull()) | (F.size(union) > DISTINCT)
            out.append(F.when(~unknown, union).alias(name))
    return leaves.groupBy(parent).agg(*out)


def may_match(p: Predicate, schema: T.StructType, summary: T.StructType) -> Column:
    """Whether a leaf with this summary may hold a passing row; comparands are typed as when rows are tested."""
    kind = p.checked(schema)
    yes = F.lit(True)
    col = lambda name, part: F.col(f"`{name}__{part}`")
    if kind == NUMBER and f"{p.column}__min" in summary.names:
        low, high = col(p.column, "min"), col(p.column, "max")
        if p.op in (Op.GEO_BOX, Op.GEO_RADIUS):
            if p.op is Op.GEO_BOX:
                a, b, x, y = p.geo
            else:
                from math import asin, cos, degrees, radians, sin

                lat, lng, km = p.geo
                angle = km / 6371.0
                a, b = lat - degrees(angle) - 1e-6, lat + degrees(angle) + 1e-6
                edge = abs(lat) + degrees(angle) >= 90 or angle >= 1.5
                wide = 360.0 if edge else degrees(asin(min(1.0, sin(angle) / cos(radians(lat))))) + 1e-6
                x, y = (lng - wide, lng + wide) if lng - wide >= -180 and lng + wide <= 180 else (-1e9, 1e9)
            ok = (low <= b) & (high >= a) & (col(p.lng_column, "min") <= y) & (col(p.lng_column, "max") >= x)
        elif p.op in (Op.EQ, Op.LT, Op.LE, Op.GT, Op.GE, Op.BETWEEN):
            dtype = schema[p.column].dataType
            if isinstance(dtype, T.TimestampType):
                return yes
            v = F.lit(typed(p.value, dtype))
            ok = {
                Op.EQ: lambda: (low <= v) & (high >= v), Op.LT: lambda: low < v, Op.LE: lambda: low <= v,
                Op.GT: lambda: high > v, Op.GE: lambda: high >= v, Op.BETWEEN: lambda: (low <= F.lit(typed(p.high, dtype))) & (high >= v),
            }[p.op]()
        else:
            return yes
        # a leaf of NULLs only has no range, and no row of it passes
        return F.coalesce(ok, F.lit(False))
    if kind in (TEXT, SET) and f"{p.column}__set" in summary.names:
        values = col(p.column, "set")
        has = lambda v: F.array_contains(values, v)
        wanted = [*p.values, *([p.value] if p.value is not None else [])]
        if p.op in (Op.EQ, Op.CONTAINS):
            return F.coalesce(has(p.value), yes)
        if p.op in (Op.IN, Op.CONTAINS_ANY):
            return F.coalesce(reduce(Column.__or__, map(has, wanted)), yes)
        if p.op is Op.CONTAINS_ALL and wanted:
            return F.coalesce(reduce(Column.__and__, map(has, wanted)), yes)
        if p.op is Op.PREFIX:
            return F.coalesce(F.exists(values, lambda v: v.startswith(p.value)), yes)
    return yes


def surviving(leaves: DataFrame, predicates: Iterable[Predicate], schema: T.StructType) -> DataFrame:
    """The leaves that may hold rows passing all predicates."""
    for p in predicates:
        leaves = leaves.where(may_match(p, schema, leaves.schema))
    return leaves


def root_estimate(children: DataFrame, predicates: list[Predicate], schema: T.StructType) -> float:
    """Share of summaries that overlap the predicates, for tables without statistics."""
    total = children.count()
    return surviving(children, predicates, schema).count() / total if total else 1.0
