"""Typed filter predicates: validated against a schema, turned into column expressions with SQL's three-valued logic.

A comparand takes the column's type before it is compared: halves round away from zero for integers, floats are
narrowed to 32 bits, and integers beyond 2**53 stay integers. A comparand out of the column's range folds to what the
comparison then means for every value. NULL satisfies IS_NULL only.
"""

from __future__ import annotations

import math
import struct
from collections.abc import Iterable
from dataclasses import dataclass, field
from decimal import ROUND_HALF_UP, Decimal
from enum import Enum
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vectorloom.functions.vectors import haversine_km


class Op(str, Enum):
    EQ, NE, LT, LE, GT, GE = "eq", "ne", "lt", "le", "gt", "ge"
    BETWEEN, PREFIX, IN, NOT_IN = "between", "prefix", "in", "not_in"
    CONTAINS, CONTAINS_ANY, CONTAINS_ALL = "contains", "contains_any", "contains_all"
    GEO_BOX, GEO_RADIUS = "geo_box", "geo_radius"
    IS_NULL, IS_NOT_NULL = "is_null", "is_not_null"


class InvalidPredicate(ValueError):
    """An unknown column, an operator that doesn't suit its type, or an operand that is missing or of the wrong kind."""


_INTEGERS = {T.ByteType: 8, T.ShortType: 16, T.IntegerType: 32, T.LongType: 64}
NUMBER, TEXT, FLAG, SET = "number", "text", "flag", "set"
_NULL_TESTS = {Op.IS_NULL, Op.IS_NOT_NULL}
_ALLOWED = {
    NUMBER: {Op.EQ, Op.NE, Op.LT, Op.LE, Op.GT, Op.GE, Op.BETWEEN, Op.IN, Op.NOT_IN, Op.GEO_BOX, Op.GEO_RADIUS} | _NULL_TESTS,
    TEXT: {Op.EQ, Op.NE, Op.PREFIX, Op.IN, Op.NOT_IN} | _NULL_TESTS,
    FLAG: {Op.EQ, Op.NE} | _NULL_TESTS,
    SET: {Op.CONTAINS, Op.CONTAINS_ANY, Op.CONTAINS_ALL} | _NULL_TESTS,
}


def kind_of(dtype: T.DataType) -> str | None:
    """The family of a column type; None where it can't be filtered on."""
    if type(dtype) in _INTEGERS or isinstance(dtype, (T.FloatType, T.DoubleType, T.TimestampType)):
        return NUMBER
    if isinstance(dtype, T.StringType):
        return TEXT
    if isinstance(dtype, T.BooleanType):
        return FLAG
    if isinstance(dtype, T.ArrayType) and isinstance(dtype.elementType, T.StringType):
        return SET
    return None


@dataclass(frozen=True)
class Predicate:
    """One condition. ``value`` and ``high`` serve comparisons, ``values`` lists and sets, ``geo`` boxes
    (lat_low, lat_high, lng_low, lng_high) and circles (lat, lng, km) over ``column`` and ``lng_column``."""

    column: str
    op: Op
    value: object = None
    high: object = None
    values: tuple = field(default=())
    lng_column: str | None = None
    geo: tuple[float, ...] = ()

    def checked(self, schema: T.StructType) -> str:
        """The column's family; raises InvalidPredicate on anything amiss."""
        if self.column not in schema.names:
            raise InvalidPredicate(f"no column {self.column!r}")
        kind = kind_of(schema[self.column].dataType)
        if kind is None or self.op not in _ALLOWED[kind]:
            raise InvalidPredicate(f"{self.op.value} does not apply to {schema[self.column].dataType.simpleString()} column {self.column!r}")
        if self.op in (Op.GEO_BOX, Op.GEO_RADIUS):
            if self.lng_column is None or self.lng_column not in schema.names or kind_of(schema[self.lng_column].dataType) != NUMBER:
                raise InvalidPredicate(f"{self.op.value} needs a numeric longitude column")
            if len(self.geo) != (4 if self.op is Op.GEO_BOX else 3):
                raise InvalidPredicate(f"{self.op.value} got {len(self.geo)} numbers")
        elif self.op in (Op.IN, Op.CONTAINS_ANY) and not self.values:
            raise InvalidPredicate(f"{self.op.value} needs values")
        elif self.op in (Op.EQ, Op.NE, Op.LT, Op.LE, Op.GT, Op.GE, Op.BETWEEN, Op.PREFIX, Op.CONTAINS) and self.value is None or self.op is Op.BETWEEN and self.high is None:
            raise InvalidPredicate(f"{self.op.value} on {self.column!r} needs an operand")
        wants = {NUMBER: (int, float, Decimal), TEXT: str, FLAG: bool, SET: str}[kind]
        for v in (self.value, self.high):
            if v is not None and (not isinstance(v, wants) or kind == NUMBER and isinstance(v, bool)):
                raise InvalidPredicate(f"{v!r} is no operand for the {kind} column {self.column!r}")
        return kind


def typed(value: object, dtype: T.DataType) -> object:
    """A numeric comparand in the column's own domain; infinities where it lies outside."""
    bits = _INTEGERS.get(type(dtype))
    if bits:
        if isinstance(value, float) and not math.isfinite(value):
            return value
        n = value if isinstance(value, int) else int(Decimal(value).quantize(Decimal(1), ROUND_HALF_UP))
        return math.inf if n >= 1 << (bits - 1) else -math.inf if n < -(1 << (bits - 1)) else n
    if isinstance(dtype, T.FloatType):
        try:
            return struct.unpack("f", struct.pack("f", float(value)))[0]
        except OverflowError:
            return math.copysign(math.inf, value)
    return float(value)


def _list_items(p: Predicate, dtype: T.DataType, kind: str) -> list:
    """The operands of IN and NOT_IN; for numbers given as text, those that don't parse are skipped."""
    if kind == TEXT:
        return [str(v) for v in p.values]
    out = []
    for v in p.values:
        if isinstance(v, str):
            try:
                v = int(v) if v.strip().lstrip("+-").isdigit() else float(v)
            except ValueError:
                continue
        t = typed(v, dtype)
        if not (type(dtype) in _INTEGERS and isinstance(t, float)):
            out.append(t)
    return out


def to_column(p: Predicate, schema: T.StructType) -> Column:
    """A boolean expression: true where the row passes, false or NULL where not."""
    kind = p.checked(schema)
    dtype, c, op = schema[p.column].dataType, F.col(f"`{p.column}`"), p.op
    if op is Op.IS_NULL:
        return c.isNull()
    if op is Op.IS_NOT_NULL:
        return c.isNotNull()
    if op in (Op.GEO_BOX, Op.GEO_RADIUS):
        lng = F.col(f"`{p.lng_column}`")
        if op is Op.GEO_BOX:
            a, b, x, y = map(float, p.geo)
            return c.cast("double").between(a, b) & lng.cast("double").between(x, y)
        lat0, lng0, km = map(float, p.geo)
        return haversine_km(c, lng, lat0, lng0) <= km
    if kind == SET:
        if op is Op.CONTAINS:
            return F.array_contains(c, p.value)
        wanted = [*p.values, *([p.value] if p.value is not None else [])]
        if op is Op.CONTAINS_ANY:
            return F.arrays_overlap(c, F.array(*map(F.lit, wanted)))
        return reduce(Column.__and__, (F.array_contains(c, v) for v in wanted), c.isNotNull())
    if kind == TEXT:
        if op is Op.PREFIX:
            return c.startswith(p.value)
        if op in (Op.IN, Op.NOT_IN):
            hit = c.isin(_list_items(p, dtype, kind)) if p.values else F.lit(False)
            return hit if op is Op.IN else c.isNotNull() & ~hit
        return c == F.lit(p.value) if op is Op.EQ else c != F.lit(p.value)
    if kind == FLAG:
        return c == F.lit(p.value) if op is Op.EQ else c != F.lit(p.value)
    return _numeric(p, dtype, c)


def _numeric(p: Predicate, dtype: T.DataType, c: Column) -> Column:
    floating = isinstance(dtype, (T.FloatType, T.DoubleType))
    # Spark holds NaN equal to itself and greater than all; IEEE comparisons with it are false, but for !=
    number = ~F.isnan(c) if floating else F.lit(True)
    if isinstance(dtype, T.TimestampType):
        c = F.unix_micros(c)
        dtype = T.LongType()
    lit = lambda v: F.lit(v).cast(dtype)
    known = c.isNotNull()
    if p.op in (Op.IN, Op.NOT_IN):
        items = [v for v in _list_items(p, dtype, NUMBER) if not (isinstance(v, float) and math.isnan(v))]
        hit = c.isin([lit(v) for v in items]) & number if items else F.lit(False)
        return hit if p.op is Op.IN else known & ~hit
    a = typed(p.value, dtype)
    if isinstance(a, float) and math.isnan(a):
        return known if p.op is Op.NE else known & F.lit(False)
    outside = type(dtype) in _INTEGERS and isinstance(a, float)
    always, never = known, known & F.lit(False)
    if p.op is Op.BETWEEN:
        b = typed(p.high, dtype)
        low = always if outside and a < 0 else never if outside else c >= lit(a)
        high = (always if b > 0 else never) if type(dtype) in _INTEGERS and isinstance(b, float) else c <= lit(b)
        return low & high & number
    if outside:
        above = a > 0
        return {Op.EQ: never, Op.NE: always, Op.LT: always if above else never, Op.LE: always if above else never, Op.GT: never if above else always, Op.GE: never if above else always}[p.op]
    v = lit(a)
    if p.op is Op.NE:
        return (c != v) | ~number if floating else c != v
    return {Op.EQ: c == v, Op.LT: c < v, Op.LE: c <= v, Op.GT: c > v, Op.GE: c >= v}[p.op] & number


def matches(df: DataFrame, predicates: Iterable[Predicate]) -> DataFrame:
    """The rows that pass all predicates; filters are pushed into the scan where the source can take them."""
    predicates = list(predicates)
    return df.where(reduce(Column.__and__, (to_column(p, df.schema) for p in predicates))) if predicates else df


def parse(text: str, schema: T.StructType) -> Predicate:
    """``column:op:operands``, or ``lat:lng:geo_box|geo_radius:numbers``; operands are read by the column's type.

    Lists are separated by commas, ranges and geometry by colons; the rest of a text operand may hold colons."""
    parts = text.split(":")
    if len(parts) >= 3 and parts[2] in (Op.GEO_BOX.value, Op.GEO_RADIUS.value):
        try:
            p = Predicate(parts[0], Op(parts[2]), lng_column=parts[1], geo=tuple(map(float, parts[3:])))
        except ValueError as e:
            raise InvalidPredicate(str(e)) from None
        p.checked(schema)
        return p
    if len(parts) < 2 or parts[1] not in {o.value for o in Op}:
        raise InvalidPredicate(f"can't read {text!r}")
    name, op, rest = parts[0], Op(parts[1]), ":".join(parts[2:])
    if name not in schema.names:
        raise InvalidPredicate(f"no column {name!r}")
    kind = kind_of(schema[name].dataType)

    def operand(s: str):
        if kind == FLAG:
            if s.lower() not in ("true", "false", "1", "0"):
                raise InvalidPredicate(f"{s!r} is no boolean")
            return s.lower() in ("true", "1")
        if kind == NUMBER:
            try:
                return int(s) if s.strip().lstrip("+-").isdigit() else float(s)
            except ValueError:
                raise InvalidPredicate(f"{s!r} is no number") from None
        return s

    if op in _NULL_TESTS:
        p = Predicate(name, op)
    elif op in (Op.IN, Op.NOT_IN, Op.CONTAINS_ANY, Op.CONTAINS_ALL):
        p = Predicate(name, op, values=tuple(rest.split(",")) if rest else ())
    elif op is Op.BETWEEN:
        if len(parts) != 4:
            raise InvalidPredicate("between needs two operands")
        p = Predicate(name, op, operand(parts[2]), operand(parts[3]))
    else:
        p = Predicate(name, op, operand(rest))
    p.checked(schema)
    return p
