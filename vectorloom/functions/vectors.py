"""Vector kernels as column expressions: double arithmetic, added from left to right."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

L2, IP = "l2", "ip"


def _fold(terms: Column) -> Column:
    return F.aggregate(terms, F.lit(0.0), lambda total, t: total + t)


def squared_l2(a: Column, b: Column) -> Column:
    return _fold(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))))


def dot(a: Column, b: Column) -> Column:
    return _fold(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def norm(a: Column) -> Column:
    return F.sqrt(_fold(F.transform(a, lambda x: x.cast("double") * x.cast("double"))))


def distance(a: Column, b: Column, metric: str) -> Column:
    """Ascending means closer: the squared Euclidean distance, or the negated inner product."""
    if metric == L2:
        return squared_l2(a, b)
    if metric == IP:
        return -dot(a, b)
    raise ValueError(f"unknown metric {metric!r}")


def normalized(a: Column) -> Column:
    """Unit length; a zero vector stays as it is."""
    n = norm(a)
    return F.when(n > 0, F.transform(a, lambda x: (x.cast("double") / n).cast("float"))).otherwise(a)


def haversine_km(lat: Column, lng: Column, lat0: float, lng0: float) -> Column:
    """Great-circle distance on a sphere of 6371 km."""
    p, q = F.radians(lat.cast("double")), F.radians(F.lit(float(lat0)))
    half_lat = F.sin((p - q) / 2)
    half_lng = F.sin((F.radians(lng.cast("double")) - F.radians(F.lit(float(lng0)))) / 2)
    a = half_lat * half_lat + F.cos(p) * F.cos(q) * half_lng * half_lng
    return F.lit(2 * 6371.0) * F.atan2(F.sqrt(a), F.sqrt(F.greatest(F.lit(0.0), 1 - a)))
