"""Column functions on vectors held as arrays: they stay inside whole-stage code and shuffle nothing."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def total(a: Column) -> Column:
    """Sum of an array of doubles; 0 for an empty one, null for a null one or a null element."""
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def minus(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x - y)


def norm(a: Column) -> Column:
    return F.sqrt(total(F.transform(a, lambda x: x * x)))


def doubles(a: Column) -> Column:
    return F.transform(a, lambda x: x.cast("double"))


def clean(x: Column) -> Column:
    """NaN to null, so that aggregates skip both alike."""
    return F.when(~F.isnan(x), x)


def distance(a: Column, b: Column, metric: str = "euclidean", p: float = 3.0) -> Column:
    """Distance of two vectors. Metrics: euclidean, sqeuclidean, cityblock, chebyshev, cosine, correlation, minkowski (`p`),
    hamming, canberra, braycurtis. Divisions by zero give null, except that canberra counts 0/0 as 0."""
    gap = F.zip_with(a, b, lambda x, y: F.abs(x - y))
    if metric == "euclidean":
        return F.sqrt(total(F.transform(gap, lambda x: x * x)))
    if metric == "sqeuclidean":
        return total(F.transform(gap, lambda x: x * x))
    if metric == "cityblock":
        return total(gap)
    if metric == "chebyshev":
        return F.array_max(gap)
    if metric == "minkowski":
        return F.pow(total(F.transform(gap, lambda x: F.pow(x, F.lit(p)))), F.lit(1 / p))
    if metric == "cosine":
        return 1 - F.try_divide(dot(a, b), norm(a) * norm(b))
    if metric == "correlation":
        n, sa, sb = F.size(a), total(a), total(b)
        square = lambda x, s: n * dot(x, x) - s * s
        return 1 - F.try_divide(n * dot(a, b) - sa * sb, F.sqrt(square(a, sa) * square(b, sb)))
    if metric == "hamming":
        return total(F.transform(gap, lambda x: F.when(x != 0, 1.0).otherwise(0.0))) / F.size(a)
    if metric == "canberra":
        return total(F.zip_with(a, b, lambda x, y: F.coalesce(F.try_divide(F.abs(x - y), F.abs(x) + F.abs(y)), F.lit(0.0))))
    if metric == "braycurtis":
        return F.try_divide(total(gap), total(F.zip_with(a, b, lambda x, y: F.abs(x + y))))
    raise ValueError(f"unknown metric {metric}")


METRICS = ("euclidean", "sqeuclidean", "cityblock", "chebyshev", "cosine", "correlation", "minkowski", "hamming", "canberra", "braycurtis")


def hyperbolic_distance(r1: Column, a1: Column, r2: Column, a2: Column) -> Column:
    """Distance in the hyperbolic plane of two points in polar coordinates."""
    c = F.cosh(r1) * F.cosh(r2) - F.sinh(r1) * F.sinh(r2) * F.cos(a1 - a2)
    return F.acosh(F.greatest(c, F.lit(1.0)))


def polar(v: Column) -> Column:
    """Radius and angles of a Cartesian vector: [r, angle 1 .. n-1]; the last angle has its sign, a zero vector has zeros."""
    n = F.size(v)
    rest = lambda i: F.sqrt(total(F.transform(F.slice(v, i, n), lambda x: x * x)))
    turns = F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.when(i == n - 1, F.atan2(F.element_at(v, n), F.element_at(v, n - 1))).otherwise(F.coalesce(F.acos(F.try_divide(F.element_at(v, i), rest(i))), F.lit(0.0))))
    return F.concat(F.array(norm(v)), turns)


def wrapped(x: Column, low: float, high: float) -> Column:
    """`x` moved by whole periods into [low, high)."""
    span = high - low
    return x - F.floor((x - low) / span) * span


def folded(point: Column) -> Column:
    """Spherical coordinates [r, angle 1 .. n-1] with every angle but the last in [0, pi] and the last in [0, 2 pi).

    An angle beyond pi is reflected, 2 pi less it, and the next one is turned by pi to stay at the same place.
    """
    turn = 2 * math.pi
    start = F.struct(F.array(F.get(point, F.lit(0))).alias("out"), F.lit(0.0).alias("by"))

    def step(s: Column, x: Column) -> Column:
        last = F.size(s["out"]) == F.size(point) - 1
        a = wrapped(x + s["by"], 0.0, turn)
        over = (a > math.pi) & ~last
        return F.struct(F.concat(s["out"], F.array(F.when(over, turn - a).otherwise(a))).alias("out"), F.when(over, F.lit(math.pi)).otherwise(F.lit(0.0)).alias("by"))

    return F.aggregate(F.slice(point, 2, F.greatest(F.size(point) - 1, F.lit(0))), start, step)["out"]
