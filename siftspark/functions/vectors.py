"""Vector expressions over array<float>; arithmetic is in double."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    """Over the shorter one's length."""
    return _sum(F.zip_with(doubles(a), doubles(b), lambda x, y: F.coalesce(x * y, F.lit(0.0))))


def l2(a: Column, b: Column) -> Column:
    return F.sqrt(_sum(F.zip_with(doubles(a), doubles(b), lambda x, y: (x - y) * (x - y))))


def norm(v: Column) -> Column:
    return F.sqrt(_sum(F.transform(doubles(v), lambda x: x * x)))


def cosine(a: Column, b: Column) -> Column:
    n = norm(a) * norm(b)
    return F.when(n > 0, dot(a, b) / n)


def unit(v: Column) -> Column:
    """Null for the zero vector."""
    n = norm(v)
    return F.when(n > 0, F.transform(doubles(v), lambda x: x / n))


def usable(v: Column, dim: int) -> Column:
    return v.isNotNull() & (F.size(v) == dim) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x)) & F.exists(v, lambda x: x != 0)


def table_name(space: Column, model: Column) -> Column:
    return F.concat(F.lit("vec_"), space, F.lit("__"), F.regexp_replace(model, "[^0-9a-zA-Z_]", "_"))
