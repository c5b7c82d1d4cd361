"""Vectors as array columns; sums run in the order of the elements."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_double(v: Column) -> Column:
    return F.transform(v, lambda x: x.cast("double"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def unit(v: Column) -> Column:
    """The vector over its length; a zero vector stays."""
    n = norm(v)
    return F.when(n > 0, F.transform(v, lambda x: x / n)).otherwise(v)


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cosine within [0, 2]; 2 if a vector is zero."""
    size = norm(a) * norm(b)
    return F.when(size > 0, F.least(F.lit(2.0), F.greatest(F.lit(0.0), 1 - dot(a, b) / size))).otherwise(F.lit(2.0))


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is worked out once, however often ``use`` names it."""
    return F.get(F.transform(F.array(value), use), 0)


def softmax(v: Column, temperature: float = 1.0) -> Column:
    shares = lambda e: bound(F.aggregate(e, F.lit(0.0), lambda s, x: s + x), lambda total: F.transform(e, lambda x: x / total))
    return bound(F.array_max(v), lambda most: bound(F.transform(v, lambda x: F.exp((x - most) / temperature)), shares))


def top_elements(v: Column, k: int = 5) -> Column:
    """The ``k`` greatest elements as structs (index, value), ties by the lower index."""
    entries = F.transform(v, lambda x, i: F.struct((-x).alias("minus"), i.alias("index")))
    return F.transform(F.slice(F.array_sort(entries), 1, k), lambda e: F.struct(e["index"].alias("index"), (-e["minus"]).alias("value")))


def log_signed(x: Column) -> Column:
    """-sign(x) log10(|x| + 1e-12)."""
    return -F.signum(x) * F.log10(F.abs(x) + 1e-12)
