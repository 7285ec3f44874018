"""Vectors in array columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(v: Column) -> Column:
    return F.transform(v, lambda x: x.cast("double"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once, however often ``body`` names it (also inside lambdas)."""
    return F.element_at(F.transform(F.array(value), lambda x: body(x)), 1)


def unit(v: Column) -> Column:
    """Of length one; a zero vector stays zero."""
    scaled = lambda w: let(norm(w), lambda n: F.when(n == 0, w).otherwise(F.transform(w, lambda x: x / n)))
    return let(v, scaled)


def cosine(a: Column, b: Column) -> Column:
    """0 if either vector is zero."""
    n = norm(a) * norm(b)
    return F.when(n == 0, F.lit(0.0)).otherwise(dot(a, b) / n)


def mean(values: Column, dim: int) -> list[Column]:
    """Aggregates of a vector column, one per component."""
    return [F.avg(values[i]).alias(f"m{i}") for i in range(dim)]
