"""Array expressions whose cost is linear in the array's length."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` worked out once a row, also where ``body`` uses it inside a lambda."""
    return F.element_at(F.transform(F.array(value), body), 1)


def indices(n: int | Column) -> Column:
    """0 to ``n - 1``; empty for 0."""
    n = F.lit(n) if isinstance(n, int) else n.cast("int")
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


def total(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda s, v: s + v)


def add_vectors(vectors: Column) -> Column:
    """Element-wise sum of an array of equally long vectors of doubles."""
    return let(vectors, lambda vs: F.aggregate(vs, F.array_repeat(F.lit(0.0), F.size(F.element_at(vs, 1))), lambda s, x: F.zip_with(s, x, lambda a, b: a + b)))
