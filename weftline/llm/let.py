"""Column expressions with names: a value is computed once and used many times."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), where value is computed once for a row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def upto(n: Column) -> Column:
    """0, 1, ..., n - 1 as an array of int; empty for n <= 0."""
    return F.when(n > 0, F.sequence(F.lit(0), (n - 1).cast("int"))).otherwise(F.array().cast("array<int>"))


def total(a: Column, kind: str = "long") -> Column:
    """The sum of an array."""
    return F.aggregate(a, F.lit(0).cast(kind), lambda s, x: s + x.cast(kind))
