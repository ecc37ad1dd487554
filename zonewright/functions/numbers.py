"""Small numeric expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once per row, however often
    ``use`` mentions it (the optimiser may inline a plain column repeatedly)."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def safe_divide(numerator: Column, denominator: Column, default: float = 0.0) -> Column:
    """``numerator / denominator``, or ``default`` where the denominator is 0."""
    n, d = numerator.cast("double"), denominator.cast("double")
    return F.when(d == 0, F.lit(float(default))).otherwise(n / d)


def entropy(p: Column) -> Column:
    return F.aggregate(
        p, F.lit(0.0), lambda acc, x: acc - F.when(x > 0, x * F.ln(x)).otherwise(0.0)
    )


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda i, j: i * j), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))
