"""Flags over the scan-result tags of a host."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from zonewright import vocabulary as V


def feature_names(tags: Sequence[str] = V.SCAN_TAGS) -> list[str]:
    return [f"scan_{t.replace('-', '_')}" for t in tags] + ["scan_count"]


def _any_contains(values: Column, tag: str) -> Column:
    return F.exists(values, lambda e: F.contains(e, F.lit(tag)))


def scan_features(
    df: DataFrame, column: str = "scan_result", tags: Sequence[str] = V.SCAN_TAGS
) -> DataFrame:
    """One flag per tag (contained in any element, any case) and the count.

    Accepts an array of strings or one string; null or no column gives zeros.
    """
    names = feature_names(tags)
    if column not in df.columns:
        return df.select("*", *[F.lit(0).alias(n) for n in names])
    value = F.col(column)
    if isinstance(df.schema[column].dataType, T.ArrayType):
        lowered = F.transform(value, F.lower)
        hits = [_any_contains(lowered, t) for t in tags]
        count = F.when(value.isNull(), 0).otherwise(F.size(value))
    else:
        hits = [F.contains(F.lower(value), F.lit(t)) for t in tags]
        count = F.when(value != "", 1).otherwise(0)
    flags = [F.when(h, 1).otherwise(0) for h in hits]
    return df.select("*", *[c.alias(n) for n, c in zip(names, [*flags, count])])
