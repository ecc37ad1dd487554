"""Combining class probabilities: expressions over probability arrays.

Each row carries its members' probabilities as arrays, so votes, ranks and
confidences are narrow expressions with no exchange.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from zonewright.operators.base import hold


def normalized_weights(weights: Mapping[str, float]) -> dict[str, float]:
    """Weights that sum to 1 (unchanged if they sum to 0)."""
    total = sum(weights.values())
    return {k: w / total for k, w in weights.items()} if total > 0 else dict(weights)


def normalize_weight_table(df: DataFrame, weight: str = "weight", out: str = "weight") -> DataFrame:
    """The same for a table of weights, one row per member."""
    total = df.agg(F.sum(weight)).first()[0] or 0.0
    return df.withColumn(out, F.col(weight) / F.lit(total) if total > 0 else F.col(weight))


def _scaled(probs: Column, weight: float) -> Column:
    return F.transform(probs, lambda p: p * F.lit(float(weight)))


def soft_vote(members: Mapping[str, Column], weights: Mapping[str, float]) -> Column:
    """Weighted mean of the members' arrays, scaled to sum to 1 (nulls if all
    weights are 0)."""
    combined = None
    for name, weight in normalized_weights(weights).items():
        part = _scaled(members[name], weight)
        combined = part if combined is None else F.zip_with(combined, part, lambda a, b: a + b)
    total = F.aggregate(combined, F.lit(0.0), lambda s, p: s + p)
    return F.transform(combined, lambda p: F.try_divide(p, total))


def predicted_class(probs: Column) -> Column:
    """Index of the largest probability; the lowest index on ties."""
    return (F.array_position(probs, F.array_max(probs)) - 1).cast("int")


def hard_vote(predictions: Mapping[str, Column], weights: Mapping[str, float]) -> Column:
    """The class with the most weight among the members' predictions; the
    smallest class on ties. Compares members pairwise: no grouping by row."""
    share = normalized_weights(weights)
    names = list(share)
    candidates = [
        F.struct(
            (-sum((F.when(predictions[o] == predictions[n], F.lit(float(share[o]))).otherwise(0.0) for o in names), F.lit(0.0))).alias("w"),
            predictions[n].alias("c"),
        )
        for n in names
    ]
    return F.array_min(F.array(*candidates))["c"]


def top_classes(probs: Column, k: int = 5) -> Column:
    """``array<struct<class_idx, probability>>``: the k best, ties by index."""
    ranked = F.array_sort(F.transform(probs, lambda p, i: F.struct((-p).alias("n"), i.alias("i"))))
    return F.transform(
        F.slice(ranked, 1, k),
        lambda x: F.struct(x["i"].alias("class_idx"), (-x["n"]).alias("probability")),
    )


def confident(df: DataFrame, probs: str = "probs", k: int = 5) -> DataFrame:
    """Adds ``class_idx``, ``confidence`` and ``top_k``."""
    p = F.col(probs)
    return df.select(
        "*", predicted_class(p).alias("class_idx"), F.array_max(p).alias("confidence"),
        top_classes(p, k).alias("top_k"),
    )


def combined_importance(importances: DataFrame, weights: DataFrame) -> DataFrame:
    """``(feature, importance)``: weighted sum over members that have any."""
    return (
        importances.join(weights, "member")
        .groupBy("feature")
        .agg(F.sum(F.col("weight") * F.col("importance")).alias("importance"))
    )


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """``(label, n, class_weight)``: balanced weights N / (k * n)."""
    counts = hold(df.where(F.col(label).isNotNull()).groupBy(label).agg(F.count("*").alias("n")))
    totals = counts.agg(F.sum("n"), F.count("*")).first()
    return counts.withColumn("class_weight", F.lit(float(totals[0] or 0)) / (F.lit(totals[1]) * F.col("n")))


def member_arrays(columns: Sequence[str]) -> dict[str, Column]:
    return {c: F.col(c) for c in columns}
