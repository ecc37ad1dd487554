"""Scoring: labels, ranked candidates, uncertainty, unknown-class rules."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from zonewright import vocabulary as V
from zonewright.functions.numbers import entropy
from zonewright.operators.base import hold
from zonewright.operators.ranks import sorted_positions
from zonewright.operators.voting import confident


def label_of(index: Column, classes: Sequence[int]) -> Column:
    """The class label at a model output position."""
    return F.get(F.array(*[F.lit(int(c)).cast("long") for c in classes]), index)


def predictions(
    df: DataFrame, classes: Sequence[int], probs: str = "probs", threshold: float = 0.3, k: int = 5
) -> DataFrame:
    """Adds predicted_appid, confidence, top_k (label, probability), is_uncertain."""
    ranked = confident(df, probs, k)
    top = F.transform(
        "top_k",
        lambda x: F.struct(label_of(x["class_idx"], classes).alias("appid"), x["probability"].alias("probability")),
    )
    return ranked.select(
        *df.columns,
        label_of(F.col("class_idx"), classes).alias("predicted_appid"),
        "confidence",
        top.alias("top_k"),
        (F.col("confidence") < threshold).alias("is_uncertain"),
    )


def with_fallback(scored: DataFrame, threshold: float = 0.2, unknown: int = V.UNKNOWN_LABEL) -> DataFrame:
    """Below the threshold the owner is unknown, and the row uncertain."""
    below = F.col("confidence") < threshold
    return scored.withColumns(
        {
            "predicted_appid": F.when(below, F.lit(unknown).cast("long")).otherwise(F.col("predicted_appid")),
            "is_uncertain": F.col("is_uncertain") | below,
        }
    )


def with_entropy_rule(scored: DataFrame, probs: str = "probs", limit: float = 2.0, unknown: int = V.UNKNOWN_LABEL) -> DataFrame:
    """A flat distribution (entropy above the limit, in nats) means unknown."""
    out = scored.withColumn("entropy", entropy(F.col(probs)))
    return out.withColumn(
        "predicted_appid", F.when(F.col("entropy") > limit, F.lit(unknown).cast("long")).otherwise(F.col("predicted_appid"))
    )


def wide(scored: DataFrame, k: int = 5, keep: Sequence[str] = ("fqdn",)) -> DataFrame:
    """Flat columns ``top_1_appid, top_1_prob, ...`` for a CSV sink."""
    tops = []
    for i in range(k):
        item = F.get("top_k", F.lit(i))
        tops += [item["appid"].alias(f"top_{i + 1}_appid"), item["probability"].alias(f"top_{i + 1}_prob")]
    return scored.select(*keep, "predicted_appid", "confidence", "is_uncertain", *tops)


def summary(scored: DataFrame) -> DataFrame:
    """Totals of a scored table in one aggregate."""
    return scored.agg(
        F.count("*").alias("total_count"),
        F.count_if("is_uncertain").alias("uncertain_count"),
        F.avg(F.col("is_uncertain").cast("double")).alias("uncertain_share"),
        F.avg("confidence").alias("avg_confidence"),
    )


def centroids(df: DataFrame, vector: str, label: str) -> DataFrame:
    """``(label, centroid)``: the mean vector of each class.

    The mean of a class is one buffer per task, so a class of any size leaves
    one partial row per task.
    """
    rows = df.where(F.col(label).isNotNull() & F.col(vector).isNotNull())
    rows = rows.select(F.col(label).alias("label"), array_to_vector(F.transform(vector, lambda x: x.cast("double"))).alias("__v"))
    return rows.groupBy("label").agg(vector_to_array(Summarizer.mean(F.col("__v"))).alias("centroid"))


def nearest_centroid(df: DataFrame, vector: str, table: DataFrame, threshold: float = 0.85, block: int = 2048) -> DataFrame:
    """Adds ``nearest`` and ``similarity``: the most similar class centroid by
    cosine, or a null class below the threshold. Ties go to the lowest label.

    The centroids go to every task in blocks of at most ``block``, each as one
    matrix product per batch, and the best so far stays with the row. Zero
    centroids and zero vectors have no direction and match nothing.
    """
    some = F.exists("centroid", lambda x: x != 0)
    placed = hold(sorted_positions(table.where(some).select("label", "centroid"), [], ["label"], "__at"))
    kind = dict(placed.dtypes)["label"]
    out = df.withColumn("__best", F.lit(None).cast(f"struct<similarity: double, label: {kind}>"))
    for start in range(0, placed.count(), block):
        rows = placed.where(F.col("__at").between(start, start + block - 1)).orderBy("__at").collect()  # one block
        labels = F.array(*[F.lit(r["label"]) for r in rows])
        matrix = np.array([r["centroid"] for r in rows], dtype="float64")
        found = _closest(df.sparkSession.sparkContext.broadcast(matrix / np.linalg.norm(matrix, axis=1, keepdims=True)))
        out = out.withColumn("__near", found(F.col(vector)))
        better = F.col("__near.similarity").isNotNull() & F.coalesce(F.col("__near.similarity") > F.col("__best.similarity"), F.lit(True))
        new = F.struct(F.col("__near.similarity").alias("similarity"), F.get(labels, F.col("__near.position")).alias("label"))
        out = out.withColumn("__best", F.when(better, new).otherwise(F.col("__best"))).drop("__near")
    close = F.col("__best.similarity") >= threshold
    return out.select(*df.columns, F.when(close, F.col("__best.label")).alias("nearest"), F.col("__best.similarity").alias("similarity"))


def _closest(shared):
    def closest(vectors: pd.Series) -> pd.DataFrame:
        found = pd.DataFrame({"position": pd.array([None] * len(vectors), dtype="Int32"), "similarity": pd.array([None] * len(vectors), dtype="Float64")})
        usable = [i for i, v in enumerate(vectors) if v is not None and np.any(v)]
        if usable:
            x = np.stack([vectors.iloc[i] for i in usable]).astype("float64")
            cosine = (x @ shared.value.T) / np.linalg.norm(x, axis=1, keepdims=True)
            found.loc[usable, "position"] = cosine.argmax(axis=1)
            found.loc[usable, "similarity"] = cosine.max(axis=1)
        return found

    return F.pandas_udf(closest, "position int, similarity double")
