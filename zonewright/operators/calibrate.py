"""Calibrated confidence: how often a score turns out right.

Isotonic regression by pooling adjacent violators: neighbouring scores are
pooled until the share of hits never falls as the score rises. Pooling is
associative, so ranges of scores are pooled side by side and their pools pooled
again, ``FAN`` ranges at a time.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml import Estimator, Model
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from zonewright.operators.base import Stage, hold

FAN = 16
CELLS = 1024


def pooled(low: np.ndarray, n: np.ndarray, hits: np.ndarray) -> list[tuple[float, int, int]]:
    """Pools ``(low, n, hits)`` of ascending scores, shares strictly rising.
    Shares are compared as whole numbers, so the pools have no rounding."""
    stack: list[tuple[float, int, int]] = []
    for x, m, h in zip(low.tolist(), n.tolist(), hits.tolist()):
        while stack and stack[-1][2] * m >= h * stack[-1][1]:
            x, m, h = stack[-1][0], stack[-1][1] + m, stack[-1][2] + h
            stack.pop()
        stack.append((x, m, h))
    return stack


def isotonic_steps(df: DataFrame, score: str, hit: str, resolution: int | None = 10_000) -> DataFrame:
    """``(low, n, hits, p)``: from ``low`` to the next step's, ``p`` of the rows hit.

    ``hit`` is a boolean or 0/1. Rows with a null or NaN score, or a null hit,
    take no part. Equal scores are counted ahead of the exchange. Shares of
    pools are different fractions whose denominators add up to the N rows, so
    there are at most about N^(2/3) of them, and a task of the later rounds
    holds the pools of ``FAN`` ranges only. ``resolution`` joins pools whose
    shares agree to 1/resolution, which bounds the table by resolution + 1
    rows; None keeps all pools.
    """
    rows = df.select(F.nanvl(F.col(score).cast("double"), F.lit(None)).alias("low"), F.col(hit).cast("int").cast("long").alias("hit"))
    values = rows.dropna().withColumn("low", F.col("low") + 0.0).groupBy("low").agg(F.count("*").alias("n"), F.sum("hit").alias("hits"))
    pools = hold(values.repartitionByRange("low").withColumn("part", F.spark_partition_id().cast("long")))
    schema = "part long, low double, n long, hits long"

    def pool(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("low")
        found = pooled(group["low"].to_numpy(), group["n"].to_numpy(), group["hits"].to_numpy())
        return pd.DataFrame(found, columns=["low", "n", "hits"]).assign(part=group["part"].iloc[0])[["part", "low", "n", "hits"]]

    while True:
        pools = hold(pools.select("part", "low", "n", "hits").groupBy("part").applyInPandas(pool, schema))
        if (pools.agg(F.max("part")).first()[0] or 0) == 0:
            break
        pools = pools.withColumn("part", F.floor(F.col("part") / FAN))
    share = F.col("hits") / F.col("n")
    steps = pools.select("low", "n", "hits", share.alias("p"))
    if resolution:
        level = F.floor(F.col("p") * resolution)
        steps = steps.groupBy(level.alias("level")).agg(F.min("low").alias("low"), F.sum("n").alias("n"), F.sum("hits").alias("hits"))
        steps = steps.select("low", "n", "hits", share.alias("p"))
    return hold(steps)


def _cell(x: Column) -> Column:
    return F.least(F.greatest(F.floor(x * CELLS), F.lit(0)), F.lit(CELLS - 1))


def calibrated(df: DataFrame, steps: DataFrame, score: str, output: str = "calibrated") -> DataFrame:
    """Add the share of the step a score falls on; scores below the first step
    take the first. Null and NaN scores, and all scores where there are no
    steps, give null.

    Steps are dealt to the ``CELLS`` cells of [0, 1] they touch, so the lookup
    is a join on the cell. The window that tells each step's end sees the
    steps only.
    """
    order = Window.orderBy("low")
    inf = F.lit(float("inf"))
    bounds = steps.select(
        F.when(F.lag("low").over(order).isNull(), -inf).otherwise(F.col("low")).alias("__low"),
        F.coalesce(F.lead("low").over(order), inf).alias("__next"),
        F.col("p").alias("__p"),
    )
    dealt = bounds.select("*", F.explode(F.sequence(_cell(F.col("__low")), _cell(F.col("__next")))).alias("__cell"))
    x = F.nanvl(F.col(score).cast("double"), F.lit(None)) + 0.0
    scored = df.withColumn("__x", x).withColumn("__at", _cell(F.col("__x")))
    last = (F.col("__x") < F.col("__next")) | (F.col("__next") == inf)
    on = (F.col("__at") == F.col("__cell")) & (F.col("__low") <= F.col("__x")) & last
    names = [F.col(f"`{c}`") for c in df.columns if c != output]
    return scored.join(dealt, on, "left").select(*names, F.col("__p").alias(output))


class ConfidenceCalibrator(Estimator, Stage):
    """Fitted on rows that were not trained on: ``score``, and whether it was ``hit``."""

    SETTINGS = {"score": "confidence", "hit": "hit", "output": "calibrated_confidence", "resolution": 10_000}

    def _fit(self, df: DataFrame) -> "ConfidenceCalibratorModel":
        model = ConfidenceCalibratorModel(**self.settings())
        model.tables = {"steps": isotonic_steps(df, self.get("score"), self.get("hit"), self.get("resolution"))}
        return model


class ConfidenceCalibratorModel(Model, Stage):
    SETTINGS = ConfidenceCalibrator.SETTINGS

    def _transform(self, df: DataFrame) -> DataFrame:
        return calibrated(df, self.tables["steps"], self.get("score"), self.get("output"))
