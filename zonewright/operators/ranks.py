"""Positions of distinct values in sorted order."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from zonewright.operators.base import hold


def sorted_positions(values: DataFrame, by: list[str], order: list[str], out: str) -> DataFrame:
    """Add the 0-based position of each (distinct) row within its ``by`` group.

    The table is cut into sorted ranges, which are ranked side by side and
    shifted by the sizes of the ranges before them. The range numbers are held,
    so a recomputed partition cannot change them.
    """
    ranged = hold(values.repartitionByRange(*by, *order).withColumn("__range", F.spark_partition_id()))
    here = F.row_number().over(Window.partitionBy(*by, "__range").orderBy(*order))
    counts = ranged.groupBy(*by, "__range").agg(F.count("*").alias("__n"))
    earlier = Window.partitionBy(*by).orderBy("__range") if by else Window.orderBy("__range")  # a row per range
    shifts = counts.select(*by, "__range", (F.sum("__n").over(earlier) - F.col("__n")).alias("__shift"))
    return (
        ranged.withColumn("__here", here)
        .join(shifts, [*by, "__range"])
        .withColumn(out, (F.col("__shift") + F.col("__here") - 1).cast("int"))
        .drop("__range", "__here", "__shift")
    )
