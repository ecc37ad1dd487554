"""Mutual information of numbers and classes by nearest neighbours.

The estimator of Ross (2014) for one continuous feature and a class, with the
rule of Gao et al. (2017) for ties. A row's radius d is the distance to its
k-th nearest other row of the same class, m the number of rows of any class
nearer than d, itself included; the information is

    psi(N) + mean(psi(k) - psi(rows of the class) - psi(m)).

Where d is 0 (k or more other rows of the class have the same value), k is the
number of the class's rows with that value and m that of all rows with it, so
a feature of few values gets the estimate from its counts. A class of k rows
or fewer takes all its other rows as neighbours; a class of one row takes no
part.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from zonewright.operators.base import hold

SHIFT = 6
FINITE = "abs(x) < double('infinity')"


def digamma(n: Column) -> Column:
    """psi of a whole number >= 1, to about 1e-11: the asymptotic series at n + 6."""
    n = n.cast("double")
    z = n + SHIFT
    z2 = z * z
    series = F.ln(z) - 0.5 / z - (1 / 12 - (1 / 120 - (1 / 252 - 1 / 240 / z2) / z2) / z2) / z2
    return series - sum((F.lit(1.0) / (n + j) for j in range(SHIFT)), F.lit(0.0))


def class_values(df: DataFrame, columns: Sequence[str], label: str) -> DataFrame:
    """``(feature, y, x, n)``: rows per class and distinct value. Nulls, NaN and
    infinite values take no part, nor do rows without a label. Counted ahead
    of the exchange, so a frequent value is one row."""
    cells = F.array(*[F.struct(F.lit(c).alias("feature"), (F.col(c).cast("double") + 0.0).alias("x")) for c in columns])
    return (
        df.where(F.col(label).isNotNull()).select(F.col(label).alias("y"), F.inline(cells))
        .where(FINITE)
        .groupBy("feature", "y", "x").agg(F.count("*").alias("n"))
    )


def with_radius(values: DataFrame, k: int) -> DataFrame:
    """Add ``d``, the distance to the k-th nearest other row of the class.

    The values of all features and classes are cut into sorted ranges. The k
    values ahead of a range's first and after its last one are copied to it, so
    each value sees k on both sides within its range, and a class with most of
    all rows is as many tasks as it fills. What travels across the borders is
    2 k values per range and class.
    """
    group = ["feature", "y"]
    ranged = hold(values.repartitionByRange(*group, "x").withColumn("part", F.spark_partition_id()))
    within = Window.partitionBy(*group, "part")
    edges = hold(
        ranged.withColumn("up", F.row_number().over(within.orderBy("x")))
        .withColumn("down", F.row_number().over(within.orderBy(F.desc("x"))))
        .where((F.col("up") <= k) | (F.col("down") <= k))
    )
    along = Window.partitionBy(*group).orderBy("x")
    cell = F.struct("x", "n")
    ahead = F.when(F.col("up") == 1, F.collect_list(cell).over(along.rowsBetween(-k, -1)))
    after = F.when(F.col("down") == 1, F.collect_list(cell).over(along.rowsBetween(1, k)))
    none = F.array().cast("array<struct<x:double,n:bigint>>")
    far = edges.withColumn("far", F.concat(F.coalesce(ahead, none), F.coalesce(after, none)))
    halo = far.select(*group, "ny", "part", F.inline("far"))
    rows = ranged.withColumn("own", F.lit(True)).unionByName(halo.withColumn("own", F.lit(False)))
    seen = rows.withColumn("near", F.collect_list(cell).over(within.orderBy("x").rowsBetween(-k, k))).where("own")
    # The value's own row is no neighbour of itself; the others with its value are, at distance 0.
    distances = F.transform(
        "near", lambda c: F.struct(F.abs(c["x"] - F.col("x")).alias("d"), (c["n"] - F.when(c["x"] == F.col("x"), 1).otherwise(0)).alias("n"))
    )
    want = F.least(F.lit(k).cast("long"), F.col("ny") - 1)
    start = F.struct(F.lit(0).cast("long").alias("seen"), F.lit(0.0).alias("d"))
    found = F.aggregate(
        F.array_sort(distances),
        start,
        lambda s, c: F.when(s["seen"] >= want, s).otherwise(F.struct((s["seen"] + c["n"]).alias("seen"), c["d"].alias("d"))),
    )
    return seen.select(*group, "x", "n", "ny", found["d"].alias("d"))


def rows_within(points: DataFrame) -> DataFrame:
    """Add ``m``: the rows of the feature with a value in (x - d, x + d), or
    equal to x where d is 0.

    Values and the ends of all intervals stand in one order, cut into ranges
    that sum the rows in them; a range's total shifts what comes after it. A
    row per range and feature goes through one window.
    """
    inside = F.col("d") > 0
    # An open end at v counts the rows before v (side 0) or up to v (side 2); values lie between (side 1).
    ends = F.array(
        F.struct((F.col("x") - F.col("d")).alias("v"), F.when(inside, 2).otherwise(0).alias("side"), F.lit(-1).alias("sign")),
        F.struct((F.col("x") + F.col("d")).alias("v"), F.when(inside, 0).otherwise(2).alias("side"), F.lit(1).alias("sign")),
    )
    asked = points.select("feature", "y", "x", F.inline(ends)).withColumn("n", F.lit(0).cast("long"))
    known = points.groupBy("feature", F.col("x").alias("v")).agg(F.sum("n").alias("n"))
    known = known.select("feature", "v", "n", F.lit(1).alias("side"), F.lit(0).alias("sign"))
    events = asked.unionByName(known, allowMissingColumns=True)
    ranged = hold(events.repartitionByRange("feature", "v", "side").withColumn("part", F.spark_partition_id()))
    totals = ranged.groupBy("feature", "part").agg(F.sum("n").alias("n"))
    before = F.sum("n").over(Window.partitionBy("feature").orderBy("part")) - F.col("n")
    shifts = totals.select("feature", "part", before.alias("shift"))
    here = F.sum("n").over(Window.partitionBy("feature", "part").orderBy("v", "side").rowsBetween(Window.unboundedPreceding, 0))
    counted = ranged.withColumn("here", here).where("sign != 0").join(shifts, ["feature", "part"])
    m = counted.groupBy("feature", "y", "x").agg(F.sum(F.col("sign") * (F.col("here") + F.col("shift"))).alias("m"))
    return points.join(m, ["feature", "y", "x"])


def information_of(counts: DataFrame, k: int = 3) -> DataFrame:
    """``(feature, mi)`` in nats, not below 0, from ``(feature, y, x, n)``: the
    rows per class and distinct finite value. All features are one job; those
    without two rows of one class have no row."""
    if k < 1:
        raise ValueError("k must be at least 1")
    counts = hold(counts)
    sizes = hold(counts.groupBy("feature", "y").agg(F.sum("n").alias("ny")).where("ny > 1"))
    points = hold(with_radius(counts.join(sizes, ["feature", "y"]), k))
    neighbours = F.when(F.col("d") > 0, F.least(F.lit(k).cast("long"), F.col("ny") - 1)).otherwise(F.col("n"))
    gain = F.col("n") * (digamma(neighbours) - digamma(F.col("ny")) - digamma(F.col("m")))
    n = F.sum("n")
    return rows_within(points).groupBy("feature").agg(F.greatest(digamma(n) + F.sum(gain) / n, F.lit(0.0)).alias("mi"))


def nearest_information(df: DataFrame, columns: Sequence[str], label: str, k: int = 3) -> DataFrame:
    """``(feature, mi)`` for numeric columns and a class; null for a column
    without two rows of one class. Repeated rows count each; names of other
    columns cannot clash."""
    columns = list(dict.fromkeys(columns))
    names = df.sparkSession.createDataFrame([(c,) for c in columns], "feature string")
    if not columns:
        return names.withColumn("mi", F.lit(None).cast("double"))
    return names.join(information_of(class_values(df, columns, label), k), "feature", "left")
