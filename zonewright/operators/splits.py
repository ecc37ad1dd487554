"""Exact random splits, folds and samples, by cut points in hash order.

Rows are ordered by ``md5(seed | key)``. A split needs only the hash value at
each cut rank, so the rows themselves never move: one pass counts rows per
hash prefix, a second ranks just the rows in the few prefixes that contain a
cut, and labelling is a comparison. A class that holds most of the table is
handled like any other, since its rows are never gathered.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from zonewright.operators.base import hold

PREFIX_DIGITS = 4  # 65,536 hash ranges per class
BEFORE_ALL, AFTER_ALL = "", "g"  # around every hexadecimal hash


def hash_order(key: str | Column, seed: int = 42) -> Column:
    key = F.col(key) if isinstance(key, str) else key
    return F.md5(F.concat(F.lit(f"{seed}|"), key.cast("string")))


def segments(
    df: DataFrame,
    key: str,
    cuts: Callable[[Column], Sequence[Column]],
    by: str | None = None,
    seed: int = 42,
    out: str = "segment",
    prefix_digits: int = PREFIX_DIGITS,
) -> DataFrame:
    """Add the segment number of each row: how many cuts its rank lies beyond.

    ``cuts(n)`` gives the ascending cut ranks for a class of ``n`` rows;
    ``key`` must be unique. Rows of a null class get segment 0.
    """
    group = F.lit(0) if by is None else F.col(by)
    hashed = df.select(group.alias("g"), hash_order(key, seed).alias("h"))
    if by is not None:
        hashed = hashed.where("g is not null")
    hashed = hashed.select("g", "h", F.substring("h", 1, prefix_digits).alias("p"))
    counts = hashed.groupBy("g", "p").agg(F.count("*").alias("c"))
    ordered = Window.partitionBy("g").orderBy("p")
    spans = counts.select(
        "g", "p", "c",
        F.sum("c").over(Window.partitionBy("g")).alias("n"),
        (F.sum("c").over(ordered) - F.col("c")).alias("before"),
    )
    ranks = F.transform(F.array(*cuts(F.col("n"))), lambda r: r.cast("long"))
    wanted = spans.select("g", "p", "c", "n", "before", F.posexplode(ranks).alias("cut", "r"))
    # One row per class and cut: inside this prefix, or beyond either end.
    inside = (F.col("r") > F.col("before")) & (F.col("r") < F.col("before") + F.col("c"))
    at_end = F.col("r") == F.col("before") + F.col("c")
    first = F.col("before") == 0
    places = hold(
        wanted.where(inside | at_end | (first & ((F.col("r") <= 0) | (F.col("r") > F.col("n"))))).select(
            "g", "p", "cut", (F.col("r") - F.col("before")).alias("need"), "n", "r", inside.alias("inside")
        )
    )
    split = places.where("inside").select("g", "p").distinct()
    ranked = (
        hashed.join(split, ["g", "p"])
        .withColumn("need", F.row_number().over(Window.partitionBy("g", "p").orderBy("h")).cast("long"))
        .join(places.where("inside").select("g", "p", "cut", "need"), ["g", "p", "need"])
        .select("g", "cut", "h")
    )
    # At the end of a prefix, every hash that starts with it is within.
    ends = places.where("not inside").select(
        "g", "cut",
        F.when(F.col("r") <= 0, BEFORE_ALL)
        .when(F.col("r") > F.col("n"), AFTER_ALL)
        .otherwise(F.concat("p", F.lit(AFTER_ALL)))
        .alias("h"),
    )
    table = ranked.unionByName(ends).groupBy("g").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("cut", "h"))), lambda x: x["h"]).alias("__cuts")
    )
    here = hash_order(key, seed)
    if by is None:
        row = table.first()
        number = sum((F.when(here > F.lit(h), 1).otherwise(0) for h in (row["__cuts"] if row else [])), F.lit(0))
        return df.withColumn(out, number)
    table = hold(table.withColumnRenamed("g", by))
    number = F.size(F.filter("__cuts", lambda h: here > h))
    return (
        df.join(table, by, "left")
        .withColumn(out, F.when(F.col("__cuts").isNull(), 0).otherwise(number))
        .select(*df.columns, out)
    )


def _part(n: Column, ratio: float) -> Column:
    return F.floor(n.cast("double") * F.lit(float(ratio)))


def split(
    df: DataFrame,
    key: str,
    train: float = 0.7,
    val: float = 0.15,
    test: float = 0.15,
    stratify: str | None = None,
    seed: int = 42,
    out: str = "split",
) -> DataFrame:
    """Add ``train`` / ``val`` / ``test``.

    Sizes are ``int(n*train)``, ``int(n*val)`` and the rest, per class when
    stratified; classes of fewer than 3 rows, and the null class, train.
    """
    if abs(train + val + test - 1.0) > 1e-6:
        raise ValueError(f"ratios must sum to 1, got {train + val + test}")
    by = stratify if stratify in df.columns else None

    def cuts(n: Column) -> list[Column]:
        first, second = _part(n, train), _part(n, train) + _part(n, val)
        if by is None:
            return [first, second]
        return [F.when(n < 3, n).otherwise(first), F.when(n < 3, n).otherwise(second)]

    named = segments(df, key, cuts, by, seed, "__segment")
    return named.withColumn(
        out, F.when(F.col("__segment") == 0, "train").when(F.col("__segment") == 1, "val").otherwise("test")
    ).drop("__segment")


def folds(df: DataFrame, key: str, k: int = 5, by: str | None = None, seed: int = 42, out: str = "fold") -> DataFrame:
    """Shuffled folds 0..k-1, balanced to within one row in every class."""
    cuts = lambda n: [F.ceil(n * j / k) for j in range(1, k)]
    return segments(df, key, cuts, by, seed, out)


def sample(df: DataFrame, key: str, size: int, seed: int = 42) -> DataFrame:
    """A seeded sample of exactly ``size`` rows (all, if there are fewer)."""
    return segments(df, key, lambda n: [F.lit(size)], None, seed, "__s").where("__s = 0").drop("__s")


def undersample(df: DataFrame, key: str, by: str, size: int, seed: int = 42) -> DataFrame:
    """At most ``size`` rows of each class, chosen by seed."""
    return segments(df, key, lambda n: [F.lit(size)], by, seed, "__s").where("__s = 0").drop("__s")


def oversample(df: DataFrame, key: str, by: str, size: int, seed: int = 42) -> DataFrame:
    """Repeat the rows of each class up to ``size`` rows: whole copies, and a
    seeded part of the class for the remainder. Larger classes stay whole."""
    counts = hold(df.where(F.col(by).isNotNull()).groupBy(by).agg(F.count("*").alias("__n")))
    marked = segments(df, key, lambda n: [F.lit(size) % n], by, seed, "__s").join(counts, by, "left")
    n = F.col("__n")
    extra = F.when((F.col("__s") == 0) & (F.lit(size) % n > 0), 1).otherwise(0)
    copies = F.when((n >= size) | n.isNull(), 1).otherwise(F.floor(F.lit(size) / n) + extra)
    return marked.withColumn("copy", F.explode(F.sequence(F.lit(1), copies.cast("int")))).select(*df.columns, "copy")


def time_folds(df: DataFrame, time: str, k: int = 5, gap_seconds: int = 0) -> DataFrame:
    """Time-ordered folds: rows of fold f validate, earlier rows train.

    The time range is cut into k+1 equal spans by exact quantiles of the
    epoch second. Adds ``fold`` (0: only ever training) and ``train_until``,
    the epoch second before which rows may train for that fold.
    """
    from zonewright.operators.quantiles import exact_quantiles

    second = F.unix_timestamp(F.col(time).cast("timestamp"))
    bounds = exact_quantiles(df.select(second.alias("t")), ["t"], [j / (k + 1) for j in range(1, k + 1)])["t"]
    bounds = [b if b is None else round(b, 3) for b in bounds]  # interpolation noise
    fold = sum((F.when(second >= F.lit(b), 1).otherwise(0) for b in bounds if b is not None), F.lit(0))
    start = F.lit(None).cast("double")
    for j, b in enumerate(bounds, 1):
        start = F.when(F.col("fold") == j, F.lit(b)).otherwise(start)
    return df.withColumn("fold", fold).withColumn("train_until", start - gap_seconds)
