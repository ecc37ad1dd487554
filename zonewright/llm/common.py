"""Small helpers of the operators in this folder."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from zonewright.operators.base import shared_folder

SPACES = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def text_of(column: str = "text") -> Column:
    """The text, null as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def remainder(column: str, parts: int) -> Column:
    """crc32 of the id's text modulo ``parts``; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % parts


def held(df: DataFrame) -> DataFrame:
    """Written once to the shared folder, so that no later step recomputes it."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


ROWS_PER_TASK = 50_000


def narrow(df: DataFrame) -> DataFrame:
    """``held``, in no more partitions than its number of rows asks for: each exchange of
    a small table in many partitions is files and tasks without rows."""
    df = held(df)
    rows = df.coalesce(df.sparkSession.sparkContext.defaultParallelism).count()
    return df.coalesce(max(1, -(-rows // ROWS_PER_TASK)))


def batches(df: DataFrame, step: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    return df.mapInArrow(step, schema)


def one_row_per(df: DataFrame, keys: list[str]) -> DataFrame:
    """One row of each key (null is a key). Combines ahead of the exchange, so
    rows that repeat a key a million times travel once per task."""
    rest = [c for c in df.columns if c not in keys]
    if not rest:
        return df.distinct()
    row = F.first(F.struct(*[F.col(f"`{c}`") for c in rest])).alias("row__")
    grouped = df.groupBy(*[F.col(f"`{k}`") for k in keys]).agg(row)
    return grouped.select(*[F.col(f"`{c}`") if c in keys else F.col("row__").getField(c).alias(c) for c in df.columns])


def key_of(column: str) -> Column:
    """A never null text that stands for the value, so that null joins null."""
    return F.coalesce(F.concat(F.lit("="), F.col(f"`{column}`").cast("string")), F.lit(""))


def join_hot(rows: DataFrame, facts: DataFrame, key: str, count: str, total: int, share: int = 512) -> DataFrame:
    """Inner join of ``rows`` with one fact row per key. Keys with over
    1/``share`` of the ``total`` rows, so fewer than ``share``, are broadcast."""
    hot = F.broadcast(facts.where(F.col(count) * share > total))
    cold = facts.where(F.col(count) * share <= total)
    return rows.join(hot, key).unionByName(rows.join(hot.select(key), key, "left_anti").join(cold, key))


def join_spread(rows: DataFrame, facts: DataFrame, key: str, most: int = 20_000) -> DataFrame:
    """Inner join of ``rows`` with one fact row per key, no task of which gets
    much more than ``most`` rows of one key: a key with more is split, its fact
    repeated for each part. The list of such keys, one in ``most`` rows at
    most, is joined without a hint, so its measured size decides how."""
    parts = rows.groupBy(key).count().where(F.col("count") > most).select(key, F.ceil(F.col("count") / most).cast("int").alias("parts__"))
    spread = rows.join(parts, key, "left").withColumn("salt__", F.when(F.col("parts__").isNull(), 0).otherwise(F.monotonically_increasing_id() % F.col("parts__")).cast("int"))
    repeated = facts.join(parts, key, "left").withColumn("salt__", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("parts__") - 1, F.lit(0)))))
    return spread.drop("parts__").join(repeated.drop("parts__"), [key, "salt__"]).drop("salt__")
