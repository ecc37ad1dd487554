"""Mixing sources to target weights, with DataFrame functions only.

Every document gets a hash-random key. The keys of a source are cut into
ranges of equal width, which hashing fills evenly; word counts are summed per
(source, range), the sums of a source's ranges are accumulated in key order,
and only inside one range are single documents accumulated. A source with a
third of all rows is spread over as many ranges as any other share of the rows.

A source whose target exceeds its size is read whole as often as fits
(epochs); the last epoch is cut at the exact word.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from zonewright.llm.common import WORD, key_of, text_of

RANGE_ROWS = 256
KEY_BITS = 60


def words(column: str = "text") -> Column:
    return F.regexp_count(text_of(column), F.lit(WORD)).cast("long")


def random_key(seed: int, id_col: str, text_col: str) -> Column:
    """The first 60 bits of a digest of seed, id and text, as a long."""
    parts = [F.lit(str(seed)), F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.md5(text_of(text_col).cast("binary"))]
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts).cast("binary")), 1, 15), 16, 10).cast("long")


def targets(sizes: DataFrame, weights: tuple[float, ...], share: float, limit: float) -> DataFrame:
    """(source__, source_size) -> target words of each source, one row per source.

    Weights are dealt by code point order of the sources, null last. Targets
    stand in proportion to the weights up to ``limit`` times the source's size,
    and what lies above is dealt again: with the sources in order of
    limit/weight, those ahead of the first that stays below its limit get
    their limit, the others share the rest.
    """
    ranked = Window.orderBy(F.col("source__").asc_nulls_last())
    n = len(weights)
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), ((F.row_number().over(ranked) - 1) % n + 1).cast("int"))
    by_limit = Window.orderBy("ratio__", "order__")
    ahead = by_limit.rowsBetween(Window.unboundedPreceding, -1)
    onward = by_limit.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy()
    t = sizes.select("*", w.alias("weight__"), F.row_number().over(ranked).alias("order__"))
    t = t.withColumn("cap__", F.col("source_size") * F.lit(float(limit)))
    t = t.withColumn("ratio__", F.col("cap__") / F.col("weight__"))
    t = t.withColumn("total__", F.sum("source_size").over(everything) * F.lit(float(share)))
    t = t.withColumn("capped__", F.coalesce(F.sum("cap__").over(ahead), F.lit(0.0)))
    t = t.withColumn("level__", (F.col("total__") - F.col("capped__")) / F.sum("weight__").over(onward))
    t = t.withColumn("level__", F.min(F.when(F.col("level__") <= F.col("ratio__"), F.struct("ratio__", "order__", "level__"))).over(everything)["level__"])
    return t.select("source__", "source_size", F.least(F.col("cap__"), F.coalesce(F.col("level__") * F.col("weight__"), F.col("cap__"))).alias("target"))


def mix(
    docs: DataFrame,
    weights: tuple[float, ...] = (5.0, 2.0, 1.0),
    share: float = 1.5,
    limit: float = 2.0,
    seed: int = 17,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    range_rows: int = RANGE_ROWS,
) -> DataFrame:
    """``docs`` with size, source_size, target, taken, epochs and rest.

    ``taken`` = ``epochs`` * ``size`` + ``rest`` words; the taken words of a
    source add up to its target, rounded. Null texts have size 0 and null
    sources are one source. Rows that repeat id and text share a key and are
    put in order of size; which of two equal rows the cut falls into does not
    show. An empty table gives no rows. Columns of the input that bear one of
    the new names are replaced. ``range_rows`` only sets how many rows one
    range holds, not the result.
    """
    names = {"size", "source_size", "target", "taken", "epochs", "rest"} - {id_col, text_col, source_col}
    ranges = docs.count() // range_rows + 1
    rows = docs.drop(*names).withColumns({
        "size": words(text_col),
        "key__": random_key(seed, id_col, text_col),
        "source__": F.col(source_col).cast("string"),
        "source_key__": key_of(source_col),
    })
    rows = rows.withColumn("range__", F.shiftright(F.shiftright("key__", KEY_BITS - 31) * F.lit(ranges), 31))
    sums = rows.groupBy("source__", "source_key__", "range__").agg(F.sum("size").alias("range_size__"))
    budget = targets(sums.groupBy("source__").agg(F.sum("range_size__").alias("source_size")), weights, share, limit)
    budget = budget.withColumn("source_key__", key_of("source__")).drop("source__")
    before = Window.partitionBy("source_key__").orderBy("range__").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("source_key__", "range__", F.coalesce(F.sum("range_size__").over(before), F.lit(0)).alias("start__"))
    starts = starts.join(budget, "source_key__")
    inside = Window.partitionBy("source_key__", "range__").orderBy("key__", "size", F.col(id_col)).rowsBetween(Window.unboundedPreceding, -1)
    mixed = rows.join(starts, ["source_key__", "range__"]).withColumn("start__", F.col("start__") + F.coalesce(F.sum("size").over(inside), F.lit(0)))
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    mixed = mixed.withColumn("epochs", epochs)
    left = F.round("target").cast("long") - F.col("epochs") * F.col("source_size")
    mixed = mixed.withColumn("rest", F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), left - F.col("start__"))))
    mixed = mixed.withColumn("taken", F.col("epochs") * F.col("size") + F.col("rest"))
    kept = [c for c in docs.columns if c not in names]
    return mixed.select(*[F.col(f"`{c}`") for c in kept], "size", "source_size", "target", "taken", "epochs", "rest")


def mixture(docs: DataFrame, **settings) -> DataFrame:
    """The mixed documents themselves: a document occurs once per epoch, and
    once more if at least half of it lies ahead of the cut. Texts stay whole."""
    mixed = mix(docs, **settings)
    copies = F.col("epochs") + F.when((F.col("rest") > 0) & (F.col("rest") * 2 >= F.col("size")), 1).otherwise(0)
    mixed = mixed.withColumn("copies__", F.when(F.col("size") == 0, F.least(F.lit(1), F.col("epochs"))).otherwise(copies).cast("int"))
    mixed = mixed.where(F.col("copies__") > 0)
    mixed = mixed.withColumn("copy__", F.explode(F.array_repeat(F.lit(1), F.col("copies__"))))
    return mixed.select(*[F.col(f"`{c}`") for c in docs.columns if c in mixed.columns])
