"""Rows in a total order over many tasks, and their places in it."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from zonewright.llm.common import held


def in_ranges(rows: DataFrame, by: Sequence[str], seed: int = 11) -> DataFrame:
    """``rows`` ordered by ``by`` (nulls first) over ranges of about equal size.
    A random last key lets rows that are equal in ``by`` lie in many ranges, so
    no key makes a large one. Only to be read once the ranges are written."""
    keys = [*by, "tie__"]
    salted = rows.withColumn("tie__", F.rand(seed))
    return salted.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("tie__")


def placed(rows: DataFrame, group: str, by: Sequence[str]) -> DataFrame:
    """``rows`` in ranges of the order (``group``, ``by``), written once, with
    ``range__`` and ``at__``, the place (from 0) among the group's rows in the
    range. Partitions keep that order. ``group`` has no nulls."""
    ordered = in_ranges(rows, [group, *by])
    names = [f.name for f in ordered.schema]

    def step(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, last, seen = TaskContext.get().partitionId(), None, 0
        for part in parts:
            if not part.num_rows:
                continue
            groups = part.column(names.index(group))
            starts = np.concatenate(([0], 1 + np.flatnonzero(np.asarray(pc.not_equal(groups[1:], groups[:-1])))))
            at = np.arange(part.num_rows) - np.repeat(starts, np.diff([*starts, part.num_rows]))
            first = part.num_rows if len(starts) == 1 else int(starts[1])
            if groups[0].as_py() == last:
                at[:first] += seen
            last, seen = groups[-1].as_py(), int(at[-1]) + 1
            columns = [pa.array(np.full(part.num_rows, own, np.int32)), pa.array(at.astype(np.int64))]
            yield pa.RecordBatch.from_arrays([*part.columns, *columns], names=[*names, "range__", "at__"])

    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in ordered.schema)
    return held(ordered.mapInArrow(step, f"{fields}range__ int, at__ long"))


def numbered(rows: DataFrame, group: str, by: Sequence[str]) -> DataFrame:
    """``rows``, written once, with ``place`` (from 0 within the group, in the
    order ``by``; rows equal in it in any order) and ``size`` of the group.

    Each range counts its rows alone; what stands ahead of a range comes from
    one count per range and group. ``group`` has no nulls.
    """
    written = placed(rows, group, by)
    counts = written.groupBy(group, "range__").agg(F.max("at__").alias("n__"))
    whole = Window.partitionBy(group)
    ahead = counts.select(
        group, "range__", (F.sum(F.col("n__") + 1).over(whole.orderBy("range__")) - F.col("n__") - 1).alias("ahead__"), F.sum(F.col("n__") + 1).over(whole).alias("size"),
    )
    return written.join(ahead, [group, "range__"]).select(*rows.columns, (F.col("at__") + F.col("ahead__")).alias("place"), "size")
