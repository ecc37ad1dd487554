"""Records of CSV files whose quoted fields hold line breaks, read by many tasks.

Files are read as lines, in byte ranges. Whether a range starts inside a quoted
field is not known to the task that reads it, so a first pass tells for both
cases how its last line ends; chaining these from range to range, per file,
gives the state at each start. A second pass cuts each range into records with
that state. Only a record that crosses a border, at most one per border, is put
together from the ranges it lies in.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def ends_open(line: str, is_open: bool, separator: str, quote: str = '"') -> bool:
    """Whether a line that starts inside (``is_open``) or outside a quoted field
    ends inside one. A quote opens a field only at its start; within, it is doubled."""
    if quote not in line:
        return is_open
    at, closing = 0, re.compile(f"(?:[^{re.escape(quote)}]|{re.escape(quote)}{re.escape(quote)})*")
    while True:
        if is_open:
            at = closing.match(line, at).end()
            if at >= len(line):
                return True
            at, is_open = at + 1, False
        elif line.startswith(quote, at):
            at, is_open = at + 1, True
            continue
        at = line.find(separator, at)
        if at < 0:
            return False
        at += len(separator)


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, start, value): lines; a task reads its ranges one by one, in order."""
    lines = spark.read.option("lineSep", "\n").text(path)
    return lines.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), "value")


def range_states(lines: DataFrame, separator: str) -> DataFrame:
    """(file, start, is_open): a row per byte range, the state at its start."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, where, ends = [], None, [False, True]
        for batch in batches:
            for file, start, line in zip(*(c.to_pylist() for c in batch.columns)):
                if (file, start) != where:
                    if where:
                        rows.append((*where, *ends))
                    where, ends = (file, start), [False, True]
                if '"' in line:
                    ends = [ends_open(line, e, separator) for e in ends]
        if where:
            rows.append((*where, *ends))
        kinds = [pa.string(), pa.int64(), pa.bool_(), pa.bool_()]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=["file", "start", "if_closed", "if_open"])

    ends = lines.mapInArrow(step, "file string, start long, if_closed boolean, if_open boolean")
    # What a range does to the state: a constant, or nothing, or a change to the other. Behind the
    # last constant the changes count. The ranges of a file are as many as its size allows.
    before = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    constant = F.col("if_closed") == F.col("if_open")
    marked = ends.withColumn("fixed", F.last(F.when(constant, F.struct("start", "if_closed")), True).over(before))
    flips = F.sum(F.when(~constant & F.col("if_closed"), 1).otherwise(0))
    counted = marked.withColumn("all", F.coalesce(flips.over(before), F.lit(0))).withColumn("own", F.when(constant, F.struct("start", "all")))
    counted = counted.withColumn("at_fixed", F.coalesce(F.last("own", True).over(before)["all"], F.lit(0)))
    odd = (F.col("all") - F.col("at_fixed")) % 2 == 1
    base = F.coalesce(F.col("fixed.if_closed"), F.lit(False))
    return counted.select("file", "start", (base != odd).alias("is_open"))


FULL, LEADING, TRAILING = 0, 1, 2


def _cut(lines: DataFrame, states: DataFrame, separator: str) -> DataFrame:
    """(file, start, n, part, kind): records of each range, and their pieces at its borders."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[tuple] = []
        where, held, n, is_open, leading = None, [], 0, False, False

        def close(kind: int) -> None:
            nonlocal held, n
            done.append((*where, n, "\n".join(held), kind))
            held, n = [], n + 1

        def leave() -> None:
            if held:
                close(LEADING if leading else TRAILING)

        def batch() -> pa.RecordBatch:
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int32()]
            out = pa.RecordBatch.from_arrays([pa.array([r[i] for r in done], k) for i, k in enumerate(kinds)], names=["file", "start", "n", "part", "kind"])
            done.clear()
            return out

        for rows in batches:
            for file, start, line, state in zip(*(c.to_pylist() for c in rows.columns)):
                if (file, start) != where:
                    leave()
                    where, held, n, is_open, leading = (file, start), [], 0, state, state
                held.append(line)
                is_open = ends_open(line, is_open, separator)
                if not is_open:
                    close(LEADING if leading else FULL)
                    leading = False
            if len(done) > 10_000:
                yield batch()
        leave()
        yield batch()

    # A row per byte range, so the table is small beside its files; the order of lines must stay.
    known = lines.join(F.broadcast(states), ["file", "start"]).select("file", "start", "value", "is_open")
    return known.mapInArrow(step, "file string, start long, n long, part string, kind int")


def records(spark: SparkSession, path: str, separator: str = ",") -> DataFrame:
    """(file, start, n, record): whole records as text; ``start`` and ``n`` put
    those of a file in order. Empty lines are no records; a quoted field that
    never ends takes the rest of its file. Lines end in LF or CRLF."""
    lines = _lines(spark, path)
    cut = _cut(lines, range_states(lines, separator), separator)
    pieces = cut.where(F.col("kind") != FULL)
    order = Window.partitionBy("file").orderBy("start", "n")  # two pieces per range at most
    owner = F.last(F.when(F.col("kind") == TRAILING, F.struct("start", "n")), True).over(order)
    joined = pieces.withColumn("owner", owner).groupBy("file", "owner").agg(F.sort_array(F.collect_list(F.struct("start", "n", "part"))).alias("parts"))
    whole = joined.select("file", "owner.start", "owner.n", F.array_join(F.transform("parts", lambda p: p["part"]), "\n").alias("part"))
    both = cut.where(F.col("kind") == FULL).select("file", "start", "n", "part").unionByName(whole)
    text = F.regexp_replace("part", r"\r\z", "")
    return both.select("file", "start", "n", text.alias("record")).where("record <> ''")
