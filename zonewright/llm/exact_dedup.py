"""Grace hash deduplication on complete texts.

1. Each scan task keeps the distinct texts it meets in an open-addressing
   table, and hands on every distinct text once, with its smallest id and its
   number of rows. A group with a third of all rows so leaves a task as one row.
2. These rows are dealt out by hash. A task reads them into the same kind of
   table. Once the distinct texts outgrow the task's memory, rows go to spill
   files by another hash, and each file is treated alike, recursively, until
   it fits.
3. Group facts return to the documents by digest. Groups above 1/512 of all
   rows (so fewer than 512) are broadcast, the others join by digest.

Two texts are equal only if their whole normalised bytes are.
"""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from zonewright.llm.common import SPACES, held, join_hot, key_of, one_row_per, text_of

TABLE_BYTES = 48 << 20
FAN_OUT = 16
DEEPEST = 40
PARTIAL = pa.schema([("h", pa.int64()), ("digest", pa.string()), ("content", pa.binary()), ("least", pa.int64()), ("n", pa.int64())])
GROUP = pa.schema([("digest", pa.string()), ("keep_id", pa.int64()), ("group_size", pa.int64())])


class TextTable:
    """Open addressing with linear probing; entries compare by complete content."""

    def __init__(self) -> None:
        self.slots = [-1] * 1024
        self.hashes: list[int] = []
        self.digests: list[str] = []
        self.contents: list[bytes] = []
        self.least: list[int | None] = []
        self.n: list[int] = []
        self.size = 0

    def add(self, h: int, digest: str, content: bytes, least: int | None, n: int) -> None:
        mask = len(self.slots) - 1
        at = h & mask
        while (e := self.slots[at]) >= 0:
            if self.hashes[e] == h and self.contents[e] == content:
                if least is not None and (self.least[e] is None or least < self.least[e]):
                    self.least[e] = least
                self.n[e] += n
                return
            at = (at + 1) & mask
        self.slots[at] = len(self.hashes)
        self.hashes.append(h)
        self.digests.append(digest)
        self.contents.append(content)
        self.least.append(least)
        self.n.append(n)
        self.size += len(content) + 200
        if len(self.hashes) * 2 > len(self.slots):
            self._grow()

    def _grow(self) -> None:
        mask = len(self.slots) * 2 - 1
        self.slots = [-1] * (mask + 1)
        for e, h in enumerate(self.hashes):
            at = h & mask
            while self.slots[at] >= 0:
                at = (at + 1) & mask
            self.slots[at] = e

    def rows(self):
        return zip(self.hashes, self.digests, self.contents, self.least, self.n)

    def partials(self, step: int = 2000) -> Iterator[pa.RecordBatch]:
        for i in range(0, len(self.hashes), step):
            part = slice(i, i + step)
            columns = [self.hashes[part], self.digests[part], self.contents[part], self.least[part], self.n[part]]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, PARTIAL)], schema=PARTIAL)

    def groups(self, step: int = 50_000) -> Iterator[pa.RecordBatch]:
        for i in range(0, len(self.hashes), step):
            part = slice(i, i + step)
            columns = [self.digests[part], self.least[part], self.n[part]]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, GROUP)], schema=GROUP)


def _rows(parts: Iterator[pa.RecordBatch]):
    for part in parts:
        yield from zip(*[part.column(f.name).to_pylist() for f in PARTIAL])


def combine(limit: int):
    """Distinct texts of a task, handed on whenever they reach ``limit`` bytes."""

    def step(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts = TextTable()
        for row in _rows(parts):
            texts.add(*row)
            if texts.size > limit:
                yield from texts.partials()
                texts = TextTable()
        yield from texts.partials()

    return step


def grace(limit: int):
    """Groups of equal texts among a task's rows, in ``limit`` bytes of memory."""

    def solve(rows, level: int, folder: str) -> Iterator[pa.RecordBatch]:
        texts = TextTable()
        spill = None
        for row in rows:
            if spill is None:
                texts.add(*row)
                if texts.size > limit and len(texts.hashes) > 1 and level < DEEPEST:
                    spill = Spill(folder, level)
                    for kept in texts.rows():
                        spill.add(kept)
                    texts = TextTable()
            else:
                spill.add(row)
        if spill is None:
            yield from texts.groups()
            return
        for path in spill.close():
            with pa.OSFile(path) as file, pa.ipc.open_stream(file) as reader:
                yield from solve(_rows(iter(reader)), level + 1, folder)
            os.remove(path)

    def step(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with tempfile.TemporaryDirectory() as folder:  # a task's own scratch, as Spark's own spill files; gone with the task
            yield from solve(_rows(parts), 0, folder)

    return step


class Spill:
    """Rows dealt out to files by a hash of their text that differs per level."""

    def __init__(self, folder: str, level: int) -> None:
        self.folder, self.level = folder, level
        self.waiting: list[list[tuple]] = [[] for _ in range(FAN_OUT)]
        self.sizes = [0] * FAN_OUT
        self.files: dict[int, tuple] = {}

    def add(self, row: tuple) -> None:
        k = xxhash.xxh64_intdigest(row[2], seed=self.level + 1) % FAN_OUT
        self.waiting[k].append(row)
        self.sizes[k] += len(row[2]) + 100
        if self.sizes[k] > 1 << 20:
            self._write(k)

    def _write(self, k: int) -> None:
        if k not in self.files:
            fd, path = tempfile.mkstemp(dir=self.folder)
            os.close(fd)
            sink = pa.OSFile(path, "wb")
            self.files[k] = (path, sink, pa.ipc.new_stream(sink, PARTIAL))
        columns = zip(*self.waiting[k])
        self.files[k][2].write_batch(pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, PARTIAL)], schema=PARTIAL))
        self.waiting[k], self.sizes[k] = [], 0

    def close(self) -> list[str]:
        for k in range(FAN_OUT):
            if self.waiting[k]:
                self._write(k)
        for _, sink, writer in self.files.values():
            writer.close()
            sink.close()
        return [path for path, _, _ in self.files.values()]


def normalised(text_col: str = "text"):
    return F.regexp_replace(text_of(text_col), SPACES, " ")


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = TABLE_BYTES) -> DataFrame:
    """(digest, keep_id, group_size), one row per distinct normalised text."""
    content = normalised(text_col).cast("binary")
    rows = docs.select(F.col(id_col).cast("long").alias("least"), content.alias("content"))
    rows = rows.select(F.xxhash64("content").alias("h"), F.sha2("content", 256).alias("digest"), "content", "least", F.lit(1).cast("long").alias("n"))
    schema = "h long, digest string, content binary, least long, n long"
    partial = rows.mapInArrow(combine(limit), schema)
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return partial.repartition(parts, "h").mapInArrow(grace(limit), "digest string, keep_id long, group_size long")


def assign(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = TABLE_BYTES) -> DataFrame:
    """One row per row of ``docs``: its id, keep_id, group_size, kept, text_sha256.

    Texts are equal if they are after each run of white space became one space;
    null is empty. The smallest id of a group stays; a null id only where the
    group has no other. Rows that repeat id and text are one document and carry
    the same flag (``deduplicated`` returns it once). An empty table gives none.
    """
    facts = held(groups(docs, id_col, text_col, limit))
    rows = held(docs.select(F.col(id_col).cast("long").alias(id_col), F.sha2(normalised(text_col).cast("binary"), 256).alias("text_sha256")))
    facts = facts.withColumnRenamed("digest", "text_sha256")
    joined = join_hot(rows, facts, "text_sha256", "group_size", rows.count())
    kept = F.col(id_col).eqNullSafe(F.col("keep_id"))
    return joined.select(id_col, "keep_id", "group_size", kept.alias("kept"), "text_sha256")


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = TABLE_BYTES) -> DataFrame:
    """The rows of ``docs`` that stay, one of each group, with all their columns."""
    facts = groups(docs, id_col, text_col, limit).select(F.col("digest").alias("digest__"), key_of("keep_id").alias("keep__"))
    rows = docs.withColumn("digest__", F.sha2(normalised(text_col).cast("binary"), 256)).withColumn("keep__", key_of(id_col))
    rows = one_row_per(rows, ["digest__", "keep__"])
    return rows.join(facts, ["digest__", "keep__"], "left_semi").select(*[F.col(f"`{c}`") for c in docs.columns])
