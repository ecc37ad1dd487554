"""Scoring of files as they arrive, in bounded micro-batches.

The counterpart of reading and scoring a large input chunk by chunk: each
micro-batch takes at most ``files_per_batch`` new files, the checkpoint in
the shared folder records which files are done, and a restarted job goes on
after the last finished batch.
"""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from zonewright import vocabulary as V
from zonewright.operators.score import wide
from zonewright.sources import readers


def arriving_records(
    spark: SparkSession, folder: str, schema: T.StructType = readers.RECORD_SCHEMA, kind: str = "csv",
    files_per_batch: int = 100, tokens: tuple[str, ...] = V.NULL_TOKENS,
) -> DataFrame:
    """A stream of records from new files; CSV gets null tokens and types."""
    text = T.StructType([T.StructField(f.name, T.StringType()) for f in schema])
    reader = spark.readStream.format(kind).option("maxFilesPerTrigger", files_per_batch)
    if kind != "csv":
        return reader.schema(schema).load(folder)
    raw = reader.schema(text).options(header=True, multiLine=True, enforceSchema=False, **readers.QUOTING).load(folder)
    return readers.typed(readers.null_tokens_to_null(raw, tokens), schema)


def write_arrivals(records: DataFrame, path: str, checkpoint: str, kind: str = "parquet") -> StreamingQuery:
    """Write all rows of the files present, batch by batch, then stop."""
    return (
        records.writeStream.format(kind)
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )


def score_arrivals(
    model: PipelineModel, records: DataFrame, path: str, checkpoint: str, k: int = 5,
    keep: tuple[str, ...] = ("fqdn",), kind: str = "parquet",
) -> StreamingQuery:
    """Score the files present. Every operator of the scoring model is
    stateless, so batches do not depend on each other."""
    return write_arrivals(wide(model.transform(records), k, keep), path, checkpoint, kind)
