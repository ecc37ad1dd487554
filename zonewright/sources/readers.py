"""Reading record tables: CSV, columnar files, tables and databases."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from pathlib import Path
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from zonewright import vocabulary as V
from zonewright.sources import quoted

RECORD_SCHEMA = T.StructType(
    [
        T.StructField("fqdn", T.StringType()),
        T.StructField("record_type", T.StringType()),
        T.StructField("record_data", T.StringType()),
        T.StructField("appid", T.LongType()),
        *[
            T.StructField(c, T.StringType())
            for c in (
                "brand", "product", "market", "fqdn_source", "fqdn_status", "tech_environment",
                "itso_id", "country_code", "buslevel4", "buslevel5", "classification",
                "primary_channel", "market_group", "region", "sub_brand", "category", "appdesc",
            )
        ],
    ]
)


def null_tokens_to_null(df: DataFrame, tokens: Sequence[str] = V.NULL_TOKENS) -> DataFrame:
    """Exact null tokens, untrimmed, become null in every text column."""
    new = {
        f.name: F.when(~F.col(f.name).isin(list(tokens)), F.col(f.name))
        for f in df.schema
        if isinstance(f.dataType, T.StringType)
    }
    return df.withColumns(new)


def typed(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Text columns to their declared types; a value that does not fit is null."""
    return df.withColumns({f.name: F.col(f.name).try_cast(f.dataType) for f in schema if f.name in df.columns})


# Quotes inside quoted fields are doubled.
QUOTING = {"quote": '"', "escape": '"'}


def csv_header(spark: SparkSession, path: str, separator: str = ",", encoding: str = "utf-8", multi_line: bool = True) -> list[str]:
    return spark.read.options(header=True, sep=separator, encoding=encoding, inferSchema=False, multiLine=multi_line, **QUOTING).csv(path).columns


def _parsed(records: DataFrame, text: T.StructType, header: bool, separator: str) -> DataFrame:
    """Fields of whole records. The first record of a file is its header and must have the names of ``text``."""
    ddl = ", ".join(f"c{i} string" for i in range(len(text)))
    fields = F.from_csv("record", ddl, {"sep": separator, "multiLine": "true", **QUOTING})
    out = records.withColumn("fields", fields)
    if header:
        found = F.lower(F.array_join(F.array(*[F.col(f"fields.c{i}") for i in range(len(text))]), "\n", ""))
        same = found == F.lit("\n".join(text.names).lower())
        wrong = F.raise_error(F.concat(F.lit("another header in "), F.col("file"))).cast("boolean")
        first = (F.col("start") == 0) & (F.col("n") == 0)
        out = out.where(F.when(~first, True).when(same, False).otherwise(wrong))
    return out.select(*[F.col(f"fields.c{i}").alias(f.name) for i, f in enumerate(text)])


def read_csv(
    spark: SparkSession,
    path: str,
    schema: T.StructType = RECORD_SCHEMA,
    columns: Sequence[str] | None = None,
    n_rows: int | None = None,
    separator: str = ",",
    header: bool = True,
    encoding: str = "utf-8",
    tokens: Sequence[str] = V.NULL_TOKENS,
    multi_line: bool = True,
) -> DataFrame:
    """A CSV table with null tokens and declared types applied.

    Quoted fields may hold doubled quotes and, with ``multi_line``, line breaks;
    a large file is read by many tasks in either case (see ``quoted``), but in
    other encodings than UTF-8, with breaks, by one. A missing path raises, and
    so does a file of the folder with another header. Columns outside
    ``schema`` stay text.
    """
    names = csv_header(spark, path, separator, encoding, multi_line) if header else schema.fieldNames()
    text = T.StructType([T.StructField(c, T.StringType()) for c in names])
    options = {"header": header, "sep": separator, "encoding": encoding, "multiLine": multi_line, "enforceSchema": not header, **QUOTING}
    if multi_line and encoding.lower() in ("utf-8", "utf8"):
        raw = _parsed(quoted.records(spark, path, separator), text, header, separator)
    else:
        raw = spark.read.schema(text).options(**options).csv(path)
    out = typed(null_tokens_to_null(raw, tokens), schema)
    if columns is not None:
        out = out.select(*columns)
    return out if n_rows is None else out.limit(n_rows)


def sniff_schema(spark: SparkSession, path: str, rows: int = 100, **options: Any) -> T.StructType:
    """Types inferred from the first rows of a CSV file."""
    head = [r["value"] for r in spark.read.text(path).limit(rows + 1).collect()]
    lines = spark.sparkContext.parallelize(head, 1)
    return spark.read.options(**{"header": True, "inferSchema": True, **QUOTING, **options}).csv(lines).schema


def select_records(
    df: DataFrame,
    columns: Sequence[str] | None = None,
    where: str | Column | None = None,
    limit: int | None = None,
) -> DataFrame:
    """Projection, predicate and limit; the optimiser pushes them to the scan."""
    out = df if where is None else df.where(where)
    out = out if columns is None else out.select(*columns)
    return out if limit is None else out.limit(limit)


def read_jdbc(
    spark: SparkSession,
    url: str,
    table: str,
    partition_column: str | None = None,
    bounds: tuple[int, int] | None = None,
    partitions: int = 64,
    fetch_size: int = 50_000,
    properties: Mapping[str, str] | None = None,
) -> DataFrame:
    """A database table, read in parallel by ranges of a numeric key."""
    reader = spark.read.format("jdbc").options(url=url, dbtable=table, fetchsize=fetch_size, **(properties or {}))
    if partition_column is not None:
        low, high = bounds
        reader = reader.options(
            partitionColumn=partition_column, lowerBound=low, upperBound=high, numPartitions=partitions
        )
    return reader.load()


def run_query(spark: SparkSession, query: str, url: str | None = None, **options: Any) -> DataFrame:
    """A SQL query, by the database if there is a URL, else by Spark."""
    if url is None:
        return spark.sql(query)
    return spark.read.format("jdbc").options(url=url, query=query, **options).load()


def key_ranges(df: DataFrame, key: str, chunk: int) -> DataFrame:
    """``(chunk, first_key, last_key, n)`` of fixed-width key ranges: stable
    chunks of a keyed table, unlike pages by offset."""
    number = F.floor(F.col(key) / chunk)
    return df.groupBy(number.alias("chunk")).agg(
        F.min(key).alias("first_key"), F.max(key).alias("last_key"), F.count("*").alias("n")
    )


def chunk_of(df: DataFrame, key: str, chunk: int, number: int) -> DataFrame:
    """One chunk of ``key_ranges``: a range predicate that reaches the scan."""
    return df.where((F.col(key) >= number * chunk) & (F.col(key) < (number + 1) * chunk))


def labeled(df: DataFrame, target: str = "appid", orphan: int = V.ORPHAN_LABEL, columns: Sequence[str] | None = None, limit: int | None = None) -> DataFrame:
    """Owned records (a null owner is neither owned nor an orphan)."""
    return select_records(df, columns, F.col(target) != orphan, limit)


def orphans(df: DataFrame, target: str = "appid", orphan: int = V.ORPHAN_LABEL, columns: Sequence[str] | None = None, limit: int | None = None) -> DataFrame:
    return select_records(df, columns, F.col(target) == orphan, limit)


def load_all(owned: DataFrame, ownerless: DataFrame, columns: Sequence[str] | None = None, n_rows: int | None = None) -> DataFrame:
    """Both tables, one below the other, up to ``n_rows`` rows in total."""
    out = select_records(owned, columns).unionByName(select_records(ownerless, columns))
    return out if n_rows is None else out.limit(n_rows)


def class_distribution(df: DataFrame, target: str = "appid") -> DataFrame:
    return df.groupBy(target).agg(F.count("*").alias("n")).orderBy(F.desc("n"), target)


def read_suffix_rules(path: str | Path, private: bool = False) -> tuple[str, ...]:
    """Rules of a file in the public suffix list's notation: one per line up to
    the first blank, ``//`` comments, ``*.x`` wildcards, ``!a.x`` exceptions.
    Those between the markers of the private section come only on request."""
    rules, inside = [], False
    for line in Path(path).read_text(encoding="utf-8").splitlines():
        if "===BEGIN PRIVATE DOMAINS===" in line:
            inside = True
        elif "===END PRIVATE DOMAINS===" in line:
            inside = False
        rule = line.split()[0] if line.split() else ""
        if rule and not rule.startswith("//") and (private or not inside):
            rules.append(rule.lower().removeprefix("."))
    return tuple(dict.fromkeys(rules))


@dataclass
class Source:
    """Where the records are: ``csv``, ``parquet``/``orc``/``json``, ``table`` or ``jdbc``.

    ``auto`` takes the owned-records path if one is given, else the table.
    """

    kind: str = "auto"
    labeled_path: str | None = None
    orphan_path: str | None = None
    table: str | None = None
    schema: T.StructType = field(default_factory=lambda: RECORD_SCHEMA)
    options: dict[str, Any] = field(default_factory=dict)
    target: str = "appid"
    orphan: int = V.ORPHAN_LABEL

    def _read(self, spark: SparkSession, path: str | None) -> DataFrame:
        kind = self.kind
        if kind == "auto":
            kind = "csv" if path else "table"
        if kind == "csv":
            return read_csv(spark, path, self.schema, **self.options)
        if kind in ("parquet", "orc", "json"):
            return spark.read.format(kind).options(**self.options).load(path)
        if kind == "table":
            return spark.table(self.table)
        if kind == "jdbc":
            return read_jdbc(spark, table=self.table, **self.options)
        raise ValueError(f"unknown source {self.kind!r}")

    def load_labeled(self, spark: SparkSession, columns: Sequence[str] | None = None, limit: int | None = None) -> DataFrame:
        return labeled(self._read(spark, self.labeled_path), self.target, self.orphan, columns, limit)

    def load_orphans(self, spark: SparkSession, columns: Sequence[str] | None = None, limit: int | None = None) -> DataFrame:
        """A separate orphan file is taken as it is; a combined one is filtered."""
        if self.orphan_path is not None:
            return select_records(self._read(spark, self.orphan_path), columns, limit=limit)
        return orphans(self._read(spark, self.labeled_path), self.target, self.orphan, columns, limit)

    def load(self, spark: SparkSession, columns: Sequence[str] | None = None, n_rows: int | None = None) -> DataFrame:
        first = self._read(spark, self.labeled_path)
        if self.orphan_path is None:
            return select_records(first, columns, limit=n_rows)
        return load_all(first, self._read(spark, self.orphan_path), columns, n_rows)
