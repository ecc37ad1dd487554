"""Sources and sinks through files in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from zonewright.functions import host
from zonewright.operators import clean, score, vectorize
from zonewright.operators.base import scratch_path
from zonewright.queries.registry import query
from zonewright.queries.score_queries import CLASSES, PROBS, SQL_SOFT, soft
from zonewright.queries.tables import Tables
from zonewright.queries.text_queries import SQL_WEIGHTS, sql_char_terms, sql_vocabulary
from zonewright.sources import readers, sinks
from zonewright.streaming import arrivals

INV = ("inventory",)
WITH_ID = T.StructType([T.StructField("id", T.LongType()), *readers.RECORD_SCHEMA.fields])


def new_folder(t: Tables, name: str) -> str:
    return scratch_path(t.spark, name)


def _csv(t: Tables) -> str:
    path = new_folder(t, "csv")
    records = t.inventory.select("id", "fqdn", "record_type", "record_data", "appid", "brand")
    records.na.fill("N/A", ["record_type", "brand"]).write.option("header", True).csv(path)
    return path


@query(
    "s01_csv_source",
    """SELECT id, fqdn, record_type, CASE WHEN record_type = 'TXT' THEN record_data || ' "' || fqdn || '",' || chr(10) || 'next "" line' ELSE record_data END AS record_data, appid, brand
FROM inventory""",
    INV,
)
def s01(t: Tables) -> DataFrame:
    """TXT targets hold quotes, separators and line breaks; every field is quoted."""
    path = new_folder(t, "csv")
    records = t.inventory.select("id", "fqdn", "record_type", "record_data", "appid", "brand")
    hard = F.concat(F.col("record_data"), F.lit(' "'), F.col("fqdn"), F.lit('",\n'), F.lit('next "" line'))
    records = records.withColumn("record_data", F.when(F.col("record_type") == "TXT", hard).otherwise(F.col("record_data")))
    records = records.select(*[F.coalesce(F.col(c).cast("string"), F.lit("N/A")).alias(c) for c in records.columns])
    records.write.options(header=True, quoteAll=True, maxRecordsPerFile=1_000_000, **readers.QUOTING).csv(path)
    return readers.read_csv(t.spark, path, WITH_ID)


@query("s01_csv_columns", "SELECT id, appid FROM inventory", INV)
def s01b(t: Tables) -> DataFrame:
    return readers.read_csv(t.spark, _csv(t), WITH_ID, columns=["id", "appid"])


@query(
    "s04_schema_sniff",
    "SELECT * FROM (VALUES ('id', 'int'), ('fqdn', 'string'), ('record_type', 'string'), ('record_data', 'string'), ('appid', 'int'), ('brand', 'string')) v(name, type)",
)
def s04(t: Tables) -> DataFrame:
    schema = readers.sniff_schema(t.spark, _csv(t))
    return t.spark.createDataFrame([(f.name, f.dataType.simpleString()) for f in schema], "name string, type string")


@query(
    "s07_arriving_files",
    "SELECT id, lower(fqdn) AS fqdn, CAST(length(fqdn) AS INTEGER) AS fqdn_length, coalesce(appid, -1) AS appid FROM inventory",
    INV,
)
def s07(t: Tables) -> DataFrame:
    """Records that arrive as files, cleaned and described batch by batch."""
    source, out = new_folder(t, "in"), new_folder(t, "out")
    t.inventory.select("id", "fqdn", "appid").repartition(4).write.parquet(source)
    schema = T.StructType([f for f in WITH_ID if f.name in ("id", "fqdn", "appid")])
    stream = arrivals.arriving_records(t.spark, source, schema, "parquet", files_per_batch=2)
    described = stream.select(
        "id", clean.normalized(F.col("fqdn")).alias("fqdn"), host.structure(F.col("fqdn"))["fqdn_length"].alias("fqdn_length"),
        F.coalesce("appid", F.lit(-1)).cast("long").alias("appid"),
    )
    arrivals.write_arrivals(described, out, new_folder(t, "progress")).awaitTermination()
    return t.spark.read.parquet(out)


@query(
    "s13_prediction_files",
    f"""WITH {SQL_SOFT} SELECT id, max(CASE WHEN r = 1 THEN CAST(1000 + 7 * class_idx AS BIGINT) END) AS predicted_appid,
  max(CASE WHEN r = 2 THEN CAST(1000 + 7 * class_idx AS BIGINT) END) AS top_2_appid, round(max(CASE WHEN r = 2 THEN x END), 9) AS top_2_prob FROM ranked GROUP BY id""",
    PROBS,
)
def s13(t: Tables) -> DataFrame:
    path = new_folder(t, "predictions")
    sinks.write_predictions(score.predictions(soft(t), CLASSES), path, "csv", 5, ("id",))
    rows = t.spark.read.option("header", True).csv(path)
    return rows.select(
        F.col("id").cast("long").alias("id"), F.col("predicted_appid").cast("long").alias("predicted_appid"),
        F.col("top_2_appid").cast("long").alias("top_2_appid"), F.round(F.col("top_2_prob").cast("double"), 9).alias("top_2_prob"),
    )


@query(
    "s17_reloaded_cleaner",
    """WITH c AS (SELECT appid AS label FROM inventory WHERE appid <> 0 GROUP BY appid HAVING count(*) BETWEEN 5 AND 39)
SELECT id, coalesce(lower(fqdn), 'unknown') AS fqdn, CASE WHEN appid IN (SELECT label FROM c) THEN -999 ELSE coalesce(appid, -1) END AS appid,
  coalesce(cost, (SELECT median(cost) FROM inventory)) AS cost FROM inventory""",
    INV,
)
def s17(t: Tables) -> DataFrame:
    df, path = t.inventory.select("id", "fqdn", "appid", "cost"), new_folder(t, "cleaner")
    clean.RecordCleaner(min_samples=5, rare_threshold=40).fit(df).write().save(path)
    return clean.RecordCleanerModel.load(path).transform(df)


@query(
    "s17_reloaded_terms",
    f"WITH {sql_char_terms('dns_records')}, {sql_vocabulary('dns_records', 80)}, {SQL_WEIGHTS} SELECT id, term, round(weight, 6) AS weight FROM weights",
    ("dns_records",),
)
def s17b(t: Tables) -> DataFrame:
    path = new_folder(t, "terms")
    vectorize.TermWeights(max_features=80).fit(t.dns_records).write().save(path)
    long = vectorize.TermWeightsModel.load(path).weights(t.dns_records)
    return long.select("id", "term", F.round("weight", 6).alias("weight"))
