"""Sources, cleaning, splits and quality checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from zonewright import vocabulary as V
from zonewright.functions.host import is_valid_host
from zonewright.functions.numbers import safe_divide
from zonewright.operators import clean, encode, quality, splits
from zonewright.queries.registry import query
from zonewright.queries.tables import Tables
from zonewright.sources import readers, sinks

INV = ("inventory",)
TOKENS = "('', 'NULL', 'null', 'None', 'NA', 'N/A')"

# --- Sources -------------------------------------------------------------


def as_text(df: DataFrame) -> DataFrame:
    """The records as a CSV file would hold them: text, with null tokens."""
    return df.select(
        F.col("id"),
        F.when(F.col("fqdn").isNull(), F.element_at(F.array(*map(F.lit, V.NULL_TOKENS)), (F.col("id") % 6 + 1).cast("int")))
        .otherwise(F.col("fqdn")).alias("fqdn"),
        F.coalesce("record_type", F.lit(" NULL")).alias("record_type"),
        F.when(F.col("id") % 7 == 0, "n.a.").otherwise(F.coalesce(F.col("appid").cast("string"), F.lit("N/A"))).alias("appid"),
    )


@query(
    "s01_s02_null_tokens_and_types",
    """SELECT id, fqdn, coalesce(record_type, ' NULL') AS record_type,
  CASE WHEN id % 7 = 0 THEN NULL ELSE appid END AS appid FROM inventory""",
    INV,
)
def s01(t: Tables) -> DataFrame:
    return readers.typed(readers.null_tokens_to_null(as_text(t.inventory)), readers.RECORD_SCHEMA)


@query("s03_lazy_scan", "SELECT doc_id, lang, source FROM documents")
def s03(t: Tables) -> DataFrame:
    return readers.Source("parquet", f"{t.folder}/documents.parquet").load(t.spark, ["doc_id", "lang", "source"])


@query("s05_projection_predicate", "SELECT l_orderkey, l_partkey, l_quantity FROM lineitem WHERE l_quantity > 45 AND l_returnflag = 'R'")
def s05(t: Tables) -> DataFrame:
    return readers.select_records(t.lineitem, ["l_orderkey", "l_partkey", "l_quantity"], "l_quantity > 45 AND l_returnflag = 'R'")


@query("s06_sql_text", "SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY o_orderpriority")
def s06(t: Tables) -> DataFrame:
    source = f"parquet.`{t.folder}/orders.parquet`"
    return readers.run_query(t.spark, f"SELECT o_orderpriority, count(*) AS n FROM {source} GROUP BY o_orderpriority")


@query(
    "s07_key_range_chunks",
    """SELECT CAST(o_orderkey // 5000 AS BIGINT) AS chunk, min(o_orderkey) AS first_key, max(o_orderkey) AS last_key, count(*) AS n
FROM orders GROUP BY 1""",
)
def s07(t: Tables) -> DataFrame:
    return readers.key_ranges(t.orders, "o_orderkey", 5000)


@query("s08_labeled", "SELECT id, fqdn, appid FROM inventory WHERE appid <> 0", INV)
def s08(t: Tables) -> DataFrame:
    return readers.labeled(t.inventory, columns=["id", "fqdn", "appid"])


@query("s09_orphans", "SELECT id, fqdn, appid FROM inventory WHERE appid = 0", INV)
def s09(t: Tables) -> DataFrame:
    return readers.orphans(t.inventory, columns=["id", "fqdn", "appid"])


@query("s10_load_all", "SELECT id, appid FROM inventory WHERE appid <> 0 UNION ALL SELECT id, appid FROM inventory WHERE appid = 0", INV)
def s10(t: Tables) -> DataFrame:
    return readers.load_all(readers.labeled(t.inventory), readers.orphans(t.inventory), ["id", "appid"])


@query("s11_class_distribution", "SELECT appid, count(*) AS n FROM inventory GROUP BY appid", INV)
def s11(t: Tables) -> DataFrame:
    return readers.class_distribution(t.inventory)


@query("s12_source_dispatch", "SELECT c_mktsegment, count(*) AS n FROM customer GROUP BY c_mktsegment")
def s12(t: Tables) -> DataFrame:
    source = readers.Source(kind="parquet", labeled_path=f"{t.folder}/customer.parquet")
    return source.load(t.spark, ["c_mktsegment"]).groupBy("c_mktsegment").agg(F.count("*").alias("n"))


def _field(c: str) -> str:
    return f"CASE WHEN {c} IS NULL THEN '-' ELSE concat(CAST(length(CAST({c} AS VARCHAR)) AS VARCHAR), ':', CAST({c} AS VARCHAR)) END"


@query(
    "s18_table_digest",
    f"""SELECT count(*) AS n_rows, CAST(sum(CAST(CAST('0x' || substr(sha256(concat({', '.join(map(_field, ('id', 'fqdn', 'record_type', 'appid')))})), 1, 12) AS BIGINT) AS DECIMAL(38, 0))) AS VARCHAR) AS digest
FROM inventory""",
    INV,
)
def s18(t: Tables) -> DataFrame:
    return sinks.table_digest(t.inventory, ["id", "fqdn", "record_type", "appid"])


# The registry's events, from the orders table: models by status, versions by
# customer, later orders delete.
_EVENTS = """SELECT o_orderstatus AS name, concat('1.0.', CAST(o_custkey % 5 AS VARCHAR(9))) AS version,
  CASE WHEN o_orderkey % 3 = 0 THEN 'deleted' ELSE 'saved' END AS event, {at} AS moment FROM {orders}"""
_AT = "o_orderdate + to_seconds(o_orderkey)"


@query(
    "s16_registry_latest",
    f"""WITH ev AS ({_EVENTS.format(at=_AT, orders='orders')}),
live AS (SELECT name, version, arg_max(event, moment) AS event, max(CASE WHEN event = 'saved' THEN moment END) AS created_at FROM ev GROUP BY name, version)
SELECT name, version, created_at FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY created_at DESC, version DESC) AS r FROM live WHERE event = 'saved') WHERE r = 1""",
)
def s16(t: Tables) -> DataFrame:
    events = t.orders.select(
        F.col("o_orderstatus").alias("name"),
        F.concat(F.lit("1.0."), (F.col("o_custkey") % 5).cast("string")).alias("version"),
        F.when(F.col("o_orderkey") % 3 == 0, "deleted").otherwise("saved").alias("event"),
        F.timestamp_add("SECOND", F.col("o_orderkey").cast("int"), F.col("o_orderdate")).alias("at"),
    )
    return sinks.latest_versions(events)


# --- Filters and cleaning -------------------------------------------------


@query("f01_status_filter", "SELECT id, fqdn_status FROM inventory WHERE fqdn_status IN ('Active')", INV)
def f01(t: Tables) -> DataFrame:
    return clean.filter_records(t.inventory, ["Active"]).select("id", "fqdn_status")


# The configured exclusions.
EXCLUDE = ("test.*", ".*localhost.*", r".*127\.0\.0\.1.*", "uat")


@query(
    "f02_pattern_filter",
    "SELECT id, fqdn FROM inventory WHERE " + " AND ".join(f"NOT regexp_matches(fqdn, '{p}')" for p in EXCLUDE),
    INV,
)
def f02(t: Tables) -> DataFrame:
    return clean.filter_records(t.inventory, exclude_patterns=EXCLUDE).select("id", "fqdn")


@query(
    "f03_f04_normalized_text",
    r"""SELECT id, rtrim(regexp_replace(lower(fqdn), '^\s+|\s+$', '', 'g'), '.') AS fqdn,
  regexp_replace(lower(record_data), '^\s+|\s+$', '', 'g') AS record_data FROM inventory_raw""",
    ("inventory_raw",),
)
def f03(t: Tables) -> DataFrame:
    return clean.normalize_text(t.inventory_raw).select("id", "fqdn", "record_data")


@query(
    "f05_null_fill",
    """SELECT id, coalesce(fqdn, 'unknown') AS fqdn, coalesce(brand, 'unknown') AS brand, coalesce(appid, -1) AS appid,
  coalesce(hits, -1) AS hits, coalesce(cost, (SELECT median(cost) FROM inventory)) AS cost FROM inventory""",
    INV,
)
def f05(t: Tables) -> DataFrame:
    df = t.inventory.select("id", "fqdn", "brand", "appid", "hits", "cost")
    return clean.fill_nulls(df, clean.medians(df))


SQL_CLASSES = """counts AS (SELECT appid AS label, count(*) AS n FROM inventory WHERE appid <> 0 GROUP BY appid),
classes AS (SELECT label, n, n >= 3 AS is_valid, n >= 3 AND n < 5 AS is_rare FROM counts)"""


@query("f06_class_table", f"WITH {SQL_CLASSES} SELECT * FROM classes", INV)
def f06(t: Tables) -> DataFrame:
    return clean.class_table(t.inventory)


def _group_cleaner() -> clean.RecordCleaner:
    # At these thresholds the tables have classes of every kind.
    return clean.RecordCleaner(min_samples=5, rare_threshold=40, policy="group", stateless=True)


SQL_GROUP = """counts AS (SELECT appid AS label, count(*) AS n FROM inventory WHERE appid <> 0 GROUP BY appid),
classes AS (SELECT label, n, n >= 5 AS is_valid, n >= 5 AND n < 40 AS is_rare FROM counts),
idx AS (SELECT label, CAST(row_number() OVER (ORDER BY r, label) - 1 AS INTEGER) AS idx FROM
  (SELECT DISTINCT CASE WHEN is_rare THEN -999 ELSE label END AS label, is_rare AS r FROM classes WHERE is_valid))"""


@query(
    "f07_rare_grouped",
    f"""WITH {SQL_GROUP} SELECT id, CASE WHEN is_rare THEN -999 ELSE coalesce(appid, -1) END AS appid
FROM inventory LEFT JOIN classes ON coalesce(appid, -1) = label""",
    INV,
)
def f07(t: Tables) -> DataFrame:
    df = t.inventory.select("id", "appid")
    return _group_cleaner().fit(df).transform(df)


@query(
    "f08_rare_dropped",
    f"""WITH {SQL_CLASSES} SELECT id, coalesce(appid, -1) AS appid FROM inventory
WHERE appid = 0 OR coalesce(appid, -1) IN (SELECT label FROM classes WHERE is_valid)""",
    INV,
)
def f08(t: Tables) -> DataFrame:
    df = t.inventory.select("id", "appid")
    return clean.RecordCleaner(policy="drop").fit(df).transform(df)


@query("f09_classes_kept", "SELECT id, coalesce(appid, -1) AS appid FROM inventory", INV)
def f09(t: Tables) -> DataFrame:
    df = t.inventory.select("id", "appid")
    return clean.RecordCleaner(policy="keep").fit(df).transform(df)


@query("f10_class_index", f"WITH {SQL_GROUP} SELECT label, idx FROM idx", INV)
def f10(t: Tables) -> DataFrame:
    return _group_cleaner().fit(t.inventory.select("id", "appid")).index


@query(
    "f11_encoded_labels",
    f"""WITH {SQL_GROUP}, grouped AS (SELECT id, CASE WHEN is_rare THEN -999 ELSE coalesce(appid, -1) END AS appid
  FROM inventory LEFT JOIN classes c ON coalesce(appid, -1) = c.label)
SELECT id, appid, idx AS label, CASE WHEN idx IS NULL THEN NULL ELSE appid END AS decoded FROM grouped LEFT JOIN idx ON appid = idx.label""",
    INV,
)
def f11(t: Tables) -> DataFrame:
    df = t.inventory.select("id", "appid")
    model = _group_cleaner().fit(df)
    encoded = clean.encode_labels(model.transform(df), model.index, "appid")
    return clean.decode_labels(encoded, model.index, "label", "decoded")


@query(
    "f11_raw_label_index",
    "SELECT label, CAST(row_number() OVER (ORDER BY label) - 1 AS INTEGER) AS idx FROM (SELECT DISTINCT c_mktsegment AS label FROM customer)",
)
def f11b(t: Tables) -> DataFrame:
    return clean.label_index(t.customer, "c_mktsegment")


@query("f12_f13_feature_columns", "SELECT fqdn, record_type, record_data, brand, fqdn_status, tech_environment, market, cost, hits, scan_text, seen_at FROM inventory", INV)
def f12(t: Tables) -> DataFrame:
    df = t.inventory
    return df.select(*clean.columns_by_role(clean.feature_columns(df.columns)))


@query(
    "f14_cleaned_records",
    r"""WITH counts AS (SELECT appid AS label, count(*) AS n FROM inventory_raw WHERE appid <> 0 GROUP BY appid),
classes AS (SELECT label, n >= 5 AS is_valid, n >= 5 AND n < 40 AS is_rare FROM counts),
kept AS (SELECT * FROM inventory_raw WHERE fqdn_status IN ('Active', 'Demised') AND NOT regexp_matches(fqdn, 'UAT')),
filled AS (SELECT id, coalesce(rtrim(regexp_replace(lower(fqdn), '^\s+|\s+$', '', 'g'), '.'), 'unknown') AS fqdn,
  coalesce(regexp_replace(lower(record_data), '^\s+|\s+$', '', 'g'), 'unknown') AS record_data,
  coalesce(record_type, 'unknown') AS record_type, coalesce(appid, -1) AS appid, coalesce(brand, 'unknown') AS brand,
  fqdn_status, coalesce(cost, (SELECT median(cost) FROM kept)) AS cost, coalesce(hits, -1) AS hits FROM kept)
SELECT id, fqdn, record_type, record_data, CASE WHEN is_rare THEN -999 ELSE appid END AS appid, brand, fqdn_status, cost, hits
FROM filled LEFT JOIN classes ON appid = label""",
    ("inventory_raw",),
)
def f14(t: Tables) -> DataFrame:
    cleaner = clean.RecordCleaner(
        min_samples=5, rare_threshold=40, include_status=["Active", "Demised"], exclude_patterns=["UAT"], stateless=True
    )
    return cleaner.fit(t.inventory_raw).transform(t.inventory_raw)


@query("f15_safe_divide", "SELECT id, CASE WHEN hits = 0 THEN -1.0 ELSE cost / hits END AS ratio FROM inventory", INV)
def f15(t: Tables) -> DataFrame:
    return t.inventory.select("id", safe_divide(F.col("cost"), F.col("hits"), -1.0).alias("ratio"))


@query(
    "d15_max_classes",
    """WITH counts AS (SELECT appid AS label, count(*) AS n FROM inventory WHERE appid <> 0 GROUP BY appid),
top AS (SELECT label FROM counts WHERE n >= 3 ORDER BY n DESC, label LIMIT 10)
SELECT label, n, label IN (SELECT label FROM top) AS is_valid, FALSE AS is_rare FROM counts""",
    INV,
)
def d15(t: Tables) -> DataFrame:
    return clean.class_table(t.inventory, policy="drop", max_classes=10)


@query("d17_overrides", "SELECT id, coalesce(CASE WHEN id % 4 = 0 THEN upper(brand) END, brand) AS brand, coalesce(CASE WHEN id % 9 = 0 THEN 4242 END, appid) AS appid FROM inventory", INV)
def d17(t: Tables) -> DataFrame:
    df = t.inventory.select(
        "id", "brand", "appid",
        F.when(F.col("id") % 4 == 0, F.upper("brand")).alias("override_brand"),
        F.when(F.col("id") % 9 == 0, F.lit(4242).cast("long")).alias("override_appid"),
    )
    return clean.apply_overrides(df).select("id", "brand", "appid")


@query("d01_interactions", "SELECT id, market || '_' || brand AS market_brand, tech_environment || '_' || fqdn_status AS env_status FROM inventory", INV)
def d01(t: Tables) -> DataFrame:
    return encode.interactions(t.inventory).select("id", "market_brand", "env_status")


# --- Splits ---------------------------------------------------------------

_CUT = "CAST(floor(n * CAST({} AS DOUBLE)) AS BIGINT)"
SQL_SPLIT = f"CASE WHEN r <= {_CUT.format('0.7')} THEN 'train' WHEN r <= {_CUT.format('0.7')} + {_CUT.format('0.15')} THEN 'val' ELSE 'test' END"
HASH = "md5(concat('42|', CAST(id AS VARCHAR)))"


def _ranked(by: str | None, columns: str = "id, appid") -> str:
    over = f"PARTITION BY {by} " if by else ""
    return f"ranked AS (SELECT {columns}, row_number() OVER ({over}ORDER BY {HASH}, id) AS r, count(*) OVER ({over.strip()}) AS n FROM inventory)"


@query("p02_random_split", f"WITH {_ranked(None)} SELECT id, {SQL_SPLIT} AS split FROM ranked", INV)
def p02(t: Tables) -> DataFrame:
    return splits.split(t.inventory.select("id"), "id")


@query(
    "p01_p03_stratified_split",
    f"WITH {_ranked('appid')} SELECT id, appid, CASE WHEN appid IS NULL OR n < 3 THEN 'train' ELSE {SQL_SPLIT} END AS split FROM ranked",
    INV,
)
def p03(t: Tables) -> DataFrame:
    return splits.split(t.inventory.select("id", "appid"), "id", stratify="appid")


@query(
    "p04_split_sizes",
    f"""WITH {_ranked('appid')}, named AS (SELECT appid, CASE WHEN appid IS NULL OR n < 3 THEN 'train' ELSE {SQL_SPLIT} END AS split FROM ranked)
SELECT appid, split, count(*) AS n FROM named GROUP BY appid, split""",
    INV,
)
def p04(t: Tables) -> DataFrame:
    named = splits.split(t.inventory.select("id", "appid"), "id", 0.7, 0.15, 0.15, "appid")
    return named.groupBy("appid", "split").agg(F.count("*").alias("n"))


@query(
    "p05_stratified_folds",
    f"""WITH {_ranked('appid')}
SELECT id, CAST(CASE WHEN appid IS NULL THEN 0 ELSE {' + '.join(f'(CASE WHEN r > ceil(n * {j} / 5.0) THEN 1 ELSE 0 END)' for j in range(1, 5))} END AS INTEGER) AS fold FROM ranked""",
    INV,
)
def p05(t: Tables) -> DataFrame:
    return splits.folds(t.inventory.select("id", "appid"), "id", 5, "appid").select("id", "fold")


@query("p06_sample", f"WITH {_ranked(None)} SELECT id FROM ranked WHERE r <= 1000", INV)
def p06(t: Tables) -> DataFrame:
    return splits.sample(t.inventory.select("id"), "id", 1000)


@query("d10_undersample", f"WITH {_ranked('appid')} SELECT id, appid FROM ranked WHERE appid IS NULL OR r <= 200", INV)
def d10(t: Tables) -> DataFrame:
    return splits.undersample(t.inventory.select("id", "appid"), "id", "appid", 200)


@query(
    "d10_oversample",
    f"""WITH {_ranked('appid')}, c AS (SELECT id, appid, CASE WHEN appid IS NULL OR n >= 700 THEN 1 ELSE 700 // n + CASE WHEN r <= 700 % n THEN 1 ELSE 0 END END AS copies FROM ranked)
SELECT id, appid, CAST(unnest(range(1, copies + 1)) AS INTEGER) AS copy FROM c""",
    INV,
)
def d10b(t: Tables) -> DataFrame:
    return splits.oversample(t.inventory.select("id", "appid"), "id", "appid", 700)


@query(
    "d11_time_folds",
    f"""WITH b AS (SELECT list_transform(quantile_cont(CAST(epoch(seen_at) AS DOUBLE), [{', '.join(f'CAST({j} AS DOUBLE) / 6' for j in range(1, 6))}]), lambda x: round(x, 3)) AS q FROM inventory),
f AS (SELECT id, CAST(len(list_filter(q, lambda x: epoch(seen_at) >= x)) AS INTEGER) AS fold, q FROM inventory, b)
SELECT id, fold, CASE WHEN fold > 0 THEN q[fold] - 3600 END AS train_until FROM f""",
    INV,
)
def d11(t: Tables) -> DataFrame:
    return splits.time_folds(t.inventory.select("id", "seen_at"), "seen_at", 5, 3600).drop("seen_at")


# --- Quality --------------------------------------------------------------

DECLARED = {
    "fqdn": {"type": "string", "nullable": False, "min_length": 3},
    "appid": {"type": "integer", "nullable": False},
    "record_type": {"type": "string", "nullable": True, "allowed_values": ["A", "AAAA", "CNAME", "MX", "TXT", "NS", "PTR", "SRV"]},
    "cost": {"type": "integer"},
}
PROFILED = ("id", "fqdn", "record_type", "record_data", "appid", "brand", "fqdn_status", "market", "cost", "hits")


def _profile_columns(t: Tables) -> DataFrame:
    return t.inventory.select(*PROFILED)


SQL_ISSUE_NULLS = " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, count(*) FILTER (WHERE {c} IS NULL) AS null_count, count(*) FILTER (WHERE {c} IS NULL) / CAST(count(*) AS DOUBLE) AS null_ratio FROM inventory"
    for c in PROFILED
)
SQL_VALID_HOST = r"""(length(fqdn) > 0 AND length(fqdn) <= 253 AND (starts_with(fqdn, 'localhost') OR ends_with(fqdn, '.local')
  OR regexp_matches(fqdn, '^([a-zA-Z0-9]([a-zA-Z0-9-]{0,61}[a-zA-Z0-9])?[.])+[a-zA-Z]{2,}[.]?$')
  OR (len(string_split(fqdn, '.')) >= 2 AND len(list_filter(string_split(fqdn, '.'), lambda p: length(p) < 1 OR length(p) > 63 OR starts_with(p, '-') OR ends_with(p, '-'))) = 0)))"""


@query(
    "q01_severity_counts",
    f"""WITH nulls AS ({SQL_ISSUE_NULLS}),
issues AS (
  SELECT CASE WHEN column_name IN ('fqdn', 'appid') THEN 'ERROR' ELSE 'WARNING' END AS severity FROM nulls
    WHERE (column_name IN ('fqdn', 'appid') AND null_count > 0) OR null_ratio > 0.5
  UNION ALL SELECT 'ERROR' WHERE FALSE
  UNION ALL SELECT 'WARNING' -- cost declared integer, holds doubles
  UNION ALL SELECT 'WARNING' WHERE (SELECT count(*) FROM inventory WHERE record_type NOT IN ('A','AAAA','CNAME','MX','TXT','NS','PTR','SRV')) > 0
  UNION ALL SELECT 'WARNING' WHERE (SELECT count(*) FROM inventory WHERE length(fqdn) < 3) > 0
  UNION ALL SELECT 'INFO' WHERE (SELECT count(*) FROM (SELECT fqdn FROM inventory GROUP BY fqdn HAVING count(*) > 1)) > 0
  UNION ALL SELECT 'WARNING' WHERE (SELECT count(*) FROM inventory WHERE NOT {SQL_VALID_HOST}) > 0
  UNION ALL SELECT 'WARNING' WHERE (SELECT count(*) FROM inventory WHERE appid < 0) > 0
  UNION ALL SELECT 'INFO' WHERE (SELECT count(*) FROM (SELECT appid FROM inventory GROUP BY appid HAVING count(*) < 3 AND appid <> 0)) > 0
  UNION ALL SELECT 'INFO' WHERE (SELECT count(*) FROM inventory WHERE record_type NOT IN ('A','AAAA','CNAME','MX','TXT','NS','PTR','SRV','SOA')) > 0)
SELECT severity, count(*) AS n FROM issues GROUP BY severity""",
    INV,
)
def q01(t: Tables) -> DataFrame:
    return quality.severity_counts(quality.all_issues(_profile_columns(t), declared=DECLARED))


@query(
    "q02_missing_columns",
    "SELECT c AS column_name, 'ERROR' AS severity FROM (VALUES ('fqdn'), ('record_type'), ('record_data'), ('appid')) v(c) WHERE c NOT IN (SELECT column_name FROM (DESCRIBE SELECT page_id, url AS fqdn FROM pages))",
)
def q02(t: Tables) -> DataFrame:
    return quality.missing_columns(t.pages.select("page_id", F.col("url").alias("fqdn"))).select("column_name", "severity")


@query("q03_declared_types", "SELECT 'cost' AS column_name, 'WARNING' AS severity FROM (SELECT typeof(cost) AS k FROM inventory WHERE cost IS NOT NULL GROUP BY 1) WHERE k NOT IN ('TINYINT', 'SMALLINT', 'INTEGER', 'BIGINT')", INV)
def q03(t: Tables) -> DataFrame:
    return quality.type_mismatches(t.inventory, DECLARED).select("column_name", "severity")


@query("q04_null_counts", SQL_ISSUE_NULLS, INV)
def q04(t: Tables) -> DataFrame:
    return quality.null_counts(_profile_columns(t))


@query(
    "q04_missing_value_issues",
    f"""WITH nulls AS ({SQL_ISSUE_NULLS})
SELECT column_name, CASE WHEN column_name = 'fqdn' THEN 'null_in_non_nullable' ELSE 'high_missing_ratio' END AS issue_type,
  CASE WHEN column_name = 'fqdn' THEN 'ERROR' ELSE 'WARNING' END AS severity, CAST(null_count AS DOUBLE) AS amount
FROM nulls WHERE (column_name = 'fqdn' AND null_count > 0) OR null_ratio > 0.3""",
    INV,
)
def q04b(t: Tables) -> DataFrame:
    return quality.missing_value_issues(_profile_columns(t), ["fqdn"], 0.3).drop("message")


@query(
    "q05_duplicate_rows",
    """WITH d AS (SELECT count(*) AS n FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem)), a AS (SELECT count(*) AS n FROM lineitem)
SELECT a.n AS total_rows, d.n AS unique_rows, (a.n - d.n) / CAST(a.n AS DOUBLE) AS duplicate_ratio FROM a, d""",
)
def q05(t: Tables) -> DataFrame:
    return quality.duplicate_rows(t.lineitem.select("l_orderkey", "l_linenumber"))


@query("q06_repeated_hosts", "SELECT count(*) AS repeated_hosts FROM (SELECT fqdn FROM inventory GROUP BY fqdn HAVING count(*) > 1)", INV)
def q06(t: Tables) -> DataFrame:
    return quality.repeated_hosts(t.inventory)


@query("q07_invalid_hosts", f"SELECT count(*) AS invalid_hosts FROM inventory_raw WHERE NOT {SQL_VALID_HOST}", ("inventory_raw",))
def q07(t: Tables) -> DataFrame:
    return quality.invalid_hosts(t.inventory_raw)


@query("q07_invalid_examples", f"SELECT DISTINCT fqdn FROM inventory WHERE NOT {SQL_VALID_HOST} ORDER BY fqdn LIMIT 5", INV)
def q07b(t: Tables) -> DataFrame:
    return quality.invalid_host_examples(t.inventory)


@query("q08_host_predicate", f"SELECT id, {SQL_VALID_HOST} AS valid FROM inventory_raw", ("inventory_raw",))
def q08(t: Tables) -> DataFrame:
    return t.inventory_raw.select("id", is_valid_host(F.col("fqdn")).alias("valid"))


@query(
    "q09_target_summary",
    """WITH c AS (SELECT appid, count(*) AS n FROM inventory GROUP BY appid)
SELECT count(*) AS n_classes, CAST(coalesce(sum(n) FILTER (WHERE appid < 0), 0) AS BIGINT) AS negative_count,
  CAST(coalesce(sum(n) FILTER (WHERE appid = 0), 0) AS BIGINT) AS orphan_count,
  CAST(sum(n) - coalesce(sum(n) FILTER (WHERE appid = 0), 0) AS BIGINT) AS labeled_count,
  CAST(coalesce(sum(n) FILTER (WHERE appid = 0), 0) AS DOUBLE) / CAST(sum(n) AS DOUBLE) AS orphan_ratio,
  count(*) FILTER (WHERE n < 3 AND appid <> 0) AS rare_classes FROM c""",
    INV,
)
def q09(t: Tables) -> DataFrame:
    return quality.target_summary(t.inventory)


@query("q10_unknown_record_types", "SELECT DISTINCT record_type FROM inventory WHERE record_type NOT IN ('A','AAAA','CNAME','MX','TXT','NS','PTR','SRV','SOA')", INV)
def q10(t: Tables) -> DataFrame:
    return quality.unknown_record_types(t.inventory)


@query("q11_status_distribution", "SELECT fqdn_status, count(*) AS n FROM inventory GROUP BY fqdn_status", INV)
def q11(t: Tables) -> DataFrame:
    return quality.distribution(t.inventory, "fqdn_status")


def _sql_profile(table: str, columns: dict[str, str]) -> str:
    parts = []
    for c, kind in columns.items():
        head = f"SELECT '{c}' AS column_name, '{kind}' AS dtype, count(*) FILTER (WHERE {c} IS NULL) AS null_count, count(*) FILTER (WHERE {c} IS NULL) / CAST(count(*) AS DOUBLE) AS null_ratio, "
        if kind == "string":
            head += f"CAST(NULL AS DOUBLE) AS min, CAST(NULL AS DOUBLE) AS max, CAST(NULL AS DOUBLE) AS mean, CAST(NULL AS DOUBLE) AS std, count(DISTINCT {c}) + CAST(bool_or({c} IS NULL) AS BIGINT) AS n_unique, CAST(min(length({c})) AS INTEGER) AS min_length, CAST(max(length({c})) AS INTEGER) AS max_length"
        else:
            head += f"CAST(min({c}) AS DOUBLE) AS min, CAST(max({c}) AS DOUBLE) AS max, round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS std, CAST(NULL AS BIGINT) AS n_unique, CAST(NULL AS INTEGER) AS min_length, CAST(NULL AS INTEGER) AS max_length"
        parts.append(f"{head} FROM {table}")
    return " UNION ALL ".join(parts)


def _rounded(profile: DataFrame) -> DataFrame:
    return profile.withColumns({c: F.round(c, 4) for c in ("mean", "std")})


@query(
    "q12_column_profile",
    _sql_profile("inventory", dict(zip(PROFILED, ("bigint", "string", "string", "string", "bigint", "string", "string", "string", "double", "int")))),
    INV,
)
def q12(t: Tables) -> DataFrame:
    return _rounded(quality.column_profile(_profile_columns(t)))


@query(
    "q13_validation_issues",
    f"""WITH nulls AS ({SQL_ISSUE_NULLS}), dup AS (SELECT count(*) AS n FROM (SELECT DISTINCT * FROM inventory))
SELECT column_name, 'high_missing_ratio' AS issue_type, 'WARNING' AS severity, CAST(null_count AS DOUBLE) AS amount FROM nulls WHERE null_ratio > 0.3
UNION ALL SELECT 'fqdn', 'duplicate_fqdns', 'INFO', CAST(count(*) AS DOUBLE) FROM (SELECT fqdn FROM inventory GROUP BY fqdn HAVING count(*) > 1) HAVING count(*) > 0
UNION ALL SELECT 'fqdn', 'invalid_fqdn_format', 'WARNING', CAST(count(*) AS DOUBLE) FROM inventory WHERE NOT {SQL_VALID_HOST} HAVING count(*) > 0
UNION ALL SELECT 'appid', 'negative_appid', 'WARNING', CAST(count(*) AS DOUBLE) FROM inventory WHERE appid < 0 HAVING count(*) > 0
UNION ALL SELECT 'appid', 'rare_classes', 'INFO', CAST(count(*) AS DOUBLE) FROM (SELECT appid FROM inventory GROUP BY appid HAVING count(*) < 3 AND appid <> 0) HAVING count(*) > 0
UNION ALL SELECT 'record_type', 'unknown_record_types', 'INFO', CAST(count(DISTINCT record_type) AS DOUBLE) FROM inventory WHERE record_type NOT IN ('A','AAAA','CNAME','MX','TXT','NS','PTR','SRV','SOA') HAVING count(*) > 0""",
    INV,
)
def q13(t: Tables) -> DataFrame:
    return quality.all_issues(_profile_columns(t), max_missing_ratio=0.3).drop("message")


@query(
    "d14_declared_values",
    """SELECT 'record_type' AS column_name, 'value_not_allowed' AS issue_type, count(*) AS violations FROM inventory WHERE record_type NOT IN ('A','AAAA','CNAME','MX','TXT','NS','PTR','SRV') HAVING count(*) > 0
UNION ALL SELECT 'fqdn', 'below_min_length', count(*) FROM inventory WHERE length(fqdn) < 25 HAVING count(*) > 0""",
    INV,
)
def d14(t: Tables) -> DataFrame:
    declared = {**DECLARED, "fqdn": {"min_length": 25}}
    return quality.declared_value_issues(t.inventory, declared)
