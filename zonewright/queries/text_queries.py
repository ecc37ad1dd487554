"""Text vectors, encoders, scaling, assembly and feature selection."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from zonewright import vocabulary as V
from zonewright.functions import host, text
from zonewright.operators import choose, encode, vectorize
from zonewright.operators.base import hold
from zonewright.operators.information import nearest_information
from zonewright.plans.features import FeaturePlan, HostFeatures, RecordFeatures, ScanFeatures, feature_names, group_columns
from zonewright.queries.host_queries import sql_flags, sql_parts
from zonewright.queries.registry import query
from zonewright.queries.tables import Tables, dealt

INV, DNS = ("inventory",), ("dns_records",)
STOP_WORDS = (
    "the", "of", "and", "in", "to", "is", "that", "it", "was", "for", "on", "are", "as", "with", "at", "be", "this",
    "from", "or", "by", "an", "not", "which", "have", "had", "but", "his", "they", "her", "she", "he", "we",
)

SQL_HOST_CLEAN = "lower(translate(coalesce(fqdn, ''), '.-', '  '))"
SQL_CLEAN = r"trim(regexp_replace(lower(replace(coalesce(text, ''), '<CR>', ' ')), '[^\p{L}\p{N}_]+', ' ', 'g'))"


def sql_char_terms(source: str, name: str = "fqdn", low: int = 2, high: int = 4) -> str:
    """CTE ``terms(id, term)`` of the character n-grams of ``source``."""
    clean = f"lower(translate(coalesce({name}, ''), '.-', '  '))"
    grams = " UNION ALL ".join(
        f"SELECT id, substr(w, i, {n}) AS term FROM words, unnest(range(1, greatest(length(w) - {n} + 1, 1) + 1)) AS r(i)"
        + (f" WHERE length(w) >= {n}" if n > low else "")
        for n in range(low, high + 1)
    )
    return f"""words AS (SELECT id, ' ' || w || ' ' AS w FROM (SELECT id, unnest(regexp_split_to_array({clean}, '\\s+')) AS w FROM {source}) WHERE w <> ''),
terms AS ({grams})"""


SQL_WORDS = f"""words AS (SELECT doc_id AS id, list_filter(string_split({SQL_CLEAN}, ' '),
  lambda w: length(w) >= 2 AND NOT list_contains([{', '.join(f"'{w}'" for w in STOP_WORDS)}], w)) AS l FROM documents),
terms AS (SELECT id, unnest(l) AS term FROM words UNION ALL
  SELECT id, unnest(list_transform(list_zip(l[:len(l) - 1], l[2:]), lambda p: p[1] || ' ' || p[2])) FROM words WHERE len(l) > 1)"""


def sql_vocabulary(rows: str, limit: int, min_df: int = 2, max_df: float = 0.95) -> str:
    return f"""tt AS (SELECT term, count(*) AS total, count(DISTINCT id) AS df FROM terms GROUP BY term),
n AS (SELECT count(*) AS n FROM {rows}),
vocab AS (SELECT term, total, df FROM tt, n WHERE df >= {min_df} AND df <= CAST({max_df} AS DOUBLE) * n ORDER BY total DESC, term LIMIT {limit})"""


SQL_WEIGHTS = """tf AS (SELECT id, term, count(*) AS c FROM terms GROUP BY id, term),
raw AS (SELECT id, term, (1 + ln(c)) * (ln((CAST(n AS DOUBLE) + 1) / (df + 1)) + 1) AS w FROM tf JOIN vocab USING (term), n),
weights AS (SELECT id, term, w / sqrt(sum(w * w) OVER (PARTITION BY id)) AS weight FROM raw)"""


@query("x01_host_text", f"SELECT id, {SQL_HOST_CLEAN} AS cleaned FROM inventory", INV)
def x01(t: Tables) -> DataFrame:
    return t.inventory.select("id", text.clean_host_text(F.col("fqdn")).alias("cleaned"))


@query(
    "x02_char_ngrams",
    f"""WITH {sql_char_terms('inventory')}
SELECT id, count(*) AS n_terms, md5(array_to_string(list(term ORDER BY term), '|')) AS digest FROM terms GROUP BY id""",
    INV,
)
def x02(t: Tables) -> DataFrame:
    grams = t.inventory.select("id", text.char_wb_ngrams(text.clean_host_text(F.col("fqdn")), 2, 4).alias("g"))
    return grams.where(F.size("g") > 0).select(
        "id", F.size("g").cast("long").alias("n_terms"), F.md5(F.array_join(F.array_sort("g"), "|")).alias("digest")
    )


@query(
    "x03_vocabulary",
    f"WITH {sql_char_terms('inventory')}, {sql_vocabulary('inventory', 500)} SELECT term, total, df FROM vocab",
    INV,
)
def x03(t: Tables) -> DataFrame:
    return vectorize.TermWeights().vocabulary(t.inventory)[0]


def _weights(t: DataFrame, key: str, **settings) -> DataFrame:
    model = vectorize.TermWeights(**settings).fit(t)
    return model.weights(dealt(t.select(key, model.get("input")))).select(F.col(key).alias("id"), "term", F.round("weight", 6).alias("weight"))


@query(
    "x04_tfidf",
    f"WITH {sql_char_terms('dns_records')}, {sql_vocabulary('dns_records', 200)}, {SQL_WEIGHTS} SELECT id, term, round(weight, 6) AS weight FROM weights",
    DNS,
)
def x04(t: Tables) -> DataFrame:
    return _weights(t.dns_records, "id", max_features=200)


@query(
    "x04_tfidf_totals",
    f"""WITH {sql_char_terms('inventory')}, {sql_vocabulary('inventory', 500)}, {SQL_WEIGHTS}
SELECT term, count(*) AS n, round(sum(weight), 4) AS total FROM weights GROUP BY term""",
    INV,
)
def x04b(t: Tables) -> DataFrame:
    model = vectorize.TermWeights().fit(t.inventory)
    long = model.weights(dealt(t.inventory.select("fqdn")))
    return long.groupBy("term").agg(F.count("*").alias("n"), F.round(F.sum("weight"), 4).alias("total"))


@query(
    "x05_description_text",
    f"SELECT doc_id, md5({SQL_CLEAN}) AS digest, CAST(length({SQL_CLEAN}) AS INTEGER) AS n_chars FROM documents",
)
def x05(t: Tables) -> DataFrame:
    cleaned = text.clean_description(F.col("text"))
    return t.documents.select("doc_id", F.md5(cleaned).alias("digest"), F.char_length(cleaned).alias("n_chars"))


@query(
    "x06_description_tfidf",
    f"WITH {SQL_WORDS}, {sql_vocabulary('documents', 100, 2, 0.9)}, {SQL_WEIGHTS} SELECT id, term, round(weight, 6) AS weight FROM weights",
)
def x06(t: Tables) -> DataFrame:
    return _weights(
        t.documents.select("doc_id", "text"), "doc_id", input="text", analyzer="description", low=1, high=2,
        max_features=100, max_df=0.9, stop_words=list(STOP_WORDS),
    )


@query(
    "x07_description_keywords",
    "SELECT doc_id, " + ", ".join(f"CAST(contains({SQL_CLEAN}, '{k}') AS INTEGER) AS appdesc_has_{k}" for k in V.DESCRIPTION_KEYWORDS) + " FROM documents",
)
def x07(t: Tables) -> DataFrame:
    return vectorize.KeywordFlags(input="text").transform(t.documents.select("doc_id", "text")).drop("text")


@query(
    "x08_feature_names",
    f"""WITH {sql_char_terms('inventory')}, {sql_vocabulary('inventory', 300)}
SELECT 'fqdn_tfidf_' || term AS name, CAST(row_number() OVER (ORDER BY term) - 1 AS INTEGER) AS position FROM vocab""",
    INV,
)
def x08(t: Tables) -> DataFrame:
    names = vectorize.TermWeights(max_features=300).fit(t.inventory).feature_names()
    return t.spark.createDataFrame(list(enumerate(names)), "position int, name string")


@query(
    "d07_host_words",
    f"""WITH words AS (SELECT id, regexp_extract_all(lower(coalesce(fqdn, '')), '[a-zA-Z0-9]+') AS l FROM dns_records),
terms AS (SELECT id, unnest(l) AS term FROM words UNION ALL
  SELECT id, unnest(list_transform(list_zip(l[:len(l) - 1], l[2:]), lambda p: p[1] || ' ' || p[2])) FROM words WHERE len(l) > 1),
{sql_vocabulary('dns_records', 200)}, {SQL_WEIGHTS} SELECT id, term, round(weight, 6) AS weight FROM weights""",
    DNS,
)
def d07(t: Tables) -> DataFrame:
    return _weights(t.dns_records, "id", analyzer="host_word", low=1, high=2, max_features=200)


for _part in ("subdomain", "domain"):

    @query(
        f"d08_{_part}_tfidf",
        f"""WITH names AS (SELECT fqdn AS name FROM dns_records), {sql_parts('names')},
named AS (SELECT id, coalesce({_part}, '') AS {_part} FROM dns_records LEFT JOIN parts ON fqdn = name),
{sql_char_terms('named', _part)}, {sql_vocabulary('named', 100, 2, 1.0)}, {SQL_WEIGHTS} SELECT id, term, round(weight, 6) AS weight FROM weights""",
        DNS,
    )
    def _(t: Tables, part=_part) -> DataFrame:
        split = host.with_name_parts(t.dns_records, {"fqdn": "p"}).select("id", F.col(f"p.{part}").alias(part))
        return _weights(split, "id", input=part, max_features=100, max_df=1.0)


@query(
    "d09_name_similarity",
    """SELECT id, round(CASE WHEN greatest(length(coalesce(brand, '')), length(coalesce(fqdn, ''))) = 0 THEN 1.0
  ELSE 1 - levenshtein(lower(coalesce(brand, '')), lower(coalesce(fqdn, ''))) / CAST(greatest(length(coalesce(brand, '')), length(coalesce(fqdn, ''))) AS DOUBLE) END, 9) AS similarity FROM inventory""",
    INV,
)
def d09(t: Tables) -> DataFrame:
    return t.inventory.select("id", F.round(text.similarity(F.col("brand"), F.col("fqdn")), 9).alias("similarity"))


# --- Encoders -------------------------------------------------------------


def sql_codes(columns, source: str = "inventory", keep: str = "") -> str:
    return ", ".join(
        f"c_{c} AS (SELECT v, row_number() OVER (ORDER BY v) - 1 AS code FROM (SELECT {c} AS v FROM {source} WHERE {c} IS NOT NULL GROUP BY {c} {keep}))"
        for c in columns
    )


E1 = ("record_type", "brand", "market")


@query(
    "e01_label_codes",
    f"""WITH {sql_codes(E1)} SELECT id, {', '.join(f'CAST(coalesce(c_{c}.code, (SELECT count(*) FROM c_{c})) AS DOUBLE) AS {c}_code' for c in E1)}
FROM inventory {' '.join(f'LEFT JOIN c_{c} ON {c} = c_{c}.v' for c in E1)}""",
    INV,
)
def e01(t: Tables) -> DataFrame:
    df = t.inventory.select("id", *E1)
    return encode.CategoryEncoder(columns=list(E1)).fit(df).transform(df).drop(*E1)


@query(
    "e01_label_codes_limited",
    """WITH f AS (SELECT record_data AS v, count(*) AS n FROM inventory WHERE record_data IS NOT NULL GROUP BY record_data HAVING count(*) >= 2),
k AS (SELECT v FROM f ORDER BY n DESC, v LIMIT 50), c AS (SELECT v, row_number() OVER (ORDER BY v) - 1 AS code FROM k)
SELECT id, CAST(coalesce(code, (SELECT count(*) FROM c)) AS DOUBLE) AS record_data_code FROM inventory LEFT JOIN c ON record_data = v""",
    INV,
)
def e01b(t: Tables) -> DataFrame:
    df = t.inventory.select("id", "record_data")
    return encode.CategoryEncoder(columns=["record_data"], min_frequency=2, max_categories=50).fit(df).transform(df).drop("record_data")


@query(
    "e02_target_encoding",
    """WITH g AS (SELECT avg(o_totalprice) AS g FROM orders),
c AS (SELECT o_custkey AS v, (avg(o_totalprice) * count(*) + (SELECT g FROM g) * 10) / (count(*) + 10) AS code FROM orders GROUP BY o_custkey),
p AS (SELECT o_orderpriority AS v, (avg(o_totalprice) * count(*) + (SELECT g FROM g) * 10) / (count(*) + 10) AS code FROM orders GROUP BY o_orderpriority)
SELECT o_orderkey, round(c.code, 4) AS o_custkey_target_encoded, round(p.code, 4) AS o_orderpriority_target_encoded
FROM orders LEFT JOIN c ON o_custkey = c.v LEFT JOIN p ON o_orderpriority = p.v""",
)
def e02(t: Tables) -> DataFrame:
    df = t.orders.select("o_orderkey", "o_custkey", "o_orderpriority", "o_totalprice")
    model = encode.CategoryEncoder(columns=["o_custkey", "o_orderpriority"], strategy="target", target="o_totalprice").fit(df)
    return model.transform(df).select("o_orderkey", *[F.round(c, 4).alias(c) for c in model.output_columns()])


_EARLIER = "OVER (PARTITION BY {c} ORDER BY md5(concat('42|', CAST(id AS VARCHAR))), id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"


@query(
    "e02_ordered_target_encoding",
    f"""WITH m AS (SELECT avg(appid) AS mean FROM inventory)
SELECT id, {', '.join(f"""round(CASE WHEN {c} IS NULL THEN mean
  ELSE (coalesce(sum(CAST(appid AS DOUBLE)) {_EARLIER.format(c=c)}, 0) + mean * 10) / (count(appid) {_EARLIER.format(c=c)} + 10) END, 6) AS {c}_ordered_encoded""" for c in ("brand", "market"))}
FROM inventory, m""",
    INV,
)
def e02b(t: Tables) -> DataFrame:
    """Training rows encoded from earlier rows only."""
    df = t.inventory.select("id", "brand", "market", "appid")
    out = encode.ordered_target_encoding(df, ["brand", "market"], "appid", "id")
    return out.select("id", *[F.round(f"{c}_ordered_encoded", 6).alias(f"{c}_ordered_encoded") for c in ("brand", "market")])


@query(
    "e03_frequency_encoding",
    f"""WITH {', '.join(f"q_{c} AS (SELECT {c} AS v, count(*) / CAST((SELECT count(*) FROM inventory) AS DOUBLE) AS code FROM inventory WHERE {c} IS NOT NULL GROUP BY {c})" for c in E1)}
SELECT id, {', '.join(f'coalesce(q_{c}.code, 0) AS {c}_freq_encoded' for c in E1)} FROM inventory {' '.join(f'LEFT JOIN q_{c} ON {c} = q_{c}.v' for c in E1)}""",
    INV,
)
def e03(t: Tables) -> DataFrame:
    df = t.inventory.select("id", *E1)
    return encode.CategoryEncoder(columns=list(E1), strategy="frequency").fit(df).transform(df).drop(*E1)


@query(
    "e04_mixed_encoders",
    """WITH a AS (SELECT brand AS v, row_number() OVER (ORDER BY brand) - 1 AS code FROM (SELECT DISTINCT brand FROM inventory WHERE brand IS NOT NULL)),
m AS (SELECT market AS v, count(*) / CAST((SELECT count(*) FROM inventory) AS DOUBLE) AS code FROM inventory WHERE market IS NOT NULL GROUP BY market)
SELECT id, CAST(coalesce(a.code, (SELECT count(*) FROM a)) AS DOUBLE) AS brand_code, coalesce(m.code, 0) AS market_freq_encoded
FROM inventory LEFT JOIN a ON brand = a.v LEFT JOIN m ON market = m.v""",
    INV,
)
def e04(t: Tables) -> DataFrame:
    df = t.inventory.select("id", "brand", "market")
    encoder = encode.CategoryEncoder(columns=["brand", "market", "not_there"], strategies={"market": "frequency"})
    return encoder.fit(df).transform(df).select("id", "brand_code", "market_freq_encoded")


@query(
    "e05_standard_scaling",
    """WITH s AS (SELECT avg(cost) AS mc, stddev_pop(cost) AS sc, avg(hits) AS mh, stddev_pop(hits) AS sh FROM inventory)
SELECT id, round((coalesce(cost, 0) - mc) / sc, 6) AS cost_scaled, round((coalesce(hits, 0) - mh) / sh, 6) AS hits_scaled FROM inventory, s""",
    INV,
)
def e05(t: Tables) -> DataFrame:
    return _scaled(t, "standard")


def _scaled(t: Tables, method: str) -> DataFrame:
    df = t.inventory.select("id", "cost", "hits")
    out = encode.NumericScaler(columns=["cost", "hits"], method=method).fit(df).transform(df)
    return out.select("id", F.round("cost_scaled", 6).alias("cost_scaled"), F.round("hits_scaled", 6).alias("hits_scaled"))


@query(
    "d05_minmax_scaling",
    """WITH s AS (SELECT min(cost) AS mc, max(cost) - min(cost) AS sc, min(hits) AS mh, CAST(max(hits) - min(hits) AS DOUBLE) AS sh FROM inventory)
SELECT id, round((coalesce(cost, 0) - mc) / sc, 6) AS cost_scaled, round((coalesce(hits, 0) - mh) / sh, 6) AS hits_scaled FROM inventory, s""",
    INV,
)
def d05(t: Tables) -> DataFrame:
    return _scaled(t, "minmax")


@query(
    "d05_robust_scaling",
    """WITH s AS (SELECT median(cost) AS mc, quantile_cont(cost, 0.75) - quantile_cont(cost, 0.25) AS sc, median(hits) AS mh, CAST(quantile_cont(hits, 0.75) - quantile_cont(hits, 0.25) AS DOUBLE) AS sh FROM inventory)
SELECT id, round((coalesce(cost, 0) - mc) / sc, 6) AS cost_scaled, round((coalesce(hits, 0) - mh) / sh, 6) AS hits_scaled FROM inventory, s""",
    INV,
)
def d05b(t: Tables) -> DataFrame:
    return _scaled(t, "robust")


@query(
    "d02_clipped_outliers",
    """WITH s AS (SELECT quantile_cont(cost, CAST(0.01 AS DOUBLE)) AS lo, quantile_cont(cost, CAST(0.99 AS DOUBLE)) AS hi FROM inventory)
SELECT id, round(CASE WHEN cost IS NULL THEN NULL ELSE least(greatest(cost, lo), hi) END, 4) AS cost FROM inventory, s""",
    INV,
)
def d02(t: Tables) -> DataFrame:
    out = encode.clip_outliers(t.inventory.select("id", "cost"), ["cost"])
    return out.select("id", F.round("cost", 4).alias("cost"))


@query(
    "d03_one_hot",
    f"""WITH {sql_codes(E1)}, cells AS ({' UNION ALL '.join(f"SELECT id, '{c}' AS col, code FROM inventory JOIN c_{c} ON {c} = c_{c}.v" for c in E1)})
SELECT id, col, code FROM cells""",
    INV,
)
def d03(t: Tables) -> DataFrame:
    df = t.inventory.select("id", *E1)
    out = encode.CategoryEncoder(columns=list(E1), strategy="onehot").fit(df).transform(df)
    cells = F.flatten(F.array(*[_ones(c) for c in E1]))
    return out.select("id", F.inline(cells))


def _ones(column: str) -> Column:
    """The set positions of a one-hot array, as (col, code) structs."""
    marked = F.transform(vector_to_array(f"{column}_onehot"), lambda x, i: F.struct(F.lit(column).alias("col"), i.cast("long").alias("code"), x.alias("x")))
    return F.transform(F.filter(marked, lambda s: s["x"] == 1), lambda s: F.struct(s["col"].alias("col"), s["code"].alias("code")))


@query(
    "d04_encoding_choice",
    """WITH u AS (SELECT 'brand' AS col, count(DISTINCT brand) AS n_values FROM inventory UNION ALL SELECT 'fqdn', count(DISTINCT fqdn) FROM inventory
  UNION ALL SELECT 'record_data', count(DISTINCT record_data) FROM inventory UNION ALL SELECT 'market', count(DISTINCT market) FROM inventory)
SELECT col AS "column", n_values, CASE WHEN n_values > 100 THEN 'target' ELSE 'label' END AS strategy FROM u""",
    INV,
)
def d04(t: Tables) -> DataFrame:
    return encode.choose_strategies(t.inventory, ["brand", "fqdn", "record_data", "market"])


for _strategy, _value in {"median": "(SELECT median(cost) FROM inventory)", "mean": "(SELECT avg(cost) FROM inventory)", "constant": "-1.0"}.items():

    @query(f"d06_fill_{_strategy}", f"SELECT id, round(coalesce(cost, {_value}), 4) AS cost FROM inventory", INV)
    def _(t: Tables, strategy=_strategy) -> DataFrame:
        out = encode.fill_numeric(t.inventory.select("id", "cost"), ["cost"], strategy)
        return out.select("id", F.round("cost", 4).alias("cost"))


# --- Assembly and selection -----------------------------------------------

PLAN = {"categorical_columns": ["record_type", "brand", "market"], "numerical_columns": ["cost"], "tfidf_max_features": 100}


def _assembled(t: Tables) -> tuple[DataFrame, list[str]]:
    df = dealt(t.inventory.withColumn("scan_result", F.split("scan_text", ",")))
    plan = FeaturePlan(**PLAN).fit(df)
    return plan.transform(df), feature_names(plan)


SQL_STRUCTURE_SUMS = {
    "fqdn_length": "length(fqdn)",
    "fqdn_num_dots": "len(regexp_extract_all(fqdn, '[.]'))",
    "fqdn_num_labels": "len(string_split(fqdn, '.'))",
    "data_length": "length(coalesce(record_data, ''))",
    "scan_count": "len(string_split(scan_text, ','))",
    "fqdn_max_label_length": "list_max(list_transform(string_split(fqdn, '.'), lambda x: length(x)))",
}


@query(
    "e06_assembled_sums",
    f"""WITH {sql_char_terms('inventory')}, {sql_vocabulary('inventory', 100)}, {SQL_WEIGHTS}, {sql_codes(E1)},
coded AS (SELECT id, {', '.join(f'coalesce(c_{c}.code, (SELECT count(*) FROM c_{c})) AS {c}' for c in E1)} FROM inventory i {' '.join(f'LEFT JOIN c_{c} ON i.{c} = c_{c}.v' for c in E1)}),
flags AS (SELECT {sql_flags(V.HOST_KEYWORDS)} FROM inventory),
s AS (SELECT avg(cost) AS m, stddev_pop(cost) AS d FROM inventory), sums AS (
{' UNION ALL '.join(f"SELECT '{n}' AS name, CAST(sum({e}) AS DOUBLE) AS total FROM inventory" for n, e in SQL_STRUCTURE_SUMS.items())}
UNION ALL {' UNION ALL '.join(f"SELECT 'fqdn_{n}', CAST(sum(fqdn_{n}) AS DOUBLE) FROM flags" for n in V.HOST_KEYWORDS)}
UNION ALL {' UNION ALL '.join(f"SELECT '{c}', CAST(sum({c}) AS DOUBLE) FROM coded" for c in E1)}
UNION ALL SELECT 'cost', sum((coalesce(cost, 0) - m) / d) FROM inventory, s
UNION ALL SELECT 'fqdn_tfidf_' || term, sum(weight) FROM weights GROUP BY term)
SELECT name, round(total, 3) + 0.0 AS total FROM sums""",
    INV,
)
def e06(t: Tables) -> DataFrame:
    rows, names = _assembled(t)
    sums = choose.vector_totals(rows)
    labels = t.spark.createDataFrame(list(enumerate(names)), "i int, name string")
    checked = [*SQL_STRUCTURE_SUMS, *[f"fqdn_{n}" for n in V.HOST_KEYWORDS], *E1, "cost"]
    out = labels.join(sums, "i", "left").where(F.col("name").isin(checked) | F.startswith("name", F.lit("fqdn_tfidf_")))
    return out.select("name", (F.round(F.coalesce("total", F.lit(0.0)), 3) + 0.0).alias("total"))


_AHEAD = [*HostFeatures().feature_names(), *RecordFeatures().feature_names(), *ScanFeatures().feature_names()]
_BEHIND = [*PLAN["categorical_columns"], *PLAN["numerical_columns"]]


@query(
    "e07_e09_feature_plan",
    f"""WITH {sql_char_terms('inventory')}, {sql_vocabulary('inventory', 100)}, named AS (
SELECT * FROM (VALUES {', '.join(f"({i}, '{n}')" for i, n in enumerate(_AHEAD))}) a(i, name)
UNION ALL SELECT {len(_AHEAD)} + CAST(row_number() OVER (ORDER BY term) AS INTEGER) - 1, 'fqdn_tfidf_' || term FROM vocab
UNION ALL SELECT i + CAST((SELECT count(*) FROM vocab) AS INTEGER), name FROM (VALUES {', '.join(f"({len(_AHEAD) + i}, '{n}')" for i, n in enumerate(_BEHIND))}) b(i, name))
SELECT CAST(i AS INTEGER) AS i, name, true AS plausible FROM named""",
    INV,
)
def e07(t: Tables) -> DataFrame:
    """Position and name of every feature; no more non-zero rows than rows."""
    rows, names = _assembled(t)
    n = rows.count()
    return _values(t, rows, names).select("i", "name", (F.col("n") <= n).alias("plausible"))


def _values(t: Tables, rows: DataFrame, names: list[str]) -> DataFrame:
    """``(i, name, n, total)``: rows with a non-zero value, and the sum, of every feature."""
    sums = choose.vector_totals(rows)
    out = t.spark.createDataFrame(list(enumerate(names)), "i int, name string").join(sums, "i", "left")
    return out.select("i", "name", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("total", F.lit(0.0)).alias("total"))


@query("e09_feature_values")
def e09(t: Tables) -> DataFrame:
    """Rows with a non-zero value, and the sum, of every assembled feature."""
    return _values(t, *_assembled(t))


NUMERIC = ("l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber")


@query(
    "l01_variance_filter",
    " UNION ALL ".join(f"SELECT '{c}' AS feature, round(var_pop({c}), 4) AS variance FROM lineitem HAVING var_pop({c}) > 0.01" for c in NUMERIC),
)
def l01(t: Tables) -> DataFrame:
    kept = choose.column_variances(t.lineitem, NUMERIC).where("variance > 0.01")
    return kept.withColumn("variance", F.round("variance", 4))


L2 = {"q": "l_quantity", "q2": "2 * l_quantity + l_tax", "p": "l_extendedprice", "d": "l_discount * 100", "nq": "-l_quantity"}


@query(
    "l02_correlation_filter",
    """WITH v AS (SELECT l_quantity AS q, 2 * l_quantity + l_tax AS q2, l_extendedprice AS p, l_discount * 100 AS d, -l_quantity AS nq FROM lineitem),
s AS (SELECT abs(corr(q, q2)) > 0.95 AND var_pop(q) < var_pop(q2) AS drop_q, abs(corr(q2, nq)) > 0.95 AND var_pop(q2) >= var_pop(nq) AS drop_nq,
  greatest(abs(corr(q2, p)), abs(corr(q, p)), abs(corr(nq, p))) > 0.95 AS with_p, greatest(abs(corr(q2, d)), abs(corr(q, d)), abs(corr(nq, d)), abs(corr(p, d))) > 0.95 AS with_d,
  abs(corr(q, q2)) > 0.95 AND var_pop(q) >= var_pop(q2) AS drop_q2 FROM v)
SELECT 'q' AS feature FROM s WHERE NOT drop_q UNION ALL SELECT 'q2' FROM s WHERE NOT drop_q2 UNION ALL SELECT 'p' FROM s WHERE NOT with_p
UNION ALL SELECT 'd' FROM s WHERE NOT with_d UNION ALL SELECT 'nq' FROM s WHERE NOT drop_nq""",
)
def l02(t: Tables) -> DataFrame:
    wide = t.lineitem.select(array_to_vector(F.array(*[F.expr(e).cast("double") for e in L2.values()])).alias("features"))
    model = choose.FeatureSelector(names=list(L2)).fit(wide)
    return t.spark.createDataFrame([(n,) for n in model.feature_names()], "feature string")


@query(
    "l03_anova_f",
    "WITH " + ", ".join(
        f"""g{i} AS (SELECT l_returnflag AS y, count({c}) AS n, sum({c} - m) AS s, sum(({c} - m) * ({c} - m)) AS q FROM lineitem, (SELECT avg({c}) AS m FROM lineitem) GROUP BY l_returnflag)"""
        for i, c in enumerate(NUMERIC)
    ) + " " + " UNION ALL ".join(
        f"SELECT '{c}' AS feature, round(((sum(s*s/n) - sum(s)*sum(s)/sum(n)) / (count(*) - 1)) / ((sum(q) - sum(s*s/n)) / (sum(n) - count(*))), 6) AS f_value FROM g{i}"
        for i, c in enumerate(NUMERIC)
    ),
)
def l03(t: Tables) -> DataFrame:
    scores = choose.anova_f(t.lineitem, NUMERIC, "l_returnflag")
    return scores.withColumn("f_value", F.round("f_value", 6))


def _sql_mi(i: int, c: str) -> str:
    edges = ", ".join(f"CAST({j} AS DOUBLE) / 10" for j in range(1, 10))
    return f"""e{i} AS (SELECT list_distinct(list_transform(quantile_cont(CAST({c} AS DOUBLE), [{edges}]), lambda x: round(x, 9))) AS e FROM lineitem),
j{i} AS (SELECT len(list_filter(e, lambda x: round(CAST({c} AS DOUBLE), 9) > x)) AS x, l_returnflag AS y, count(*) AS n FROM lineitem, e{i} GROUP BY 1, 2),
p{i} AS (SELECT n, CAST(sum(n) OVER () AS DOUBLE) AS a, sum(n) OVER (PARTITION BY x) AS nx, sum(n) OVER (PARTITION BY y) AS ny FROM j{i})"""


@query(
    "l04_mutual_information",
    "WITH " + ", ".join(_sql_mi(i, c) for i, c in enumerate(NUMERIC)) + " " + " UNION ALL ".join(
        f"SELECT '{c}' AS feature, round(greatest(sum(n / a * ln(n * a / (nx * ny))), 0), 6) AS mi FROM p{i}" for i, c in enumerate(NUMERIC)
    ),
)
def l04(t: Tables) -> DataFrame:
    scores = choose.mutual_information(t.lineitem, NUMERIC, "l_returnflag")
    return scores.withColumn("mi", F.round("mi", 6))


def _sql_psi(n: str) -> str:
    shifted = " - ".join(f"1 / (CAST({n} AS DOUBLE) + {j})" for j in range(6))
    series = "ln(z) - 0.5 / z - 1 / (12 * z ** 2) + 1 / (120 * z ** 4) - 1 / (252 * z ** 6) + 1 / (240 * z ** 8)"
    return f"({series.replace('z', f'(CAST({n} AS DOUBLE) + 6)')} - {shifted})"


@query(
    "l04_nearest_information",
    f"""WITH cells AS (UNPIVOT (SELECT l_returnflag AS y, {", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in NUMERIC)} FROM lineitem) ON {", ".join(NUMERIC)} INTO NAME feature VALUE x),
near AS (SELECT feature, y, x, count(*) OVER (PARTITION BY feature, y) AS ny, count(*) OVER (PARTITION BY feature, y, x) AS nxy,
    least({", ".join(
        f"greatest(coalesce(x - lag(x, {j}) OVER o, CAST('inf' AS DOUBLE)), coalesce(lead(x, {3 - j}) OVER o - x, CAST('inf' AS DOUBLE)))" for j in range(4)
    )}) AS d FROM cells WINDOW o AS (PARTITION BY feature, y ORDER BY x)),
upto AS (SELECT feature, x, sum(count(*)) OVER (PARTITION BY feature ORDER BY x) AS c, count(*) AS nx FROM cells GROUP BY feature, x),
points AS (SELECT feature, y, x, d, ny, nxy, count(*) AS n FROM near GROUP BY ALL),
inside AS (SELECT p.*, b.c - coalesce(a.c, 0) AS m FROM points p ASOF JOIN upto b ON p.feature = b.feature AND p.x + p.d > b.x
    ASOF LEFT JOIN upto a ON p.feature = a.feature AND p.x - p.d >= a.x WHERE p.d > 0
  UNION ALL SELECT p.*, u.nx AS m FROM points p JOIN upto u ON p.feature = u.feature AND p.x = u.x WHERE p.d = 0)
SELECT feature, round(greatest({_sql_psi("sum(n)")} + sum(n * ({_sql_psi("CASE WHEN d > 0 THEN 3 ELSE nxy END")} - {_sql_psi("ny")} - {_sql_psi("m")})) / sum(n), 0), 6) AS mi
FROM inside GROUP BY feature""",
)
def l04b(t: Tables) -> DataFrame:
    """Three neighbours, every row of the table."""
    return nearest_information(t.lineitem, NUMERIC, "l_returnflag").withColumn("mi", F.round("mi", 6))


def _selected(t: Tables) -> tuple[choose.FeatureSelectorModel, DataFrame, list[str]]:
    """The three filters on all host features; label: the record type."""
    rows, names = _assembled(t)
    labelled = rows.select("features", (F.crc32(F.coalesce("record_type", F.lit(""))) % 5).alias("label"))
    labelled = hold(labelled)  # the filters and the check read the vectors many times; they are made once
    return choose.FeatureSelector(names=names, max_features=25).fit(labelled), labelled, names


@query("l05_selected_features", "SELECT CAST(i AS INTEGER) AS i, true AS known, true AS varies, true AS scored FROM range(25) t(i)")
def l05(t: Tables) -> DataFrame:
    """Every selected feature has a name, a score, and values that vary in the
    transformed rows. ``l05_selected_scores`` tells which they are."""
    model, labelled, names = _selected(t)
    n, spread = model.transform(labelled).select(F.count("*"), Summarizer.variance(F.col("selected"))).first()
    varies = [float(v) * (n - 1) / n > 0.01 for v in spread.toArray()]
    chosen = [(i, c in names, varies[i], model.get("scores")[c] > 0) for i, c in enumerate(model.feature_names())]
    return t.spark.createDataFrame(chosen, "i int, known boolean, varies boolean, scored boolean")


@query("l05_selected_scores")
def l05b(t: Tables) -> DataFrame:
    model, _, _ = _selected(t)
    chosen = [(i, n, float(model.get("scores")[n])) for i, n in enumerate(model.feature_names())]
    return t.spark.createDataFrame(chosen, "position int, feature string, score double")


@query("d20_feature_groups", "SELECT id, fqdn, record_type, record_data, appid, fqdn_status, cost, hits, scan_text, seen_at, tech_environment FROM inventory", INV)
def d20(t: Tables) -> DataFrame:
    return group_columns(t.inventory, {"business": False})
