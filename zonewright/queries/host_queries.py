"""Host, record-target and scan-tag features."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from zonewright import vocabulary as V
from zonewright.functions import host, record_data, scan_tags
from zonewright.queries.registry import query
from zonewright.queries.tables import Tables, dealt

NUM_DIGITS = r"len(regexp_extract_all(fqdn, '\p{Nd}'))"
SQL_STRUCTURE = {
    "h01_length": {"fqdn_length": "CAST(length(fqdn) AS INTEGER)"},
    "h02_char_counts": {
        "fqdn_num_dots": "CAST(len(regexp_extract_all(fqdn, '[.]')) AS INTEGER)",
        "fqdn_num_hyphens": "CAST(len(regexp_extract_all(fqdn, '-')) AS INTEGER)",
        "fqdn_num_digits": f"CAST({NUM_DIGITS} AS INTEGER)",
    },
    "h03_www": {"fqdn_has_www": "CAST(starts_with(fqdn, 'www.') AS INTEGER)"},
    "h04_label_count": {"fqdn_num_labels": "CAST(len(string_split(fqdn, '.')) AS INTEGER)"},
    "h05_label_lengths": {
        "fqdn_max_label_length": "CAST(list_max(list_transform(string_split(fqdn, '.'), lambda x: length(x))) AS INTEGER)",
        "fqdn_avg_label_length": "round(list_avg(list_transform(string_split(fqdn, '.'), lambda x: length(x))), 6)",
    },
    "h06_numeric_label": {"fqdn_has_numeric_label": r"CAST(regexp_matches(fqdn, '[.]\p{Nd}+[.]') AS INTEGER)"},
    "h07_first_label": {"fqdn_first_label": "string_split(fqdn, '.')[1]"},
}


def _structure(name: str, outputs: dict[str, str]) -> None:
    sql = "SELECT id, " + ", ".join(f"{e} AS {n}" for n, e in outputs.items()) + " FROM inventory"

    @query(name, sql, ("inventory",))
    def _(t: Tables) -> DataFrame:
        columns = host.structure(F.col("fqdn"))
        if "fqdn_avg_label_length" in outputs:
            columns["fqdn_avg_label_length"] = F.round(columns["fqdn_avg_label_length"], 6)
        return t.inventory.select("id", *[columns[n].alias(n) for n in outputs])


for _name, _outputs in SQL_STRUCTURE.items():
    _structure(_name, _outputs)


def _sql_list(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


_EXACT = [r for r in V.PUBLIC_SUFFIXES if r[0] not in "*!"]
_WILD = [r[2:] for r in V.PUBLIC_SUFFIXES if r.startswith("*.")]
_EXCEPT = [r[1:] for r in V.PUBLIC_SUFFIXES if r.startswith("!")]
SQL_IPV4 = host.IPV4


def sql_parts(source: str) -> str:
    """CTEs ending in ``parts(name, suffix, domain, subdomain)`` for the
    distinct names of ``source(name)``: candidates joined to the rule list."""
    return f"""
cleaned AS (SELECT DISTINCT name, rtrim(trim(string_split(list_extract(string_split(regexp_extract(
    regexp_replace(name, '^([A-Za-z0-9+.\\-]+:)?//', ''), '^[^/?#]*', 0), '@'), -1), ':')[1]), '.') AS h
  FROM {source} WHERE name IS NOT NULL),
lists AS (SELECT name, h, string_split(h, '.') AS l FROM cleaned),
candidates AS (SELECT name, i, lower(array_to_string(l[i:], '.')) AS tail, lower(array_to_string(l[i+1:], '.')) AS parent, len(l) AS n
  FROM lists, unnest(range(1, len(l) + 1)) AS r(i)),
starts AS (SELECT name, min(CASE WHEN tail IN ({_sql_list(_EXCEPT)}) THEN i + 1
    WHEN tail IN ({_sql_list(_EXACT)}) OR (i < n AND parent IN ({_sql_list(_WILD)})) THEN i END) AS pos
  FROM candidates GROUP BY name),
parts AS (SELECT name,
    CASE WHEN h = '' OR regexp_matches(h, '{SQL_IPV4}') OR pos IS NULL THEN '' ELSE array_to_string(l[pos:], '.') END AS suffix,
    CASE WHEN h = '' OR regexp_matches(h, '{SQL_IPV4}') THEN h WHEN pos IS NULL THEN l[-1]
      WHEN pos > 1 THEN l[pos-1] ELSE '' END AS domain,
    CASE WHEN h = '' OR regexp_matches(h, '{SQL_IPV4}') THEN ''
      WHEN coalesce(pos, len(l) + 1) <= 2 THEN '' ELSE array_to_string(l[1:coalesce(pos, len(l) + 1) - 2], '.') END AS subdomain
  FROM lists JOIN starts USING (name))"""


@query(
    "h08_suffix_split",
    f"""WITH names AS (SELECT fqdn AS name FROM inventory), {sql_parts('names')}
SELECT id, coalesce(suffix, '') AS fqdn_tld, coalesce(domain, '') AS fqdn_domain, coalesce(subdomain, '') AS fqdn_subdomain
FROM inventory LEFT JOIN parts ON fqdn = name""",
    ("inventory",),
)
def h08(t: Tables) -> DataFrame:
    p = host.with_name_parts(t.inventory, {"fqdn": "p"})
    return p.select("id", F.col("p.suffix").alias("fqdn_tld"), F.col("p.domain").alias("fqdn_domain"), F.col("p.subdomain").alias("fqdn_subdomain"))


@query(
    "h09_subdomain_depth",
    f"""WITH names AS (SELECT fqdn AS name FROM dns_records), {sql_parts('names')}
SELECT id, CAST(CASE WHEN coalesce(subdomain, '') = '' THEN 0 ELSE len(string_split(subdomain, '.')) END AS INTEGER) AS fqdn_subdomain_depth
FROM dns_records LEFT JOIN parts ON fqdn = name""",
    ("dns_records",),
)
def h09(t: Tables) -> DataFrame:
    p = host.with_name_parts(t.dns_records, {"fqdn": "p"})
    return p.select("id", host.depth(F.col("p.subdomain")).alias("fqdn_subdomain_depth"))


@query(
    "h10_naive_split",
    "SELECT id, string_split(fqdn, '.')[-1] AS fqdn_tld, string_split(fqdn, '.')[-2] AS fqdn_domain FROM inventory",
    ("inventory",),
)
def h10(t: Tables) -> DataFrame:
    return t.inventory.select("id", *[c.alias(n) for n, c in host.naive_parts(F.col("fqdn")).items()])


def _regex(words) -> str:
    return "(?i)(" + "|".join(w.replace(".", r"\.") for w in words) + ")"


def sql_flags(tables) -> str:
    return ", ".join(f"CAST(regexp_matches(fqdn, '{_regex(w)}') AS INTEGER) AS fqdn_{n}" for n, w in tables.items())


for _name, _tables in {
    "h11_environment_flags": V.ENVIRONMENT_KEYWORDS,
    "h12_service_flags": V.SERVICE_KEYWORDS,
    "h13_region_flags": V.REGION_KEYWORDS,
    "h14_cloud_flags": V.CLOUD_KEYWORDS,
    "d16_extra_region_flags": V.EXTRA_REGION_KEYWORDS,
}.items():

    @query(_name, f"SELECT id, {sql_flags(_tables)} FROM inventory", ("inventory",))
    def _(t: Tables, tables=_tables) -> DataFrame:
        flags = host.keyword_flags(F.lower("fqdn"), tables)
        return t.inventory.select("id", *[c.alias(n) for n, c in flags.items()])


FLAG_SUMS = [f"fqdn_{n}" for n in V.HOST_KEYWORDS]


@query(
    "h15_host_features_by_owner",
    f"""WITH names AS (SELECT DISTINCT fqdn AS name FROM hosts_big), {sql_parts('names')},
f AS (SELECT owner, length(fqdn) AS len, subdomain, domain, {sql_flags(V.HOST_KEYWORDS)}, {NUM_DIGITS} AS digits
  FROM hosts_big JOIN parts ON fqdn = name)
SELECT owner, count(*) AS hosts, CAST(sum(len) AS BIGINT) AS total_length, CAST(sum(digits) AS BIGINT) AS total_digits,
  CAST(sum(CASE WHEN subdomain = '' THEN 0 ELSE len(string_split(subdomain, '.')) END) AS BIGINT) AS total_depth,
  CAST(count(DISTINCT domain) AS BIGINT) AS domains,
  {', '.join(f'CAST(sum({c}) AS BIGINT) AS {c}' for c in FLAG_SUMS)}
FROM f GROUP BY owner""",
    ("hosts_big",),
)
def h15(t: Tables) -> DataFrame:
    return host.host_features(dealt(t.hosts_big)).groupBy("owner").agg(
        F.count("*").alias("hosts"),
        F.sum("fqdn_length").alias("total_length"),
        F.sum("fqdn_num_digits").alias("total_digits"),
        F.sum("fqdn_subdomain_depth").alias("total_depth"),
        F.count_distinct("fqdn_domain").alias("domains"),
        *[F.sum(c).alias(c) for c in FLAG_SUMS],
    )


def _any(patterns) -> str:
    return "(?i)(" + "|".join(patterns) + ")"


def _match(patterns, name: str) -> str:
    return f"CAST(regexp_matches(coalesce(record_data, ''), '{_any(patterns)}') AS INTEGER) AS {name}"


_CLOUD = [_match(p, f"data_is_{n}") for n, p in V.TARGET_CLOUD_PATTERNS.items()]
_EVERY = _match([p for g in V.TARGET_CLOUD_PATTERNS.values() for p in g], "data_is_cloud")
_INFRA = [_match([p], f"data_has_{n}") for n, p in V.TARGET_INFRA_PATTERNS.items()]
_VALID = f"(coalesce(record_type, '') = 'A' AND regexp_matches(coalesce(record_data, ''), '{SQL_IPV4}'))"
_OCTET = "TRY_CAST(string_split(record_data, '.')[{}] AS INTEGER)"
_ADDRESS = [
    f"CAST(CASE WHEN {_VALID} THEN {_OCTET.format(1)} IN (10, 127) OR ({_OCTET.format(1)} = 172 AND {_OCTET.format(2)} BETWEEN 16 AND 31)"
    f" OR ({_OCTET.format(1)} = 192 AND {_OCTET.format(2)} = 168) ELSE FALSE END AS INTEGER) AS data_is_private_ip",
    f"CAST({_VALID} AS INTEGER) AS data_is_valid_ipv4",
    f"CASE WHEN {_VALID} THEN {_OCTET.format(1)} ELSE 0 END AS data_ip_first_octet",
]
_SHAPE = [
    "CAST(len(regexp_extract_all(coalesce(record_data, ''), '[.]')) + 1 AS INTEGER) AS data_subdomain_depth",
    "CAST(length(coalesce(record_data, '')) AS INTEGER) AS data_length",
]
_MAIL = [
    f"CASE WHEN coalesce(record_type, '') = 'TXT' THEN CAST(regexp_matches(coalesce(record_data, ''), '(?i){p}') AS INTEGER) ELSE 0 END AS data_is_{n}"
    for n, p in V.MAIL_POLICY_PATTERNS.items()
]
_SAME = """CAST(coalesce(fqdn, '') <> '' AND coalesce(record_data, '') <> '' AND hp.domain = rp.domain AS INTEGER) AS data_same_domain"""

for _name, _columns in {
    "r01_target_cloud_flags": _CLOUD,
    "r02_target_any_cloud": [_EVERY],
    "r03_target_infrastructure": _INFRA,
    "r04_r06_target_addresses": _ADDRESS,
    "r07_r08_target_shape": _SHAPE,
    "r10_target_mail_policy": _MAIL,
}.items():

    @query(_name, f"SELECT id, {', '.join(_columns)} FROM inventory", ("inventory",))
    def _(t: Tables, names=tuple(c.rsplit(" AS ", 1)[1] for c in _columns)) -> DataFrame:
        return record_data.record_features(t.inventory).select("id", *names)


@query(
    "r09_same_domain",
    f"""WITH names AS (SELECT fqdn AS name FROM inventory UNION SELECT record_data FROM inventory), {sql_parts('names')}
SELECT id, CAST(coalesce(fqdn, '') <> '' AND coalesce(record_data, '') <> '' AND coalesce(hp.domain, '') = coalesce(rp.domain, '') AS INTEGER) AS data_same_domain
FROM inventory LEFT JOIN parts hp ON fqdn = hp.name LEFT JOIN parts rp ON record_data = rp.name""",
    ("inventory",),
)
def r09(t: Tables) -> DataFrame:
    return record_data.record_features(t.inventory).select("id", "data_same_domain")


@query(
    "r11_record_features",
    f"""WITH names AS (SELECT fqdn AS name FROM dns_records UNION SELECT record_data FROM dns_records), {sql_parts('names')}
SELECT id, {', '.join([*_CLOUD, _EVERY, *_INFRA, *_ADDRESS, *_SHAPE, *_MAIL])},
  CAST(coalesce(fqdn, '') <> '' AND coalesce(record_data, '') <> '' AND coalesce(hp.domain, '') = coalesce(rp.domain, '') AS INTEGER) AS data_same_domain
FROM dns_records LEFT JOIN parts hp ON fqdn = hp.name LEFT JOIN parts rp ON record_data = rp.name""",
    ("dns_records",),
)
def r11(t: Tables) -> DataFrame:
    return record_data.record_features(t.dns_records).select("id", *record_data.FEATURE_NAMES)


@query(
    "d16_target_parts",
    f"""WITH names AS (SELECT record_data AS name FROM inventory), {sql_parts('names')}
SELECT id, coalesce(suffix, '') AS data_target_tld,
  CAST(regexp_matches(lower(coalesce(record_data, '')), '[.](local|internal|corp)$') AS INTEGER) AS data_is_internal
FROM inventory LEFT JOIN parts ON record_data = name""",
    ("inventory",),
)
def d16(t: Tables) -> DataFrame:
    return record_data.target_parts(t.inventory).select("id", "data_target_tld", "data_is_internal")


_TAGS_ARRAY = ", ".join(
    f"CAST(coalesce(len(list_filter(string_split(scan_text, ','), lambda e: contains(lower(e), '{g}'))) > 0, FALSE) AS INTEGER) AS scan_{g}"
    for g in V.SCAN_TAGS
)
_TAGS_TEXT = ", ".join(f"CAST(coalesce(contains(lower(scan_text), '{g}'), FALSE) AS INTEGER) AS scan_{g}" for g in V.SCAN_TAGS)


@query(
    "a01_a02_scan_tags",
    f"SELECT id, {_TAGS_ARRAY}, CAST(coalesce(len(string_split(scan_text, ',')), 0) AS INTEGER) AS scan_count FROM inventory",
    ("inventory",),
)
def a01(t: Tables) -> DataFrame:
    tagged = t.inventory.select("id", F.split("scan_text", ",").alias("scan_result"))
    return scan_tags.scan_features(tagged).drop("scan_result")


@query(
    "a03_scan_text",
    f"SELECT id, {_TAGS_TEXT}, CAST(CASE WHEN scan_text <> '' THEN 1 ELSE 0 END AS INTEGER) AS scan_count FROM inventory",
    ("inventory",),
)
def a03(t: Tables) -> DataFrame:
    return scan_tags.scan_features(t.inventory.select("id", "scan_text"), "scan_text").drop("scan_text")


@query("a04_no_scan_column", f"SELECT id, {', '.join(f'0 AS scan_{g}' for g in V.SCAN_TAGS)}, 0 AS scan_count FROM inventory", ("inventory",))
def a04(t: Tables) -> DataFrame:
    return scan_tags.scan_features(t.inventory.select("id"))


@query(
    "a05_scan_totals",
    f"""WITH f AS (SELECT event_type, {_TAGS_ARRAY.replace('scan_text', 'tags')}, len(string_split(tags, ',')) AS scan_count
  FROM (SELECT event_type, CASE event_type WHEN 'error' THEN 'dns_error,Timeout' WHEN 'click' THEN 'rxdomain' ELSE concat('seen,', event_type) END AS tags FROM events))
SELECT event_type, {', '.join(f'CAST(sum(scan_{g}) AS BIGINT) AS scan_{g}' for g in V.SCAN_TAGS)}, CAST(sum(scan_count) AS BIGINT) AS scan_count
FROM f GROUP BY event_type""",
)
def a05(t: Tables) -> DataFrame:
    tags = F.when(F.col("event_type") == "error", F.array(F.lit("dns_error"), F.lit("Timeout")))
    tags = tags.when(F.col("event_type") == "click", F.array(F.lit("rxdomain")))
    tags = tags.otherwise(F.array(F.lit("seen"), F.col("event_type")))
    out = scan_tags.scan_features(t.events.select("event_type", tags.alias("scan_result")))
    return out.groupBy("event_type").agg(*[F.sum(c).alias(c) for c in scan_tags.feature_names()])
