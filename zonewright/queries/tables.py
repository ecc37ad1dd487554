"""The given tables, and record tables derived from them.

The derived tables are SQL text that both engines accept, so a query and its
check start from the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from zonewright.sources import readers

INVENTORY = """
SELECT o_orderkey AS id,
  CASE WHEN o_orderkey % 53 = 0 THEN NULL ELSE concat(
    CASE o_orderstatus WHEN 'F' THEN 'api-' WHEN 'O' THEN 'www.' ELSE 'db-' END,
    CAST(o_custkey % 97 AS VARCHAR(9)), '.',
    CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'dev' WHEN '2' THEN 'Prod'
      WHEN '3' THEN 'uat' WHEN '4' THEN 'stg' ELSE 'eu-dr' END,
    '.svc', CAST(o_custkey % 31 AS VARCHAR(9)),
    CASE o_orderkey % 6 WHEN 0 THEN '.example.co.uk' WHEN 1 THEN '.example.com'
      WHEN 2 THEN '.mysql.example.org' WHEN 3 THEN '.corp.local'
      WHEN 4 THEN '.7.example.ck' ELSE '-.example.net' END) END AS fqdn,
  CASE WHEN o_orderkey % 101 = 0 THEN 'CAA' ELSE
    CASE o_orderkey % 16 WHEN 0 THEN 'A' WHEN 1 THEN 'A' WHEN 2 THEN 'A' WHEN 15 THEN 'A'
      WHEN 7 THEN CASE WHEN o_custkey % 3 = 0 THEN 'CNAME' ELSE 'TXT' END WHEN 8 THEN 'TXT'
      WHEN 9 THEN 'MX' WHEN 11 THEN NULL ELSE 'CNAME' END END AS record_type,
  CASE o_orderkey % 16
    WHEN 0 THEN concat('10.', CAST(o_custkey % 256 AS VARCHAR(9)), '.', CAST(o_orderkey % 256 AS VARCHAR(9)), '.7')
    WHEN 1 THEN concat('172.', CAST(o_custkey % 64 AS VARCHAR(9)), '.0.1')
    WHEN 2 THEN concat('203.0.113.', CAST(o_custkey % 300 AS VARCHAR(9)))
    WHEN 3 THEN concat('lb-alb-', CAST(o_orderkey AS VARCHAR(12)), '.elb.eu-west-1.amazonaws.com')
    WHEN 4 THEN 'd111.cloudfront.net' WHEN 5 THEN 'api.GSLB-uk1.example.com'
    WHEN 6 THEN 'x.wv18.cloud1.example.co.uk' WHEN 7 THEN 'v=DMARC1; p=reject'
    WHEN 8 THEN 'v=spf1 include:_spf.example.com -all' WHEN 9 THEN 'mx1.example.com'
    WHEN 10 THEN 'site.azurewebsites.net' WHEN 11 THEN NULL WHEN 12 THEN 'e1.akamaiedge.net'
    WHEN 13 THEN 'app.run.app' WHEN 14 THEN 'www.cdn.example.org' ELSE '2001:db8::1' END AS record_data,
  CAST(CASE WHEN o_orderkey % 211 = 5 THEN NULL WHEN o_orderkey % 10 = 0 THEN 0
    WHEN o_orderkey % 499 = 1 THEN 9000 + o_orderkey WHEN o_orderkey % 499 = 2 THEN 5000 + o_custkey % 11
    WHEN o_orderkey % 499 = 3 THEN -7
    ELSE 1000 + (o_custkey * 7) % 23 END AS BIGINT) AS appid,
  CASE WHEN o_orderkey % 17 = 3 THEN NULL ELSE concat('brand-', CAST(o_custkey % 13 AS VARCHAR(9))) END AS brand,
  CASE o_orderkey % 3 WHEN 0 THEN 'Active' WHEN 1 THEN 'Demised' END AS fqdn_status,
  o_orderpriority AS tech_environment,
  CASE o_custkey % 5 WHEN 0 THEN 'EMEA' WHEN 1 THEN 'APAC' WHEN 2 THEN 'Americas' ELSE NULL END AS market,
  CASE WHEN o_orderkey % 19 = 0 THEN NULL ELSE o_totalprice END AS cost,
  CAST(CASE WHEN o_orderkey % 23 = 0 THEN NULL ELSE o_custkey % 50 END AS INTEGER) AS hits,
  CASE o_orderkey % 8 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN 'RXDOMAIN' WHEN 3 THEN 'timeout,http_unreachable'
    WHEN 4 THEN 'x-dns_error-y,SSL_CERT_ERROR,other' WHEN 5 THEN 'cname_ip_present'
    WHEN 6 THEN 'no_host_records,https_unreachable' ELSE 'clean' END AS scan_text,
  o_orderdate AS seen_at
FROM {orders}
"""

# Mixed case, padding, closing dots.
INVENTORY_RAW = """
SELECT id, chr(9) || ' ' || upper(fqdn) || CASE id % 4 WHEN 0 THEN '..' WHEN 1 THEN '. ' ELSE '' END || ' ' AS fqdn,
  record_type, '  ' || upper(record_data) || chr(9) AS record_data, appid, brand, fqdn_status, cost, hits
FROM inventory
"""

DNS_RECORDS = """
SELECT h.page_id AS id, h.fqdn,
  CASE h.page_id % 4 WHEN 0 THEN 'A' WHEN 1 THEN 'CNAME' WHEN 2 THEN 'TXT' ELSE 'MX' END AS record_type,
  CASE WHEN h.page_id % 29 = 0 THEN NULL
    WHEN h.page_id % 4 = 0 THEN concat(CASE h.page_id % 3 WHEN 0 THEN '10' WHEN 1 THEN '203' ELSE '172' END, '.', CAST(h.page_id % 40 AS VARCHAR(9)), '.', CAST(h.page_id % 256 AS VARCHAR(9)), '.7')
    WHEN h.page_id % 4 = 1 THEN concat('lb-alb-', CAST(h.page_id AS VARCHAR(9)), '.elb.eu-west-1.amazonaws.com')
    WHEN h.page_id % 4 = 2 THEN CASE WHEN h.page_id % 3 = 0 THEN 'v=DMARC1; p=reject' ELSE 'v=spf1 -all' END
    ELSE concat('mail.', h.fqdn) END AS record_data,
  CAST(CASE WHEN h.page_id % 10 = 0 THEN 0 WHEN h.page_id < 4 THEN 9000 + h.page_id ELSE 1000 + (h.page_id * h.page_id) % 17 END AS BIGINT) AS appid,
  p.p_brand AS brand,
  CASE h.page_id % 3 WHEN 0 THEN 'Active' WHEN 1 THEN 'Demised' END AS fqdn_status
FROM (SELECT page_id, regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1) AS fqdn FROM {pages}) h
  LEFT JOIN {part} p ON p.p_partkey = h.page_id % 100
"""

HOSTS_BIG = """
SELECT l_suppkey AS owner, l_returnflag,
  concat(CASE l_suppkey % 3 WHEN 0 THEN 'api-' WHEN 1 THEN 'www.' ELSE 'db.' END,
    CAST(l_partkey % 997 AS VARCHAR(9)), '.',
    CASE l_linenumber % 3 WHEN 0 THEN 'dev' WHEN 1 THEN 'prod' ELSE 'uat' END,
    '.svc', CAST(l_suppkey AS VARCHAR(9)), '.example.co.uk') AS fqdn
FROM {lineitem}
"""

RAW = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
       "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def dealt(df: DataFrame) -> DataFrame:
    """The rows over the session's number of shuffle partitions, ahead of
    expressions that cost more than moving a narrow row: the given files are
    single row groups, and a scan of one is one task."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


class Tables:
    """The tables of one data folder, as DataFrames."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        if name not in RAW:
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @property
    def inventory(self) -> DataFrame:
        return self.spark.sql(INVENTORY, orders=self.orders)

    @property
    def inventory_raw(self) -> DataFrame:
        return self.spark.sql(INVENTORY_RAW.replace("FROM inventory", "FROM {inventory}"), inventory=self.inventory)

    @property
    def dns_records(self) -> DataFrame:
        return self.spark.sql(DNS_RECORDS, pages=self.pages, part=self.part)

    @property
    def hosts_big(self) -> DataFrame:
        return self.spark.sql(HOSTS_BIG, lineitem=self.lineitem)

    @property
    def probs(self) -> DataFrame:
        """Three members' class probabilities from slices of the embedding."""
        def member(m: int) -> str:
            squares = f"transform(slice(embedding, {1 + 10 * m}, 10), x -> CAST(x AS DOUBLE) * CAST(x AS DOUBLE))"
            return f"transform({squares}, x -> x / aggregate({squares}, 0D, (s, y) -> s + y)) AS m{m + 1}"

        return self.embeddings.selectExpr("vec_id AS id", "label", *[member(m) for m in range(3)])


def _sql_probs() -> str:
    def member(m: int) -> str:
        squares = f"list_transform(embedding[{1 + 10 * m}:{10 + 10 * m}], lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE))"
        return f"list_transform({squares}, lambda x: x / list_sum({squares})) AS m{m + 1}"

    return f"SELECT vec_id AS id, label, {', '.join(member(m) for m in range(3))} FROM embeddings"


CTES = {
    "inventory": INVENTORY.replace("{orders}", "orders"),
    "inventory_raw": INVENTORY_RAW,
    "dns_records": DNS_RECORDS.replace("{pages}", "pages").replace("{part}", "part"),
    "hosts_big": HOSTS_BIG.replace("{lineitem}", "lineitem"),
    "probs": _sql_probs(),
}


def with_ctes(sql: str, *names: str) -> str:
    """Prefix the named derived tables to a check query."""
    if "inventory_raw" in names and "inventory" not in names:
        names = ("inventory", *names)
    heads = ", ".join(f"{n} AS ({CTES[n].strip()})" for n in names)
    body = sql.strip()
    if body[:5].upper() == "WITH ":
        return f"WITH {heads}, {body[5:]}"
    return f"WITH {heads} {body}"
