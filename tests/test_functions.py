"""Hand-computed values for host, record, tag and text expressions."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from zonewright import vocabulary as V
from zonewright.functions import host, record_data, scan_tags, text
from zonewright.functions.numbers import bind, entropy, safe_divide
from zonewright.queries import QUERIES

# fqdn: (length, dots, hyphens, digits, labels, max, avg, numeric label, flags)
HOSTS = {
    "api.dev.example.com": (19, 3, 0, 0, 4, 7, 4.0, 0, {"is_dev", "is_api"}),
    "www.production.myapp.co.uk": (26, 4, 0, 0, 5, 10, 4.4, 0, {"is_prod", "is_web", "region_uk"}),
    "cdn.static.assets.net": (21, 3, 0, 0, 4, 6, 4.5, 0, {"is_cdn"}),
    "mail.corporate.internal.org": (27, 3, 0, 0, 4, 9, 6.0, 0, {"is_email", "is_internal"}),
    "db.mysql.staging.cloud": (22, 3, 0, 0, 4, 7, 4.75, 0, {"is_staging", "is_database"}),
    "a.12.b-c.status.example.com": (27, 5, 1, 2, 6, 7, 22 / 6, 1, {"region_us"}),
    "12.example.com": (14, 2, 0, 2, 3, 7, 4.0, 0, set()),
    "": (0, 0, 0, 0, 1, 0, 0.0, 0, set()),
}


def hosts(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "fqdn string")


def test_host_structure_and_flags(spark):
    rows = {r["fqdn"]: r for r in host.host_features(hosts(spark, *HOSTS)).collect()}
    for name, (*numbers, numeric, flags) in HOSTS.items():
        r = rows[name]
        got = [r[c] for c in host.STRUCTURE_COLUMNS[:4]] + [r["fqdn_num_labels"], r["fqdn_max_label_length"], r["fqdn_avg_label_length"]]
        assert got == pytest.approx(numbers), name
        assert r["fqdn_has_numeric_label"] == numeric
        assert {f for f in V.HOST_KEYWORDS if r[f"fqdn_{f}"]} == flags, name


def test_null_host_gives_null_features(spark):
    r = host.host_features(hosts(spark, None)).first()
    assert r["fqdn_length"] is None and r["fqdn_is_dev"] is None
    assert (r["fqdn_tld"], r["fqdn_domain"], r["fqdn_subdomain"]) == ("", "", "")


def test_digits_beyond_ascii(spark):
    assert host.host_features(hosts(spark, "a٣b")).first()["fqdn_num_digits"] == 1


@pytest.mark.parametrize(
    "name, parts",
    [
        ("www.production.myapp.co.uk", ("co.uk", "myapp", "www.production")),
        ("WWW.Example.COM.", ("COM", "Example", "WWW")),
        ("co.uk", ("co.uk", "", "")),
        ("com", ("com", "", "")),
        ("host", ("", "host", "")),
        ("a.b.nosuchsuffix", ("", "nosuchsuffix", "a.b")),
        ("10.0.0.7", ("", "10.0.0.7", "")),
        ("x.y.z.ck", ("z.ck", "y", "x")),
        ("a.www.ck", ("ck", "www", "a")),
        ("https://user@a.example.co.uk:8443/p?q=1", ("co.uk", "example", "a")),
        ("", ("", "", "")),
        (None, ("", "", "")),
    ],
)
def test_suffix_split(spark, name, parts):
    r = host.with_name_parts(hosts(spark, name), {"fqdn": "p"}).first()["p"]
    assert (r["suffix"], r["domain"], r["subdomain"]) == parts


def test_own_suffix_rules_of_any_number(spark):
    r = host.with_name_parts(hosts(spark, "a.b.c"), {"fqdn": "p"}, ["b.c", *(f"s{i}" for i in range(60_000))]).first()["p"]
    assert (r["suffix"], r["domain"]) == ("b.c", "a")


def test_naive_split(spark):
    r = host.host_features(hosts(spark, "www.production.myapp.co.uk"), rules=None).first()
    assert (r["fqdn_tld"], r["fqdn_domain"]) == ("uk", "co")
    assert "fqdn_subdomain" not in r.asDict()
    assert host.host_features(hosts(spark, "one"), rules=None).first()["fqdn_domain"] is None


def test_word_boundary_option(spark):
    df = hosts(spark, "status.address.com", "us-dr.example.com")
    rows = host.host_features(df, word_boundary=True).orderBy("fqdn").collect()
    assert [(r["fqdn_region_us"], r["fqdn_is_dr"]) for r in rows] == [(0, 0), (1, 1)]


def test_host_feature_methods_are_small_enough_to_be_compiled(spark, capsys):
    """The JVM interprets methods of 8,000 bytes and more for good."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        QUERIES["h15_host_features_by_owner"](spark, "/root/testdata/sf0.001").explain("codegen")
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    sizes = [int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", capsys.readouterr().out)]
    assert sizes and max(sizes) < 8000


def test_absent_column_is_a_no_op(spark):
    df = spark.createDataFrame([("x",)], "other string")
    assert host.host_features(df).columns == ["other"]
    assert record_data.record_features(df).columns == ["other"]


def test_empty_table(spark):
    assert host.host_features(hosts(spark)).count() == 0


@pytest.mark.parametrize(
    "name, valid",
    [("valid.com", True), ("valid.com.", True), ("invalid..fqdn", False), ("-invalid.com", False), ("localhost1", True),
     ("printer.local", True), ("host", False), ("a_b.c1", True), ("a" * 64 + ".com", False), ("x." * 127 + "com", False), ("", False)],
)
def test_host_predicate(spark, name, valid):
    assert hosts(spark, name).select(host.is_valid_host(F.col("fqdn"))).first()[0] is valid


RECORDS = [
    ("A", "10.0.0.1", 1, 1, 10, 4, set()),
    ("A", "8.8.8.8", 1, 0, 8, 4, set()),
    ("A", "172.16.0.1", 1, 1, 172, 4, set()),
    ("A", "172.32.0.1", 1, 0, 172, 4, set()),
    ("A", "192.168.9.9", 1, 1, 192, 4, set()),
    ("A", "127.0.0.1", 1, 1, 127, 4, set()),
    ("A", "256.1.1.1", 0, 0, 0, 4, set()),
    ("A", "010.0.0.1", 0, 0, 0, 4, set()),
    ("A", "2001:db8::1", 0, 0, 0, 1, set()),
    ("CNAME", "10.0.0.1", 0, 0, 0, 4, set()),
    ("CNAME", "lb-alb-123.elb.eu-west-1.amazonaws.com", 0, 0, 0, 5, {"is_aws", "is_cloud", "has_alb"}),
    ("CNAME", "api.gslb-uk1.example.com", 0, 0, 0, 4, {"has_gslb"}),
    ("TXT", "v=DMARC1; p=reject", 0, 0, 0, 1, {"is_dmarc"}),
    ("TXT", "v=spf1 -all", 0, 0, 0, 1, {"is_spf"}),
    ("CNAME", "v=spf1 -all", 0, 0, 0, 1, set()),
    ("A", None, 0, 0, 0, 1, set()),
]


def test_record_features(spark):
    rows = [(i, "h.example.com", k, d) for i, (k, d, *_) in enumerate(RECORDS)]
    df = spark.createDataFrame(rows, "i int, fqdn string, record_type string, record_data string")
    out = record_data.record_features(df).orderBy("i").collect()
    flags = [c for c in record_data.FEATURE_NAMES if c.startswith(("data_is_", "data_has_")) and c not in ("data_is_private_ip", "data_is_valid_ipv4")]
    for r, (_, data, valid, private, first, depth, on) in zip(out, RECORDS):
        got = (r["data_is_valid_ipv4"], r["data_is_private_ip"], r["data_ip_first_octet"], r["data_subdomain_depth"])
        assert got == (valid, private, first, depth), data
        assert {f.removeprefix("data_") for f in flags if r[f]} == on, data
        assert r["data_length"] == len(data or "")


def test_same_domain_and_missing_type_column(spark):
    df = spark.createDataFrame([("a.example.com", "b.example.co.uk"), ("a.example.com", ""), ("a.x.com", "b.y.com")], "fqdn string, data string")
    rows = record_data.record_features(df, "data").collect()
    assert [r["data_same_domain"] for r in rows] == [1, 0, 0]
    assert {r["data_is_spf"] for r in rows} == {0}


def test_scan_tags(spark):
    df = spark.createDataFrame([(["RXDOMAIN", "x-timeout"],), (None,), ([],), ([f"t{i}" for i in range(200)],)], "scan_result array<string>")
    rows = scan_tags.scan_features(df).collect()
    assert [r["scan_count"] for r in rows] == [2, 0, 0, 200]
    assert (rows[0]["scan_rxdomain"], rows[0]["scan_timeout"], rows[0]["scan_dns_error"]) == (1, 1, 0)
    assert set(scan_tags.scan_features(df, "absent").first()[1:]) == {0}


def test_char_ngrams(spark):
    df = spark.createDataFrame([("api a",), ("",)], "t string")
    got = [r[0] for r in df.select(text.char_wb_ngrams(F.col("t"), 2, 4)).collect()]
    expected = [" a", " a", " a ", " ap", " api", "a ", "ap", "api", "api ", "i ", "pi", "pi "]
    assert sorted(got[0]) == sorted(expected) and got[1] == []


def test_description_terms(spark):
    df = spark.createDataFrame([("The Trading<CR>portal, a café_x",)], "t string")
    assert df.select(text.clean_description(F.col("t"))).first()[0] == "the trading portal a café_x"
    terms = df.select(text.description_terms(F.col("t"), ["the"])).first()[0]
    assert terms == ["trading", "portal", "café_x", "trading portal", "portal café_x"]
    flags = df.select(*[c.alias(n) for n, c in text.description_flags(F.lit("Capital")).items()]).first()
    assert flags["appdesc_has_api"] == 1


def test_numbers(spark):
    r = spark.range(1).select(
        safe_divide(F.lit(6), F.lit(4)).alias("a"), safe_divide(F.lit(6), F.lit(0), -1).alias("b"),
        safe_divide(F.lit(None).cast("int"), F.lit(2)).alias("c"),
        entropy(F.array(F.lit(0.5), F.lit(0.5), F.lit(0.0))).alias("d"), bind(F.lit(3), lambda x: x * x).alias("e"),
        text.similarity(F.lit("abcd"), F.lit("abce")).alias("f"), text.similarity(F.lit(None), F.lit("")).alias("g"),
    ).first()
    assert (r["a"], r["b"], r["c"], r["e"], r["f"], r["g"]) == (1.5, -1.0, None, 9, 0.75, 1.0)
    assert r["d"] == pytest.approx(0.693147, abs=1e-6)
