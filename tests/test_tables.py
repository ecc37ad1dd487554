"""Sources, cleaning, splits, quality and quantiles on small tables."""

from __future__ import annotations

import random
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from zonewright.operators import clean, quality, quantiles, ranks, splits
from zonewright.operators.base import hold
from zonewright.sources import readers, sinks

RECORDS = "fqdn string, record_type string, record_data string, appid long"


def test_csv_source(spark, tmp_path):
    path = tmp_path / "records.csv"
    path.write_text("fqdn,record_type,appid,extra\na.com,A,1,x\nN/A,NULL,oops, NULL\nb.com,,0,\n", encoding="utf-8")
    rows = readers.read_csv(spark, str(path)).collect()
    assert [tuple(r) for r in rows] == [("a.com", "A", 1, "x"), (None, None, None, " NULL"), ("b.com", None, 0, None)]
    assert readers.read_csv(spark, str(path), columns=["appid"], n_rows=2).count() == 2
    assert readers.sniff_schema(spark, str(path))["fqdn"].dataType.simpleString() == "string"
    with pytest.raises(Exception):
        readers.read_csv(spark, str(tmp_path / "nothing.csv")).collect()
    source = readers.Source("auto", str(path))
    assert source.load_labeled(spark).count() == 1
    assert source.load_orphans(spark).count() == 1
    assert source.load(spark, ["fqdn"]).columns == ["fqdn"]
    with pytest.raises(ValueError):
        readers.Source("nosuch", str(path)).load(spark)


def test_filter_comes_before_limit(spark):
    df = spark.range(100).withColumn("appid", F.when(F.col("id") < 95, 0).otherwise(1))
    assert readers.labeled(df, limit=3).count() == 3


def test_key_range_chunks_cover_all_rows(spark):
    df = spark.range(2500)
    ranges = readers.key_ranges(df, "id", 1000).orderBy("chunk").collect()
    assert [r["n"] for r in ranges] == [1000, 1000, 500]
    assert readers.chunk_of(df, "id", 1000, 2).count() == 500


def test_digest_ignores_order_and_tells_nulls(spark):
    a = spark.createDataFrame([("x", None), ("y", "z")], "a string, b string")
    b = spark.createDataFrame([("x", "-"), ("y", "z")], "a string, b string")
    digest = lambda df: sinks.table_digest(df).first()["digest"]
    assert digest(a) == digest(a.orderBy(F.desc("a"))) != digest(b)


def test_cleaned_strings(spark):
    df = spark.createDataFrame([("Api.Example.COM.",), ("  www.test.net  ",), ("a.com..",), (" x.y\t",), (None,)], "fqdn string")
    got = [r[0] for r in clean.fill_nulls(clean.normalize_text(df), {}).collect()]
    assert got == ["api.example.com", "www.test.net", "a.com", "x.y", "unknown"]


def test_fill_by_type(spark):
    df = spark.createDataFrame([(1, 1.0, True), (None, 2.0, None), (3, 4.0, None), (4, 10.0, None), (5, None, None)], "i int, x double, b boolean")
    rows = clean.fill_nulls(df, clean.medians(df)).collect()
    assert (rows[1]["i"], rows[4]["x"], rows[4]["b"]) == (-1, 3.0, None)
    empty = df.where("x is null").select("x")
    assert clean.medians(empty) == {"x": 0.0}


COUNTS = {1: 50, 2: 30, 3: 10, 4: 5, 5: 3, 6: 1, 7: 1}


def classes(spark, counts):
    rows = [(f"h{i}.com", c) for c, n in counts.items() for i in range(n)]
    return spark.createDataFrame(rows, "fqdn string, appid long")


def test_group_policy(spark):
    model = clean.RecordCleaner(min_samples=5, rare_threshold=10).fit(classes(spark, COUNTS))
    out = model.transform(classes(spark, COUNTS))
    counts = {r["appid"]: r["count"] for r in out.groupBy("appid").count().collect()}
    assert counts == {1: 50, 2: 30, 3: 10, -999: 5, 5: 3, 6: 1, 7: 1}
    index = {r["label"]: r["idx"] for r in model.index.collect()}
    assert index == {1: 0, 2: 1, 3: 2, -999: 3}
    encoded = clean.encode_labels(out, model.index, "appid")
    assert encoded.where("label is null").count() == 5
    assert clean.encode_labels(out, model.index, "appid", on_unmapped="drop").count() == 95
    assert clean.encode_labels(out, model.index, "appid", on_unmapped="group").where("label = 3").count() == 10
    back = clean.decode_labels(encoded.where("label is not null"), model.index, "label", "again")
    assert back.where("appid <> again").count() == 0


def test_drop_policy_and_orphans(spark):
    df = classes(spark, {1: 10, 2: 5, 3: 3, 4: 1, 5: 1, 0: 4})
    assert clean.RecordCleaner(policy="drop").fit(df).transform(df).count() == 22
    with pytest.raises(ValueError):
        clean.RecordCleaner(policy="oversample").fit(df)


def test_cleaner_reloads(spark, tmp_path):
    df = classes(spark, COUNTS).withColumn("x", F.lit(2.5))
    model = clean.RecordCleaner(exclude_patterns=["^h1[.]"], rare_threshold=10).fit(df)
    model.write().overwrite().save(str(tmp_path / "m"))
    again = clean.RecordCleanerModel.load(str(tmp_path / "m"))
    assert again.settings() == model.settings()
    assert sorted(again.transform(df).collect()) == sorted(model.transform(df).collect())
    assert model.for_scoring().transform(df).count() == df.count()


def test_filters_use_search_and_drop_nulls(spark):
    df = spark.createDataFrame([("a.test.com", "Active"), ("b.com", None), (None, "Active"), ("c.com", "Active")], "fqdn string, fqdn_status string")
    assert [r[0] for r in clean.filter_records(df, ["Active"], ["test"]).collect()] == ["c.com"]


def test_columns_by_role():
    names = ["fqdn", "brand", "num_dots", "mystery"]
    assert clean.columns_by_role(names) == names
    assert clean.columns_by_role(names, categorical=False) == ["fqdn", "num_dots"]
    assert clean.columns_by_role(names, text=False, categorical=False) == ["num_dots"]
    assert clean.feature_columns(["id", "appid", "fqdn"]) == ["fqdn"]


SIZES = {3: (2, 0, 1), 8: (5, 1, 2), 10: (7, 1, 2), 58: (40, 8, 10), 100: (70, 15, 15), 250: (175, 37, 38), 500: (350, 75, 75)}


def sizes(df):
    counts = {r["split"]: r["count"] for r in df.groupBy("split").count().collect()}
    return tuple(counts.get(s, 0) for s in ("train", "val", "test"))


@pytest.mark.parametrize("n", SIZES)
def test_split_sizes(spark, n):
    assert sizes(splits.split(spark.range(n), "id")) == SIZES[n]


def test_stratified_split(spark):
    rows = [(f"{c}-{i}", c) for c, n in ((1, 10), (2, 58), (3, 2), (4, 1), (None, 7)) for i in range(n)]
    df = spark.createDataFrame(rows, "key string, appid int")
    out = splits.split(df, "key", stratify="appid").persist()
    assert out.count() == 78 and out.select("key").distinct().count() == 78
    assert sizes(out.where("appid = 1")) == SIZES[10]
    assert sizes(out.where("appid = 2")) == SIZES[58]
    assert sizes(out.where("appid in (3, 4) or appid is null")) == (10, 0, 0)
    again = splits.split(df.repartition(5), "key", stratify="appid")
    assert sorted(again.select("key", "split").collect()) == sorted(out.select("key", "split").collect())
    with pytest.raises(ValueError):
        splits.split(df, "key", 0.7, 0.2, 0.2)


@pytest.mark.parametrize("digits", [1, 4])
def test_segments_match_a_full_sort(spark, digits):
    """One class holds most rows; every cut, also 0 and beyond the end."""
    df = spark.range(3000).withColumn("g", F.when(F.col("id") % 10 < 7, 0).otherwise(F.col("id") % 10))
    cuts = lambda n: [F.lit(0), F.lit(1), F.floor(n / 3), n - 1, n, n + 5]
    got = {r["id"]: r["segment"] for r in splits.segments(df, "id", cuts, "g", prefix_digits=digits).collect()}
    import hashlib

    groups: dict[int, list] = {}
    for i in range(3000):
        groups.setdefault(0 if i % 10 < 7 else i % 10, []).append((hashlib.md5(f"42|{i}".encode()).hexdigest(), i))
    for members in groups.values():
        n = len(members)
        for rank, (_, i) in enumerate(sorted(members), 1):
            assert got[i] == sum(rank > c for c in (0, 1, n // 3, n - 1, n, n + 5))


def test_folds_are_balanced(spark):
    df = spark.range(103).withColumn("c", F.when(F.col("id") < 60, 0).otherwise(1))
    counts = splits.folds(df, "id", 5, "c").groupBy("c", "fold").count().collect()
    for c in (0, 1):
        sizes_of = [r["count"] for r in counts if r["c"] == c]
        assert len(sizes_of) == 5 and max(sizes_of) - min(sizes_of) <= 1


def test_sampling(spark):
    df = spark.range(50).withColumn("c", F.when(F.col("id") < 47, 0).otherwise(1))
    assert splits.sample(df, "id", 20).count() == 20 and splits.sample(df, "id", 99).count() == 50
    under = {r["c"]: r["count"] for r in splits.undersample(df, "id", "c", 10).groupBy("c").count().collect()}
    assert under == {0: 10, 1: 3}
    over = splits.oversample(df, "id", "c", 20)
    assert {r["c"]: r["count"] for r in over.groupBy("c").count().collect()} == {0: 47, 1: 20}
    assert over.where("c = 1").select("id").distinct().count() == 3


def test_exact_quantiles(spark):
    """Hot values, negatives and nulls."""
    rng = random.Random(7)
    values = [rng.choice([0.0, 0.0, 0.0, rng.gauss(0, 50), float(rng.randint(-5, 5))]) for _ in range(2000)]
    df = spark.createDataFrame([(v, None) for v in values] + [(None, None)], "x double, y double")
    probs = [0.0, 0.01, 0.25, 0.5, 0.731, 0.99, 1.0]
    got = quantiles.exact_quantiles(df, ["x", "y"], probs)
    assert got["x"] == pytest.approx(list(np.quantile(values, probs)))
    assert got["x"][3] == pytest.approx(statistics.median(values))
    assert got["y"] == [None] * 7


@pytest.mark.parametrize("share", [0.0, 0.5, 1.0])
def test_quantiles_take_nan_as_null(spark, share):
    rows = [(float("nan") if i < 100 * share else float(i),) for i in range(100)]
    got = quantiles.exact_quantiles(spark.createDataFrame(rows, "x double"), ["x"], [0.0, 0.75, 1.0])["x"]
    fine = [v for (v,) in rows if v == v]
    assert got == (pytest.approx(list(np.quantile(fine, [0, 0.75, 1]))) if fine else [None] * 3)


def test_positions_by_ranges(spark):
    df = spark.range(4000).select((F.col("id") % 3).alias("g"), F.md5(F.col("id").cast("string")).alias("v"))
    rows = ranks.sorted_positions(df, ["g"], ["v"], "at").collect()
    for g in range(3):
        assert [r["at"] for r in sorted((r for r in rows if r["g"] == g), key=lambda r: r["v"])] == list(range(len([r for r in rows if r["g"] == g])))
    whole = ranks.sorted_positions(df, [], ["v"], "at").orderBy("v").collect()
    assert [r["at"] for r in whole] == list(range(4000))
    assert ranks.sorted_positions(df.where("false"), [], ["v"], "at").count() == 0


def test_hold_gives_the_same_rows(spark):
    assert sorted(r[0] for r in hold(spark.range(30)).collect()) == list(range(30))
    empty = hold(spark.createDataFrame([], "a string, b array<double>"))
    assert empty.count() == 0 and empty.columns == ["a", "b"]


def test_csv_quotes_and_line_breaks(spark, tmp_path):
    (tmp_path / "a.csv").write_text('fqdn,record_type,record_data,appid\na.com,TXT,"v=spf1 ""x"", include:b",5\nb.com,TXT,"one\ntwo",6\n')
    rows = {r["fqdn"]: r for r in readers.read_csv(spark, str(tmp_path)).collect()}
    assert (rows["a.com"]["record_data"], rows["a.com"]["appid"]) == ('v=spf1 "x", include:b', 5)
    assert (rows["b.com"]["record_data"], rows["b.com"]["appid"], len(rows)) == ("one\ntwo", 6, 2)
    sinks_path = str(tmp_path / "out")
    readers.read_csv(spark, str(tmp_path)).write.options(header=True, **readers.QUOTING).csv(sinks_path)
    assert {r["record_data"] for r in readers.read_csv(spark, sinks_path).collect()} == {r["record_data"] for r in rows.values()}
    (tmp_path / "b.csv").write_text("record_type,fqdn,record_data,appid\nA,c.com,1.1.1.1,7\n")
    with pytest.raises(Exception, match="(?i)header"):
        readers.read_csv(spark, str(tmp_path)).collect()


RULES = """// a list in the public notation
shop
bg
uk
nhs.uk
jp
*.kawasaki.jp
!city.kawasaki.jp
// ===BEGIN PRIVATE DOMAINS===
pages.shop   trailing words are ignored
// ===END PRIVATE DOMAINS===
"""


def test_suffix_rules_from_a_file(spark, tmp_path):
    from zonewright.functions import host

    (tmp_path / "rules.dat").write_text(RULES)
    rules = readers.read_suffix_rules(tmp_path / "rules.dat")
    assert rules == ("shop", "bg", "uk", "nhs.uk", "jp", "*.kawasaki.jp", "!city.kawasaki.jp")
    assert "pages.shop" in readers.read_suffix_rules(tmp_path / "rules.dat", private=True)
    hosts = {"www.foo.shop": ("shop", "foo"), "a.b.nhs.uk": ("nhs.uk", "b"), "x.city.kawasaki.jp": ("kawasaki.jp", "city"),
             "x.y.z.kawasaki.jp": ("z.kawasaki.jp", "y"), "www.foo.bg": ("bg", "foo")}
    df = host.with_name_parts(spark.createDataFrame([(h,) for h in hosts], "h string"), {"h": "p"}, rules)
    assert {r["h"]: (r["p"]["suffix"], r["p"]["domain"]) for r in df.collect()} == hosts


def issues(spark, rows, schema=RECORDS, **settings):
    found = quality.all_issues(spark.createDataFrame(rows, schema), **settings).collect()
    return {(r["column_name"], r["issue_type"], r["severity"]): r["amount"] for r in found}


def test_valid_table_has_no_errors(spark):
    rows = [(f"h{i}.example.com", "A", "10.0.0.1", 1) for i in range(5)]
    assert issues(spark, rows) == {}
    assert quality.validate(spark.createDataFrame(rows, RECORDS)).is_valid


def test_issues(spark):
    rows = [("valid.com", "A", None, 1), ("invalid..fqdn", "A", None, -1), ("-invalid.com", "ODD", "x", None), ("-invalid.com", "ODD", "x", None)]
    found = issues(spark, rows, declared={"appid": {"type": "string", "nullable": False}, "record_data": {"min_length": 2}}, max_duplicate_ratio=0.2)
    assert found == {
        ("appid", "null_in_non_nullable", "ERROR"): 2.0,
        ("appid", "invalid_type", "WARNING"): None,
        (None, "high_duplicate_ratio", "WARNING"): 0.25,
        ("record_data", "below_min_length", "WARNING"): 2.0,
        ("fqdn", "duplicate_fqdns", "INFO"): 1.0,
        ("fqdn", "invalid_fqdn_format", "WARNING"): 3.0,
        ("appid", "negative_appid", "WARNING"): 1.0,
        ("appid", "rare_classes", "INFO"): 2.0,
        ("record_type", "unknown_record_types", "INFO"): 1.0,
    }


def test_missing_column_is_an_error(spark):
    found = issues(spark, [("a.com",)], "fqdn string")
    assert {k for k in found if k[2] == "ERROR"} == {(c, "missing_column", "ERROR") for c in ("record_type", "record_data", "appid")}


def test_empty_table(spark):
    df = spark.createDataFrame([], RECORDS)
    assert quality.duplicate_rows(df).first()["duplicate_ratio"] == 0.0
    assert quality.target_summary(df).first()["n_classes"] == 0
    assert quality.column_profile(df).count() == 4


def test_profile(spark):
    df = spark.createDataFrame([("ab", 1.0), ("c", 3.0), (None, None)], "s string, x double")
    rows = {r["column_name"]: r for r in quality.column_profile(df).collect()}
    assert (rows["s"]["n_unique"], rows["s"]["min_length"], rows["s"]["max_length"], rows["s"]["null_count"]) == (3, 1, 2, 1)
    assert (rows["x"]["min"], rows["x"]["max"], rows["x"]["mean"]) == (1.0, 3.0, 2.0)
    assert rows["x"]["std"] == pytest.approx(2**0.5)
    assert quality.column_profile(df, exact=False).count() == 2


@pytest.mark.parametrize("size", [None, 1000, 64, 23, 5])
def test_csv_ranges_agree_with_one_task(spark, tmp_path, size):
    """Fields with quotes, separators and breaks over the borders of ranges of any size."""
    rng = random.Random(11)
    texts = ["", "plain", 'say ""hi""', "a,b", "one\ntwo", "\n", '""', 'x""\n"",y', "\n\n\n" * 9, "é漢🙂", "tail\r\nnext", "long " * 30]
    for name in ("a.csv", "b.csv"):
        rows = ["fqdn,record_type,record_data"]
        for i in range(120):
            fields = [f'"{t}"' if rng.random() < 0.8 or any(c in t for c in '",\n\r') else t for t in rng.choices(texts, k=2)]
            rows.append(",".join([f"{name}{i}", *fields]))
        rows.insert(5, "")
        rows.insert(9, 'stray,in"ner,"quoted ""x"""')
        (tmp_path / name).write_bytes(("\n".join(rows) + ("\n" if name == "a.csv" else "")).encode())
    want = spark.read.options(header=True, multiLine=True, enforceSchema=False, **readers.QUOTING).csv(str(tmp_path))
    want = sorted(map(tuple, want.collect()), key=repr)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        if size:
            spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
        got = readers.read_csv(spark, str(tmp_path), tokens=())
        assert sorted(map(tuple, got.collect()), key=repr) == want and len(want) == 242
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_quoted_lines():
    from zonewright.sources.quoted import ends_open

    for line, closed, opened in [("a,b", False, True), ('a,"b', True, False), ('"a""', True, False), ('""', False, True), ('x"y,z', False, False), ('","', False, True), ('a",b', False, False), ('"a",""', False, False), ("", False, True)]:
        assert (ends_open(line, False, ","), ends_open(line, True, ",")) == (closed, opened), line
