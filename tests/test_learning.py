"""Encoders, TF-IDF, selection, voting, metrics, models and whole jobs."""

from __future__ import annotations

import math
import re

import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.sql import functions as F
from pyspark.sql import types as T

from zonewright.operators import choose, encode, evaluate, score, vectorize, voting
from zonewright.operators.splits import hash_order
from zonewright.plans import jobs
from zonewright.plans import members as M
from zonewright.plans.features import FeaturePlan, FeatureVector, feature_names, group_columns
from zonewright.sources import readers, sinks
from zonewright.streaming import arrivals

VALUES = [("A", 1.0), ("CNAME", 2.0), ("A", 3.0), ("MX", 4.0), ("A", 5.0), (None, 6.0)]


def column(rows, name):
    return [r[name] for r in rows]


@pytest.mark.parametrize(
    "strategy, expected",
    [
        ("label", [0, 1, 0, 2, 0, 3]),
        ("frequency", [3 / 6, 1 / 6, 3 / 6, 1 / 6, 3 / 6, 0]),
        ("target", [3.384615, 3.363636, 3.384615, 3.545455, 3.384615, 3.5]),
    ],
)
def test_encoders(spark, strategy, expected):
    df = spark.createDataFrame(VALUES, "c string, y double").coalesce(1)
    model = encode.CategoryEncoder(columns=["c", "absent"], strategy=strategy, target="y").fit(df)
    name = model.output_columns()[0]
    out = {(r["c"], r["y"]): r[name] for r in model.transform(df).collect()}
    assert [out[v] for v in VALUES] == pytest.approx(expected, abs=1e-6)
    unseen = spark.createDataFrame([("NEW", 0.0)], "c string, y double")
    assert model.transform(unseen).first()[name] == pytest.approx(expected[-1], abs=1e-6)


def test_one_hot_and_unknown_strategy(spark, tmp_path):
    df = spark.createDataFrame(VALUES, "c string, y double")
    model = encode.CategoryEncoder(columns=["c"], strategy="onehot").fit(df)
    model.write().overwrite().save(str(tmp_path / "e"))
    again = encode.CategoryEncoderModel.load(str(tmp_path / "e"))
    rows = {r["c"]: r["c_onehot"].toArray().tolist() for r in again.transform(df).collect()}
    assert rows == {"A": [1, 0, 0], "CNAME": [0, 1, 0], "MX": [0, 0, 1], None: [0, 0, 0]}
    with pytest.raises(ValueError):
        encode.CategoryEncoder(columns=["c"], strategy="other").fit(df)
    with pytest.raises(TypeError):
        encode.CategoryEncoder(colums=["c"])


def test_scaling(spark):
    df = spark.createDataFrame([(1.0, 5.0), (2.0, 5.0), (None, 5.0), (6.0, 5.0)], "x double, k double")
    out = encode.NumericScaler(columns=["x", "k"]).fit(df).transform(df).collect()
    std = math.sqrt(((1 - 3) ** 2 + (2 - 3) ** 2 + (6 - 3) ** 2) / 3)
    assert sorted(column(out, "x_scaled")) == pytest.approx(sorted([(v - 3) / std for v in (1, 2, 0, 6)]))
    assert set(column(out, "k_scaled")) == {0.0}
    with pytest.raises(ValueError):
        encode.NumericScaler(columns=["x"], method="log").fit(df)


def weights_of(model, df):
    return {(r["id"], r["term"]): r["weight"] for r in model.weights(df).collect()}


def test_tfidf(spark, tmp_path):
    rows = [(1, "ab cd ab"), (2, "ab ef"), (3, "ef")]
    df = spark.createDataFrame(rows, "id int, t string")
    model = vectorize.TermWeights(input="t", output="v", analyzer="description", low=1, high=1, min_df=1, max_df=1.0).fit(df)
    assert model.get("vocabulary") == ["ab", "cd", "ef"]
    assert model.get("idf") == pytest.approx([1.287682, 1.693147, 1.287682], abs=1e-6)
    got = weights_of(model, df)
    assert got[1, "ab"] == pytest.approx(0.789807, abs=1e-6) and got[1, "cd"] == pytest.approx(0.613356, abs=1e-6)
    model.write().overwrite().save(str(tmp_path / "t"))
    again = vectorize.TermWeightsModel.load(str(tmp_path / "t"))
    dense = {r["id"]: r["v"] for r in again.transform(df).select("id", vector_to_array("v").alias("v")).collect()}
    assert dense[1] == pytest.approx([0.789807, 0.613356, 0], abs=1e-6) and dense[3] == [0, 0, 1]
    assert again.feature_names() == ["t_tfidf_ab", "t_tfidf_cd", "t_tfidf_ef"]


def test_document_frequency_counts_rows_not_occurrences(spark):
    df = spark.createDataFrame([(["a", "a", "b"],), (["a"],), ([],)], "g array<string>")
    got = {r["term"]: (r["total"], r["df"]) for r in vectorize.term_table(df, "g").collect()}
    assert got == {"a": (3, 2), "b": (1, 1)}


@pytest.mark.parametrize("analyzer, low, high", [("char_wb", 2, 4), ("char_wb", 3, 3), ("host_word", 1, 2), ("host_word", 2, 3), ("description", 1, 2)])
def test_terms_are_counted_without_a_row_each(spark, monkeypatch, analyzer, low, high):
    from zonewright.functions import text as X

    texts = ["A.b-c.dev", "a", "", None, "Ünï-x.ex\u00a0ample  \t y.dev.dev", "The cat, the_CAT<CR>sat on 3 mats", "api-7.svc\U0001f600x", "a"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    stop = ["the", "on"]
    expected = {
        "char_wb": X.char_wb_ngrams(X.clean_host_text(F.col("t")), low, high),
        "host_word": X.host_word_terms(F.col("t"), low, high),
        "description": X.description_terms(F.col("t"), stop, low, high),
    }[analyzer]
    monkeypatch.setattr(vectorize, "COUNTED_TERMS", 3)
    found, n = vectorize.TermWeights(input="t", analyzer=analyzer, low=low, high=high, stop_words=stop, min_df=1, max_df=1.0, max_features=1000).vocabulary(df)
    one_by_one = vectorize.term_table(df.select(expected.alias("g")), "g")
    assert n == len(texts) and sorted(found.collect()) == sorted(one_by_one.collect())
    assert "explode" not in found._jdf.queryExecution().optimizedPlan().toString()


def matrix(spark, columns):
    rows = list(zip(*columns))
    names = [f"c{i}" for i in range(len(columns))]
    return spark.createDataFrame([tuple(map(float, r)) for r in rows], ", ".join(f"{n} double" for n in names)).withColumn(
        "features", array_to_vector(F.array(*names))
    )


def test_selection_filters(spark):
    rng = np.random.default_rng(0)
    a = rng.normal(size=200)
    columns = [a, 2 * a, np.full(200, 3.0), rng.normal(size=200), a + rng.normal(size=200) * 0.01, (a > 0).astype(float)]
    df = matrix(spark, columns)
    model = choose.FeatureSelector(names=list("abcdef")).fit(df)
    assert model.feature_names() == ["b", "d", "f"]  # widest of a, b, e; c is constant
    labelled = df.withColumn("label", (F.col("c3") > 0).cast("double"))
    for method in ("mutual_info", "f_classif"):
        best = choose.FeatureSelector(names=list("abcdef"), max_features=1, method=method).fit(labelled)
        assert best.feature_names() == ["d"] and list(best.get("scores")) == ["d"]


def test_anova_agrees_between_columns_and_vectors(spark):
    rng = np.random.default_rng(1)
    y = rng.integers(0, 3, 300)
    columns = [y + rng.normal(size=300), np.where(rng.random(300) < 0.7, 0, rng.normal(size=300)), 100 + y * 0.1 + rng.normal(size=300)]
    df = matrix(spark, [*columns, y])
    got = {r["i"]: r["score"] for r in choose.vector_anova(df, "features", "c3", [0, 1, 2]).collect()}
    want = {r["feature"]: r["f_value"] for r in choose.anova_f(df, ["c0", "c1", "c2"], "c3").collect()}
    for i, x in enumerate(columns):
        groups = [x[y == k] for k in range(3)]
        between = sum(len(g) * (g.mean() - x.mean()) ** 2 for g in groups) / 2
        within = sum(((g - g.mean()) ** 2).sum() for g in groups) / 297
        assert got[i] == pytest.approx(between / within) and want[f"c{i}"] == pytest.approx(between / within)


def test_voting(spark):
    df = spark.createDataFrame([([0.5, 0.3, 0.2], [0.1, 0.8, 0.1])], "a array<double>, b array<double>")
    weights = {"a": 3, "b": 2}
    p = voting.soft_vote(voting.member_arrays(["a", "b"]), weights)
    picks = {m: voting.predicted_class(F.col(m)) for m in weights}
    r = df.select(p.alias("p"), voting.predicted_class(p).alias("soft"), voting.hard_vote(picks, weights).alias("hard"),
                  voting.top_classes(F.array(*map(F.lit, [0.34, 0.5, 0.16, 0.5])), 3).alias("top")).first()
    assert r["p"] == pytest.approx([0.34, 0.5, 0.16])
    assert (r["soft"], r["hard"], [x["class_idx"] for x in r["top"]]) == (1, 0, [1, 3, 0])
    assert voting.normalized_weights({"a": 0, "b": 0}) == {"a": 0, "b": 0}


def test_metrics(spark):
    df = spark.createDataFrame(list(zip([0, 0, 1, 1, 2, 2], [0, 1, 1, 1, 2, 0])), "label int, prediction int")
    m = M.metrics(df)
    expected = {"accuracy": 0.666667, "precision_macro": 0.722222, "recall_macro": 0.666667, "f1_macro": 0.655556, "f1_weighted": 0.655556}
    assert m == pytest.approx(expected, abs=1e-6)
    pairs = evaluate.confusion_pairs(evaluate.confusion(df)).collect()
    assert {tuple(r) for r in pairs} == {(0, 1, 1), (2, 0, 1)}


def test_unseen_predicted_class_counts_in_the_macro_mean(spark):
    df = spark.createDataFrame([(0, 0), (0, 9)], "label int, prediction int")
    assert M.metrics(df)["f1_macro"] == pytest.approx((2 / 3) / 2)


def test_probability_metrics(spark):
    df = spark.createDataFrame([(0, [0.4, 0.4, 0.2]), (1, [0.4, 0.4, 0.2]), (2, [1.0, 0.0, 0.0])], "label int, probs array<double>")
    r = evaluate.probability_metrics(df, 3).first()
    assert r["top_3_accuracy"] == 1.0 and r["top_5_accuracy"] == 0.0
    eps = evaluate.EPSILON
    assert r["log_loss"] == pytest.approx(-(2 * math.log(0.4) + math.log(eps)) / 3)
    ranks = df.select(evaluate.true_rank(F.col("probs"), F.col("label"))).collect()
    assert [x[0] for x in ranks] == [1, 2, 3]


def test_fallback_recounts_uncertain_rows(spark):
    df = spark.createDataFrame([("a", [0.5, 0.5]), ("b", [0.9, 0.1])], "fqdn string, probs array<double>")
    out = score.with_fallback(score.predictions(df, [70, 80], threshold=0.3), 0.6)
    rows = {r["fqdn"]: r for r in out.collect()}
    assert (rows["a"]["predicted_appid"], rows["a"]["is_uncertain"]) == (-1, True)
    assert (rows["b"]["predicted_appid"], rows["b"]["is_uncertain"]) == (70, False)
    assert score.summary(out).first()["uncertain_count"] == 1
    assert score.wide(out, 3).columns[-2:] == ["top_3_appid", "top_3_prob"]


def test_nearest_centroid(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0], 5), (2, [0.0, 2.0], 6), (3, [1.0, 1.0], None), (4, None, None)], "id int, v array<double>, c int")
    out = {r["id"]: (r["nearest"], r["similarity"]) for r in score.nearest_centroid(df, "v", score.centroids(df, "v", "c")).collect()}
    assert out[1][0] == 5 and out[2][0] == 6 and out[3][0] is None
    assert out[3][1] == pytest.approx(2**-0.5)


def records(n=500):
    """Five host templates, ten owners."""
    templates = ["api.{o}.{b}.com", "www.{b}.{o}.co.uk", "cdn.{o}.{b}.net", "mail.{b}.internal.org", "db.{o}.{b}.cloud"]
    options = [["dev", "staging", "prod"], ["uk", "us", "eu"], ["static", "media", "assets"], ["x"], ["mysql", "postgres", "mongo"]]
    brands = ["alder", "birch", "cedar", "dogwood", "elm"]
    for i in range(n):
        host = templates[i % 5].format(o=options[i % 5][i % len(options[i % 5])], b=brands[i % 5])
        yield (i, host, 1000 + i % 10, ("A", "CNAME", "MX")[i % 3], brands[i % 5], f"192.168.{i % 256}.{i % 256}", [] if i % 2 else ["timeout"], "trading portal" if i % 3 else "loan risk portal")


SCHEMA = "id long, fqdn string, appid long, record_type string, brand string, record_data string, scan_result array<string>, appdesc string"
FEATURES = {"categorical_columns": ["record_type", "brand"], "tfidf_max_features": 100}
MEMBERS = [{"type": "forest", "weight": 0.5, "options": {"numTrees": 15, "maxDepth": 8}}, {"type": "logistic", "weight": 0.5, "options": {"maxIter": 30}}]


@pytest.fixture(scope="module")
def owned(spark):
    return spark.createDataFrame(list(records()), SCHEMA)


@pytest.fixture(scope="module")
def trained(spark, owned, tmp_path_factory):
    store = sinks.ModelStore(spark, str(tmp_path_factory.mktemp("models")))
    result = jobs.train(owned, "id", features=FEATURES, ensemble={"members": MEMBERS}, calibrate=True, store=store)
    return result, store


def test_feature_plan(spark, owned):
    df = owned.withColumn("hits", F.when(F.col("id") > 5, F.col("id").cast("double")))
    plan = FeaturePlan(**FEATURES, numerical_columns=["hits"]).fit(df)
    names = feature_names(plan)
    out = plan.transform(df.unionByName(df.limit(1).withColumn("fqdn", F.lit(None).cast("string"))))
    arrays = [r[0] for r in out.select(vector_to_array("features")).collect()]
    assert {len(a) for a in arrays} == {len(names)} and len(set(names)) == len(names)
    assert np.isfinite(np.array(arrays)).all()
    assert names[0] == "fqdn_length" and names[10] == "fqdn_is_admin" and names[-3:] == ["record_type", "brand", "hits"]
    assert "scan_count" in names and "appdesc_has_trading" in names and "data_same_domain" in names
    assert "features" in out.columns and not [c for c in out.columns if c.startswith("__")]
    hot = FeaturePlan(**FEATURES, categorical_strategies={"brand": "onehot"}).fit(owned)
    assert feature_names(hot)[-5:] == [f"brand_onehot_{i}" for i in range(5)]
    assert {len(r[0]) for r in hot.transform(owned).select(vector_to_array("features")).collect()} == {len(feature_names(hot))}
    small = FeaturePlan(**FEATURES, importance_threshold=0.01, label="appid").fit(df.withColumn("appid", F.col("appid") - 1000))
    assert 0 < len(feature_names(small)) < len(names)


def test_group_toggles(owned):
    assert "brand" not in group_columns(owned, {"business": False}).columns


def test_training_reaches_the_floor(trained):
    result, _ = trained
    numbers = {r["metric"]: r["value"] for r in result.metrics.collect()}
    assert numbers["accuracy"] > 0.35 and 0 <= numbers["log_loss"] < 20
    assert result.unmapped_rows == 0
    total = result.report["importance"].agg(F.sum("importance")).first()[0]
    assert total == pytest.approx(1.0)


def test_stored_model_scores_the_same(spark, owned, trained):
    result, store = trained
    model = store.load(jobs.MODEL_NAME)
    columns = ["id", "predicted_appid", "confidence", "is_uncertain"]
    columns.append("calibrated_confidence")
    a = result.model.transform(owned).select(*columns).orderBy("id").collect()
    b = model.transform(owned.repartition(3)).select(*columns).orderBy("id").collect()
    assert a == b and len(a) == 500
    assert all(0 <= r["confidence"] <= 1 and 0 <= r["calibrated_confidence"] <= 1 for r in a)
    rising = sorted((r["confidence"], r["calibrated_confidence"]) for r in a)
    assert [c for _, c in rising] == sorted(c for _, c in rising)
    sums = result.model.transform(owned).select(F.aggregate("probs", F.lit(0.0), lambda s, x: s + x).alias("s"))
    assert sums.where("abs(s - 1) > 1e-5").count() == 0


def test_single_record_and_evaluation(spark, owned, trained):
    result, _ = trained
    one = jobs.predict_one(result.model, spark, "api.dev.alder.com", "A", "10.0.0.1", brand="alder")
    assert len(one["top_k"]) == 5 and one["predicted_appid"] in range(1000, 1010)
    report = jobs.evaluate_stored(result.model, owned)
    assert report["per_class"].agg(F.sum("n_samples")).first()[0] == 500


def test_files_and_report(spark, owned, trained, tmp_path):
    result, _ = trained
    summary = jobs.predict_file(result.model, owned, str(tmp_path / "out"), keep=("id", "fqdn")).first()
    assert summary["total_count"] == 500
    assert spark.read.option("header", True).csv(str(tmp_path / "out")).columns[-2:] == ["top_5_appid", "top_5_prob"]
    jobs.save_report(result.report, str(tmp_path / "report"))
    assert 0 < spark.read.json(str(tmp_path / "report" / "top_features")).count() <= 50


def test_scoring_as_files_arrive(spark, trained, tmp_path):
    result, _ = trained
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.csv").write_text("fqdn,record_type,record_data,appid\nx.api.alder.com,A,10.0.0.1,0\nNULL,N/A,,0\n")
    schema = readers.T.StructType([f for f in readers.RECORD_SCHEMA if f.name in ("fqdn", "record_type", "record_data", "appid")])

    def run():
        stream = arrivals.arriving_records(spark, str(folder), schema)
        arrivals.score_arrivals(result.model, stream, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
        return spark.read.parquet(str(tmp_path / "out")).count()

    assert run() == 2
    (folder / "b.csv").write_text("fqdn,record_type,record_data,appid\nwww.birch.uk.co.uk,A,10.0.0.2,0\n")
    assert run() == 3 and run() == 3


def test_store_versions(spark, trained):
    _, store = trained
    model = store.load(jobs.MODEL_NAME)
    small = PipelineModel([model.stages[0]])
    assert store.save(small, "tiny") == "1.0.0" and store.save(small, "tiny") == "1.0.1"
    assert store.versions("tiny") == {"tiny": ["1.0.0", "1.0.1"]} and store.latest("tiny") == "1.0.1"
    assert store.delete("tiny", "1.0.1") and not store.delete("tiny", "1.0.1")
    assert store.latest("tiny") == "1.0.0" and store.latest("none") is None
    hashed = sinks.ModelStore(spark, store.folder, "hash")
    assert len(hashed.save(small, "hashed", metadata={"a": 1})) == 12
    with pytest.raises(ValueError):
        store.load("none")
    with pytest.raises(FileNotFoundError):
        store.load("tiny", "9.9.9")


def test_unknown_model_name():
    with pytest.raises(ValueError):
        M.create_member("nosuch")


def test_boosted_member_and_missing_class(spark):
    rng = np.random.default_rng(3)
    y = rng.integers(0, 3, 150)
    df = matrix(spark, [y + rng.normal(size=150) * 0.2, rng.normal(size=150)]).withColumn("k", F.monotonically_increasing_id())
    df = spark.createDataFrame([(float(a),) for a in y], "label double").withColumn("k", F.monotonically_increasing_id()).join(df, "k")
    model = M.create_member("xgboost", iterations=4, max_depth=3, n_classes=3).fit(df)
    out = model.transform(df).select("label", "probs").collect()
    assert np.mean([int(r["label"]) == int(np.argmax(r["probs"])) for r in out]) > 0.8
    assert all(sum(r["probs"]) == pytest.approx(1) for r in out)
    for kind in ("forest", "logistic"):
        wider = M.create_member(kind, n_classes=5).fit(df)
        assert len(wider.transform(df).first()["probs"]) == 5
        assert sum(wider.importances()) == pytest.approx(1)


def test_search_samples_within_its_space():
    a, b = M.sample_parameters("boosted", 5), M.sample_parameters("boosted", 5)
    assert a == b and all(0.01 <= p["learning_rate"] <= 0.3 and 3 <= p["max_depth"] <= 12 for p in a)
    with pytest.raises(ValueError):
        M.sample_parameters("bayes", 1)


def test_selection_scores_with_absent_classes(spark):
    """Classes without any non-zero element, against the plain formulas."""
    rng = np.random.default_rng(3)
    y = np.repeat(np.arange(8), 25)
    x = np.where((y < 3) & (rng.random(200) < 0.6), rng.integers(1, 4, 200), 0).astype(float)
    df = matrix(spark, [x, rng.normal(size=200), y])
    got = {r["i"]: r["score"] for r in choose.vector_anova(df, "features", "c2", [0, 1]).collect()}
    groups = [x[y == k] for k in range(8)]
    between = sum(len(g) * (g.mean() - x.mean()) ** 2 for g in groups) / 7
    within = sum(((g - g.mean()) ** 2).sum() for g in groups) / 192
    assert got[0] == pytest.approx(between / within)
    info = {r["i"]: r["score"] for r in choose.vector_information(df, "features", "c2", [0]).collect()}
    want = 0.0
    for value in np.unique(x):
        for k in range(8):
            n = ((x == value) & (y == k)).sum()
            want += n / 200 * np.log(n * 200 / ((x == value).sum() * 25)) if n else 0
    assert info[0] == pytest.approx(want)


def test_correlation_by_blocks(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(80, 4))
    columns = [base[:, i % 4] * (1 + i / 10) + rng.normal(size=80) * (0.01 if i % 3 else 2) for i in range(12)]
    df = matrix(spark, columns)
    whole = choose.strong_pairs(df, "features", np.arange(12), 0.9)
    assert whole == choose.strong_pairs(df, "features", np.arange(12), 0.9, block=5) and whole
    c = np.abs(np.corrcoef(np.array(columns))) > 0.9
    assert whole == {i: [j for j in range(i + 1, 12) if c[i, j]] for i in range(12) if c[i, i + 1 :].any()}


def test_centroids_without_direction(spark):
    table = spark.createDataFrame([(1, [0.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 1.0]), (4, [2.0, 0.0])], "label int, centroid array<double>")
    df = spark.createDataFrame([(1, [3.0, 0.1]), (2, [0.0, 2.0]), (3, [0.0, 0.0]), (4, None)], "id int, v array<double>")
    for block in (1, 2, 100):
        got = {r["id"]: r["nearest"] for r in score.nearest_centroid(df, "v", table, block=block).collect()}
        assert got == {1: 2, 2: 3, 3: None, 4: None}
    assert {r["nearest"] for r in score.nearest_centroid(df, "v", table.where("label = 1")).collect()} == {None}


def test_zero_weights_give_nulls(spark):
    df = spark.createDataFrame([([0.5, 0.5],)], "a array<double>")
    assert df.select(voting.soft_vote({"a": F.col("a")}, {"a": 0.0}).alias("p")).first()["p"] == [None, None]


def test_hash_versions_follow_the_content(spark, tmp_path):
    store = sinks.ModelStore(spark, str(tmp_path / "m"), "hash")
    df = spark.createDataFrame([(1.0,), (2.0,), (6.0,)], "x double")
    fit = lambda rows, **more: PipelineModel([encode.NumericScaler(columns=["x"], **more).fit(rows)])
    first = store.save(fit(df), "s")
    assert store.save(fit(df), "s") == first
    other = store.save(fit(df, method="minmax"), "s")
    third = store.save(fit(df.where("x < 5")), "s")
    assert len({first, other, third}) == 3 and set(store.versions("s")["s"]) == {first, other, third}
    stamped = sinks.ModelStore(spark, str(tmp_path / "t"), "timestamp")
    assert stamped.save(fit(df), "s") != stamped.save(fit(df), "s")
    plain = sinks.ModelStore(spark, str(tmp_path / "p"))
    plain.save(fit(df), "s", "1.0.0")
    with pytest.raises(FileExistsError):
        plain.save(fit(df), "s", "1.0.0")


def test_every_class_gets_a_booster(spark):
    rows = [(float(i % 60), float(i % 60), float(i)) for i in range(240)]
    df = matrix(spark, [list(c) for c in zip(*rows)]).withColumnRenamed("c0", "label")
    model = M.create_member("xgboost", maxIter=1, maxDepth=1, colsample_bytree=1.0, min_child_weight=1).fit(df)
    assert len(model.children) == 60 and all(n.startswith("class_") for n in model.children)
    with pytest.raises(ValueError, match="reg_alpha"):
        M.create_member("xgboost", reg_alpha=0.1).fit(df)


def test_class_weights_by_table_and_flag(spark):
    rng = np.random.default_rng(7)
    y = (rng.random(300) < 0.1).astype(float)
    df = matrix(spark, [y * 0.5 + rng.normal(size=300), y]).withColumnRenamed("c1", "label")
    df = df.withColumn("features", array_to_vector(F.array("c0")))
    share = lambda **more: M.create_member("logistic", **more).fit(df).transform(df).agg(F.avg(F.get("probs", F.lit(1)))).first()[0]
    plain, balanced = share(), share(class_weight="balanced")
    assert balanced > plain + 0.1
    assert share(is_unbalance=True) == pytest.approx(balanced)
    assert share(class_weight={0: 1.0, 1: 9.0}) > plain + 0.1 and share(class_weight={0: 1.0}) == pytest.approx(plain, abs=1e-6)


def test_stopping_round():
    assert M.stopping_round([5, 4, 3, 3.5, 3.4, 2.0], 2) == 3
    assert M.stopping_round([5, 4, 3, 3.5, 3.4, 2.0], 5) == 6


def separable(spark, n=400, classes=4, seed=5):
    """Classes around their own centres, a quarter of the rows for validation."""
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(classes, 6)) * 2
    rows = [(i, float(i % classes), bool(i % 16 < 4), [float(x) for x in centres[i % classes] + rng.normal(size=6)]) for i in range(n)]
    return spark.createDataFrame(rows, "id long, label double, is_val boolean, x array<double>").select("id", "label", "is_val", array_to_vector("x").alias("features"))


@pytest.mark.parametrize(("kind", "options"), [("xgboost", {"maxIter": 10, "maxDepth": 4}), ("lightgbm", {"numTrees": 30}), ("catboost", {})])
def test_members_reach_the_floor(spark, kind, options):
    rows = separable(spark)
    model = M.create_member(kind, validation="is_val", n_classes=4, **options).fit(rows)
    scored = model.transform(rows.where("is_val")).select("label", "probs").collect()
    assert all(sum(r["probs"]) == pytest.approx(1, abs=1e-9) and len(r["probs"]) == 4 for r in scored)
    assert np.mean([int(np.argmax(r["probs"])) == r["label"] for r in scored]) > 0.7


def test_rounds_grow_until_the_best_is_seen(spark):
    rows = separable(spark, 200, 2).withColumn("label", F.when(F.pmod(F.xxhash64("id"), F.lit(10)) < 2, 1 - F.col("label")).otherwise(F.col("label")))
    member = M.create_member("boosted", maxDepth=3, validation="is_val", early_stopping_rounds=3)
    model = member.fit(rows)
    for name, losses in model.get("losses").items():
        best = model.get("best_iterations")[name]
        assert best == M.stopping_round(losses, 3) and len(losses) - best >= 3 and len(losses) < 500
        assert min(losses[: best + 3]) == losses[best - 1]


def test_one_fit_tells_the_best_round(spark, monkeypatch, tmp_path):
    """Rounds up to the best one are taken from the fit that showed it: losses, trees and
    probabilities are those of a fit of just as many rounds, and nothing is fitted twice."""
    from pyspark.ml.classification import GBTClassificationModel

    rows = separable(spark, 200, 2).withColumn("label", F.when(F.pmod(F.xxhash64("id"), F.lit(10)) < 2, 1 - F.col("label")).otherwise(F.col("label")))
    fits, fit = [], M.GBTClassifier.fit
    monkeypatch.setattr(M.GBTClassifier, "fit", lambda self, df: (fits.append(self.getMaxIter()), fit(self, df))[1])
    member = M.create_member("boosted", maxDepth=3, stepSize=0.2, validation="is_val", early_stopping_rounds=3)
    model = member.fit(rows)
    assert fits == [20, 20] and max(model.get("best_iterations").values()) < 17
    for c, (name, losses) in enumerate(model.get("losses").items()):
        best, child = model.get("best_iterations")[name], model.children[name]
        assert best == M.stopping_round(losses, 3) and len(losses) == next(n for n in (6, 12, 20) if n - best >= 3)
        options = {**M.DEFAULTS["boosted"], "maxDepth": 3, "stepSize": 0.2, "maxIter": best}
        one = rows.where("not is_val").withColumn("one", (F.col("label") == c).cast("double"))
        want = fit(M.GBTClassifier(featuresCol="features", labelCol="one", predictionCol="__pred", seed=42, **options), one)
        assert child.getNumTrees == best and child.treeWeights == want.treeWeights and child.getMaxIter() == best
        assert [t.toDebugString.split("\n")[1:] for t in child.trees] == [t.toDebugString.split("\n")[1:] for t in want.trees]
        assert child.featureImportances.toArray() == pytest.approx(want.featureImportances.toArray())
        child.write().overwrite().save(str(tmp_path / name))
        for m in (child, GBTClassificationModel.load(str(tmp_path / name))):
            got = [r["__prob"].toArray() for r in m.transform(rows).orderBy("id").collect()]
            assert np.allclose(got, [r["probability"].toArray() for r in want.transform(rows).orderBy("id").collect()])


def test_cross_validation_reaches_the_floor(spark):
    from zonewright.operators import splits

    rows = splits.folds(separable(spark), "id", 3, "label")
    ensemble = M.Ensemble(members=[{"type": "forest", "weight": 0.5, "options": {"numTrees": 20}}, {"type": "logistic", "weight": 0.5}], n_classes=4)
    scores = [r["accuracy"] for r in M.cross_validate(rows, ensemble, 3)[0].collect()]
    assert len(scores) == 3 and min(scores) > 0.30 and np.mean(scores) > 0.40


def test_halving_search(spark):
    rows = separable(spark)
    space = {"n_estimators": (9, 18, "int"), "max_depth": (1, 6, "int")}
    best, table = M.halving_search(rows.where("not is_val"), rows.where("is_val"), "forest", key="id", trials=9, space=space)
    runs = table.collect()
    per_rung = {g: [r for r in runs if r["rung"] == g] for g in (0, 1, 2)}
    assert [len(per_rung[g]) for g in (0, 1, 2)] == [9, 3, 1]
    for g in (0, 1):
        ordered = sorted(per_rung[g], key=lambda r: (-r["f1_macro"], r["trial"]))
        assert {r["trial"] for r in per_rung[g + 1]} == {r["trial"] for r in ordered[: len(per_rung[g + 1])]}
    assert [per_rung[g][0]["share"] for g in (0, 1, 2)] == pytest.approx([1 / 9, 1 / 3, 1])
    assert str(best) == per_rung[2][0]["params"] and per_rung[2][0]["f1_macro"] > 0.7
    with pytest.raises(ValueError):
        M.halving_search(rows, rows, "forest", key="id", trials=0)


def test_ordered_target_encoding_sees_earlier_rows_only(spark):
    """One value with most rows, over several ranges; nulls, and a value met once."""
    import hashlib

    rows = [(i, "hot" if i % 3 else f"v{i % 7}", float(i % 5) if i % 11 else None) for i in range(300)] + [(300, None, 2.0), (301, "once", 4.0)]
    df = spark.createDataFrame(rows, "id long, c string, t double").repartition(3)
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {r["id"]: r["c_ordered_encoded"] for r in encode.ordered_target_encoding(df, ["c"], "t", "id", smoothing=2.0, seed=5).collect()}
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    mean = np.mean([t for _, _, t in rows if t is not None])
    sums, counts, want = {}, {}, {}
    for i, c, t in sorted(rows, key=lambda r: (hashlib.md5(f"5|{r[0]}".encode()).hexdigest(), r[0])):
        want[i] = mean if c is None else (sums.get(c, 0.0) + 2 * mean) / (counts.get(c, 0) + 2)
        if t is not None:
            sums[c], counts[c] = sums.get(c, 0.0) + t, counts.get(c, 0) + 1
    assert got == pytest.approx(want) and got[301] == pytest.approx(mean)


def test_vector_totals_of_sparse_and_dense_rows(spark):
    """Counts and sums of every element, against the same rows in plain Python."""
    rows = [Vectors.sparse(4, [1, 3], [2.0, 0.0]), Vectors.dense([1.0, 0.0, -1.5, 4.0]), Vectors.sparse(4, [], []), Vectors.dense([0.5, 0.0, 0.0, 1.0]), None]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(rows)], T.StructType([T.StructField("id", T.LongType()), T.StructField("features", VectorUDT())])).repartition(3)
    got = {r["i"]: (r["n"], r["total"]) for r in choose.vector_totals(df).collect()}
    assert got == {0: (2, 1.5), 1: (1, 2.0), 2: (1, -1.5), 3: (2, 5.0)}
    assert choose.vector_totals(df.where("id > 9")).count() == 0


def test_feature_queries_do_the_whole_job():
    """The plan's query counts every feature's cells; the selector's query reads the selected
    values; early stopping has all ten classes."""
    from __spark_entry__ import oracle_sql, queries

    sql = oracle_sql()
    assert "plausible" in sql["e07_e09_feature_plan"]
    assert "varies" in sql["l05_selected_features"] and "range(10)" in sql["m04_early_stopping"]
    assert {"e09_feature_values", "l05_selected_scores", "m04_best_rounds"} <= set(queries())


def test_assembling_methods_are_small_enough_to_be_compiled(spark, capsys):
    """The JVM interprets methods of 8,000 bytes and more for good."""
    from zonewright.queries.tables import Tables
    from zonewright.queries.text_queries import _assembled

    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        _assembled(Tables(spark, "/root/testdata/sf0.001"))[0].select("features").explain("codegen")
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    sizes = [int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", capsys.readouterr().out)]
    assert sizes and max(sizes) < 8000


def test_numbers_are_assembled_as_they_were_given(spark):
    """Null, NaN and infinite numbers become 0; neighbouring numbers and vectors keep their order."""
    rows = spark.sql("SELECT 1 AS a, CAST('NaN' AS DOUBLE) AS b, array(2D, 3D) AS v, CAST('-Infinity' AS FLOAT) AS c, CAST(NULL AS INT) AS d, -4L AS e")
    rows = rows.withColumn("v", array_to_vector("v"))
    out = FeatureVector(inputs=["a", "b", "v", "c", "d", "e"], names=list("abvwcde"), drop=["a"]).transform(rows)
    assert out.columns == ["b", "v", "c", "d", "e", "features"]
    assert out.first()["features"].toArray().tolist() == [1, 0, 2, 3, 0, 0, -4]


def test_selection_reads_vectors_made_once(spark):
    from zonewright.queries.tables import Tables
    from zonewright.queries.text_queries import _selected

    files = _selected(Tables(spark, "/root/testdata/sf0.001"))[1].inputFiles()
    assert files and all("held-" in f for f in files)


def test_rows_over_the_cores(spark):
    from zonewright.operators.base import ROWS_PER_TASK, over_cores

    assert over_cores(spark.range(10, numPartitions=5), "id").rdd.getNumPartitions() == 1
    rows = over_cores(spark.range(3 * ROWS_PER_TASK, numPartitions=1), "id")
    assert rows.rdd.getNumPartitions() == min(3, spark.sparkContext.defaultParallelism)
    assert rows.count() == 3 * ROWS_PER_TASK and over_cores(spark.range(0), "id").count() == 0


def test_validation_rows_are_scored_once(spark, monkeypatch):
    """The reported metrics and their check read the same held scores."""
    from zonewright.queries import QUERIES, model_queries

    monkeypatch.setattr(model_queries, "_ensemble", lambda: M.Ensemble(members=[{"type": "forest", "options": {"numTrees": 2, "maxDepth": 2}}], n_classes=10))
    out = QUERIES["m13_validation_metrics"](spark, "/root/testdata/sf0.001")
    assert out.inputFiles() and all("held-" in f for f in out.inputFiles())
    assert out.first().asDict().keys() == {"n_rows", "accuracy_agrees", "recall_agrees"}


def test_permuted_columns_come_from_one_order(spark):
    """Every row takes the next row's value, the last that of the first; rows are ordered once for all columns."""
    seen = []

    class Same:
        def transform(self, df):
            seen.append(df)
            return df.withColumn("prediction", F.col("a").cast("int"))

    rows = spark.range(12).select("id", F.col("id").cast("double").alias("a"), (F.col("id") * 10).alias("b"), F.col("id").cast("double").alias("label"))
    drops = {r["column"]: r["drop"] for r in M.permutation_importance(Same(), rows, "id", ["a", "b"]).collect()}
    assert drops == {"a": 1.0, "b": 0.0}
    a, b = ({r["id"]: r[c] for r in df.collect()} for c, df in zip("ab", seen[1:]))
    order = [r["id"] for r in rows.orderBy(hash_order("id")).collect()]
    assert [int(a[i]) for i in order] == order[1:] + order[:1] and [b[i] // 10 for i in order] == order[1:] + order[:1]
    assert not any("Window" in df._jdf.queryExecution().toString() for df in seen[1:])


def test_folds_are_fitted_side_by_side(spark, monkeypatch):
    """Every fold starts before the first one has ended; scores are those of one after another."""
    import threading

    from zonewright.operators import splits

    rows = splits.folds(separable(spark, 120, 2), "id", 3, "label").persist()
    member = M.Ensemble(members=[{"type": "logistic"}], n_classes=2)
    want = [tuple(r) for r in M.cross_validate(rows, member, 3, parallelism=1)[0].collect()]
    gate, fit = threading.Barrier(3, timeout=60), M.Ensemble.fit
    monkeypatch.setattr(M.Ensemble, "fit", lambda self, df: (gate.wait(), fit(self, df))[1])
    assert [tuple(r) for r in M.cross_validate(rows, member, 3, parallelism=3)[0].collect()] == want


def test_folds_share_the_memory_of_the_driver(spark, monkeypatch):
    """Parts of all folds' forests take turns where there is room for one only; scores are the same."""
    import threading

    from zonewright.operators import splits

    monkeypatch.setattr(M, "TREES", 4)
    rows = splits.folds(separable(spark, 120, 2), "id", 3, "label").persist()
    member = M.Ensemble(members=[{"type": "forest", "options": {"numTrees": 10, "maxDepth": 3}}], n_classes=2)
    scores = lambda: [tuple(r) for r in M.cross_validate(rows, member, 3)[0].collect()]
    want, room, lock, running, peak = scores(), M.Room(1), threading.Lock(), [0], [0]
    fit = M.RandomForestClassifier.fit

    def counted(self, df):
        with lock:
            running[0] += 1
            peak[0] = max(peak[0], running[0])
        try:
            return fit(self, df)
        finally:
            with lock:
                running[0] -= 1

    monkeypatch.setattr(M.RandomForestClassifier, "fit", counted)
    monkeypatch.setattr(M.Room, "of", classmethod(lambda cls, spark: room))
    assert scores() == want and peak == [1] and room.used == 0


def test_forest_in_parts(spark, monkeypatch, tmp_path):
    """A large forest is fitted side by side over few tasks, and its parts weigh by their trees."""
    monkeypatch.setattr(M, "TREES", 4)
    df = separable(spark).repartition(6).persist()
    model = M.Member(type="forest", options={"numTrees": 10, "maxDepth": 3, "minInstancesPerNode": 1}, n_classes=5).fit(df)
    assert [c.getNumTrees for c in model.children.values()] == [4, 4, 2]
    model.write().overwrite().save(str(tmp_path / "m"))
    out = M.MemberModel.load(str(tmp_path / "m")).transform(df)
    assert out.columns == [*df.columns, "probs"]
    for r in out.limit(20).collect():
        parts = [c.predictProbability(r["features"]).toArray() * c.getNumTrees / 10 for c in model.children.values()]
        assert r["probs"] == pytest.approx([*sum(parts), 0.0], abs=1e-12)
    assert sum(model.importances()) == pytest.approx(1)


def test_large_forests_stay_off_the_driver(spark, monkeypatch, tmp_path):
    """Parts are as large as memory asks for, few are in work at a time, and a forest that is
    too large is read from files: probabilities and importances are those of one kept whole."""
    df = separable(spark).repartition(6).persist()
    member = M.Member(type="forest", options={"numTrees": 10, "maxDepth": 3, "minInstancesPerNode": 20}, n_classes=5)
    tree = M.tree_bytes(400, 5, {"maxDepth": 3, "minInstancesPerNode": 20})
    assert tree == 16 * (256 + 32 * 5) and M.tree_bytes(70_000, 10, {"maxDepth": 16, "minInstancesPerNode": 5}) == 28_000 * 576
    assert M.count_bytes(70_000, 10, 64, {"numTrees": 64, "maxDepth": 16}) == 256 << 20
    assert M.count_bytes(400, 5, 6, {"numTrees": 10, "maxDepth": 3, "minInstancesPerNode": 20}) == 10 * 4 * 3 * 32 * 6 * 8
    monkeypatch.setattr(M, "count_bytes", lambda *given: tree // 2)
    monkeypatch.setattr(M, "PART_BYTES", 3 * tree + 1)
    whole = member.fit(df)
    assert isinstance(whole.children, dict) and [c.getNumTrees for c in whole.children.values()] == [3, 3, 3, 1]
    room, peak = M.Room(7 * tree), []
    taken = M.Room.taken

    def seen(self, size):
        peak.append(self.used)
        return taken(self, size)

    monkeypatch.setattr(M.Room, "of", classmethod(lambda cls, spark: room))
    monkeypatch.setattr(M.Room, "taken", seen)
    stored = member.fit(df)
    assert isinstance(stored.children, M.StoredParts) and stored.get("trees") == whole.get("trees")
    assert room.used == 0 and 0 < max(peak) <= 7 * tree  # a part asks for up to 3.5 trees
    probs = lambda m: [r["probs"] for r in m.transform(df).orderBy("id").collect()]
    want = probs(whole)
    out = stored.transform(df)
    assert out.columns == [*df.columns, "probs"] and "UDF" not in out._jdf.queryExecution().toString()
    assert np.allclose(probs(stored), want, atol=1e-12) and stored.importances() == pytest.approx(whole.importances())
    stored.write().overwrite().save(str(tmp_path / "m"))
    assert np.allclose(probs(M.MemberModel.load(str(tmp_path / "m"))), want, atol=1e-12)


def test_training_rows_are_dealt_over_the_cores(spark, owned, monkeypatch):
    from zonewright.operators import base

    class Seen(Exception):
        pass

    def fit(self, df):
        raise Seen(df.rdd.getNumPartitions())

    monkeypatch.setattr(base, "ROWS_PER_TASK", 50)
    monkeypatch.setattr(FeaturePlan, "fit", fit)
    with pytest.raises(Seen) as seen:
        jobs.train(owned.coalesce(1), "id")
    assert seen.value.args[0] > 1


def test_children_are_saved_side_by_side(spark, tmp_path):
    import threading

    from zonewright.operators.base import Stage

    met = threading.Barrier(2, timeout=20)

    class Child(Stage):
        def write(self):
            return self

        def overwrite(self):
            return self

        def save(self, path):
            met.wait()

    parent = Stage()
    parent.children = {"a": Child(), "b": Child()}
    parent.write().overwrite().save(str(tmp_path / "s"))
    assert not met.broken
