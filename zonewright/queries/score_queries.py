"""Voting, scoring and evaluation over given probabilities."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from zonewright.operators import evaluate, score, voting
from zonewright.operators.calibrate import ConfidenceCalibrator
from zonewright.queries.registry import query
from zonewright.queries.tables import Tables

PROBS = ("probs",)
WEIGHTS = {"m1": 0.4, "m2": 0.4, "m3": 0.2}
CLASSES = [1000 + 7 * i for i in range(10)]

SQL_SOFT = """raw AS (SELECT id, label, list_transform(list_zip(m1, m2, m3), lambda z: z[1] * CAST(0.4 AS DOUBLE) + z[2] * CAST(0.4 AS DOUBLE) + z[3] * CAST(0.2 AS DOUBLE)) AS r FROM probs),
soft AS (SELECT id, label, list_transform(r, lambda x: x / list_sum(r)) AS p FROM raw),
cells AS (SELECT id, label, CAST(unnest(range(0, 10)) AS INTEGER) AS class_idx, unnest(p) AS x, p FROM soft),
ranked AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY x DESC, class_idx) AS r FROM cells),
scored AS (SELECT id, label, class_idx AS prediction, x AS confidence, p FROM ranked WHERE r = 1)"""


def soft(t: Tables) -> DataFrame:
    members = voting.member_arrays(list(WEIGHTS))
    return t.probs.select("id", "label", "m1", "m2", "m3", voting.soft_vote(members, WEIGHTS).alias("probs"))


def scored(t: Tables) -> DataFrame:
    return soft(t).withColumn("prediction", voting.predicted_class(F.col("probs")))


@query("m05_top_k", f"WITH {SQL_SOFT} SELECT id, CAST(r AS INTEGER) AS rank, class_idx, round(x, 9) AS probability FROM ranked WHERE r <= 5", PROBS)
def m05(t: Tables) -> DataFrame:
    top = soft(t).select("id", F.posexplode(voting.top_classes(F.col("probs"), 5)).alias("pos", "c"))
    return top.select("id", (F.col("pos") + 1).alias("rank"), "c.class_idx", F.round("c.probability", 9).alias("probability"))


@query("m06_member_weights", "SELECT event_type AS member, round(count(*) / CAST((SELECT count(*) FROM events) AS DOUBLE), 9) AS weight FROM events GROUP BY event_type")
def m06(t: Tables) -> DataFrame:
    weights = t.events.groupBy(F.col("event_type").alias("member")).agg(F.count("*").cast("double").alias("weight"))
    return voting.normalize_weight_table(weights).withColumn("weight", F.round("weight", 9))


@query("m07_soft_vote", f"WITH {SQL_SOFT} SELECT id, class_idx, round(x, 9) AS p FROM cells", PROBS)
def m07(t: Tables) -> DataFrame:
    return soft(t).select("id", F.posexplode("probs").alias("class_idx", "p")).withColumn("p", F.round("p", 9))


@query("m08_predicted_class", f"WITH {SQL_SOFT} SELECT id, prediction FROM scored", PROBS)
def m08(t: Tables) -> DataFrame:
    return scored(t).select("id", "prediction")


@query(
    "m09_hard_vote",
    """WITH votes AS (SELECT id, CAST(list_position(m1, list_max(m1)) - 1 AS INTEGER) AS c, CAST(0.4 AS DOUBLE) AS w FROM probs
  UNION ALL SELECT id, list_position(m2, list_max(m2)) - 1, 0.4 FROM probs UNION ALL SELECT id, list_position(m3, list_max(m3)) - 1, 0.2 FROM probs),
sums AS (SELECT id, c, sum(w) AS w FROM votes GROUP BY id, c)
SELECT id, c AS prediction FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY w DESC, c) AS r FROM sums) WHERE r = 1""",
    PROBS,
)
def m09(t: Tables) -> DataFrame:
    picks = {m: voting.predicted_class(F.col(m)) for m in WEIGHTS}
    return t.probs.select("id", voting.hard_vote(picks, WEIGHTS).alias("prediction"))


@query(
    "m10_confidence",
    f"WITH {SQL_SOFT} SELECT id, prediction AS class_idx, round(confidence, 9) AS confidence, (SELECT string_agg(CAST(class_idx AS VARCHAR), ',' ORDER BY r) FROM ranked k WHERE k.id = s.id AND r <= 3) AS top FROM scored s",
    PROBS,
)
def m10(t: Tables) -> DataFrame:
    out = voting.confident(soft(t), "probs", 3)
    top = F.array_join(F.transform("top_k", lambda x: x["class_idx"].cast("string")), ",")
    return out.select("id", "class_idx", F.round("confidence", 9).alias("confidence"), top.alias("top"))


@query(
    "m11_combined_importance",
    """WITH imp AS (SELECT l_returnflag AS member, l_linenumber AS feature, avg(l_tax) AS importance FROM lineitem GROUP BY 1, 2),
w AS (SELECT l_returnflag AS member, count(*) / CAST((SELECT count(*) FROM lineitem) AS DOUBLE) AS weight FROM lineitem GROUP BY 1)
SELECT feature, round(sum(weight * importance), 6) AS importance FROM imp JOIN w USING (member) GROUP BY feature""",
)
def m11(t: Tables) -> DataFrame:
    rows = t.lineitem
    importances = rows.groupBy(F.col("l_returnflag").alias("member"), F.col("l_linenumber").alias("feature")).agg(F.avg("l_tax").alias("importance"))
    weights = voting.normalize_weight_table(rows.groupBy(F.col("l_returnflag").alias("member")).agg(F.count("*").cast("double").alias("weight")))
    return voting.combined_importance(importances, weights).withColumn("importance", F.round("importance", 6))


@query(
    "m02_balanced_class_weights",
    "SELECT appid, count(*) AS n, round((SELECT count(*) FROM inventory WHERE appid IS NOT NULL) / ((SELECT count(DISTINCT appid) FROM inventory) * CAST(count(*) AS DOUBLE)), 9) AS class_weight FROM inventory WHERE appid IS NOT NULL GROUP BY appid",
    ("inventory",),
)
def m02(t: Tables) -> DataFrame:
    return voting.class_weights(t.inventory, "appid").withColumn("class_weight", F.round("class_weight", 9))


@query(
    "m14_fold_summary",
    """WITH f AS (SELECT l_linenumber AS fold, avg(l_discount) AS accuracy, avg(l_tax) AS f1_macro FROM lineitem GROUP BY 1)
SELECT 'accuracy' AS metric, round(avg(accuracy), 9) AS mean, round(stddev_pop(accuracy), 9) AS std FROM f
UNION ALL SELECT 'f1_macro', round(avg(f1_macro), 9), round(stddev_pop(f1_macro), 9) FROM f""",
)
def m14(t: Tables) -> DataFrame:
    folds = t.lineitem.groupBy(F.col("l_linenumber").alias("fold")).agg(F.avg("l_discount").alias("accuracy"), F.avg("l_tax").alias("f1_macro"))
    out = evaluate.fold_summary(folds, ["accuracy", "f1_macro"])
    return out.select("metric", F.round("mean", 9).alias("mean"), F.round("std", 9).alias("std"))


_TOP = ", ".join(
    f"max(CASE WHEN r = {k} THEN CAST(1000 + 7 * class_idx AS BIGINT) END) AS top_{k}_appid, round(max(CASE WHEN r = {k} THEN x END), 9) AS top_{k}_prob"
    for k in range(1, 6)
)


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.round(c, 9) for c in df.columns if c.endswith("_prob") or c == "confidence"})


@query(
    "s13_i01_predictions",
    f"""WITH {SQL_SOFT} SELECT id, max(CASE WHEN r = 1 THEN CAST(1000 + 7 * class_idx AS BIGINT) END) AS predicted_appid,
  round(max(x), 9) AS confidence, max(x) < 0.3 AS is_uncertain, {_TOP} FROM ranked GROUP BY id""",
    PROBS,
)
def i01(t: Tables) -> DataFrame:
    return _rounded(score.wide(score.predictions(soft(t), CLASSES), 5, ("id",)))


@query(
    "i03_unknown_fallback",
    f"""WITH {SQL_SOFT} SELECT id, CASE WHEN confidence < 0.2 THEN -1 ELSE CAST(1000 + 7 * prediction AS BIGINT) END AS predicted_appid,
  round(confidence, 9) AS confidence, confidence < 0.3 AS is_uncertain FROM scored""",
    PROBS,
)
def i03(t: Tables) -> DataFrame:
    out = score.with_fallback(score.predictions(soft(t), CLASSES))
    return _rounded(out.select("id", "predicted_appid", "confidence", "is_uncertain"))


@query(
    "s14_score_summary",
    f"""WITH {SQL_SOFT} SELECT count(*) AS total_count, count(*) FILTER (WHERE confidence < 0.3) AS uncertain_count,
  round(avg(CAST(confidence < 0.3 AS DOUBLE)), 9) AS uncertain_share, round(avg(confidence), 9) AS avg_confidence FROM scored""",
    PROBS,
)
def s14(t: Tables) -> DataFrame:
    out = score.summary(score.predictions(soft(t), CLASSES))
    return out.withColumns({c: F.round(c, 9) for c in ("uncertain_share", "avg_confidence")})


@query(
    "d12_entropy_rule",
    f"""WITH {SQL_SOFT}, e AS (SELECT id, prediction, list_sum(list_transform(p, lambda x: CASE WHEN x > 0 THEN -x * ln(x) ELSE 0 END)) AS h FROM scored)
SELECT id, round(h, 9) AS entropy, CASE WHEN h > 2.0 THEN -1 ELSE CAST(1000 + 7 * prediction AS BIGINT) END AS predicted_appid FROM e""",
    PROBS,
)
def d12(t: Tables) -> DataFrame:
    out = score.with_entropy_rule(score.predictions(soft(t), CLASSES))
    return out.select("id", F.round("entropy", 9).alias("entropy"), "predicted_appid")


SQL_CENTROIDS = """cells AS (SELECT vec_id, label, unnest(range(1, len(embedding) + 1)) AS i, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings),
cent AS (SELECT label, i, avg(x) AS m FROM cells GROUP BY label, i)"""


@query("d13_class_centroids", f"WITH {SQL_CENTROIDS} SELECT label, CAST(i - 1 AS INTEGER) AS i, round(m, 9) AS m FROM cent")
def d13a(t: Tables) -> DataFrame:
    table = score.centroids(t.embeddings, "embedding", "label")
    return table.select("label", F.posexplode("centroid").alias("i", "m")).withColumn("m", F.round("m", 9))


@query(
    "d13_nearest_centroid",
    f"""WITH {SQL_CENTROIDS}, cn AS (SELECT label, sqrt(sum(m * m)) AS n FROM cent GROUP BY label),
vn AS (SELECT vec_id, sqrt(sum(x * x)) AS n FROM cells GROUP BY vec_id),
sims AS (SELECT c.vec_id, t.label, sum(c.x * t.m) / (any_value(vn.n) * any_value(cn.n)) AS s FROM cells c JOIN cent t ON c.i = t.i
  JOIN vn ON vn.vec_id = c.vec_id JOIN cn ON cn.label = t.label GROUP BY c.vec_id, t.label),
best AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, label) AS r FROM sims)
SELECT vec_id, CASE WHEN s >= 0.85 THEN label END AS nearest, round(s, 6) AS similarity FROM best WHERE r = 1""",
)
def d13(t: Tables) -> DataFrame:
    table = score.centroids(t.embeddings, "embedding", "label")
    out = score.nearest_centroid(t.embeddings, "embedding", table)
    return out.select("vec_id", "nearest", F.round("similarity", 6).alias("similarity"))


# --- Evaluation -----------------------------------------------------------

SQL_REPORT = """classes AS (SELECT label AS c FROM scored UNION SELECT prediction FROM scored),
rep AS (SELECT c AS class, (SELECT count(*) FROM scored WHERE label = c) AS support, (SELECT count(*) FROM scored WHERE prediction = c) AS predicted,
  (SELECT count(*) FROM scored WHERE label = c AND prediction = c) AS hits FROM classes),
pr AS (SELECT *, CASE WHEN predicted = 0 THEN 0 ELSE hits / CAST(predicted AS DOUBLE) END AS precision, CASE WHEN support = 0 THEN 0 ELSE hits / CAST(support AS DOUBLE) END AS recall FROM rep),
report AS (SELECT *, CASE WHEN precision + recall = 0 THEN 0 ELSE 2 * precision * recall / (precision + recall) END AS f1 FROM pr)"""


@query(
    "v01_label_metrics",
    f"""WITH {SQL_SOFT}, {SQL_REPORT} SELECT round(sum(hits) / CAST(sum(support) AS DOUBLE), 9) AS accuracy, round(avg(f1), 9) AS f1_macro,
  round(sum(f1 * support) / CAST(sum(support) AS DOUBLE), 9) AS f1_weighted, round(avg(precision), 9) AS precision_macro, round(avg(recall), 9) AS recall_macro FROM report""",
    PROBS,
)
def v01(t: Tables) -> DataFrame:
    out = evaluate.label_metrics(evaluate.confusion(scored(t)))
    return out.select(*[F.round(c, 9).alias(c) for c in out.columns])


@query(
    "v02_v03_probability_metrics",
    f"""WITH {SQL_SOFT}, tr AS (SELECT r, x FROM ranked WHERE class_idx = label)
SELECT round(avg(CAST(r <= 3 AS DOUBLE)), 9) AS top_3_accuracy, round(avg(CAST(r <= 5 AS DOUBLE)), 9) AS top_5_accuracy,
  round(avg(-ln(greatest(2.220446049250313e-16, least(1 - 2.220446049250313e-16, x)))), 6) AS log_loss FROM tr""",
    PROBS,
)
def v02(t: Tables) -> DataFrame:
    out = evaluate.probability_metrics(soft(t), 10)
    return out.select(F.round("top_3_accuracy", 9).alias("top_3_accuracy"), F.round("top_5_accuracy", 9).alias("top_5_accuracy"), F.round("log_loss", 6).alias("log_loss"))


@query("v04_confusion", f"WITH {SQL_SOFT} SELECT label, prediction, count(*) AS n FROM scored GROUP BY label, prediction", PROBS)
def v04(t: Tables) -> DataFrame:
    return evaluate.confusion(scored(t))


@query(
    "v04_confusion_matrix",
    f"WITH {SQL_SOFT} SELECT label, {', '.join(f'count(*) FILTER (WHERE prediction = {c}) AS \"{c}\"' for c in range(10))} FROM scored GROUP BY label",
    PROBS,
)
def v04b(t: Tables) -> DataFrame:
    return evaluate.confusion_matrix(evaluate.confusion(scored(t)), list(range(10)))


@query(
    "v05_class_report",
    f"WITH {SQL_SOFT}, {SQL_REPORT} SELECT class, support, round(precision, 9) AS precision, round(recall, 9) AS recall, round(f1, 9) AS f1, hits FROM report",
    PROBS,
)
def v05(t: Tables) -> DataFrame:
    out = evaluate.class_report(evaluate.confusion(scored(t)))
    return out.withColumns({c: F.round(c, 9) for c in ("precision", "recall", "f1")})


@query(
    "v06_per_class",
    f"""WITH {SQL_SOFT} SELECT label AS class, count(*) AS n_samples, round(avg(CAST(prediction = label AS DOUBLE)), 9) AS accuracy,
  round(avg(p[label + 1]), 9) AS avg_confidence, round(coalesce(avg(p[label + 1]) FILTER (WHERE prediction = label), 0), 9) AS correct_confidence FROM scored GROUP BY label""",
    PROBS,
)
def v06(t: Tables) -> DataFrame:
    out = evaluate.per_class(scored(t))
    return out.withColumns({c: F.round(c, 9) for c in ("accuracy", "avg_confidence", "correct_confidence")})


@query(
    "v07_error_summary",
    f"""WITH {SQL_SOFT} SELECT count(*) FILTER (WHERE prediction <> label) AS total_errors, round(avg(CAST(prediction <> label AS DOUBLE)), 9) AS error_rate,
  round(avg(confidence) FILTER (WHERE prediction <> label), 9) AS avg_error_confidence FROM scored""",
    PROBS,
)
def v07(t: Tables) -> DataFrame:
    out = evaluate.error_summary(scored(t))
    return out.withColumns({c: F.round(c, 9) for c in ("error_rate", "avg_error_confidence")})


@query(
    "v07_confident_errors",
    f"""WITH {SQL_SOFT}, worst AS (SELECT * FROM scored WHERE prediction <> label ORDER BY confidence DESC, id LIMIT 100)
SELECT id, label, prediction, round(confidence, 9) AS confidence,
  (SELECT string_agg(CAST(class_idx AS VARCHAR), ',' ORDER BY r) FROM ranked k WHERE k.id = w.id AND r <= 3) AS top_3 FROM worst w""",
    PROBS,
)
def v07b(t: Tables) -> DataFrame:
    out = evaluate.confident_errors(scored(t), "id")
    top = F.array_join(F.transform("top_3", lambda c: c.cast("string")), ",")
    return out.select("id", "label", "prediction", F.round("confidence", 9).alias("confidence"), top.alias("top_3"))


@query(
    "v08_confusion_pairs",
    f"WITH {SQL_SOFT} SELECT label, prediction, count(*) AS n FROM scored WHERE label <> prediction GROUP BY label, prediction ORDER BY n DESC, label, prediction LIMIT 10",
    PROBS,
)
def v08(t: Tables) -> DataFrame:
    return evaluate.confusion_pairs(evaluate.confusion(scored(t)))


SQL_BINS = """bins AS (SELECT CAST(least(floor(confidence * 10), 9) AS INTEGER) AS bin, count(*) AS n, avg(confidence) AS mean_confidence,
  avg(CAST(prediction = label AS DOUBLE)) AS accuracy FROM scored GROUP BY 1)"""


@query("d21_calibration", f"WITH {SQL_SOFT}, {SQL_BINS} SELECT bin, n, round(mean_confidence, 9) AS mean_confidence, round(accuracy, 9) AS accuracy FROM bins", PROBS)
def d21(t: Tables) -> DataFrame:
    out = evaluate.calibration(scored(t))
    return out.withColumns({c: F.round(c, 9) for c in ("mean_confidence", "accuracy")})


@query("d21_calibration_error", f"WITH {SQL_SOFT}, {SQL_BINS} SELECT round(sum(abs(mean_confidence - accuracy) * n) / sum(n), 9) AS ece FROM bins", PROBS)
def d21b(t: Tables) -> DataFrame:
    return evaluate.calibration_error(evaluate.calibration(scored(t))).select(F.round("ece", 9).alias("ece"))


@query(
    "d21_calibrated_confidence",
    f"""WITH {SQL_SOFT}, rounded AS (SELECT id, round(confidence, 3) AS s, prediction = label AS hit FROM scored),
v AS (SELECT s, count(*) AS n, count(*) FILTER (WHERE hit) AS h FROM rounded WHERE id % 2 = 0 GROUP BY s),
c AS (SELECT s, row_number() OVER o AS i, n, h, sum(n) OVER o AS cn, sum(h) OVER o AS ch FROM v WINDOW o AS (ORDER BY s)),
pairs AS (SELECT a.i AS a, b.i AS b, (b.ch - a.ch + a.h) / CAST(b.cn - a.cn + a.n AS DOUBLE) AS mean FROM c a JOIN c b ON a.i <= b.i),
least_ends AS (SELECT a, b AS i, min(mean) OVER (PARTITION BY a ORDER BY b ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS g FROM pairs),
shares AS (SELECT i, max(g) AS p FROM least_ends GROUP BY i),
steps AS (SELECT s, sum(h) OVER l / CAST(sum(n) OVER l AS DOUBLE) AS p FROM c JOIN shares USING (i) WINDOW l AS (PARTITION BY floor(p * 10000)))
SELECT r.id, r.s AS confidence, round(coalesce(t.p, (SELECT arg_min(p, s) FROM steps)), 9) AS calibrated_confidence
FROM rounded r ASOF LEFT JOIN steps t ON r.s >= t.s WHERE r.id % 2 = 1""",
    PROBS,
)
def d21c(t: Tables) -> DataFrame:
    """Fitted on even ids, applied to odd ones."""
    rows = scored(t).select("id", F.round(F.array_max("probs"), 3).alias("confidence"), (F.col("prediction") == F.col("label")).alias("hit"))
    model = ConfidenceCalibrator().fit(rows.where("id % 2 = 0"))
    out = model.transform(rows.where("id % 2 = 1"))
    return out.select("id", "confidence", F.round("calibrated_confidence", 9).alias("calibrated_confidence"))


@query(
    "v01_quality_labels",
    """WITH j AS (SELECT quality AS label, CAST(n_chars > 1500 AS INTEGER) AS prediction FROM documents JOIN labels USING (doc_id)),
rep AS (SELECT c, count(*) FILTER (WHERE label = c) AS support, count(*) FILTER (WHERE prediction = c) AS predicted, count(*) FILTER (WHERE label = c AND prediction = c) AS hits
  FROM j, (VALUES (0), (1)) v(c) GROUP BY c)
SELECT CAST(c AS INTEGER) AS class, support, round(CASE WHEN predicted = 0 THEN 0 ELSE hits / CAST(predicted AS DOUBLE) END, 9) AS precision, round(CASE WHEN support = 0 THEN 0 ELSE hits / CAST(support AS DOUBLE) END, 9) AS recall FROM rep""",
)
def v01b(t: Tables) -> DataFrame:
    rows = t.documents.select("doc_id", (F.col("n_chars") > 1500).cast("int").alias("prediction")).join(t.labels, "doc_id")
    out = evaluate.class_report(evaluate.confusion(rows, "quality"))
    return out.select("class", "support", F.round("precision", 9).alias("precision"), F.round("recall", 9).alias("recall"))


@query(
    "s15_v09_top_features",
    """SELECT concat('part_', CAST(l_partkey AS VARCHAR)) AS feature, round(sum(l_tax), 6) AS importance FROM lineitem GROUP BY l_partkey
ORDER BY round(sum(l_tax), 6) DESC, feature LIMIT 50""",
)
def s15(t: Tables) -> DataFrame:
    # Rounded before ranking: the same sums added up in another order may
    # differ in their last digits.
    importance = t.lineitem.groupBy(F.concat(F.lit("part_"), F.col("l_partkey").cast("string")).alias("feature")).agg(F.round(F.sum("l_tax"), 6).alias("importance"))
    return evaluate.top_features(importance)

