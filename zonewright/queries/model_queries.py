"""Fitted models, whole jobs and the model store.

SQL cannot fit them, so most have none; the tests assert what must hold for
their results: rows, sums, ranges, and accuracy floors.
"""

from __future__ import annotations

from pyspark.ml.feature import StringIndexer, Word2Vec
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from zonewright.functions import text
from zonewright.operators import choose, splits, voting
from zonewright.operators.base import hold, over_cores, scratch_path
from zonewright.plans import jobs
from zonewright.plans import members as M
from zonewright.queries.registry import query
from zonewright.queries.tables import Tables
from zonewright.sources import readers, sinks

# The exact stratified split of the embeddings.
_CUT = "floor(CAST(n AS DOUBLE) * {})"
SQL_VECTORS = f"""ranked AS (SELECT vec_id AS id, label, row_number() OVER (PARTITION BY label ORDER BY md5(concat('42|', CAST(vec_id AS VARCHAR))), vec_id) AS r,
  count(*) OVER (PARTITION BY label) AS n FROM embeddings),
vectors AS (SELECT id, CAST(label AS DOUBLE) AS label, CASE WHEN label IS NULL OR n < 3 OR r <= {_CUT.format('0.7')} THEN 'train'
  WHEN r <= {_CUT.format('0.7')} + {_CUT.format('0.15')} THEN 'val' ELSE 'test' END AS split FROM ranked)"""

def vectors(t: Tables) -> DataFrame:
    """The embeddings as labelled feature vectors, with a stratified split."""
    rows = t.embeddings.select(
        F.col("vec_id").alias("id"), F.col("label").cast("double").alias("label"),
        array_to_vector(F.transform("embedding", lambda x: x.cast("double"))).alias("features"),
    )
    return splits.split(over_cores(rows, "id"), "id", stratify="label").withColumn("is_val", F.col("split") == "val")


def _tested(scored: DataFrame) -> DataFrame:
    """Id, label, the class of the greatest probability, and that probability."""
    return scored.select("id", "label", voting.predicted_class(F.col("probs")).alias("prediction"), F.array_max("probs").alias("confidence"))


def _member(t: Tables, kind: str, **settings) -> DataFrame:
    rows = vectors(t)
    model = M.create_member(kind, validation="is_val", **settings).fit(rows.where("split <> 'test'"))
    return _tested(model.transform(rows.where("split = 'test'")))


@query("m01_boosted_member")
def m01(t: Tables) -> DataFrame:
    return _member(t, "xgboost")


@query("m02_forest_member_balanced")
def m02(t: Tables) -> DataFrame:
    return _member(t, "lightgbm", class_weight="balanced")


@query("m03_logistic_member")
def m03(t: Tables) -> DataFrame:
    return _member(t, "catboost")


def _boosted(t: Tables) -> M.MemberModel:
    """Boosters with their default rounds and depth, one for each of the ten
    classes, kept up to the best round on the validation rows."""
    return M.create_member("boosted", validation="is_val", early_stopping_rounds=5).fit(vectors(t).where("split <> 'test'"))


@query("m04_early_stopping", "SELECT concat('class_', CAST(i AS VARCHAR)) AS class, true AS stopped, true AS losses_kept FROM range(10) t(i)")
def m04(t: Tables) -> DataFrame:
    """Every booster ends at its best round, and its losses are kept until that was seen."""
    model = _boosted(t)
    losses, best, limit = model.get("losses"), model.get("best_iterations"), M.DEFAULTS["boosted"]["maxIter"]
    rows = [(c, best[c] == M.stopping_round(found, 5), len(found) - best[c] >= 5 or len(found) == limit) for c, found in losses.items()]
    return t.spark.createDataFrame(rows, "class string, stopped boolean, losses_kept boolean")


@query("m04_best_rounds")
def m04b(t: Tables) -> DataFrame:
    model = _boosted(t)
    losses, best = model.get("losses"), model.get("best_iterations")
    rows = [(c, len(found), best[c], found[best[c] - 1]) for c, found in losses.items()]
    return t.spark.createDataFrame(rows, "class string, rounds int, best_round int, best_loss double")


def _ensemble(vote: str = "soft") -> M.Ensemble:
    return M.Ensemble(members=[{"type": "forest", "weight": 0.6}, {"type": "logistic", "weight": 0.4}], voting=vote, n_classes=10)


@query("m12_ensemble")
def m12(t: Tables) -> DataFrame:
    rows = vectors(t)
    model = _ensemble("hard").fit(rows.where("split = 'train'"))
    scored = model.transform(rows.where("split = 'test'"))
    return scored.select("id", "label", "prediction", "probs")


@query("m13_validation_metrics", f"WITH {SQL_VECTORS} SELECT count(*) AS n_rows, true AS accuracy_agrees, true AS recall_agrees FROM vectors WHERE split = 'val'")
def m13(t: Tables) -> DataFrame:
    """Reported metrics against the same numbers straight from the rows."""
    rows = vectors(t)
    scored = _ensemble().fit(rows.where("split = 'train'")).transform(rows.where("split = 'val'"))
    scored = hold(scored.select("id", "label", "prediction", "probs"))  # read by several reports, scored once
    told = {r["metric"]: r["value"] for r in jobs.evaluation(scored, 10, "id")["metrics"].collect()}
    hit = (F.col("label") == F.col("prediction")).cast("double")
    classes = scored.select("label").union(scored.select(F.col("prediction").cast("double"))).distinct().count()
    recall = scored.groupBy("label").agg(F.avg(hit).alias("r")).agg(F.sum("r") / classes).first()[0]
    same = F.abs(F.avg(hit) - F.lit(told["accuracy"])) < 1e-9
    return scored.agg(F.count("*").alias("n_rows"), same.alias("accuracy_agrees"), F.lit(abs(recall - told["recall_macro"]) < 1e-9).alias("recall_agrees"))


@query("m14_cross_validation")
def m14(t: Tables) -> DataFrame:
    rows = splits.folds(vectors(t), "id", 3, "label")
    return M.cross_validate(rows, _ensemble(), 3)[0]


@query("m15_parameter_search")
def m15(t: Tables) -> DataFrame:
    """27 trials of the forest's own search space, by successive halving."""
    rows = vectors(t)
    return M.halving_search(rows.where("split = 'train'"), rows.where("split = 'val'"), "forest", key="id", trials=27)[1]


@query("m16_importance_table")
def m16(t: Tables) -> DataFrame:
    rows = vectors(t)
    model = _ensemble().fit(rows.where("split = 'train'"))
    return model.importance_table(rows, [f"e{i}" for i in range(64)])


@query("l06_importance_selection")
def l06(t: Tables) -> DataFrame:
    model = choose.ImportanceSelector(names=[f"e{i}" for i in range(64)], threshold=0.01).fit(vectors(t))
    scores = model.get("scores")
    return t.spark.createDataFrame([(i, n, float(scores[n])) for i, n in enumerate(model.feature_names())], "position int, feature string, importance double")


@query("d18_permutation_importance")
def d18(t: Tables) -> DataFrame:
    """The column the label follows loses accuracy, the other does not."""
    from pyspark.ml import PipelineModel
    from pyspark.ml.feature import VectorAssembler

    rows = t.lineitem.select(
        F.concat_ws("-", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber").alias("key"),
        F.when(F.col("l_quantity") > 25, 1.0).otherwise(0.0).alias("label"), "l_quantity", "l_tax",
    )
    assembler = VectorAssembler(inputCols=["l_quantity", "l_tax"], outputCol="features")
    member = M.Ensemble(members=[{"type": "forest", "options": {"numTrees": 5, "maxDepth": 3}}], n_classes=2)
    model = PipelineModel([assembler, member.fit(assembler.transform(rows))])
    return M.permutation_importance(model, rows, "key", ["l_quantity", "l_tax"])


@query("d19_host_embeddings")
def d19(t: Tables) -> DataFrame:
    """Word2Vec vectors of host words (64 numbers per host)."""
    words = t.dns_records.select("id", text.host_word_terms(F.col("fqdn"), 1, 1).alias("words"))
    model = Word2Vec(vectorSize=64, minCount=1, seed=42, inputCol="words", outputCol="v").fit(words)
    return model.transform(words).select("id", vector_to_array("v").alias("vector"))


_TRAINED: dict[tuple[str, str], tuple] = {}


def _train(t: Tables) -> tuple[jobs.Training, sinks.ModelStore]:
    """The whole training job with its defaults, once per session and folder."""
    key = (t.spark.sparkContext.applicationId, t.folder)
    if key not in _TRAINED:
        store = sinks.ModelStore(t.spark, scratch_path(t.spark, "models"))
        _TRAINED[key] = jobs.train(t.dns_records, "id", store=store), store
    return _TRAINED[key]


@query("m17_training_report")
def m17(t: Tables) -> DataFrame:
    return _train(t)[0].metrics


@query("i01_i04_stored_model_scores")
def i04(t: Tables) -> DataFrame:
    """Train, store, load the latest version, score the orphans."""
    model = _train(t)[1].load(jobs.MODEL_NAME)
    scored = jobs.predict(model, readers.orphans(t.dns_records))
    return scored.select("id", "fqdn", "predicted_appid", "confidence")


@query("i02_single_record", "SELECT min(id) AS id, true AS same_owner, true AS same_confidence FROM dns_records WHERE appid = 0", ("dns_records",))
def i02(t: Tables) -> DataFrame:
    """One record scored alone agrees with the same record in its table."""
    model = _train(t)[0].model
    orphans = readers.orphans(t.dns_records)
    least = orphans.agg(F.min("id")).first()[0]
    row = jobs.predict(model, orphans.where(F.col("id") == least)).first().asDict()
    given = {c: row[c] for c in ("brand", "fqdn_status")}
    alone = jobs.predict_one(model, t.spark, row["fqdn"], row["record_type"], row["record_data"], **given)
    same = alone["predicted_appid"] == row["predicted_appid"], abs(alone["confidence"] - row["confidence"]) < 1e-9
    return t.spark.createDataFrame([(least, *same)], "id long, same_owner boolean, same_confidence boolean")


@query(
    "v10_stored_model_evaluation",
    """WITH owned AS (SELECT appid, count(*) OVER (PARTITION BY appid) AS n FROM dns_records WHERE appid <> 0)
SELECT count(*) AS rows, count(*) FILTER (n < 3) AS unmapped_rows, count(*) FILTER (n BETWEEN 3 AND 4) AS rare_rows, count(*) AS reported FROM owned""",
    ("dns_records",),
)
def v10(t: Tables) -> DataFrame:
    """Every labelled row is evaluated: rare owners as one class, unknown ones as errors."""
    trained = _train(t)[0]
    report = jobs.evaluate_stored(trained.model, readers.labeled(t.dns_records), "id")
    classes = jobs.owner_scorer(trained.model).get("classes")
    rare = classes.index(-999) if -999 in classes else None
    counts = report["per_class"].agg(
        F.coalesce(F.sum(F.when(F.col("class") == F.lit(rare), F.col("n_samples"))), F.lit(0)).alias("rare_rows"), F.sum("n_samples").alias("reported")
    )
    return report["unmapped"].crossJoin(counts)  # one row each


@query("e04_string_indexer_agrees", "SELECT true AS same, count(*) AS n FROM inventory", ("inventory",))
def e04(t: Tables) -> DataFrame:
    """Rows whose label code differs from Spark's own indexer: none expected,
    so the count is over all rows."""
    from zonewright.operators.encode import CategoryEncoder

    df = t.inventory.select("id", "brand")
    mine = CategoryEncoder(columns=["brand"]).fit(df).transform(df)
    indexer = StringIndexer(inputCol="brand", outputCol="own", stringOrderType="alphabetAsc", handleInvalid="keep")
    both = indexer.fit(df).transform(mine)
    return both.groupBy((F.col("own") == F.col("brand_code")).alias("same")).agg(F.count("*").alias("n"))
