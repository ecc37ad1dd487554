"""Whole jobs: train and store an owner model, score a table, evaluate."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

from pyspark.ml import Model, PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from zonewright.operators import evaluate as E
from zonewright.operators import quality, score, splits
from zonewright.operators.base import Stage, hold, over_cores, shared_folder
from zonewright.operators.calibrate import ConfidenceCalibrator
from zonewright.operators.clean import RecordCleaner, apply_class_policy, encode_labels
from zonewright.operators.quality import row_digest
from zonewright.plans import members as M
from zonewright.plans.features import FeaturePlan, feature_names
from zonewright.sources import sinks

MODEL_NAME = "owner_classifier"
UNKNOWN_CLASS = -1


class OwnerScorer(Model, Stage):
    """Probabilities to owners: label, confidence, top-k, uncertainty."""

    SETTINGS = {"classes": [], "threshold": 0.3, "top_k": 5, "fallback": None, "entropy_limit": None}

    def _transform(self, df: DataFrame) -> DataFrame:
        out = score.predictions(df, self.get("classes"), "probs", self.get("threshold"), self.get("top_k"))
        if self.get("fallback") is not None:
            out = score.with_fallback(out, self.get("fallback"))
        if self.get("entropy_limit") is not None:
            out = score.with_entropy_rule(out, "probs", self.get("entropy_limit"))
        return out


@dataclass
class Training:
    model: PipelineModel
    metrics: DataFrame
    report: dict[str, DataFrame]
    issues: DataFrame
    unmapped_rows: int
    names: list[str]
    version: str | None = None
    extra: dict[str, Any] = field(default_factory=dict)


def with_key(df: DataFrame, key: str | None) -> tuple[DataFrame, str]:
    """A unique row key: the given column, else row numbers.

    Row numbers depend on the partitions, so the numbered table is written to
    the shared folder first: a lost executor cannot renumber rows. Give a key
    column for splits that repeat from run to run.
    """
    if key is not None:
        return df, key
    shared_folder(df.sparkSession)
    return df.withColumn("__key", F.monotonically_increasing_id()).checkpoint(), "__key"


def train(
    df: DataFrame,
    key: str | None = None,
    target: str = "appid",
    cleaner: dict[str, Any] | None = None,
    features: dict[str, Any] | None = None,
    ensemble: dict[str, Any] | None = None,
    scorer: dict[str, Any] | None = None,
    ratios: tuple[float, float, float] = (0.7, 0.15, 0.15),
    folds: int | None = None,
    trials: int | None = None,
    trial_kind: str = "forest",
    calibrate: bool = False,
    seed: int = 42,
    store: sinks.ModelStore | None = None,
    name: str = MODEL_NAME,
) -> Training:
    """Validate, clean, split, featurise (on training rows only), optionally
    cross-validate or search, fit the ensemble, evaluate on the test rows.

    Boosted members stop on the validation rows, which nothing else is fitted
    on but, with ``calibrate``, the calibrated confidence that scoring adds."""
    settings = {"target": target, **(cleaner or {})}
    orphan = settings.get("orphan", 0)
    issues = quality.all_issues(df, target=target)
    owned = df.where(F.col(target).isNotNull() & (F.col(target) != orphan))
    fitted_cleaner = RecordCleaner(**settings).fit(owned)
    keyed, key = with_key(owned, key)
    # The key stays as it is: cleaning touches text and numbers only.
    clean_rows = fitted_cleaner.transform(keyed)
    labelled = encode_labels(clean_rows, fitted_cleaner.index, target, "label")
    known = labelled.where(F.col("label").isNotNull())
    # Dealt ahead of the features and fits: the input may be a few files, each one task.
    parts = over_cores(splits.split(known, key, *ratios, stratify=target, seed=seed), key).persist()
    unmapped = labelled.where(F.col("label").isNull()).count()
    train_rows = parts.where("split = 'train'")
    plan = FeaturePlan(target=target, **(features or {})).fit(train_rows)
    names = feature_names(plan)
    # Featurise every split once: one pass, reused by each member's iterations.
    ready = plan.transform(parts).select(key, target, "label", "split", "features").persist()
    fit_rows = ready.where("split = 'train'")
    extra: dict[str, Any] = {}
    options = dict(ensemble or {})
    n_classes = fitted_cleaner.index.count()
    if folds:
        numbered = splits.folds(fit_rows, key, folds, "label", seed)
        extra["cv"] = M.cross_validate(numbered, M.Ensemble(n_classes=n_classes, seed=seed, **options), folds)
    if trials:
        best, table = M.search(fit_rows, ready.where("split = 'val'"), trial_kind, trials, seed, n_classes=n_classes)
        extra["search"], extra["best_params"] = table, best
        options.setdefault("members", [{"type": trial_kind, "weight": 1.0, "options": best}])
    watched = ready.where("split <> 'test'").withColumn("is_val", F.col("split") == "val")
    model = M.Ensemble(n_classes=n_classes, seed=seed, validation="is_val", **options).fit(watched)
    tested = hold(model.transform(ready.where("split = 'test'")).drop("features"))  # for the report tables
    calibrator = ConfidenceCalibrator().fit(_judged(model.transform(watched.where("is_val")))) if calibrate else None
    parts.unpersist()
    ready.unpersist()
    report = evaluation(tested, n_classes, key)
    report["importance"] = model.importance_table(df, names)
    classes = [r["label"] for r in fitted_cleaner.index.orderBy("idx").collect()]
    final = PipelineModel(
        [fitted_cleaner.for_scoring(), *plan.stages, model, OwnerScorer(classes=classes, **(scorer or {}))]
    )
    if calibrator is not None:
        final.stages.append(calibrator)
        better = calibrator.transform(_judged(tested))
        report["calibrated"] = E.calibration_of(better, F.col("calibrated_confidence"), F.col("hit"))
    out = Training(final, report["metrics"], report, issues, unmapped, names, extra=extra)
    if store is not None:
        numbers = {r["metric"]: r["value"] for r in report["metrics"].collect()}
        out.version = store.save(final, name, metadata={"metrics": numbers, "classes": len(classes), "features": len(names)})
    return out


def _judged(scored: DataFrame) -> DataFrame:
    """``confidence`` and ``hit`` of rows with ``label``, ``prediction``, ``probs``."""
    return scored.select(F.array_max("probs").alias("confidence"), (F.col("prediction") == F.col("label")).alias("hit"))


def owner_scorer(model: PipelineModel) -> OwnerScorer:
    return next(s for s in model.stages if isinstance(s, OwnerScorer))


def evaluation(scored: DataFrame, n_classes: int, key: str) -> dict[str, DataFrame]:
    """All report tables of rows with ``label``, ``prediction``, ``probs``."""
    pairs = E.confusion(scored)
    overall = E.as_rows(E.label_metrics(pairs)).unionByName(E.as_rows(E.probability_metrics(scored, n_classes)))
    return {
        "metrics": overall,
        "class_report": E.class_report(pairs),
        "per_class": E.per_class(scored),
        "confusion": pairs,
        "confusion_pairs": E.confusion_pairs(pairs),
        "errors": E.error_summary(scored),
        "confident_errors": E.confident_errors(scored, key),
        "calibration": E.calibration(scored),
    }


def save_report(report: dict[str, DataFrame], path: str, top: int = 50) -> None:
    tables = dict(report)
    if "importance" in tables:
        tables["top_features"] = E.top_features(tables.pop("importance"), top)
    sinks.write_tables(tables, path)


def predict(model: PipelineModel, df: DataFrame) -> DataFrame:
    """Score every input row; scoring never filters."""
    return model.transform(df)


def predict_one(model: PipelineModel, spark: SparkSession, fqdn: str, record_type: str | None = None, record_data: str | None = None, **more: str) -> dict[str, Any]:
    row = {"fqdn": fqdn, "record_type": record_type, "record_data": record_data, **more}
    schema = ", ".join(f"`{c}` string" for c in row)
    scored = predict(model, spark.createDataFrame([tuple(row.values())], schema))
    return scored.select("fqdn", "predicted_appid", "confidence", "top_k", "is_uncertain").first().asDict(recursive=True)


def predict_file(model: PipelineModel, df: DataFrame, path: str, kind: str = "csv", keep: tuple[str, ...] = ("fqdn",)) -> DataFrame:
    """Score a table into files; returns the summary of what was written."""
    k = owner_scorer(model).get("top_k")
    sinks.write_predictions(predict(model, df), path, kind, k, keep)
    spark = df.sparkSession
    reader = spark.read.option("header", True) if kind == "csv" else spark.read
    written = reader.format(kind).load(path)
    return score.summary(written.select(F.col("is_uncertain").cast("boolean").alias("is_uncertain"), F.col("confidence").cast("double").alias("confidence")))


def evaluate_stored(model: PipelineModel, df: DataFrame, key: str | None = None, target: str = "appid") -> dict[str, DataFrame]:
    """Report tables of a stored model on labelled records.

    The fitted class policy is applied to the labels, so rare owners are the
    rare class. Rows of owners the model does not know stay, as class -1, and
    count as errors; ``unmapped`` tells how many they are (``rows``,
    ``unmapped_rows``).
    """
    df = df.where(F.col(target).isNotNull())
    if key is None:  # only breaks ties among the reported errors
        df, key = df.withColumn("__key", row_digest(df)), "__key"
    cleaner, classes = model.stages[0], owner_scorer(model).get("classes")
    mapped = apply_class_policy(model.transform(df).drop("label"), cleaner.classes, target, "group", cleaner.get("orphan"), cleaner.get("rare_label"))
    index = df.sparkSession.createDataFrame(list(enumerate(classes)), "idx int, label long")
    scored = hold(encode_labels(mapped, index, target, "label").na.fill(UNKNOWN_CLASS, ["label"]))
    counts = scored.agg(F.count("*").alias("rows"), F.count_if(F.col("label") == UNKNOWN_CLASS).alias("unmapped_rows"))
    return {**evaluation(scored, len(classes), key), "unmapped": counts}


def load(spark: SparkSession, folder: str, name: str = MODEL_NAME, version: str | None = None) -> PipelineModel:
    return sinks.ModelStore(spark, folder).load(name, version)
