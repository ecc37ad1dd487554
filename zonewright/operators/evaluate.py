"""Evaluation tables. Class metrics all come from one (true, predicted) count."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from zonewright.functions.numbers import safe_divide

EPSILON = 2.220446049250313e-16


def confusion(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    return df.groupBy(F.col(label).alias("label"), F.col(prediction).alias("prediction")).agg(F.count("*").alias("n"))


def confusion_matrix(pairs: DataFrame, classes: list[int]) -> DataFrame:
    """The counts as a wide table, one column per predicted class."""
    return pairs.groupBy("label").pivot("prediction", classes).agg(F.sum("n")).na.fill(0)


def class_report(pairs: DataFrame) -> DataFrame:
    """Precision, recall, F1, support for every true or predicted class."""
    n = F.col("n")
    # Each pair counts once as a true class and once as a predicted class.
    sides = F.array(
        F.struct(F.col("label").alias("class"), n.alias("support"), F.lit(0).cast("long").alias("predicted"),
                 F.when(F.col("label") == F.col("prediction"), n).otherwise(0).alias("hits")),
        F.struct(F.col("prediction").alias("class"), F.lit(0).cast("long").alias("support"), n.alias("predicted"),
                 F.lit(0).cast("long").alias("hits")),
    )
    totals = pairs.select(F.inline(sides)).groupBy("class").agg(
        F.sum("support").alias("support"), F.sum("predicted").alias("predicted"), F.sum("hits").alias("hits")
    )
    precision = safe_divide(F.col("hits"), F.col("predicted"))
    recall = safe_divide(F.col("hits"), F.col("support"))
    return totals.select(
        "class", "support", precision.alias("precision"), recall.alias("recall"),
        safe_divide(2 * precision * recall, precision + recall).alias("f1"), "hits",
    )


def label_metrics(pairs: DataFrame) -> DataFrame:
    """One row: accuracy, macro and weighted F1, macro precision and recall."""
    total = F.sum("support")
    return class_report(pairs).agg(
        safe_divide(F.sum("hits"), total).alias("accuracy"),
        F.avg("f1").alias("f1_macro"),
        safe_divide(F.sum(F.col("f1") * F.col("support")), total).alias("f1_weighted"),
        F.avg("precision").alias("precision_macro"),
        F.avg("recall").alias("recall_macro"),
    )


def as_rows(metrics: DataFrame) -> DataFrame:
    """A one-row metrics table as ``(metric, value)`` rows."""
    cells = [F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in metrics.columns]
    return metrics.select(F.inline(F.array(*cells)))


def true_rank(probs: Column, label: Column) -> Column:
    """Rank of the true class, 1 = best; ties go to the lower index. A class
    outside the array ranks behind all."""
    own = F.coalesce(F.get(probs, label), F.lit(-1.0))
    ahead = F.filter(probs, lambda p, i: (p > own) | ((p == own) & (i < label)))
    return F.size(ahead) + 1


def probability_metrics(df: DataFrame, n_classes: int, label: str = "label", probs: str = "probs") -> DataFrame:
    """One row: top-3 and top-5 accuracy (0 with too few classes), log loss."""
    p, y = F.col(probs), F.col(label)
    own = F.least(F.greatest(F.coalesce(F.get(p, y), F.lit(0.0)), F.lit(EPSILON)), F.lit(1 - EPSILON))
    rank = true_rank(p, y)
    top = lambda k: F.avg((rank <= k).cast("double")) if n_classes >= k else F.lit(0.0)
    return df.agg(
        top(3).alias("top_3_accuracy"), top(5).alias("top_5_accuracy"), F.avg(-F.ln(own)).alias("log_loss")
    )


def per_class(df: DataFrame, label: str = "label", prediction: str = "prediction", probs: str = "probs") -> DataFrame:
    """Rows, accuracy and mean confidence in the true class, per true class."""
    own, right = F.coalesce(F.get(F.col(probs), F.col(label)), F.lit(0.0)), F.col(label) == F.col(prediction)
    return df.groupBy(F.col(label).alias("class")).agg(
        F.count("*").alias("n_samples"),
        F.avg(right.cast("double")).alias("accuracy"),
        F.avg(own).alias("avg_confidence"),
        F.coalesce(F.avg(F.when(right, own)), F.lit(0.0)).alias("correct_confidence"),
    )


def error_summary(df: DataFrame, label: str = "label", prediction: str = "prediction", probs: str = "probs") -> DataFrame:
    wrong = F.col(label) != F.col(prediction)
    return df.agg(
        F.count_if(wrong).alias("total_errors"),
        F.avg(wrong.cast("double")).alias("error_rate"),
        F.avg(F.when(wrong, F.array_max(probs))).alias("avg_error_confidence"),
    )


def confident_errors(df: DataFrame, key: str, label: str = "label", prediction: str = "prediction", probs: str = "probs", size: int = 100) -> DataFrame:
    """The most confident errors with their three best classes (a report)."""
    from zonewright.operators.voting import top_classes

    return (
        df.where(F.col(label) != F.col(prediction))
        .select(key, F.col(label).alias("label"), F.col(prediction).alias("prediction"), F.array_max(probs).alias("confidence"), probs)
        .orderBy(F.desc("confidence"), key)
        .limit(size)
        .withColumn("top_3", F.transform(top_classes(F.col(probs), 3), lambda x: x["class_idx"]))
        .drop(probs)
    )


def confusion_pairs(pairs: DataFrame, size: int = 10) -> DataFrame:
    """The most frequent confusions (a report)."""
    return pairs.where("label != prediction").orderBy(F.desc("n"), "label", "prediction").limit(size)


def calibration(df: DataFrame, label: str = "label", prediction: str = "prediction", probs: str = "probs", bins: int = 10) -> DataFrame:
    """Per confidence bin: count, mean confidence, accuracy."""
    return calibration_of(df, F.array_max(probs), F.col(label) == F.col(prediction), bins)


def calibration_of(df: DataFrame, confidence: Column, hit: Column, bins: int = 10) -> DataFrame:
    """The same of any confidence, as one that was calibrated."""
    return df.groupBy(F.least(F.floor(confidence * bins), F.lit(bins - 1)).cast("int").alias("bin")).agg(
        F.count("*").alias("n"),
        F.avg(confidence).alias("mean_confidence"),
        F.avg(hit.cast("double")).alias("accuracy"),
    )


def calibration_error(bins: DataFrame) -> DataFrame:
    """Expected calibration error: the weighted gap over the bins."""
    gap = F.abs(F.col("mean_confidence") - F.col("accuracy")) * F.col("n")
    return bins.agg((F.sum(gap) / F.sum("n")).alias("ece"))


def fold_summary(scores: DataFrame, columns: list[str]) -> DataFrame:
    """``(metric, mean, std)`` over folds, population deviation."""
    cells = F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("x")) for c in columns])
    return scores.select(F.inline(cells)).groupBy("metric").agg(F.avg("x").alias("mean"), F.stddev_pop("x").alias("std"))


def top_features(importance: DataFrame, size: int = 50) -> DataFrame:
    return importance.orderBy(F.desc("importance"), "feature").limit(size)
