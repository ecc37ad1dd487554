"""Feature selection: variance, correlation, F and mutual-information ranks."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml import Estimator, Model
from pyspark.ml.feature import VectorSlicer
from pyspark.ml.stat import Correlation, Summarizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from zonewright.operators.base import Stage, hold
from zonewright.operators.information import FINITE, information_of
from zonewright.operators.quantiles import exact_quantiles


def vector_cells(df: DataFrame, features: str = "features", *keep: str) -> DataFrame:
    """``(keep..., i, x)``: the non-zero elements of each vector, long form."""
    parts = df.select(*keep, F.unwrap_udt(features).alias("v"))
    dense = F.transform("v.values", lambda x, i: F.struct(i.alias("i"), x.alias("x")))
    sparse = F.zip_with("v.indices", "v.values", lambda i, x: F.struct(i.alias("i"), x.alias("x")))
    cells = F.when(F.col("v.type") == 1, dense).otherwise(sparse)
    return parts.select(*keep, F.inline(cells)).where("x != 0")


def vector_totals(df: DataFrame, features: str = "features") -> DataFrame:
    """``(i, n, total)``: rows with a non-zero value, and the sum, of each element.

    A task adds up its Arrow batches, so the exchange carries a row per task
    and element, and no cell becomes a row. Elements without cells give none.
    """

    def step(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = np.zeros(0, np.int64), np.zeros(0)
        for part in parts:
            kinds, _, indices, values = part.column(0).flatten()
            for kind in (0, 1):  # sparse, dense
                own = pc.equal(kinds, kind)
                lists = values.filter(own)
                x = lists.flatten().to_numpy(zero_copy_only=False)
                if kind == 0:
                    at = indices.filter(own).flatten().to_numpy(zero_copy_only=False)
                else:
                    sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
                    at = np.arange(len(x)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
                found = x != 0
                at, x = at[found], x[found]
                if len(at):
                    missing = max(int(at.max()) + 1 - len(n), 0)
                    n, total = np.pad(n, (0, missing)), np.pad(total, (0, missing))
                    n += np.bincount(at, minlength=len(n))
                    total += np.bincount(at, x, len(n))
        present = np.flatnonzero(n)
        columns = [pa.array(present.astype(np.int32)), pa.array(n[present]), pa.array(total[present])]
        yield pa.RecordBatch.from_arrays(columns, names=["i", "n", "total"])

    sums = df.select(F.unwrap_udt(features).alias("v")).mapInArrow(step, "i int, n long, total double")
    return sums.groupBy("i").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))


def column_variances(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``(feature, variance)``, population variance, one pass."""
    row = df.agg(*[F.var_pop(F.col(c).cast("double")).alias(f"v{i}") for i, c in enumerate(columns)])
    pairs = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"v{i}").alias("variance")) for i, c in enumerate(columns)])
    return row.select(F.inline(pairs))


def anova_f(df: DataFrame, columns: Sequence[str], label: str) -> DataFrame:
    """``(feature, f_value)`` from per-class sums, all features in one pass.

    Values are centred on the feature mean first, so that the sums of squares
    keep their digits on large values.
    """
    means = df.agg(*[F.avg(F.col(c).cast("double")).alias(f"m{i}") for i, c in enumerate(columns)]).first()
    cells = F.array(*[
        F.struct(F.lit(c).alias("feature"), (F.col(c).cast("double") - F.lit(means[f"m{i}"])).alias("x"))
        for i, c in enumerate(columns)
    ])
    groups = (
        df.where(F.col(label).isNotNull()).select(F.col(label).alias("y"), F.inline(cells))
        .groupBy("feature", "y")
        .agg(F.count("x").alias("n"), F.sum("x").alias("s"), F.sum(F.col("x") * F.col("x")).alias("q"))
    )
    n, s = F.sum("n"), F.sum("s")
    between = F.sum(F.col("s") * F.col("s") / F.col("n")) - s * s / n
    within = F.sum("q") - F.sum(F.col("s") * F.col("s") / F.col("n"))
    f = F.try_divide(between / (F.count("*") - 1), within / (n - F.count("*")))
    return groups.groupBy("feature").agg(f.alias("f_value"))


def binned(df: DataFrame, columns: Sequence[str], bins: int = 10) -> DataFrame:
    """Replace each column by its equal-frequency bin (exact quantile edges)."""
    edges = exact_quantiles(df, columns, [j / bins for j in range(1, bins)])
    new = {}
    for c in columns:
        cuts = sorted({e for e in edges[c] if e is not None})
        new[c] = sum((F.when(F.col(c).cast("double") > F.lit(e), 1).otherwise(0) for e in cuts), F.lit(0))
    return df.withColumns(new)


def mutual_information(df: DataFrame, columns: Sequence[str], label: str, bins: int = 10) -> DataFrame:
    """``(feature, mi)`` in nats between binned features and the label."""
    cells = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("x")) for c in columns])
    joint = (
        binned(df.where(F.col(label).isNotNull()), columns, bins)
        .select(F.col(label).alias("y"), F.inline(cells))
        .groupBy("feature", "x", "y").agg(F.count("*").alias("n"))
    )
    total = lambda *by: F.sum("n").over(Window.partitionBy("feature", *by))
    p = joint.select("feature", "n", total().alias("all"), total("x").alias("nx"), total("y").alias("ny"))
    share = F.col("n") / F.col("all")
    gain = share * F.ln(F.col("n") * F.col("all") / (F.col("nx") * F.col("ny")))
    return p.groupBy("feature").agg(F.greatest(F.sum(gain), F.lit(0.0)).alias("mi"))


def _labelled_cells(df: DataFrame, features: str, label: str, kept: Sequence[int]) -> tuple[DataFrame, DataFrame, int, int]:
    """Non-zero cells ``(y, i, x)`` of the kept elements, class sizes, and the
    numbers of rows and classes."""
    rows = df.where(F.col(label).isNotNull()).select(F.col(label).alias("y"), features)
    sizes = hold(rows.groupBy("y").agg(F.count("*").alias("ny")))
    n, classes = sizes.agg(F.coalesce(F.sum("ny"), F.lit(0)), F.count("*")).first()
    wanted = [int(i) for i in kept]
    return vector_cells(rows, features, "y").where(F.col("i").isin(wanted)), sizes, n, classes


def vector_anova(df: DataFrame, features: str, label: str, kept: Sequence[int]) -> DataFrame:
    """``(i, score)``: F values from the non-zero elements only.

    Zeros enter through the class sizes, and classes without any non-zero
    element through the rows that no other class has. Values are centred on
    the mean.
    """
    cells, sizes, n, classes = _labelled_cells(df, features, label, kept)
    part = cells.groupBy("i", "y").agg(F.sum("x").alias("sx"), F.sum(F.col("x") * F.col("x")).alias("qx")).join(sizes, "y")
    means = part.groupBy("i").agg((F.sum("sx") / n).alias("m"))
    m, ny = F.col("m"), F.col("ny")
    full = part.join(means, "i").select("i", "m", "ny", (F.col("sx") - ny * m).alias("s"), (F.col("qx") - 2 * m * F.col("sx") + ny * m * m).alias("q"))
    absent = F.first("m") * F.first("m") * (n - F.sum("ny"))  # of both sums
    explained = F.sum(F.col("s") * F.col("s") / ny) + absent
    total = F.sum("s") - F.first("m") * (n - F.sum("ny"))
    f = F.try_divide((explained - total * total / n) / (classes - 1), (F.sum("q") + absent - explained) / (n - classes))
    return full.groupBy("i").agg(f.alias("score"))


def vector_information(df: DataFrame, features: str, label: str, kept: Sequence[int], bins: int = 10) -> DataFrame:
    """``(i, score)``: mutual information of each element with the label.

    Zero is a bin of its own; the non-zero values share ``bins`` bins of
    about equal count (edges from bounded quantile sketches). Classes with
    zeros only are accounted for together.
    """
    cells, sizes, n, _ = _labelled_cells(df, features, label, kept)
    probs = [j / bins for j in range(1, bins)]
    edges = hold(cells.groupBy("i").agg(F.array_distinct(F.percentile_approx("x", probs, 1000)).alias("edges")))
    bin_of = F.aggregate("edges", F.lit(1), lambda a, e: a + F.when(F.col("x") > e, 1).otherwise(0))
    joint = cells.join(edges, "i").select("i", "y", bin_of.alias("b")).groupBy("i", "y", "b").agg(F.count("*").alias("n"))
    seen = joint.groupBy("i", "y").agg(F.sum("n").alias("k")).join(sizes, "y")
    zeros = seen.select("i", "y", F.lit(0).alias("b"), (F.col("ny") - F.col("k")).alias("n"), "ny")
    of_bin = F.sum("n").over(Window.partitionBy("i", "b"))
    # In the bin of zeros there are also all rows of the classes not seen.
    others = seen.groupBy("i").agg((n - F.sum("ny")).alias("absent"))
    full = joint.join(sizes, "y").select("i", "y", "b", "n", "ny").unionByName(zeros).join(others, "i")
    full = full.withColumn("nb", of_bin + F.when(F.col("b") == 0, F.col("absent")).otherwise(0))
    gain = F.when(F.col("n") > 0, F.col("n") / n * F.ln(F.col("n") * F.lit(float(n)) / (F.col("nb") * F.col("ny")))).otherwise(0.0)
    zero_bin = F.max(F.when(F.col("b") == 0, F.col("nb")))
    rest = F.when((F.first("absent") > 0), F.first("absent") / n * F.ln(F.lit(float(n)) / zero_bin)).otherwise(0.0)
    return full.groupBy("i").agg(F.greatest(F.sum(gain) + rest, F.lit(0.0)).alias("score"))


def vector_nearest_information(df: DataFrame, features: str, label: str, kept: Sequence[int], k: int = 3) -> DataFrame:
    """``(i, score)``: the nearest-neighbour estimate of each element's
    information on the label. Only non-zero cells are read; the zeros of a
    class are its other rows, one count per element and class."""
    cells, sizes, _, _ = _labelled_cells(df, features, label, kept)
    seen = hold(cells.groupBy("i", "y", "x").agg(F.count("*").alias("n")))
    elements = F.explode(F.array(*[F.lit(int(i)) for i in kept])).alias("i")
    other = sizes.select("y", "ny", elements).join(seen.groupBy("i", "y").agg(F.sum("n").alias("k")), ["i", "y"], "left")
    zeros = other.select("i", "y", F.lit(0.0).alias("x"), (F.col("ny") - F.coalesce("k", F.lit(0))).alias("n")).where("n > 0")
    counts = seen.where(FINITE).unionByName(zeros).withColumnRenamed("i", "feature")
    return information_of(counts, k).select(F.col("feature").alias("i"), F.col("mi").alias("score"))


CORRELATED_BLOCK = 1000


def strong_pairs(data: DataFrame, features: str, kept: np.ndarray, limit: float, block: int = CORRELATED_BLOCK) -> dict[int, list[int]]:
    """``{a: later b}``: positions in ``kept`` correlated beyond the limit.

    Two blocks of columns at a time, so the driver holds a matrix of at most
    2 * ``block`` columns and the pairs found.
    """
    found: dict[int, list[int]] = {}
    starts = range(0, len(kept), block)
    for a in starts:
        for b in starts[a // block :]:
            left = list(range(a, min(a + block, len(kept))))
            right = [] if a == b else list(range(b, min(b + block, len(kept))))
            if len(left) + len(right) < 2:
                continue
            sliced = VectorSlicer(inputCol=features, outputCol="__s", indices=[int(kept[i]) for i in left + right]).transform(data)
            matrix = Correlation.corr(sliced, "__s").first()[0].toArray()
            part = np.abs(np.nan_to_num(matrix))[: len(left), (len(left) if right else 0) :] > limit
            for i, j in zip(*np.nonzero(part)):
                x, y = left[i], (right or left)[j]
                if x < y:
                    found.setdefault(x, []).append(y)
    return {x: sorted(ys) for x, ys in found.items()}


def uncorrelated(strong: dict[int, list[int]], variances: np.ndarray) -> np.ndarray:
    """Which features stay when, of each strong pair, the one of lower
    variance leaves (the later one on ties)."""
    keep = np.ones(len(variances), dtype=bool)
    for i in sorted(strong):
        for j in strong[i]:
            if not keep[i]:
                break
            if keep[j]:
                keep[j if variances[i] >= variances[j] else i] = False
    return keep


class FeatureSelector(Estimator, Stage):
    """Variance, then correlation, then the best ``max_features`` by score:
    ``mutual_info`` (bins), ``nearest_info`` (nearest neighbours), ``f_classif``.
    """

    SETTINGS = {
        "features": "features",
        "output": "selected",
        "label": "label",
        "names": [],
        "variance_threshold": 0.01,
        "correlation_threshold": 0.95,
        "max_features": None,
        "method": "mutual_info",
        "bins": 10,
        "neighbors": 3,
    }

    def _fit(self, df: DataFrame) -> "FeatureSelectorModel":
        features, label = self.get("features"), self.get("label")
        data = df.select(features, *([label] if label in df.columns else [])).persist()
        n, sample_var = data.select(
            F.count("*"), Summarizer.variance(F.col(features))
        ).first()
        variances = np.asarray(sample_var.toArray()) * (n - 1) / max(n, 1)
        names = self.get("names") or [f"f{i}" for i in range(len(variances))]
        kept = np.flatnonzero(variances > self.get("variance_threshold")) if self.get("variance_threshold") > 0 else np.arange(len(variances))
        if self.get("correlation_threshold") < 1.0 and len(kept) > 1:
            strong = strong_pairs(data, features, kept, self.get("correlation_threshold"))
            kept = kept[uncorrelated(strong, variances[kept])]
        scores: dict[str, float] = {}
        limit = self.get("max_features")
        if limit and limit < len(kept):
            if self.get("method") == "mutual_info":
                table = vector_information(data, features, label, kept, self.get("bins"))
            elif self.get("method") == "nearest_info":
                table = vector_nearest_information(data, features, label, kept, self.get("neighbors"))
            elif self.get("method") in ("f_classif", "model"):
                table = vector_anova(data, features, label, kept)
            else:
                raise ValueError(f"unknown method {self.get('method')!r}")
            found = {r["i"]: r["score"] or 0.0 for r in table.collect()}  # one row per feature
            best = sorted(kept, key=lambda i: (-found.get(i, 0.0), i))[:limit]
            kept = np.array(sorted(best))
            scores = {names[i]: found.get(i, 0.0) for i in kept}
        data.unpersist()
        return FeatureSelectorModel(**self.settings(), indices=[int(i) for i in kept], scores=scores)


class FeatureSelectorModel(Model, Stage):
    SETTINGS = {**FeatureSelector.SETTINGS, "indices": [], "scores": {}}

    def feature_names(self) -> list[str]:
        names = self.get("names")
        return [names[i] if names else f"f{i}" for i in self.get("indices")]

    def _transform(self, df: DataFrame) -> DataFrame:
        return VectorSlicer(
            inputCol=self.get("features"), outputCol=self.get("output"), indices=self.get("indices")
        ).transform(df)


class ImportanceSelector(Estimator, Stage):
    """Keep features a small random forest finds important enough."""

    SETTINGS = {
        "features": "features",
        "output": "selected",
        "label": "label",
        "names": [],
        "threshold": 0.001,
        "trees": 50,
        "depth": 10,
        "seed": 42,
    }

    def _fit(self, df: DataFrame) -> FeatureSelectorModel:
        from pyspark.ml.classification import RandomForestClassifier

        forest = RandomForestClassifier(
            featuresCol=self.get("features"), labelCol=self.get("label"), numTrees=self.get("trees"),
            maxDepth=self.get("depth"), seed=self.get("seed"),
        ).fit(df)
        found = forest.featureImportances.toArray()
        names = self.get("names") or [f"f{i}" for i in range(len(found))]
        kept = [int(i) for i in np.flatnonzero(found >= self.get("threshold"))]
        return FeatureSelectorModel(
            features=self.get("features"), output=self.get("output"), label=self.get("label"), names=names,
            indices=kept, scores={names[i]: float(found[i]) for i in kept},
        )
