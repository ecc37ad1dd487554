"""Categorical encoders and numeric scaling, as fitted stages."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Estimator, Model
from pyspark.ml.feature import OneHotEncoder
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from zonewright import vocabulary as V
from zonewright.operators.base import Stage, hold
from zonewright.operators.quantiles import exact_quantiles
from zonewright.operators.ranks import sorted_positions
from zonewright.operators.splits import hash_order

STRATEGIES = ("label", "target", "frequency", "onehot")
SUFFIX = {"label": "", "target": "_target_encoded", "frequency": "_freq_encoded", "onehot": "_onehot"}


def long_values(df: DataFrame, columns: Sequence[str], *keep: str) -> DataFrame:
    """``(column, value, keep...)``: one row per cell, values as text."""
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns])
    return df.select(*keep, F.inline(cells))


def value_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``(column, value, n)`` of the non-null values, all columns in one pass."""
    cells = long_values(df, columns).where("value is not null")
    return cells.groupBy("column", "value").agg(F.count("*").alias("n"))


def label_codes(
    df: DataFrame, columns: Sequence[str], min_frequency: int | None = None, max_categories: int | None = None
) -> DataFrame:
    """``(column, value, code)``: codes 0.. over the sorted kept values.

    Ranks are over the distinct values of a column, never over rows; see
    ``sorted_positions`` for columns with very many of them.
    """
    counts = value_counts(df, columns)
    if min_frequency:
        counts = counts.where(F.col("n") >= min_frequency)
    if max_categories:
        ordered = counts.withColumn("less", -F.col("n"))
        counts = sorted_positions(ordered, ["column"], ["less", "value"], "r").where(F.col("r") < max_categories)
    coded = sorted_positions(counts.select("column", "value"), ["column"], ["value"], "code")
    return coded.withColumn("code", F.col("code").cast("double"))


def target_means(df: DataFrame, columns: Sequence[str], target: str, smoothing: float = 10.0) -> DataFrame:
    """``(column, value, code)``: class mean shrunk towards the global mean.

    The row with a null value holds the global mean, for anything unseen.
    """
    everything = df.agg(F.avg(F.col(target).cast("double"))).first()[0]
    mean = F.lit(everything).cast("double")
    groups = (
        long_values(df, columns, F.col(target).cast("double").alias("t"))
        .where("value is not null")
        .groupBy("column", "value")
        .agg(F.sum("t").alias("total"), F.count("t").alias("n"))
        .select("column", "value", ((F.coalesce("total", F.lit(0.0)) + mean * smoothing) / (F.col("n") + smoothing)).alias("code"))
    )
    rest = F.array(*[F.struct(F.lit(c).alias("column"), F.lit(None).cast("string").alias("value"), mean.alias("code")) for c in columns])
    return groups.unionByName(df.sparkSession.range(1).select(F.inline(rest)))


def ordered_target_codes(df: DataFrame, columns: Sequence[str], target: str, key: str, smoothing: float = 10.0, seed: int = 42) -> DataFrame:
    """``(key, column, code)``: each row's value by the targets of earlier rows
    only, so that a training row does not see its own target.

    Rows come in the order of ``md5(seed|key)``; ``key`` names a row. The code
    is the mean of the earlier rows with the value, shrunk towards the global
    mean as in ``target_means``, which serves rows that are not trained on.
    Null targets add nothing; a null value has no row here.

    All columns' cells lie in one global order, (column, value, place), cut into
    ranges. A range sums its own cells; what stands ahead of it comes from one
    total per range and value. So a value with a third of all rows is as many
    tasks as it has ranges.
    """
    mean = F.lit(df.agg(F.avg(F.col(target).cast("double"))).first()[0]).cast("double")
    cells = long_values(df, columns, F.col(key).alias("key"), F.col(target).cast("double").alias("t"), hash_order(key, seed).alias("place"))
    order = ["column", "value", "place", "key"]
    ranged = hold(cells.where("value is not null").repartitionByRange(*order).withColumn("range", F.spark_partition_id()))
    group = ["range", "column", "value"]
    inside = Window.partitionBy(*group).orderBy("place", "key").rowsBetween(Window.unboundedPreceding, -1)
    own = ranged.select(*group, "key", F.coalesce(F.sum("t").over(inside), F.lit(0.0)).alias("s"), F.count("t").over(inside).alias("n"))
    totals = ranged.groupBy(*group).agg(F.coalesce(F.sum("t"), F.lit(0.0)).alias("ts"), F.count("t").alias("tn"))
    before = Window.partitionBy("column", "value").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ahead = totals.select(*group, F.coalesce(F.sum("ts").over(before), F.lit(0.0)).alias("as"), F.coalesce(F.sum("tn").over(before), F.lit(0)).alias("an"))
    code = (F.col("s") + F.col("as") + mean * smoothing) / (F.col("n") + F.col("an") + smoothing)
    return own.join(ahead, group).select("key", "column", code.alias("code"))


def ordered_target_encoding(df: DataFrame, columns: Sequence[str], target: str, key: str, smoothing: float = 10.0, seed: int = 42) -> DataFrame:
    """``df`` with ``c_ordered_encoded`` per column; a null value has the global mean."""
    mean = F.lit(df.agg(F.avg(F.col(target).cast("double"))).first()[0]).cast("double")
    codes = ordered_target_codes(df, columns, target, key, smoothing, seed)
    wide = codes.groupBy(F.col("key").alias("__key")).agg(*[F.max(F.when(F.col("column") == c, F.col("code"))).alias(f"__{i}") for i, c in enumerate(columns)])
    out = df.join(wide, F.col(key) == F.col("__key"), "left")
    return out.select(*[F.col(f"`{c}`") for c in df.columns], *[F.coalesce(f"__{i}", mean).alias(f"{c}_ordered_encoded") for i, c in enumerate(columns)])


def frequencies(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``(column, value, code)``: share of all rows, nulls included."""
    total = max(df.count(), 1)
    return value_counts(df, columns).select("column", "value", (F.col("n") / total).alias("code"))


def choose_strategies(df: DataFrame, columns: Sequence[str], default: str = "label", threshold: int = 100) -> DataFrame:
    """``(column, n_values, strategy)``: many distinct values -> target encoding."""
    counts = value_counts(df, columns).groupBy("column").agg(F.count("*").alias("n_values"))
    return counts.withColumn("strategy", F.when(F.col("n_values") > threshold, "target").otherwise(default))


def interactions(df: DataFrame, pairs: dict[str, tuple[str, str]] = V.INTERACTIONS) -> DataFrame:
    """Concatenated columns ``a_b``; a missing value leaves the pair null."""
    return df.withColumns(
        {name: F.concat(F.col(a), F.lit("_"), F.col(b)) for name, (a, b) in pairs.items() if {a, b} <= set(df.columns)}
    )


class CategoryEncoder(Estimator, Stage):
    """Encode categorical columns; absent columns are skipped.

    ``strategies`` overrides ``strategy`` per column.
    """

    SETTINGS = {
        "columns": [],
        "strategy": "label",
        "strategies": {},
        "target": None,
        "smoothing": 10.0,
        "min_frequency": None,
        "max_categories": None,
    }

    def _fit(self, df: DataFrame) -> "CategoryEncoderModel":
        chosen = {c: self.get("strategies").get(c, self.get("strategy")) for c in self.get("columns") if c in df.columns}
        for strategy in chosen.values():
            if strategy not in STRATEGIES:
                raise ValueError(f"unknown strategy {strategy!r}; use one of {STRATEGIES}")
        of = lambda *kinds: [c for c, s in chosen.items() if s in kinds]
        tables = []
        ranked = of("label", "onehot")
        if ranked:
            tables.append(label_codes(df, ranked, self.get("min_frequency"), self.get("max_categories")))
        if of("target"):
            tables.append(target_means(df, of("target"), self.get("target"), self.get("smoothing")))
        if of("frequency"):
            tables.append(frequencies(df, of("frequency")))
        codes = df.sparkSession.createDataFrame([], "column string, value string, code double")
        for table in tables:
            codes = codes.unionByName(table)
        codes = hold(codes)
        sizes = {r["column"]: r["n"] for r in codes.where("value is not null").groupBy("column").agg(F.count("*").alias("n")).collect()}
        means = {r["column"]: r["code"] for r in codes.where("value is null").collect()}
        defaults = {}
        for c, s in chosen.items():
            defaults[c] = float(sizes.get(c, 0)) if s in ("label", "onehot") else means.get(c) if s == "target" else 0.0
        model = CategoryEncoderModel(**self.settings(), chosen=chosen, defaults=defaults)
        model.tables = {"codes": codes}
        return model


class CategoryEncoderModel(Model, Stage):
    SETTINGS = {**CategoryEncoder.SETTINGS, "chosen": {}, "defaults": {}}

    @property
    def codes(self) -> DataFrame:
        return self.tables["codes"]

    def output_columns(self) -> list[str]:
        """Label encoding writes ``c_code`` beside ``c``; see ``feature_names``."""
        return [c + (SUFFIX[s] or "_code") for c, s in self.get("chosen").items()]

    def feature_names(self) -> list[str]:
        return [c + SUFFIX[s] for c, s in self.get("chosen").items()]

    def _transform(self, df: DataFrame) -> DataFrame:
        out, names = df, list(df.columns)
        plain = [f.name for f in df.schema if isinstance(f.dataType, T.AtomicType)]
        for (c, strategy), target in zip(self.get("chosen").items(), self.output_columns()):
            default = self.get("defaults")[c]
            if c not in df.columns:
                out = out.withColumn(target, F.lit(default))
                names.append(target)
                continue
            known = self.codes.where((F.col("column") == c) & F.col("value").isNotNull()).select(
                F.col("value").alias("__value"), F.col("code").alias("__code")
            )
            # Nulls match nothing; should the join move rows, they go to many tasks.
            nowhere = F.concat(F.lit("\0null-"), F.pmod(F.xxhash64(*plain), F.lit(1024)).cast("string"))
            out = out.withColumn("__lookup", F.coalesce(F.col(c).cast("string"), nowhere))
            out = out.join(known, F.col("__lookup") == F.col("__value"), "left")
            out = out.withColumn(target, F.coalesce("__code", F.lit(default))).drop("__lookup", "__value", "__code")
            if strategy == "onehot":
                out = sparse_slots(out, target, int(default))
            names.append(target)
        return out.select(*names)


def sparse_slots(df: DataFrame, column: str, size: int) -> DataFrame:
    """A code to a sparse vector of ``size``; the code one past the last, of
    unseen values, to all zeros."""
    slots = df.sparkSession.range(max(size, 1)).select(F.col("id").cast("double").alias("__slot"))
    encoder = OneHotEncoder(inputCol="__slot", outputCol=column, dropLast=True, handleInvalid="keep").fit(slots)
    return encoder.transform(df.withColumnRenamed(column, "__slot")).drop("__slot")


def fill_numeric(df: DataFrame, columns: Sequence[str], strategy: str = "median", constant: float = -1.0) -> DataFrame:
    """Null and NaN numbers to the column's mean or median, or a constant."""
    if strategy == "median":
        values = {c: q[0] for c, q in exact_quantiles(df.select(*[F.nanvl(F.col(c).cast("double"), F.lit(None)).alias(c) for c in columns]), columns, [0.5]).items()}
    elif strategy == "mean":
        row = df.agg(*[F.avg(F.nanvl(F.col(c).cast("double"), F.lit(None))).alias(f"m{i}") for i, c in enumerate(columns)]).first()
        values = {c: row[f"m{i}"] for i, c in enumerate(columns)}
    elif strategy == "constant":
        values = {c: constant for c in columns}
    else:
        raise ValueError(f"strategy must be mean, median or constant, not {strategy!r}")
    return df.withColumns(
        {c: F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(None)), F.lit(values[c]).cast("double")) for c in columns}
    )


def clip_outliers(df: DataFrame, columns: Sequence[str], lower: float = 0.01, upper: float = 0.99) -> DataFrame:
    """Values outside the exact quantiles move to them; nulls stay null."""
    bounds = exact_quantiles(df, columns, [lower, upper])
    clipped = {}
    for c, (low, high) in bounds.items():
        if low is not None:
            value = F.least(F.greatest(F.col(c), F.lit(low)), F.lit(high))
            clipped[c] = F.when(F.col(c).isNotNull(), value)
    return df.withColumns(clipped)


class NumericScaler(Estimator, Stage):
    """standard (population deviation), minmax, robust (quartiles) or none.

    Fitting ignores nulls; transforming counts a null as 0 before scaling. A
    spread of 0 divides by 1. ``methods`` overrides ``method`` per column.
    """

    SETTINGS = {"columns": [], "method": "standard", "methods": {}}

    def _fit(self, df: DataFrame) -> "NumericScalerModel":
        columns = [c for c in self.get("columns") if c in df.columns]
        methods = {c: self.get("methods").get(c, self.get("method")) for c in columns}
        aggregates, scales = [], {}
        for i, c in enumerate(columns):
            x = F.col(c).cast("double")
            pair = {
                "standard": (F.avg(x), F.stddev_pop(x)),
                "minmax": (F.min(x), F.max(x) - F.min(x)),
                "robust": (F.lit(None), F.lit(None)),
                "none": (F.lit(0.0), F.lit(1.0)),
            }.get(methods[c])
            if pair is None:
                raise ValueError(f"unknown scaling {methods[c]!r}")
            aggregates += [pair[0].alias(f"c{i}"), pair[1].alias(f"s{i}")]
        row = df.agg(F.count("*"), *aggregates).first()
        robust = exact_quantiles(df, [c for c in columns if methods[c] == "robust"], [0.25, 0.5, 0.75])
        for i, c in enumerate(columns):
            center, spread = row[f"c{i}"], row[f"s{i}"]
            if c in robust and robust[c][0] is not None:
                center, spread = robust[c][1], robust[c][2] - robust[c][0]
            scales[c] = [float(center or 0.0), float(spread or 1.0)]
        return NumericScalerModel(**self.settings(), scales=scales)


class NumericScalerModel(Model, Stage):
    SETTINGS = {**NumericScaler.SETTINGS, "scales": {}}

    def output_columns(self) -> list[str]:
        return [f"{c}_scaled" for c in self.get("scales")]

    def feature_names(self) -> list[str]:
        return list(self.get("scales"))

    def _transform(self, df: DataFrame) -> DataFrame:
        new = {}
        for c, (center, spread) in self.get("scales").items():
            x = F.coalesce(F.col(c).cast("double"), F.lit(0.0)) if c in df.columns else F.lit(0.0)
            new[f"{c}_scaled"] = (x - center) / spread
        return df.withColumns(new)
