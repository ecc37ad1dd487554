"""Record cleaning: filters, text normalisation, null fill, class policy."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.ml import Estimator, Model
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from zonewright import vocabulary as V
from zonewright.operators.base import Stage, hold
from zonewright.operators.quantiles import exact_quantiles
from zonewright.operators.ranks import sorted_positions

SIGNED = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
FLOATING = (T.FloatType, T.DoubleType)


def filter_records(
    df: DataFrame,
    include_status: Sequence[str] = (),
    exclude_patterns: Sequence[str] = (),
    status_column: str = "fqdn_status",
    host_column: str = "fqdn",
) -> DataFrame:
    """Keep listed statuses; drop hosts in which any pattern is found.

    With a list or pattern set, a null status or host drops the row.
    """
    if include_status and status_column in df.columns:
        df = df.where(F.col(status_column).isin(list(include_status)))
    if host_column in df.columns:
        for pattern in exclude_patterns:
            df = df.where(~F.col(host_column).rlike(pattern))
    return df


def normalized(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), r"(?U)^\s+|\s+$", "")


def normalize_text(
    df: DataFrame, columns: Sequence[str] = V.NORMALIZED_TEXT_COLUMNS, host_column: str = "fqdn"
) -> DataFrame:
    """Lower-case and strip; the host also loses all its closing dots."""
    new = {c: normalized(F.col(c)) for c in columns if c in df.columns}
    if host_column in df.columns:
        new[host_column] = F.rtrim(new.get(host_column, F.col(host_column)), F.lit("."))
    return df.withColumns(new)


def float_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, FLOATING)]


def medians(df: DataFrame, columns: Sequence[str] | None = None) -> dict[str, float]:
    """Median per float column, 0 where all values are null."""
    found = exact_quantiles(df, float_columns(df) if columns is None else columns, [0.5])
    return {c: 0.0 if q[0] is None else q[0] for c, q in found.items()}


def fill_nulls(df: DataFrame, float_values: Mapping[str, float]) -> DataFrame:
    """Text to ``unknown``, signed integers to -1, floats to the given values."""
    new = {}
    for field in df.schema:
        if isinstance(field.dataType, T.StringType):
            value = F.lit("unknown")
        elif isinstance(field.dataType, SIGNED):
            value = F.lit(-1).cast(field.dataType)
        elif field.name in float_values:
            value = F.lit(float_values[field.name]).cast(field.dataType)
        else:
            continue
        new[field.name] = F.coalesce(F.col(field.name), value)
    return df.withColumns(new)


def class_table(
    df: DataFrame,
    target: str = "appid",
    orphan: int = V.ORPHAN_LABEL,
    min_samples: int = 3,
    rare_threshold: int = 5,
    policy: str = "group",
    max_classes: int | None = None,
) -> DataFrame:
    """``(label, n, is_valid, is_rare)`` per class of the owned rows.

    ``max_classes`` keeps only the most frequent valid classes.
    """
    n = F.col("n")
    counts = (
        df.where(F.col(target) != orphan)
        .groupBy(F.col(target).alias("label"))
        .agg(F.count("*").alias("n"))
        .withColumn("is_valid", n >= min_samples)
    )
    if max_classes is not None:
        top = (
            counts.where("is_valid").orderBy(F.desc("n"), "label").limit(max_classes)
            .select("label", F.lit(True).alias("kept"))
        )
        counts = counts.join(top, "label", "left").select(
            "label", "n", (F.col("is_valid") & F.coalesce("kept", F.lit(False))).alias("is_valid")
        )
    rare = F.col("is_valid") & (n < rare_threshold) if policy == "group" else F.lit(False)
    return counts.withColumn("is_rare", rare)


def class_index(classes: DataFrame, rare_label: int = V.RARE_LABEL) -> DataFrame:
    """``(label, idx)``: sorted valid labels, the shared rare label last."""
    labels = classes.where("is_valid").select(
        F.when(F.col("is_rare"), F.lit(rare_label)).otherwise(F.col("label")).cast("long").alias("label"),
        F.col("is_rare"),
    ).distinct()
    return sorted_positions(labels, [], ["is_rare", "label"], "idx").select("label", "idx")


def label_index(df: DataFrame, column: str) -> DataFrame:
    """``(label, idx)`` from raw labels: sorted distinct values."""
    labels = df.select(F.col(column).alias("label")).where("label is not null").distinct()
    return sorted_positions(labels, [], ["label"], "idx")


def apply_class_policy(df: DataFrame, classes: DataFrame, target: str, policy: str, orphan: int, rare_label: int) -> DataFrame:
    if policy == "keep" or target not in df.columns:
        return df
    known = classes.select(F.col("label").alias(target), "is_valid", "is_rare")
    joined = df.join(known, target, "left")
    if policy == "group":
        label = F.when(F.coalesce("is_rare", F.lit(False)), F.lit(rare_label).cast(df.schema[target].dataType))
        joined = joined.withColumn(target, label.otherwise(F.col(target)))
    else:
        joined = joined.where(F.coalesce("is_valid", F.lit(False)) | (F.col(target) == orphan))
    return joined.select(*df.columns)


def encode_labels(
    df: DataFrame, index: DataFrame, column: str, out: str = "label", on_unmapped: str = "null", rare_label: int = V.RARE_LABEL
) -> DataFrame:
    """Class index per row. Unmapped labels give null, the rare class or no row."""
    mapping = index.select(F.col("label").alias(column), F.col("idx").alias(out))
    if on_unmapped == "group":
        known = index.select(F.col("label").alias(column), F.lit(True).alias("__known"))
        df = (
            df.join(known, column, "left")
            .withColumn(column, F.when(F.col("__known"), F.col(column)).otherwise(F.lit(rare_label)))
            .drop("__known")
        )
    if on_unmapped not in ("null", "group", "drop"):
        raise ValueError(f"on_unmapped must be null, group or drop, not {on_unmapped!r}")
    return df.join(mapping, column, "inner" if on_unmapped == "drop" else "left")


def decode_labels(df: DataFrame, index: DataFrame, column: str, out: str) -> DataFrame:
    mapping = index.select(F.col("idx").alias(column), F.col("label").alias(out))
    return df.join(mapping, column, "left")


def feature_columns(columns: Sequence[str], target: str = "appid") -> list[str]:
    return [c for c in columns if c != target and c not in V.NEVER_FEATURES]


def columns_by_role(columns: Sequence[str], text: bool = True, categorical: bool = True, numerical: bool = True) -> list[str]:
    """Columns of the wanted roles. An unlisted column counts as categorical,
    and so does a text or numeric one whose own role is not wanted."""
    if categorical:
        return list(columns)
    wanted = (*(V.TEXT_ROLE if text else ()), *(V.NUMERIC_ROLE if numerical else ()))
    return [c for c in columns if c in wanted]


def apply_overrides(df: DataFrame, prefix: str = "override_") -> DataFrame:
    """Human-verified ``override_x`` values win over ``x``."""
    new = {}
    for c in df.columns:
        base = c.removeprefix(prefix)
        if c.startswith(prefix) and base in df.columns:
            new[base] = F.coalesce(F.col(c), F.col(base))
    return df.withColumns(new)


class RecordCleaner(Estimator, Stage):
    """Filters, normalisation, null fill and class policy, in that order."""

    SETTINGS = {
        "target": "appid",
        "orphan": V.ORPHAN_LABEL,
        "min_samples": 3,
        "policy": "group",
        "rare_threshold": 5,
        "rare_label": V.RARE_LABEL,
        "max_classes": None,
        "include_status": [],
        "exclude_patterns": [],
        # False: float nulls take the median of the fitted table;
        # True: of whichever table is being transformed.
        "stateless": False,
    }

    def _fit(self, df: DataFrame) -> "RecordCleanerModel":
        policy = self.get("policy")
        if policy not in ("group", "drop", "keep"):
            raise ValueError(f"policy must be group, drop or keep, not {policy!r}")
        classes = hold(
            class_table(
                df, self.get("target"), self.get("orphan"), self.get("min_samples"),
                self.get("rare_threshold"), policy, self.get("max_classes"),
            )
        )
        kept = filter_records(df, self.get("include_status"), self.get("exclude_patterns"))
        model = RecordCleanerModel(
            **self.settings(),
            medians={} if self.get("stateless") else medians(kept),
            columns=feature_columns(df.columns, self.get("target")),
        )
        model.tables = {"classes": classes, "index": hold(class_index(classes, self.get("rare_label")))}
        return model


class RecordCleanerModel(Model, Stage):
    SETTINGS = {**RecordCleaner.SETTINGS, "medians": {}, "columns": []}

    @property
    def classes(self) -> DataFrame:
        return self.tables["classes"]

    @property
    def index(self) -> DataFrame:
        return self.tables["index"]

    def _transform(self, df: DataFrame) -> DataFrame:
        out = filter_records(df, self.get("include_status"), self.get("exclude_patterns"))
        out = normalize_text(out)
        out = fill_nulls(out, medians(out) if self.get("stateless") else self.get("medians"))
        return apply_class_policy(
            out, self.classes, self.get("target"), self.get("policy"), self.get("orphan"),
            self.get("rare_label"),
        )

    def for_scoring(self) -> "RecordCleanerModel":
        """The same cleaner without row filters or class policy."""
        return self.with_settings(include_status=[], exclude_patterns=[], policy="keep")
