"""Data-quality checks. Each check is one aggregate and returns a small table."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from zonewright import vocabulary as V
from zonewright.functions.host import is_valid_host
from zonewright.functions.numbers import safe_divide

ISSUE = "column_name string, issue_type string, severity string, amount double, message string"
STATS_TYPES = (
    T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType,
)
TYPE_FAMILIES: dict[str, tuple[type, ...]] = {
    "string": (T.StringType,),
    "integer": (T.ByteType, T.ShortType, T.IntegerType, T.LongType),
    "float": (T.FloatType, T.DoubleType),
    "boolean": (T.BooleanType,),
    "datetime": (T.TimestampType, T.TimestampNTZType, T.DateType),
}


def missing_columns(df: DataFrame, required: Sequence[str] = V.REQUIRED_COLUMNS) -> DataFrame:
    absent = [c for c in required if c not in df.columns]
    rows = [(c, "missing_column", "ERROR", None, f"no column {c}, which every table must have") for c in absent]
    return df.sparkSession.createDataFrame(rows, ISSUE)


def type_mismatches(df: DataFrame, declared: Mapping[str, Mapping[str, Any]]) -> DataFrame:
    rows = []
    for column, spec in declared.items():
        family = TYPE_FAMILIES.get(spec.get("type", ""))
        if column in df.columns and family and not isinstance(df.schema[column].dataType, family):
            actual = df.schema[column].dataType.simpleString()
            text = f"{column} is {actual} where {spec['type']} was declared"
            rows.append((column, "invalid_type", "WARNING", None, text))
    return df.sparkSession.createDataFrame(rows, ISSUE)


def unpivot(df: DataFrame, columns: Sequence[str], fields: Mapping[str, Any]) -> DataFrame:
    """One aggregate row to one row per column: ``fields`` maps an output name
    to a function of the column's position."""
    structs = [
        F.struct(F.lit(c).alias("column_name"), *[f(i).alias(n) for n, f in fields.items()])
        for i, c in enumerate(columns)
    ]
    return df.select(F.inline(F.array(*structs)))


def null_counts(df: DataFrame) -> DataFrame:
    """``(column_name, null_count, null_ratio)`` in a single pass."""
    counts = df.agg(
        F.count("*").alias("rows"),
        *[F.count_if(F.col(c).isNull()).alias(f"x{i}") for i, c in enumerate(df.columns)],
    )
    return unpivot(
        counts, df.columns,
        {"null_count": lambda i: F.col(f"x{i}"),
         "null_ratio": lambda i: safe_divide(F.col(f"x{i}"), F.col("rows"))},
    )


def missing_value_issues(
    df: DataFrame, not_nullable: Sequence[str] = (), max_ratio: float = 0.5
) -> DataFrame:
    strict = F.col("column_name").isin(list(not_nullable)) & (F.col("null_count") > 0)
    high = F.col("null_ratio") > max_ratio
    return (
        null_counts(df)
        .where(strict | high)
        .select(
            "column_name",
            F.when(strict, "null_in_non_nullable").otherwise("high_missing_ratio").alias("issue_type"),
            F.when(strict, "ERROR").otherwise("WARNING").alias("severity"),
            F.col("null_count").cast("double").alias("amount"),
            F.concat_ws(" ", F.lit("Missing values in"), F.col("column_name")).alias("message"),
        )
    )


def row_digest(df: DataFrame, columns: Sequence[str] | None = None) -> Column:
    """SHA-256 of the row: each field as ``length:text``, null as ``-``."""
    fields = []
    for c in columns or df.columns:
        kind = df.schema[c].dataType
        text = F.to_json(F.col(c)) if isinstance(kind, (T.ArrayType, T.MapType, T.StructType)) else F.col(c).cast("string")
        fields.append(
            F.when(text.isNull(), "-").otherwise(F.concat(F.char_length(text).cast("string"), F.lit(":"), text))
        )
    return F.sha2(F.concat(*fields), 256)


def duplicate_rows(df: DataFrame) -> DataFrame:
    """``(total_rows, unique_rows, duplicate_ratio)``.

    Only a 32-byte digest per row is shuffled, not the row.
    """
    digests = df.select(F.unhex(row_digest(df)).alias("d")).groupBy("d").agg(F.count("*").alias("n"))
    return digests.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_rows"), F.count("*").alias("unique_rows")
    ).select("*", safe_divide(F.col("total_rows") - F.col("unique_rows"), F.col("total_rows")).alias("duplicate_ratio"))


def repeated_hosts(df: DataFrame, host: str = "fqdn") -> DataFrame:
    """How many hosts (null counts as one) have more than one record."""
    counts = df.groupBy(host).agg(F.count("*").alias("n"))
    return counts.agg(F.count_if(F.col("n") > 1).alias("repeated_hosts"))


def invalid_hosts(df: DataFrame, host: str = "fqdn") -> DataFrame:
    return df.agg(F.count_if(~is_valid_host(F.col(host))).alias("invalid_hosts"))


def invalid_host_examples(df: DataFrame, host: str = "fqdn", size: int = 5) -> DataFrame:
    """The alphabetically first invalid hosts (a report sample)."""
    return df.select(host).where(~is_valid_host(F.col(host))).distinct().orderBy(host).limit(size)


def target_summary(
    df: DataFrame, target: str = "appid", orphan: int = V.ORPHAN_LABEL, rare_below: int = 3
) -> DataFrame:
    """One row; the orphan class and null count as classes, null as labelled."""
    label, n = F.col(target), F.col("n")
    total = F.coalesce(F.sum("n"), F.lit(0))
    orphans = F.coalesce(F.sum(F.when(label == orphan, n)), F.lit(0))
    return (
        df.groupBy(target)
        .agg(F.count("*").alias("n"))
        .agg(
            F.count("*").alias("n_classes"),
            F.coalesce(F.sum(F.when(label < 0, n)), F.lit(0)).alias("negative_count"),
            orphans.alias("orphan_count"),
            (total - orphans).alias("labeled_count"),
            safe_divide(orphans, total).alias("orphan_ratio"),
            F.count_if((n < rare_below) & (label != orphan)).alias("rare_classes"),
        )
    )


def unknown_record_types(df: DataFrame, column: str = "record_type", known: Sequence[str] = V.KNOWN_RECORD_TYPES) -> DataFrame:
    return df.select(column).where(F.col(column).isNotNull() & ~F.col(column).isin(list(known))).distinct()


def distribution(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count("*").alias("n"))


def column_profile(df: DataFrame, exact: bool = True) -> DataFrame:
    """Type, nulls, numeric moments, text distinct count and lengths per column.

    ``exact=False`` replaces the distinct counts (one exchange of the distinct
    values of every text column) by sketches.
    """
    aggregates: list[Column] = [F.count("*").alias("rows")]
    none = {k: F.lit(None).cast("double") for k in ("min", "max", "mean", "std")}
    picks: list[dict[str, Column]] = []
    for i, field in enumerate(df.schema):
        c = F.col(field.name)
        aggregates.append(F.count_if(c.isNull()).alias(f"null{i}"))
        pick = {
            "dtype": F.lit(field.dataType.simpleString()),
            "null_count": F.col(f"null{i}"),
            "null_ratio": safe_divide(F.col(f"null{i}"), F.col("rows")),
            **none,
            "n_unique": F.lit(None).cast("long"),
            "min_length": F.lit(None).cast("int"),
            "max_length": F.lit(None).cast("int"),
        }
        if isinstance(field.dataType, STATS_TYPES):
            aggregates += [
                F.min(c).cast("double").alias(f"min{i}"), F.max(c).cast("double").alias(f"max{i}"),
                F.avg(c).alias(f"mean{i}"), F.stddev_samp(c).alias(f"std{i}"),
            ]
            pick.update({k: F.col(f"{k}{i}") for k in none})
        elif isinstance(field.dataType, T.StringType):
            distinct = F.count_distinct(c) if exact else F.approx_count_distinct(c)
            aggregates += [
                distinct.alias(f"unique{i}"),
                F.min(F.char_length(c)).alias(f"short{i}"), F.max(F.char_length(c)).alias(f"long{i}"),
            ]
            pick["n_unique"] = F.col(f"unique{i}") + (F.col(f"null{i}") > 0).cast("long")
            pick["min_length"], pick["max_length"] = F.col(f"short{i}"), F.col(f"long{i}")
        picks.append(pick)
    names = list(picks[0])
    return unpivot(df.agg(*aggregates), df.columns, {n: lambda i, n=n: picks[i][n] for n in names})


def declared_value_issues(df: DataFrame, declared: Mapping[str, Mapping[str, Any]]) -> DataFrame:
    """Counts of values shorter than ``min_length`` or not in ``allowed_values``."""
    checks = _declared_checks(df, declared)
    if not checks:
        return df.sparkSession.createDataFrame([], "column_name string, issue_type string, violations long")
    counts = df.agg(*[F.count_if(test).alias(f"v{i}") for i, (_, _, test) in enumerate(checks)])
    return unpivot(
        counts, [c for c, _, _ in checks],
        {"issue_type": lambda i: F.lit(checks[i][1]), "violations": lambda i: F.col(f"v{i}")},
    ).where("violations > 0")


def severity_counts(issues: DataFrame) -> DataFrame:
    return issues.groupBy("severity").agg(F.count("*").alias("n"))


@dataclass
class QualityReport:
    issues: DataFrame
    profile: DataFrame
    target: DataFrame | None
    status: DataFrame | None

    @property
    def is_valid(self) -> bool:
        return self.issues.where("severity = 'ERROR'").isEmpty()


def _declared_checks(df: DataFrame, declared: Mapping[str, Mapping[str, Any]]) -> list[tuple[str, str, Column]]:
    """``(column, issue, test)`` of the declared lengths and values."""
    checks: list[tuple[str, str, Column]] = []
    for column, spec in declared.items():
        if column not in df.columns:
            continue
        if spec.get("min_length") is not None:
            checks.append((column, "below_min_length", F.char_length(F.col(column)) < spec["min_length"]))
        if spec.get("allowed_values"):
            checks.append((column, "value_not_allowed", ~F.col(column).isin(list(spec["allowed_values"]))))
    return checks


Finding = tuple[str | None, str, str, Column, Column, str]


def _findings(row: DataFrame, findings: Sequence[Finding]) -> DataFrame:
    """A one-row table to issue rows: (column, issue, severity, when, amount, text)."""
    structs = [
        F.struct(
            F.lit(column).cast("string").alias("column_name"), F.lit(kind).alias("issue_type"),
            F.lit(severity).alias("severity"), amount.cast("double").alias("amount"),
            F.lit(text).alias("message"), when.alias("found"),
        )
        for column, kind, severity, when, amount, text in findings
    ]
    return row.select(F.inline(F.array(*structs))).where("found").drop("found")


def all_issues(
    df: DataFrame,
    required: Sequence[str] = V.REQUIRED_COLUMNS,
    declared: Mapping[str, Mapping[str, Any]] | None = None,
    max_missing_ratio: float = 0.5,
    max_duplicate_ratio: float = 0.1,
    target: str = "appid",
    orphan: int = V.ORPHAN_LABEL,
) -> DataFrame:
    """Every check's findings as one issues table, in three passes: one wide
    aggregate, one over row digests, one that counts hosts, owners and types."""
    declared = declared or {}
    strict = {c for c, spec in declared.items() if not spec.get("nullable", True)}
    n = F.col
    # Pass 1: everything that is a count over rows.
    aggregates, findings = [F.count("*").alias("rows")], []
    for i, c in enumerate(df.columns):
        aggregates.append(F.count_if(F.col(c).isNull()).alias(f"null{i}"))
        nulls, text = n(f"null{i}"), f"Missing values in {c}"
        if c in strict:
            findings.append((c, "null_in_non_nullable", "ERROR", nulls > 0, nulls, text))
        high = safe_divide(nulls, n("rows")) > max_missing_ratio
        findings.append((c, "high_missing_ratio", "WARNING", high & ((nulls == 0) if c in strict else F.lit(True)), nulls, text))
    for i, (c, kind, test) in enumerate(_declared_checks(df, declared)):
        aggregates.append(F.count_if(test).alias(f"bad{i}"))
        findings.append((c, kind, "WARNING", n(f"bad{i}") > 0, n(f"bad{i}"), "Declared values violated"))
    if "fqdn" in df.columns:
        aggregates.append(F.count_if(~is_valid_host(n("fqdn"))).alias("bad_hosts"))
        findings.append(("fqdn", "invalid_fqdn_format", "WARNING", n("bad_hosts") > 0, n("bad_hosts"), "Hosts of invalid format"))
    if target in df.columns:
        aggregates.append(F.count_if(n(target) < 0).alias("negative"))
        findings.append((target, "negative_appid", "WARNING", n("negative") > 0, n("negative"), "Negative owners"))
    found = [missing_columns(df, required), type_mismatches(df, declared), _findings(df.agg(*aggregates), findings)]
    # Pass 2: equal rows.
    ratio = n("duplicate_ratio")
    found.append(_findings(duplicate_rows(df), [(None, "high_duplicate_ratio", "WARNING", ratio > max_duplicate_ratio, ratio, "Duplicate rows")]))
    # Pass 3: values that occur several times, seldom, or should not occur.
    counted = [c for c in ("fqdn", target, "record_type") if c in df.columns]
    if counted:
        cells = F.array(*[F.struct(F.lit(c).alias("column"), n(c).cast("string").alias("value")) for c in counted])
        groups = df.select(F.inline(cells)).groupBy("column", "value").agg(F.count("*").alias("n"))
        repeated = (n("column") == "fqdn") & (n("n") > 1)
        rare = (n("column") == target) & (n("n") < 3) & (n("value") != str(orphan))
        odd = (n("column") == "record_type") & ~n("value").isin(list(V.KNOWN_RECORD_TYPES))
        sums = groups.agg(F.count_if(repeated).alias("repeated"), F.count_if(rare).alias("rare"), F.count_if(odd).alias("odd"))
        found.append(
            _findings(sums, [
                ("fqdn", "duplicate_fqdns", "INFO", n("repeated") > 0, n("repeated"), "Hosts with several records"),
                (target, "rare_classes", "INFO", n("rare") > 0, n("rare"), "Owners with few records"),
                ("record_type", "unknown_record_types", "INFO", n("odd") > 0, n("odd"), "Unknown record types"),
            ])
        )
    return reduce(DataFrame.unionByName, found)


def validate(df: DataFrame, **settings: Any) -> QualityReport:
    target = settings.get("target", "appid")
    return QualityReport(
        all_issues(df, **settings),
        column_profile(df),
        target_summary(df, target) if target in df.columns else None,
        distribution(df, "fqdn_status") if "fqdn_status" in df.columns else None,
    )
