"""Record-target expressions: cloud, infrastructure, address and mail flags."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from zonewright import vocabulary as V
from zonewright.functions.host import IPV4, count_char, with_name_parts

FEATURE_NAMES: tuple[str, ...] = (
    *[f"data_is_{p}" for p in V.TARGET_CLOUD_PATTERNS],
    "data_is_cloud",
    *[f"data_has_{p}" for p in V.TARGET_INFRA_PATTERNS],
    "data_is_private_ip", "data_is_valid_ipv4", "data_ip_first_octet",
    "data_subdomain_depth", "data_length", "data_same_domain",
    *[f"data_is_{p}" for p in V.MAIL_POLICY_PATTERNS],
)


def matches(text: Column, patterns: Sequence[str]) -> Column:
    return text.rlike("(?i)(" + "|".join(patterns) + ")").cast("int")


def cloud_flags(
    target: Column, patterns: Mapping[str, Sequence[str]] = V.TARGET_CLOUD_PATTERNS
) -> dict[str, Column]:
    flags = {f"data_is_{name}": matches(target, p) for name, p in patterns.items()}
    every = [p for group in patterns.values() for p in group]
    return {**flags, "data_is_cloud": matches(target, every)}


def infra_flags(
    target: Column, patterns: Mapping[str, str] = V.TARGET_INFRA_PATTERNS
) -> dict[str, Column]:
    return {f"data_has_{name}": matches(target, [p]) for name, p in patterns.items()}


def address_flags(target: Column, record_type: Column) -> dict[str, Column]:
    """IPv4 checks for address records; any other record gives zeros."""
    valid = (record_type == "A") & target.rlike(IPV4)
    octets = F.split(target, "[.]")
    first = F.when(valid, F.try_element_at(octets, F.lit(1)).try_cast("int")).otherwise(0)
    second = F.when(valid, F.try_element_at(octets, F.lit(2)).try_cast("int")).otherwise(0)
    private = (
        first.isin(10, 127)
        | ((first == 172) & second.between(16, 31))
        | ((first == 192) & (second == 168))
    )
    return {
        "data_is_private_ip": private.cast("int"),
        "data_is_valid_ipv4": valid.cast("int"),
        "data_ip_first_octet": first,
    }


def mail_flags(target: Column, record_type: Column) -> dict[str, Column]:
    return {
        f"data_is_{name}": F.when(record_type == "TXT", matches(target, [p])).otherwise(0)
        for name, p in V.MAIL_POLICY_PATTERNS.items()
    }


def record_features(
    df: DataFrame,
    data_column: str = "record_data",
    type_column: str = "record_type",
    host_column: str = "fqdn",
    rules: Sequence[str] = V.PUBLIC_SUFFIXES,
    cloud_patterns: Mapping[str, Sequence[str]] = V.TARGET_CLOUD_PATTERNS,
    host_domain: str | None = None,
) -> DataFrame:
    """All record-target features; a no-op without the target column.

    A null target counts as empty text and a missing type column as no type.
    ``host_domain`` names a column that already holds the host's domain, so
    the host is not split again.
    """
    if data_column not in df.columns:
        return df
    target = F.coalesce(F.col(data_column), F.lit(""))
    kind = F.coalesce(F.col(type_column), F.lit("")) if type_column in df.columns else F.lit("")
    features = {
        **cloud_flags(target, cloud_patterns),
        **infra_flags(target),
        **address_flags(target, kind),
        "data_subdomain_depth": count_char(target, ".") + 1,
        "data_length": F.char_length(target),
    }
    out = df
    if host_column in df.columns:
        known = host_domain is not None and host_domain in df.columns
        wanted = {data_column: "__target"} if known else {host_column: "__host", data_column: "__target"}
        out = with_name_parts(df, wanted, rules)
        domain = F.col(host_domain) if known else F.col("__host.domain")
        host = F.coalesce(F.col(host_column), F.lit(""))
        features["data_same_domain"] = (
            (host != "") & (target != "") & (domain == F.col("__target.domain"))
        ).cast("int")
    features.update(mail_flags(target, kind))
    return out.select("*", *[c.alias(n) for n, c in features.items()]).drop("__host", "__target")


def target_parts(
    df: DataFrame,
    data_column: str = "record_data",
    internal_suffixes: Sequence[str] = (".local", ".internal", ".corp"),
    rules: Sequence[str] = V.PUBLIC_SUFFIXES,
) -> DataFrame:
    """Declared extras: the target's suffix and whether it points inside."""
    target = F.lower(F.coalesce(F.col(data_column), F.lit("")))
    inside = F.lit(False)
    for suffix in internal_suffixes:
        inside = inside | F.endswith(target, F.lit(suffix))
    out = with_name_parts(df, {data_column: "__target"}, rules)
    return out.select(
        "*",
        F.col("__target.suffix").alias("data_target_tld"),
        inside.cast("int").alias("data_is_internal"),
    ).drop("__target")
