"""Host-name expressions: structure, keyword flags, public-suffix parts.

Everything is a native column expression, so it runs inside the scan stage:
no shuffle, no Python worker.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from zonewright import vocabulary as V

IPV4_OCTET = "(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
IPV4 = rf"^{IPV4_OCTET}([.]{IPV4_OCTET}){{3}}$"

STRUCTURE_COLUMNS = (
    "fqdn_length", "fqdn_num_dots", "fqdn_num_hyphens", "fqdn_num_digits",
    "fqdn_has_www", "fqdn_num_labels", "fqdn_max_label_length",
    "fqdn_avg_label_length", "fqdn_has_numeric_label", "fqdn_subdomain_depth",
)


def count_char(text: Column, char: str) -> Column:
    return F.char_length(text) - F.char_length(F.replace(text, F.lit(char), F.lit("")))


def structure(host: Column) -> dict[str, Column]:
    dots = count_char(host, ".")
    labels = dots + 1
    return {
        "fqdn_length": F.char_length(host),
        "fqdn_num_dots": dots,
        "fqdn_num_hyphens": count_char(host, "-"),
        "fqdn_num_digits": F.regexp_count(host, F.lit(r"\p{Nd}")),
        "fqdn_has_www": F.startswith(host, F.lit("www.")).cast("int"),
        "fqdn_num_labels": labels,
        "fqdn_max_label_length": F.array_max(F.transform(F.split(host, "[.]"), F.char_length)),
        # The labels hold every character but the dots, so no second pass.
        "fqdn_avg_label_length": (F.char_length(host) - dots) / labels,
        "fqdn_has_numeric_label": host.rlike(r"[.]\p{Nd}+[.]").cast("int"),
        "fqdn_first_label": F.substring_index(host, ".", 1),
    }


def _without_supersets(keywords: Iterable[str]) -> list[str]:
    """A keyword that contains another one can never decide the flag."""
    words = sorted(set(keywords), key=len)
    kept: list[str] = []
    for word in words:
        if not any(k in word for k in kept):
            kept.append(word)
    return kept


def has_keyword(lowered: Column, keywords: Sequence[str], word_boundary: bool = False) -> Column:
    """Whether any keyword occurs in the (lower-cased) text.

    One test over a literal list, as a test per keyword makes generated methods of 8,000
    bytes and more, which the JVM does not compile.
    """
    if word_boundary:
        words = "|".join(r"\Q" + k.lower() + r"\E" for k in keywords)
        return lowered.rlike(rf"(^|[^a-z0-9])({words})($|[^a-z0-9])")
    words = F.array(*map(F.lit, _without_supersets(k.lower() for k in keywords)))
    return F.exists(words, lambda word: F.contains(lowered, word))


def keyword_flags(
    lowered: Column,
    tables: Mapping[str, Sequence[str]],
    prefix: str = "fqdn_",
    word_boundary: bool = False,
) -> dict[str, Column]:
    return {
        prefix + name: has_keyword(lowered, words, word_boundary).cast("int")
        for name, words in tables.items()
    }


def naive_parts(host: Column) -> dict[str, Column]:
    """Last and second-last label, for use without a suffix table."""
    labels = F.split(host, "[.]")
    return {
        "fqdn_tld": F.try_element_at(labels, F.lit(-1)),
        "fqdn_domain": F.try_element_at(labels, F.lit(-2)),
    }


def _host_of(text: Column) -> Column:
    """Host part of a name or URL: no scheme, path, user, port, closing dots."""
    bare = F.regexp_replace(text, r"^([A-Za-z0-9+.\-]+:)?//", "")
    bare = F.substring_index(F.regexp_extract(bare, r"^[^/?#]*", 0), "@", -1)
    bare = F.substring_index(bare, ":", 1)
    plain = F.when(text.rlike("[/?#@:]"), bare).otherwise(text)
    return F.rtrim(F.btrim(plain), F.lit("."))


def _labels(host: Column, count: Column | int) -> Column:
    """The first ``count`` labels, or the last ones if negative."""
    return F.call_function("substring_index", host, F.lit("."), count if isinstance(count, Column) else F.lit(count))


def _by_length(rules: Sequence[str], drop: str) -> dict[int, list[str]]:
    found: dict[int, list[str]] = {}
    for rule in rules:
        found.setdefault(rule.count(".") + 1, []).append(rule.removeprefix(drop))
    return found


def longest_rule(rules: Sequence[str]) -> int:
    return max((r.count(".") + 1 for r in rules), default=1)


def _is_one_of(column: str, names: Sequence[str]) -> Column:
    # As SQL text: one parse instead of a driver call per name.
    quoted = ", ".join("'" + n.replace("\\", "\\\\").replace("'", "\\'") + "'" for n in names)
    return F.expr(f"`{column}` IN ({quoted})")


def suffix_length(endings: Mapping[int, str], labels: Column, rules: Sequence[str]) -> Column:
    """How many closing labels form the public suffix, 0 without a rule.

    Column ``endings[j]`` holds the last j labels in lower case. The longest rule
    wins and an exception beats all. Rules have few labels, so this is a short
    chain of hashed IN-set tests.
    """
    exact = _by_length([r for r in rules if r[:1] not in "*!"], "")
    wild = _by_length([r for r in rules if r.startswith("*.")], "*.")
    exceptions = _by_length([r for r in rules if r.startswith("!")], "!")
    ends_in = lambda j, names: (labels >= j) & _is_one_of(endings[j], names)
    tests: list[tuple[Column, int]] = [(ends_in(j, exceptions[j]), j - 1) for j in sorted(exceptions, reverse=True)]
    for j in sorted(endings, reverse=True):
        if j in exact:
            tests.append((ends_in(j, exact[j]), j))
        if j in wild:
            tests.append(((labels >= j) & _is_one_of(endings[j - 1], wild[j]), j))
    length = F.lit(0)
    for test, value in reversed(tests):
        length = F.when(test, value).otherwise(length)
    return length


def with_name_parts(
    df: DataFrame,
    columns: Mapping[str, str],
    rules: Sequence[str] = V.PUBLIC_SUFFIXES,
) -> DataFrame:
    """Add ``struct<suffix, domain, subdomain>`` for each ``{source: output}``.

    The rules are part of the expression, so the split needs neither a join
    nor a shuffle however large the host table is. Null and blank hosts give
    blank parts; an IPv4 literal is its own domain; without a matching rule
    the last label is the domain.
    """
    host, size, length = ("__{}_" + part for part in ("h", "n", "k"))
    out = df.withColumns(
        {host.format(o): _host_of(F.coalesce(F.col(c), F.lit(""))) for c, o in columns.items()}
    )
    # Each projection computes what the next one mentions more than once.
    ending = {j: "__{}_e" + str(j) for j in range(1, longest_rule(rules) + 1)}
    new = {size.format(o): count_char(F.col(host.format(o)), ".") + 1 for o in columns.values()}
    for j, name in ending.items():
        new.update({name.format(o): F.lower(_labels(F.col(host.format(o)), -j)) for o in columns.values()})
    out = out.withColumns(new)
    out = out.withColumns(
        {
            length.format(o): suffix_length(
                {j: name.format(o) for j, name in ending.items()}, F.col(size.format(o)), rules
            )
            for o in columns.values()
        }
    )

    def parts(o: str) -> Column:
        h, n, k = (F.col(c.format(o)) for c in (host, size, length))
        whole = (h == "") | h.rlike(IPV4)
        return F.struct(
            F.when(whole, "").otherwise(_labels(h, -k)).alias("suffix"),
            F.when(whole, h).when(n > k, F.substring_index(_labels(h, -k - 1), ".", 1)).otherwise("").alias("domain"),
            F.when(whole, "").otherwise(_labels(h, F.greatest(n - k - 1, F.lit(0)))).alias("subdomain"),
        )

    scratch = [c.format(o) for o in columns.values() for c in (host, size, length, *ending.values())]
    return out.withColumns({o: parts(o) for o in columns.values()}).drop(*scratch)


def depth(subdomain: Column) -> Column:
    return F.when(F.coalesce(subdomain, F.lit("")) == "", 0).otherwise(count_char(subdomain, ".") + 1)


def host_features(
    df: DataFrame,
    column: str = "fqdn",
    rules: Sequence[str] | None = V.PUBLIC_SUFFIXES,
    keywords: Mapping[str, Sequence[str]] = V.HOST_KEYWORDS,
    word_boundary: bool = False,
) -> DataFrame:
    """All host features in two projections; a no-op without the column.

    ``rules=None`` uses the last two labels instead of a suffix table.
    """
    if column not in df.columns:
        return df
    host = F.col(column)
    out = df
    if rules is not None:
        out = with_name_parts(df, {column: "__parts"}, rules)
        parts = {
            "fqdn_tld": F.col("__parts.suffix"),
            "fqdn_domain": F.col("__parts.domain"),
            "fqdn_subdomain": F.col("__parts.subdomain"),
            "fqdn_subdomain_depth": depth(F.col("__parts.subdomain")),
        }
    else:
        parts = naive_parts(host)
    out = out.select("*", F.lower(host).alias("__lower"))
    features = {
        **structure(host),
        **parts,
        **keyword_flags(F.col("__lower"), keywords, word_boundary=word_boundary),
    }
    return out.select("*", *[c.alias(n) for n, c in features.items()]).drop("__parts", "__lower")


def is_valid_host(host: Column) -> Column:
    """Syntactic check: strict pattern first, then a lenient label check."""
    strict = host.rlike(V.STRICT_HOST_PATTERN)
    labels = F.split(host, "[.]")
    lenient = (F.size(labels) >= 2) & F.forall(
        labels,
        lambda p: (F.char_length(p) >= 1)
        & (F.char_length(p) <= 63)
        & ~F.startswith(p, F.lit("-"))
        & ~F.endswith(p, F.lit("-")),
    )
    local = F.startswith(host, F.lit("localhost")) | F.endswith(host, F.lit(".local"))
    size = F.char_length(host)
    return (size > 0) & (size <= 253) & (local | strict | lenient)
