"""TF-IDF over character or word n-grams, as a fitted stage."""

from __future__ import annotations

import re
import sys
from collections import Counter
from collections.abc import Callable, Iterator, Sequence
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.ml import Estimator, Model
from pyspark.ml.feature import VectorSizeHint
from pyspark.ml.functions import array_to_vector
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from zonewright.functions import text as X
from zonewright.functions.numbers import bind
from zonewright.operators.base import Stage, hold


def term_table(df: DataFrame, terms: str, copies: str | None = None) -> DataFrame:
    """``(term, total, df)`` from a column of term arrays; ``copies`` names the
    number of rows each array stands for.

    Each row lists its terms twice, whole and distinct, so document
    frequencies need no grouping by row: the only exchange carries partial
    counts per term.
    """
    whole = F.struct(F.col(terms).alias("t"), F.lit(1).alias("total"), F.lit(0).alias("df"))
    distinct = F.struct(F.array_distinct(terms).alias("t"), F.lit(0).alias("total"), F.lit(1).alias("df"))
    lists = df.select((F.col(copies) if copies else F.lit(1)).alias("n"), F.inline(F.array(whole, distinct)))
    return (
        lists.select("n", F.explode("t").alias("term"), "total", "df")
        .groupBy("term").agg(F.sum(F.col("total") * F.col("n")).alias("total"), F.sum(F.col("df") * F.col("n")).alias("df"))
    )


cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers need no copy of this module
COUNTED_TERMS = 1 << 19  # terms a task counts before it passes them on


def splitter(
    analyzer: str, low: int, high: int, stop_words: Sequence[str] = (), place: dict[str, int] | None = None
) -> Callable[[str], list]:
    """The terms of one cleaned text, as the expressions of ``functions.text``
    give them: per text a few list steps in place of a nested lambda per term.
    With ``place``, the places of the terms that have one."""

    def placed(terms: list[str]) -> list:
        return terms if place is None else [place[t] for t in terms if t in place]

    def runs(words: list[str]) -> list[str]:
        found = list(words) if low == 1 else []
        for n in range(max(low, 2), high + 1):
            found += map(" ".join, zip(*[words[k:] for k in range(n)]))
        return found

    if analyzer == "char_wb":
        blank = re.compile(r"[ \t\n\x0b\f\r]+")

        @lru_cache(1 << 16)
        def grams(word: str) -> list[str]:
            w = f" {word} "
            sizes = [n for n in range(low, high + 1) if n == low or len(w) >= n]
            return placed([w[i : i + n] for n in sizes for i in range(max(len(w) - n + 1, 1))])

        return lambda text: [g for word in blank.split(text) if word for g in grams(word)]
    if analyzer == "host_word":
        word = re.compile("[a-zA-Z0-9]+")
        return lambda text: placed(runs(word.findall(text)))
    stop = frozenset(stop_words)
    return lambda text: placed(runs([w for w in text.split(" ") if len(w) >= 2 and w not in stop]))


def counted_terms(texts: DataFrame, analyzer: str, low: int, high: int, stop_words: Sequence[str] = ()) -> DataFrame:
    """``(term, total, df)`` from ``(cleaned text, copies)``.

    A task adds up its texts and passes on a row per term, so no occurrence
    becomes a row; it holds at most ``COUNTED_TERMS`` terms and those of a text.
    """
    limit = COUNTED_TERMS

    def batch(total: Counter, rows: Counter) -> pa.RecordBatch:
        columns = [pa.array(total.keys(), pa.string()), pa.array(total.values(), pa.int64()), pa.array(rows.values(), pa.int64())]
        return pa.RecordBatch.from_arrays(columns, names=["term", "total", "df"])

    def step(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = splitter(analyzer, low, high, stop_words)
        total, rows = Counter(), Counter()
        for part in parts:
            for text, copies in zip(*(c.to_pylist() for c in part.columns)):
                for term, n in Counter(split(text)).items():
                    total[term] += n * copies
                    rows[term] += copies
                if len(total) > limit:
                    yield batch(total, rows)
                    total.clear()
                    rows.clear()
        yield batch(total, rows)

    sums = texts.mapInArrow(step, "term string, total long, df long")
    return sums.groupBy("term").agg(F.sum("total").alias("total"), F.sum("df").alias("df"))


def distinct_texts(df: DataFrame, column: str) -> DataFrame:
    """``(text, copies)``, written once. What follows is costly per text, so it
    runs once per distinct text, and over the session's number of shuffle
    partitions, however few tasks read the input. Equal texts are counted ahead
    of the exchange."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return hold(df.groupBy(F.col(column).alias("text")).agg(F.count("*").alias("copies"))).repartition(parts)


def vocabulary_table(
    df: DataFrame, terms: str, max_features: int, min_df: int = 2, max_df: float = 0.95, n_rows: int | None = None, copies: str | None = None
) -> DataFrame:
    """``(term, total, df)`` of the kept terms.

    Terms in fewer than ``min_df`` rows or more than ``max_df`` of the rows
    leave; of the rest the most frequent stay (ties: alphabetical).
    """
    n = df.count() if n_rows is None else n_rows
    return most_frequent(term_table(df, terms, copies), max_features, min_df, max_df, n)


def most_frequent(counts: DataFrame, max_features: int, min_df: int, max_df: float, n: int) -> DataFrame:
    kept = counts.where((F.col("df") >= min_df) & (F.col("df") <= max_df * n))
    return kept.orderBy(F.desc("total"), "term").limit(max_features)


class TermWeights(Estimator, Stage):
    """Sublinear TF-IDF with smoothed idf and unit rows.

    ``analyzer``: char_wb (host characters), host_word (host words) or
    description (words without stop words).
    """

    SETTINGS = {
        "input": "fqdn",
        "output": "fqdn_tfidf",
        "analyzer": "char_wb",
        "low": 2,
        "high": 4,
        "max_features": 500,
        "min_df": 2,
        "max_df": 0.95,
        "stop_words": [],
    }

    def cleaned(self, column: str | None = None) -> Column:
        source = F.col(column or self.get("input"))
        analyzer = self.get("analyzer")
        if analyzer == "char_wb":
            return X.clean_host_text(source)
        if analyzer == "host_word":
            return F.lower(F.coalesce(source, F.lit("")))
        if analyzer == "description":
            return X.clean_description(source)
        raise ValueError(f"unknown analyzer {analyzer!r}")

    def splitting(self) -> tuple:
        return self.get("analyzer"), self.get("low"), self.get("high"), self.get("stop_words")

    def vocabulary(self, df: DataFrame) -> tuple[DataFrame, int]:
        """(term, total, df) of the kept terms, and the number of rows."""
        texts = distinct_texts(df, self.get("input"))
        n = texts.agg(F.coalesce(F.sum("copies"), F.lit(0))).first()[0]
        counts = counted_terms(texts.select(self.cleaned("text").alias("text"), "copies"), *self.splitting())
        return most_frequent(counts, self.get("max_features"), self.get("min_df"), self.get("max_df"), n), n

    def _fit(self, df: DataFrame) -> "TermWeightsModel":
        kept, n = self.vocabulary(df)
        found = kept.orderBy("term").select(
            "term", (F.ln((F.lit(n) + 1.0) / (F.col("df") + 1.0)) + 1.0).alias("idf")
        ).collect()  # at most max_features rows
        return TermWeightsModel(
            **self.settings(), vocabulary=[r["term"] for r in found], idf=[r["idf"] for r in found]
        )


class TermWeightsModel(Model, Stage):
    SETTINGS = {**TermWeights.SETTINGS, "vocabulary": [], "idf": []}
    cleaned = TermWeights.cleaned
    splitting = TermWeights.splitting

    def feature_names(self) -> list[str]:
        return [f"{self.get('input')}_tfidf_{t}" for t in self.get("vocabulary")]

    def weights(self, df: DataFrame) -> DataFrame:
        """Long form: the input columns with ``term, weight`` per present term."""
        names = df.columns
        if not self.get("vocabulary"):
            return df.select("*", F.lit("").alias("term"), F.lit(0.0).alias("weight")).where("false")
        words = F.array(*map(F.lit, self.get("vocabulary")))
        pairs = bind(
            F.unwrap_udt("__weights"),
            lambda v: F.zip_with(v["indices"], v["values"], lambda i, w: F.struct(F.get(words, i).alias("term"), w.alias("weight"))),
        )
        return self._weighted(df, "__weights").select(*names, F.inline(pairs))

    def _weighted(self, df: DataFrame, output: str) -> DataFrame:
        """Texts to sparse weights of unit length, in Arrow batches."""
        idf, splitting = np.array(self.get("idf")), self.splitting()
        place = {term: i for i, term in enumerate(self.get("vocabulary"))}
        kind = pa.struct([("type", pa.int8()), ("size", pa.int32()), ("indices", pa.list_(pa.int32())), ("values", pa.list_(pa.float64()))])

        @arrow_udf(VectorUDT())
        def weigh(texts: pa.Array) -> pa.Array:
            split = splitter(*splitting, place)
            found = [split(text) for text in texts.to_pylist()]
            per_row = np.array([len(places) for places in found], np.int64)
            cells = np.repeat(np.arange(len(found)), per_row) * len(place) + np.fromiter(chain.from_iterable(found), np.int64, per_row.sum())
            cells, counts = np.unique(cells, return_counts=True)  # by row, then place
            row, at = np.divmod(cells, len(place))
            sizes = np.bincount(row, minlength=len(found))
            w = (1.0 + np.log(counts)) * idf[at]
            w /= np.sqrt(np.bincount(row, w * w, len(sizes)))[row]
            ends = pa.array(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32))
            lists = [pa.ListArray.from_arrays(ends, pa.array(x)) for x in (at.astype(np.int32), w)]
            one = [pa.array(np.full(len(sizes), x, t)) for x, t in ((0, np.int8), (len(place), np.int32))]
            return pa.StructArray.from_arrays([*one, *lists], fields=list(kind))

        # Spark 4.1 does not evaluate a Python function that has a lambda in its argument or stands
        # in one. The random number (streams refuse row ids) and the mark keep the optimizer from
        # merging the steps to that.
        source = self.cleaned() if self.get("input") in df.columns else F.lit("")
        cleaned = df.withColumn("__clean", F.when(F.rand(0) + 1 > 0, source))
        return cleaned.withColumn(output, weigh.asNondeterministic()("__clean")).drop("__clean")

    def _transform(self, df: DataFrame) -> DataFrame:
        output = self.get("output")
        if not self.get("vocabulary"):
            return df.withColumn(output, array_to_vector(F.array().cast("array<double>")))
        # With the size declared, assembling needs no look at the first row.
        return VectorSizeHint(inputCol=output, size=len(self.get("idf")), handleInvalid="optimistic").transform(self._weighted(df, output))


class KeywordFlags(Model, Stage):
    """Keyword flags of a description column (nothing to fit)."""

    SETTINGS = {"input": "appdesc", "keywords": list(X.V.DESCRIPTION_KEYWORDS)}

    def feature_names(self) -> list[str]:
        return [f"appdesc_has_{k}" for k in self.get("keywords")]

    def _transform(self, df: DataFrame) -> DataFrame:
        source = F.col(self.get("input")) if self.get("input") in df.columns else F.lit("")
        cleaned = df.select("*", X.clean_description(source).alias("__clean"))
        flags = [
            F.contains("__clean", F.lit(k)).cast("int").alias(f"appdesc_has_{k}") for k in self.get("keywords")
        ]
        return cleaned.select("*", *flags).drop("__clean")
