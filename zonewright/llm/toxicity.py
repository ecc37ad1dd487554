"""Toxicity scores from a weighted lexicon matched by an Aho-Corasick automaton.

Texts are folded first: compatibility forms and homoglyphs become Latin
letters, digits and signs inside words become the letters they stand for, and
l and i (both written 1) become one letter. Entries are word beginnings and
whole words. Their weights are log odds between toxic and clean labelled
texts, kept where the evidence is strong. A text's weight sum is normalised by
its length; a logistic function gives the score, fitted on the labelled texts
with a lexicon from the other half of them.
Hits inside an exception phrase do not count.

The labelled sample is the only bounded part (``per_label``): it is chosen by a
hash of the id, so it is spread over all labelled rows. Near copies in it are
reduced to one text by a min-hash over five-word shingles, else the chance words
of one copied text would look like evidence.
"""

from __future__ import annotations

import math
import unicodedata
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import ahocorasick
import pyarrow as pa
import regex
import xxhash
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from zonewright.llm.common import held, text_of

PER_LABEL = 20_000
LEXICON_ENTRIES = 20_000
SHORTEST, LONGEST = 4, 7
SLACK = 8.0
MIN_WEIGHT = 1.5
THRESHOLD = 0.3
EXCEPTIONS = ("trash can", "trash bag", "trash bin", "clown fish", "clown car", "not stupid")

# Letters of other scripts that look like Latin ones, and what digits and signs
# stand for inside a word.
HOMOGLYPHS = dict(zip("аеорсухіјѕкмтвнԁһԛԝαορνικτευχ", "aeopcyxijskmtbhdhqwaopvikteux"))
DIGITS = dict(zip("0134578@$", "oieastbas"))
INVISIBLE = "­​‌‍⁠﻿"
MIXED = regex.compile(r"(?<!\S)(?=\S*[0134578@$!|])(?=\S*\p{L})\S+")
SIGN_IN_WORD = regex.compile(r"[!|](?=\p{L})")
DIGIT_TABLE = str.maketrans(DIGITS)


class _Fold(dict):
    """Per character: letters and digits stay, other characters part words."""

    def __missing__(self, code: int):
        c = chr(code)
        value = code if c.isalnum() or unicodedata.category(c) == "Mn" else " "
        self[code] = value
        return value


FOLD = _Fold({ord(k): v for k, v in HOMOGLYPHS.items()} | {ord(c): None for c in INVISIBLE} | {ord("l"): "i"})


def _plain_word(m) -> str:
    return SIGN_IN_WORD.sub("i", m.group()).translate(DIGIT_TABLE)


def fold(text: str) -> str:
    """Folded words, parted by single or more spaces, with one at both ends."""
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text)
    text = MIXED.sub(_plain_word, text.lower())
    return f" {text.translate(FOLD)} "


def features(folded: str) -> set[str]:
    """' stem' for beginnings of words, ' word ' for whole words."""
    out = set()
    for w in set(folded.split()):
        if len(w) <= 40:
            out.add(f" {w} ")
        for k in range(SHORTEST, min(LONGEST, len(w)) + 1):
            out.add(f" {w[:k]}")
    return out


def copy_key(text: str, width: int = 5) -> int:
    """The least hash of the shingles of ``width`` words."""
    words = text.lower().encode().split()
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= width:
        return digest(joined) - (1 << 63)
    at, starts = 0, []
    for w in words:
        starts.append(at)
        at += len(w) + 1
    starts.append(at)
    view = memoryview(joined)
    return min(digest(view[starts[i] : starts[i + width] - 1]) for i in range(len(words) - width + 1)) - (1 << 63)


@dataclass
class Lexicon:
    entries: dict[str, float]
    exceptions: tuple[str, ...] = EXCEPTIONS
    intercept: float = -3.0
    slopes: tuple[float, float] = (1.0, 1.0)
    built: dict = field(default_factory=dict, repr=False, compare=False)

    def matcher(self):
        if "automaton" not in self.built:
            automaton = ahocorasick.Automaton()
            for entry, weight in self.entries.items():
                automaton.add_word(entry, (len(entry), weight))
            for phrase in self.exceptions:
                folded = " " + " ".join(fold(phrase).split()) + " "
                automaton.add_word(folded, (len(folded), None))
            automaton.make_automaton()
            self.built["automaton"] = automaton
        return self.built["automaton"]

    def __getstate__(self):
        return self.__dict__ | {"built": {}}

    def inputs(self, text: str) -> tuple[float, float]:
        """(weight sum by length, log weight sum) of a whole text."""
        folded = fold(text)
        automaton = self.matcher()
        if not len(automaton):
            return 0.0, 0.0
        best: dict[int, float] = {}
        spared: list[tuple[int, int]] = []
        for end, (length, weight) in automaton.iter(folded):
            start = end - length + 1
            if weight is None:
                spared.append((start, end))
            elif weight > best.get(start, 0.0):
                best[start] = weight
        for a, b in spared:
            for start in [s for s in best if a <= s < b]:
                del best[start]
        total = sum(best.values())
        return total / math.log2(2 + folded.count(" ") / 50), math.log1p(total)

    def score(self, text: str) -> float:
        x, y = self.inputs(text)
        z = self.intercept + self.slopes[0] * x + self.slopes[1] * y
        return 1 / (1 + math.exp(-z)) if z > -700 else 0.0


def _mapped(fn: Callable[[str], tuple], schema: pa.Schema):
    """A step over (text, label) batches that gives one row per text."""

    def step(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            rows = [fn(t.as_py()) for t in part.column(0)]
            columns = [pa.array([r[i] for r in rows], schema.field(i).type) for i in range(len(schema))]
            yield pa.RecordBatch.from_arrays([*part.columns, *columns], names=[*part.schema.names, *schema.names])

    return step


def _feature_counts(limit: int = 300_000):
    """(feature, part, n): texts of each part (0 to 3) with the feature."""

    def step(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = [Counter() for _ in range(4)]

        def out():
            for part, c in enumerate(counts):
                items = list(c.items())
                c.clear()
                for i in range(0, len(items), 50_000):
                    names, n = zip(*items[i : i + 50_000])
                    yield pa.RecordBatch.from_arrays([pa.array(names), pa.array([part] * len(n), pa.int32()), pa.array(n, pa.int64())], names=["feature", "part", "n"])

        for batch in parts:
            for text, part in zip(batch.column(0), batch.column(1)):
                counts[part.as_py()].update(features(fold(text.as_py())))
                if sum(map(len, counts)) > limit:
                    yield from out()
        yield from out()

    return step


def sample(labels: DataFrame, id_col: str, label_col: str, per_label: int) -> DataFrame:
    """About ``per_label`` ids of each label (all, if fewer), by hash of the id.
    ``weight``: how many labelled rows of its label a row of the sample stands for."""
    one = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id__")).agg(F.max(label_col).cast("int").alias("label"))
    counts = {r["label"]: r["n"] for r in one.groupBy("label").agg(F.count("*").alias("n")).collect()}
    share = F.lit(0.0)
    for label, n in counts.items():
        share = F.when(F.col("label") == label, F.lit(per_label / n)).otherwise(share)
    chosen = one.where(F.pmod(F.xxhash64("id__"), F.lit(1 << 20)) < share * F.lit(float(1 << 20)))
    return chosen.withColumn("weight", F.greatest(F.lit(1.0), 1 / share))


def learn(
    docs: DataFrame,
    labels: DataFrame,
    training: Callable = lambda id_col: F.lit(True),
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    per_label: int = PER_LABEL,
    entries: int = LEXICON_ENTRIES,
    exceptions: tuple[str, ...] = EXCEPTIONS,
) -> Lexicon:
    """A lexicon from the labelled rows whose id passes ``training``.

    Null labels, ids and texts do not take part. Without toxic or clean rows
    the lexicon is empty and every text gets the same low score.
    """
    ids = sample(labels.where(training(id_col)), id_col, label_col, per_label)
    texts = docs.select(F.col(id_col).alias("id__"), F.col(text_col).cast("string").alias("text")).where(F.col("text").isNotNull())
    chosen = texts.join(F.broadcast(ids), "id__").select("text", "label", "weight")  # at most about 2 * per_label ids of 20 bytes
    keyed = chosen.mapInArrow(_mapped(lambda t: (copy_key(t),), pa.schema([("key", pa.int64())])), "text string, label int, weight double, key long")
    halves = keyed.groupBy("key", "label", "weight").agg(F.min("text").alias("text")).select("text", "label", "weight", F.pmod(F.xxhash64("key"), F.lit(2)).cast("int").alias("half"))
    rows = held(halves)
    sizes = {(r["label"], r["half"]): r["n"] for r in rows.groupBy("label", "half").agg(F.count("*").alias("n")).collect()}
    toxic, clean = ([sizes.get((label, half), 0) for half in (0, 1)] for label in (1, 0))
    if not sum(toxic) or not sum(clean):
        return Lexicon({}, exceptions)
    counts = rows.select("text", (F.col("label") * 2 + F.col("half")).cast("int").alias("part")).mapInArrow(_feature_counts(), "feature string, part int, n long")
    names = ("c0", "c1", "t0", "t1")
    counts = counts.groupBy("feature").agg(*[F.sum(F.when(F.col("part") == i, F.col("n")).otherwise(0)).alias(n) for i, n in enumerate(names)])
    counts = held(counts)
    tested = counts.count()

    def lexicon_of(halves: tuple[int, ...]) -> Lexicon:
        t, c = (sum((F.col(f"{x}{h}") for h in halves), F.lit(0)) for x in "tc")
        found = _strong(counts, t, c, sum(toxic[h] for h in halves), sum(clean[h] for h in halves), tested, entries)
        return Lexicon(found, exceptions)

    lexicon = lexicon_of((0, 1))
    # Fitted on texts that the lexicon at hand has not seen: each half meets the other's.
    others = [lexicon_of((1 - half,)) for half in (0, 1)] if min(*toxic, *clean) else [lexicon, lexicon]
    schema = "text string, label int, weight double, half int, x double, y double"
    scored = None
    for half, other in enumerate(others):
        part = rows.where(F.col("half") == half).mapInArrow(_mapped(other.inputs, pa.schema([("x", pa.float64()), ("y", pa.float64())])), schema)
        scored = part if scored is None else scored.union(part)
    table = held(scored.select(F.col("label").cast("double"), "weight", array_to_vector(F.array("x", "y")).alias("features")))
    model = LogisticRegression(regParam=0.001, maxIter=50, standardization=True, weightCol="weight").fit(table)
    lexicon.intercept, lexicon.slopes = float(model.intercept), tuple(float(v) for v in model.coefficients)
    return lexicon


def _strong(counts: DataFrame, t, c, toxic: int, clean: int, tested: int, entries: int) -> dict[str, float]:
    """Entries with their weights: features far more frequent in toxic texts.

    The evidence (log likelihood ratio) must exceed what the best of ``tested``
    chance features would reach, but for a few that the fit makes up for.
    """

    def term(n, expected):
        return F.when(n > 0, n * F.log(n / expected)).otherwise(F.lit(0.0))

    share, n = toxic / (toxic + clean), t + c
    evidence = 2 * (term(t, n * share) + term(c, n * (1 - share)))
    weight = F.log((t + 0.5) / (toxic + 1)) - F.log((c + 0.5) / (clean + 1))
    least = 2 * math.log(max(tested, 2)) - SLACK
    strong = counts.select("feature", weight.alias("weight"), evidence.alias("evidence")).where((F.col("weight") >= MIN_WEIGHT) & (F.col("evidence") >= least))
    found = strong.orderBy(F.desc("evidence"), "feature").limit(entries).collect()  # ``entries`` bounds the model
    kept: dict[str, float] = {}
    for r in sorted(found, key=lambda r: (len(r["feature"].rstrip()), r["feature"])):
        entry = r["feature"]
        if not any(kept.get(entry[:k], -9.0) >= r["weight"] - 0.7 for k in range(SHORTEST + 1, len(entry))):
            kept[entry] = float(r["weight"])
    return kept


def score(docs: DataFrame, lexicon: Lexicon, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score, predicted) per row; null texts are empty. Rows may repeat."""
    schema = pa.schema([("score", pa.float64())])
    rows = docs.select(text_of(text_col).alias("text"), F.col(id_col).alias(id_col))
    kind = dict(rows.dtypes)[id_col]
    scored = rows.mapInArrow(_mapped(lambda t: (lexicon.score(t),), schema), f"text string, `{id_col}` {kind}, score double")
    return scored.select(id_col, "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def clean(docs: DataFrame, lexicon: Lexicon, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose text is not predicted toxic, with all columns."""
    def step(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            at = part.schema.get_field_index(text_col)
            yield part.filter(pa.array([lexicon.score(t.as_py() or "") < THRESHOLD for t in part.column(at)], pa.bool_()))

    return docs.mapInArrow(step, docs.schema)
