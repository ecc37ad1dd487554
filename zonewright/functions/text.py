"""Text cleaning and n-gram expressions (arrays of terms, JVM side)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from zonewright import vocabulary as V


def clean_host_text(text: Column) -> Column:
    return F.lower(F.translate(F.coalesce(text, F.lit("")), ".-", "  "))


def clean_description(text: Column) -> Column:
    """Words of letters, digits and underscores, in lower case, one space apart."""
    plain = F.replace(F.coalesce(text, F.lit("")), F.lit("<CR>"), F.lit(" "))
    return F.btrim(F.regexp_replace(F.lower(plain), r"[^\p{L}\p{N}_]+", " "))


def char_wb_ngrams(text: Column, low: int, high: int) -> Column:
    """Character n-grams inside words that are padded with one space.

    A padded word shorter than ``low`` is emitted once, whole; for larger n a
    word contributes only while it is at least n characters long.
    """

    def windows(word: Column, n: int) -> Column:
        size = F.char_length(word)
        grams = F.transform(
            F.sequence(F.lit(1), F.greatest(size - n + 1, F.lit(1))),
            lambda i: F.substring(word, i, F.lit(n)),
        )
        return grams if n == low else F.when(size >= n, grams).otherwise(F.array().cast("array<string>"))

    words = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    padded = F.transform(words, lambda w: F.concat(F.lit(" "), w, F.lit(" ")))
    return F.flatten(
        F.transform(padded, lambda w: F.concat(*[windows(w, n) for n in range(low, high + 1)]))
    )


def word_ngrams(tokens: Column, low: int, high: int) -> Column:
    """Runs of ``low``..``high`` neighbouring tokens, joined by a space."""

    def grams(n: int) -> Column:
        if n == 1:
            return tokens
        # Neighbours by zipping shifted slices: linear in the token count,
        # whereas slicing per position would be quadratic on long texts.
        count = F.greatest(F.size(tokens) - n + 1, F.lit(0))
        out = F.slice(tokens, 1, count)
        for k in range(1, n):
            out = F.zip_with(
                out, F.slice(tokens, k + 1, count), lambda a, b: F.concat_ws(" ", a, b)
            )
        return out

    return F.concat(*[grams(n) for n in range(low, high + 1)])


def description_terms(text: Column, stop_words: Sequence[str] = (), low: int = 1, high: int = 2) -> Column:
    """Word n-grams of a description; stop words leave before pairing."""
    words = F.filter(F.split(clean_description(text), " "), lambda w: F.char_length(w) >= 2)
    if stop_words:
        words = F.filter(words, lambda w: ~w.isin(list(stop_words)))
    return word_ngrams(words, low, high)


def host_word_terms(host: Column, low: int = 1, high: int = 2) -> Column:
    words = F.regexp_extract_all(F.lower(F.coalesce(host, F.lit(""))), F.lit("([a-zA-Z0-9]+)"), 1)
    return word_ngrams(words, low, high)


def description_flags(
    text: Column, keywords: Sequence[str] = V.DESCRIPTION_KEYWORDS
) -> dict[str, Column]:
    cleaned = clean_description(text)
    return {f"appdesc_has_{k}": F.contains(cleaned, F.lit(k)).cast("int") for k in keywords}


def similarity(left: Column, right: Column) -> Column:
    """``1 - edit distance / longer length``; two empty texts are equal."""
    a, b = F.lower(F.coalesce(left, F.lit(""))), F.lower(F.coalesce(right, F.lit("")))
    longest = F.greatest(F.char_length(a), F.char_length(b))
    return F.when(longest == 0, 1.0).otherwise(1 - F.levenshtein(a, b) / longest)
