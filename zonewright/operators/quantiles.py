"""Exact, interpolated quantiles that never gather a column in one task."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from math import ceil, floor, inf, nextafter

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ACCURACY = 10_000
MARGIN = 2 / ACCURACY


@dataclass
class _Part:
    """The ``count`` values of a column in [low, high], and the ranks sought
    in it: ``{rank in the column: rank in the part}``, both from 0."""

    low: float
    high: float
    count: int
    ranks: dict[int, int]

    def shares(self) -> list[float]:
        return [x for r in self.ranks.values() for x in _about((r + 0.5) / self.count)]


def _about(share: float) -> list[float]:
    """The share, and as far to both sides as a sketch may be off."""
    return [min(1.0, max(0.0, x)) for x in (share - MARGIN, share, share + MARGIN)]


def exact_quantiles(df: DataFrame, columns: Sequence[str], probs: Sequence[float]) -> dict[str, list[float | None]]:
    """``{column: [quantile per probability]}``, None for columns without values.

    NaN counts as null. A round takes two passes, both over cells in long form,
    one aggregate for all columns and ranks: the first gives one sketch per part
    of a column (at first the whole column), the second counts exactly between
    the sketch's values around the ranks. Of a column only the parts that hold
    a rank go on; a round makes them thousands of times smaller, and settles
    what has fewer values than the sketch, so 10^12 values take four rounds.
    """
    columns = list(dict.fromkeys(columns))
    if not columns:
        return {}
    df = df.select(*[F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")).alias(f"x{i}") for i, c in enumerate(columns)])
    # The first sketch is asked for the probabilities, so it needs no count ahead of it.
    shares = sorted({x for p in probs for x in _about(p)})
    whole = {i: row for (i, _), row in _per_bucket(df, {i: [] for i in range(len(columns))}, shares).items()}
    places = {i: [(row["n"] - 1) * p for p in probs] for i, row in whole.items()}
    values: dict[int, dict[int, float]] = {i: {} for i in whole}
    live = {i: [_Part(row["low"], row["high"], row["n"], {r: r for x in places[i] for r in (floor(x), ceil(x))})] for i, row in whole.items()}
    near = {(i, row["low"]): row["sketch"] for i, row in whole.items()}
    while live := {i: wide for i, parts in live.items() if (wide := _unsettled(parts, values[i]))}:
        if not near:
            edges = {i: {x for p in parts for x in (p.low, nextafter(p.high, inf))} for i, parts in live.items()}
            shares = sorted({x for parts in live.values() for p in parts for x in p.shares()})
            sketches = {(i, row["low"]): dict(zip(shares, row["sketch"])) for (i, _), row in _per_bucket(df, edges, shares).items()}
            near = {(i, p.low): [sketches[i, p.low][x] for x in p.shares()] for i, parts in live.items() for p in parts}
        # Ends of the parts, and the values around their ranks: each value is a bucket of its own.
        cuts = {i: {x for p in parts for v in (p.low, p.high, *near[i, p.low]) for x in (v, nextafter(v, inf))} for i, parts in live.items()}
        counted = _per_bucket(df, cuts)
        live = {i: [q for p in parts for q in _narrowed(p, [row for (j, _), row in counted.items() if j == i])] for i, parts in live.items()}
        near = {}
    out: dict[str, list[float | None]] = {c: [None] * len(probs) for c in columns}
    for i, at in places.items():
        pairs = [(x, values[i][floor(x)], values[i][ceil(x)]) for x in at]
        out[columns[i]] = [a if a == b else (ceil(x) - x) * a + (x - floor(x)) * b for x, a, b in pairs]
    return out


def _unsettled(parts: list[_Part], values: dict[int, float]) -> list[_Part]:
    """Parts with different values; what is known of the others goes to ``values``."""
    for p in parts:
        if p.low == p.high:
            values.update(dict.fromkeys(p.ranks, p.low))
    return [p for p in parts if p.low != p.high]


def _narrowed(part: _Part, buckets: list[dict]) -> list[_Part]:
    """The buckets of the part that hold a rank."""
    out, before = [], 0
    for row in sorted((b for b in buckets if part.low <= b["low"] and b["high"] <= part.high), key=lambda b: b["low"]):
        ranks = {name: r - before for name, r in part.ranks.items() if before <= r < before + row["n"]}
        if ranks:
            out.append(_Part(row["low"], row["high"], row["n"], ranks))
        before += row["n"]
    return out


def _per_bucket(df: DataFrame, cuts: dict[int, Sequence[float]], shares: list[float] | None = None) -> dict[tuple[int, int], dict]:
    """``{(column, bucket): n, low, high, sketch}`` of the columns named by
    ``cuts``. A bucket goes from one cut up to, without, the next."""
    splits = {i: [-inf, *sorted(c for c in cs if -inf < c < inf), inf] for i, cs in cuts.items()}
    named = {i: s for i, s in splits.items() if len(s) > 2}
    if named:
        df = Bucketizer(
            inputCols=[f"x{i}" for i in named], outputCols=[f"b{i}" for i in named], splitsArray=list(named.values()), handleInvalid="keep"
        ).transform(df)
    cells = F.array(*[
        F.struct(F.lit(i).alias("i"), (F.col(f"b{i}").cast("int") if i in named else F.lit(0)).alias("b"), F.col(f"x{i}").alias("x")) for i in cuts
    ])
    parts = [F.count("*").alias("n"), F.min("x").alias("low"), F.max("x").alias("high")]
    if shares:
        parts.append(F.percentile_approx("x", shares, ACCURACY).alias("sketch"))
    rows = df.select(F.inline(cells)).where("x is not null").groupBy("i", "b").agg(*parts).collect()
    return {(r["i"], r["b"]): r.asDict() for r in rows}
