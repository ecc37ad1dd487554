"""Pooled shares against the max-min formula of isotonic regression."""

from __future__ import annotations

import bisect
import random

import pytest
from pyspark.sql import functions as F

from zonewright.operators import calibrate, evaluate


def max_min(rows):
    """{score: share} by max over starts of min over ends of the mean."""
    counts = {}
    for x, h in rows:
        n, k = counts.get(x, (0, 0))
        counts[x] = (n + 1, k + h)
    xs = sorted(counts)
    out = {}
    for i, x in enumerate(xs):
        best = 0.0
        for a in range(i + 1):
            n = sum(counts[v][0] for v in xs[a:i])
            k = sum(counts[v][1] for v in xs[a:i])
            least = 1.0
            for v in xs[i:]:
                n, k = n + counts[v][0], k + counts[v][1]
                least = min(least, k / n)
            best = max(best, least)
        out[x] = best
    return out


def scores(n, seed=1, digits=2):
    """A third of all rows share one score."""
    rng = random.Random(seed)
    xs = [0.5 if rng.random() < 0.33 else round(rng.random(), digits) for _ in range(n)]
    return [(x, rng.random() < x * x) for x in xs]


@pytest.mark.parametrize("parts", [1, 40])
def test_equals_max_min(spark, parts):
    rows = scores(3000)
    want = max_min(rows)
    df = spark.createDataFrame(rows, "s double, hit boolean")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", str(parts))  # 40 ranges: two rounds of merging
        steps = calibrate.isotonic_steps(df, "s", "hit", None)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    table = sorted(tuple(r) for r in steps.collect())
    assert [r[3] for r in table] == sorted({r[3] for r in table})
    assert sum(r[1] for r in table) == 3000
    assert sum(r[2] for r in table) == sum(h for _, h in rows)
    got = {r["s"]: r["calibrated"] for r in calibrate.calibrated(df, steps, "s").collect()}
    assert got == pytest.approx(want)


def test_resolution_bounds_the_table(spark):
    df = spark.createDataFrame(scores(4000, 2, 6), "s double, hit boolean")
    whole = calibrate.isotonic_steps(df, "s", "hit", None)
    coarse = calibrate.isotonic_steps(df, "s", "hit", 10)
    assert coarse.count() <= 11 < whole.count()
    pair = calibrate.calibrated(calibrate.calibrated(df, whole, "s", "a"), coarse, "s", "b")
    assert pair.agg(F.max(F.abs(F.col("a") - F.col("b")))).first()[0] <= 0.1


def test_scores_between_and_beyond_steps(spark):
    fit = spark.createDataFrame([(0.2, 0), (0.4, 1), (0.4, 0), (0.9, 1)], "s double, hit int")
    steps = calibrate.isotonic_steps(fit, "s", "hit")
    assert sorted(tuple(r) for r in steps.collect()) == [(0.2, 1, 0, 0.0), (0.4, 2, 1, 0.5), (0.9, 1, 1, 1.0)]
    asked = [-3.0, 0.1, 0.2, 0.39, 0.4, 0.6, 0.9, 5.0, float("inf"), float("-inf")]
    lows = [0.2, 0.4, 0.9]
    want = {x: [0.0, 0.5, 1.0][max(0, bisect.bisect_right(lows, x) - 1)] for x in asked}
    df = spark.createDataFrame([(x, "n") for x in [*asked, None, float("nan")]], "s double, p string")  # p: a name of the steps
    out = calibrate.calibrated(df, steps, "s").collect()
    assert len(out) == len(asked) + 2
    assert {r["s"]: r["calibrated"] for r in out if r["s"] in want} == want
    assert [r["calibrated"] for r in out if r["s"] is None or r["s"] != r["s"]] == [None, None]
    assert {r["p"] for r in out} == {"n"}


def test_empty_and_null_rows(spark):
    df = spark.createDataFrame([(None, True), (float("nan"), True), (0.5, None)], "s double, hit boolean")
    steps = calibrate.isotonic_steps(df, "s", "hit")
    assert steps.count() == 0
    assert [r["calibrated"] for r in calibrate.calibrated(df, steps, "s").collect()] == [None] * 3


def test_error_falls_on_other_rows(spark, tmp_path):
    fit = spark.createDataFrame(scores(6000, 3, 4), "confidence double, hit boolean")
    rest = spark.createDataFrame(scores(6000, 4, 4), "confidence double, hit boolean")
    model = calibrate.ConfidenceCalibrator().fit(fit)
    model.save(str(tmp_path / "m"))
    again = calibrate.ConfidenceCalibratorModel.load(str(tmp_path / "m"))
    scored = again.transform(rest)
    error = lambda c: evaluate.calibration_error(evaluate.calibration_of(scored, F.col(c), F.col("hit"))).first()["ece"]
    before, after = error("confidence"), error("calibrated_confidence")
    assert before > 0.1 and after < 0.03
