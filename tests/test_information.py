"""Mutual information by nearest neighbours against all pairs in plain Python."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from zonewright.operators import choose
from zonewright.operators.information import digamma, nearest_information


def psi(n):
    return -0.57721566490153286 + sum(1 / j for j in range(1, n))


def plain(pairs, k):
    """All pairs of rows of one feature."""
    pairs = [(x, y) for x, y in pairs if x is not None and y is not None and math.isfinite(x)]
    sizes = {}
    for _, y in pairs:
        sizes[y] = sizes.get(y, 0) + 1
    pairs = [(x, y) for x, y in pairs if sizes[y] > 1]
    if not pairs:
        return None
    total = 0.0
    for i, (x, y) in enumerate(pairs):
        of_class = sorted(abs(x - a) for j, (a, b) in enumerate(pairs) if b == y and j != i)
        near = min(k, len(of_class))
        d = of_class[near - 1]
        if d > 0:
            m = sum(x - d < a < x + d for a, _ in pairs)
        else:
            near = 1 + of_class.count(0.0)
            m = sum(a == x for a, _ in pairs)
        total += psi(near) - psi(sizes[y]) - psi(m)
    return max(0.0, psi(len(pairs)) + total / len(pairs))


def mixed_rows(n, seed=3):
    """One class has most rows; one has a single row; one has fewer than k."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        y = rng.choice(["a"] * 7 + ["b", "c"]) if i > 4 else ["one", "two", "two", None, "c"][i]
        shift = {"a": 0, "b": 2, "c": 5}.get(y, 1)
        rows.append((
            y,
            rng.gauss(shift, 1),
            float(rng.randint(0, 3) + shift),
            rng.choice([0.0, -0.0, 0.0, rng.gauss(shift, 1)]),
            rng.choice([None, math.nan, math.inf, rng.random()]),
            None,
            7.0,
        ))
    return rows


COLUMNS = ["normal", "whole", "spiked", "holes", "nothing", "constant"]


@pytest.mark.parametrize(("n", "k"), [(1200, 3), (300, 1), (60, 10)])
def test_equals_all_pairs(spark, n, k):
    rows = mixed_rows(n)
    df = spark.createDataFrame(rows, "y string, " + ", ".join(f"{c} double" for c in COLUMNS)).repartition(7)
    got = {r["feature"]: r["mi"] for r in nearest_information(df, COLUMNS, "y", k).collect()}
    assert set(got) == set(COLUMNS)
    for i, c in enumerate(COLUMNS):
        want = plain([(r[i + 1], r[0]) for r in rows], k)
        assert got[c] is None if want is None else got[c] == pytest.approx(want, abs=1e-8)


def test_ranges_change_nothing(spark):
    """Ranges shorter than k values, so halos reach over several of them."""
    rng = random.Random(5)
    rows = [(i % 2, rng.random(), rng.random()) for i in range(90)]
    df = spark.createDataFrame(rows, "y int, n double, part double")  # names of inner columns
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "60")
        many = {r["feature"]: r["mi"] for r in nearest_information(df, ["n", "part"], "y", 5).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    for i, c in enumerate(["n", "part"]):
        assert many[c] == pytest.approx(plain([(r[i + 1], r[0]) for r in rows], 5), abs=1e-8)


def test_known_amounts(spark):
    """A class that follows from the value: the entropy of the class; an unrelated one: about nothing."""
    rng = random.Random(7)
    rows = [(i % 2, (i % 2) * 10 + rng.random(), rng.random()) for i in range(2000)]
    df = spark.createDataFrame(rows, "label int, told double, noise double")
    got = {r["feature"]: r["mi"] for r in nearest_information(df, ["told", "noise"], "label").collect()}
    assert got["told"] == pytest.approx(math.log(2), abs=0.01)
    assert got["noise"] < 0.03


def test_vectors_count_zeros(spark):
    """Sparse and dense rows; a class without any non-zero value of an element."""
    rng = random.Random(9)
    rows = [(rng.choice("aab"), [rng.choice([0.0, 0.0, rng.random()]), 0.0, rng.gauss(0, 1)]) for _ in range(300)]
    rows = [(y, [v[0] + (y == "b") * (v[0] != 0), float(y == "b"), v[2]]) for y, v in rows]
    table = [(y, Vectors.dense(v) if i % 2 else Vectors.sparse(3, [(j, x) for j, x in enumerate(v) if x])) for i, (y, v) in enumerate(rows)]
    df = spark.createDataFrame(table, ["label", "features"])
    got = {r["i"]: r["score"] for r in choose.vector_nearest_information(df, "features", "label", [0, 1, 2]).collect()}
    for i in range(3):
        assert got[i] == pytest.approx(plain([(v[i], y) for y, v in rows], 3), abs=1e-8)
    model = choose.FeatureSelector(max_features=1, method="nearest_info", correlation_threshold=1.0).fit(df)
    assert model.get("indices") == [1]


def test_empty_tables(spark):
    df = spark.createDataFrame([], "y string, x double")
    assert [tuple(r) for r in nearest_information(df, ["x"], "y").collect()] == [("x", None)]
    assert nearest_information(df, [], "y").collect() == []
    with pytest.raises(ValueError):
        nearest_information(df, ["x"], "y", 0)


def test_digamma(spark):
    for r in spark.range(1, 200, 7).select("id", digamma(F.col("id")).alias("psi")).collect():
        assert r["psi"] == pytest.approx(psi(r["id"]), abs=1e-10)
