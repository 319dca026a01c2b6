"""Cleaning and summaries against hand-made and brute-force results."""


import math
import random
from itertools import combinations

import numpy as np
import pytest
from conftest import plan_of, rows
from pyspark.sql import functions as F

from catalogue import queries as q
from supplypanel.operators import profile, quantiles

FOLDER = "/root/testdata/sf0.001"


def test_missing_counts_fill_and_drop(spark):
    df = spark.createDataFrame([(1, None, "x"), (None, None, "y"), (3, 4, "z")], "a int, b int, c string")
    assert rows(profile.missing_counts(df)) == [("a", 1, 33.33), ("b", 2, 66.67), ("c", 0, 0.0)]
    assert rows(profile.fill_missing(df, {"a": 9})) == [(1, None, "x"), (9, None, "y"), (3, 4, "z")]
    assert rows(profile.drop_missing(df)) == [(3, 4, "z")]
    assert rows(profile.drop_missing(df, ["a"])) == [(1, None, "x"), (3, 4, "z")]


def test_first_per_key_with_a_hot_key(spark):
    df = spark.range(30_000).select(
        F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).alias("k"), (-F.col("id")).alias("v")
    )
    first = profile.first_per_key(df, ["k"], ["v"])
    assert first.where("k = 7").collect()[0]["v"] == -29_997
    assert first.count() == df.select("k").distinct().count()
    assert "WindowGroupLimit" in plan_of(first)


def test_correlation_skips_incomplete_pairs(spark):
    df = spark.createDataFrame([(1.0, 2.0), (2.0, 4.0), (3.0, None), (4.0, 8.0)], "a double, b double")
    [(first, second, value)] = rows(profile.correlations(df, ["a", "b"]))
    assert (first, second) == ("a", "b") and value == pytest.approx(1.0)


@pytest.mark.parametrize("width", [2, 4, 5, 9, 13])
def test_correlations_against_numpy(spark, width):
    rng = random.Random(width)
    names = [f"c.{i}" for i in range(width)]
    data = [
        (rng.choice(["a", "b", None]), *[rng.choice([None, rng.gauss(0, 1), i * k / 50.0]) for i in range(width)])
        for k in range(300)
    ]
    df = spark.createDataFrame(data, ", ".join(["k string", *[f"`{c}` double" for c in names]])).repartition(3)
    got = {(r.k, r["first"], r["second"]): r["correlation"] for r in profile.correlations(df, names, ["k"]).collect()}
    assert len(got) == 3 * width * (width - 1) // 2
    for (key, first, second), value in got.items():
        i, j = names.index(first) + 1, names.index(second) + 1
        assert i < j
        both = [(r[i], r[j]) for r in data if r[0] == key and r[i] is not None and r[j] is not None]
        assert value == pytest.approx(np.corrcoef(np.array(both).T)[0, 1], abs=1e-12)


def test_correlations_of_nothing(spark):
    df = spark.createDataFrame([], "k string, " + ", ".join(f"c{i} double" for i in range(6)))
    names = [f"c{i}" for i in range(6)]
    out = rows(profile.correlations(df, names))
    assert sorted(r[:2] for r in out) == list(combinations(names, 2)) and {r[2] for r in out} == {None}
    assert rows(profile.correlations(df, names, ["k"])) == []
    with pytest.raises(ValueError):
        profile.correlations(df, ["c0"])


def test_wide_correlations_stay_in_generated_code(spark):
    names = [f"c{i}" for i in range(94)]
    df = spark.range(500).select((F.col("id") % 2).alias("k"), *[F.rand(i).alias(c) for i, c in enumerate(names)])
    out = profile.correlations(df, names, ["k"])
    found = out.collect()
    assert len(found) == 2 * 94 * 93 // 2 and all(-1 <= r["correlation"] <= 1 for r in found)
    plan = plan_of(out).split("Initial Plan")[0]
    assert plan.count("Range (") == 1 and plan.count("Exchange") == 1
    aggregates = [line for line in plan.splitlines() if "HashAggregate(" in line]
    assert len(aggregates) == 2 and all("*(" in line for line in aggregates)


@pytest.mark.parametrize("n", [1, 2, 3, 4, 7, 1000])
def test_quantiles_against_sorted_values(spark, n):
    rng = random.Random(n)
    data = [
        (rng.choice(["a", None]), rng.choice([rng.lognormvariate(0, 9), -1.5, 1e300, 3.0]))
        for _ in range(n)
    ]
    df = spark.createDataFrame([*data, ("a", None), ("a", math.nan)], "k string, v double")
    out = {(r.k, r.quantile): r.value for r in profile.quantiles(df, "v", ["k"], [0.25, 0.5, 0.9]).collect()}
    for k in {k for k, _ in data}:
        values = sorted(v for x, v in data if x == k)
        for q in (0.25, 0.5, 0.9):
            assert out[k, q] == values[max(math.ceil(q * len(values)), 1) - 1]


@pytest.mark.parametrize("accuracy", [10_000, 3])
def test_quantiles_of_extreme_values(spark, monkeypatch, accuracy):
    """Infinities and the largest doubles, also where the sketch is too coarse to be right."""
    monkeypatch.setattr(quantiles, "ACCURACY", accuracy)
    inf = math.inf
    sets = {
        "inf": [1.0, 2.0, 5.0, inf],
        "both": [-inf, -inf, 0.0, -0.0, inf],
        "wide": [1e308, -1e308, 1.7e308, -1.7e308, 5e-324, -5e-324],
        "same": [3.0] * 50,
        "many": [math.ldexp(x, 900) for x in range(-500, 500)],
        "none": [],
    }
    data = [(k, v) for k, values in sets.items() for v in [*values, math.nan, None]]
    df = spark.createDataFrame(data, "k string, v double").repartition(7)
    shares = [0.0, 0.25, 0.5, 0.75, 1.0]
    out = {(r.k, r.quantile): r.value for r in profile.quantiles(df, "v", ["k"], shares).collect()}
    for k, values in sets.items():
        values = sorted(values)
        for q in shares:
            expected = values[max(math.ceil(q * len(values)), 1) - 1] if values else None
            assert out.get((k, q)) == expected, (k, q)


def test_quantiles_take_two_scans(spark, monkeypatch):
    """The rows are read once for the brackets and once inside them, for all columns."""
    reads = []
    own = quantiles._ranked
    monkeypatch.setattr(quantiles, "_ranked", lambda *a: reads.append(1) or own(*a))
    df = spark.range(20_000).select(
        (F.col("id") % 3).alias("k"), (F.hash("id") / 7).alias("a"), (F.col("id") % 11).alias("b")
    )
    out = profile.describe_columns(df, ["a", "b"], ["k"]).collect()
    values = {(k, c): sorted(r[c] for r in df.where(F.col("k") == k).collect()) for k in range(3) for c in "ab"}
    for r in out:
        own_values = values[r.k, r.column]
        assert (r.q1, r.median, r.q3) == tuple(
            own_values[math.ceil(q * len(own_values)) - 1] for q in (0.25, 0.5, 0.75)
        )
    assert len(reads) == 1


def test_outliers_of_infinite_values(spark):
    inf = math.inf
    data = [("a", v) for v in [1.0, 2.0, 3.0, 4.0, inf, math.nan, None]] + [("b", inf), ("b", inf), ("b", 1.0)]
    df = spark.createDataFrame(data, "k string, v double")
    assert rows(profile.outliers(df, "v", ["k"])) == [("a", inf)]


def test_outliers_of_a_missing_key_and_without_keys(spark):
    data = [(None, float(v)) for v in [*range(20), 1_000_000]] + [("a", float(v)) for v in range(20)]
    df = spark.createDataFrame(data, "k string, v double")
    assert rows(profile.outliers(df, "v", ["k"])) == [(None, 1_000_000.0)]
    assert rows(profile.outliers(df, "v")) == [(None, 1_000_000.0)]
    assert rows(profile.outliers(df.limit(0), "v", ["k"])) == []


def test_quartiles_of_a_description(spark):
    df = spark.createDataFrame([(None, 4.0), (None, 1.0), (None, 2.0), ("x", None)], "k string, v double")
    out = {r.k: (r.q1, r.median, r.q3) for r in profile.describe_columns(df, ["v"], ["k"]).collect()}
    assert out == {None: (1.0, 2.0, 4.0), "x": (None, None, None)}
