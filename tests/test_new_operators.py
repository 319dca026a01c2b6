"""Features, sums of doubles, repeated rows and change over a whole table, against plain Python."""

import math
import random
from collections import Counter

import pytest
from conftest import plan_of, rows
from pyspark.sql import functions as F

from supplypanel.operators import change, duplicates, exact_sums, features


SEEN: dict[str, float] = {}


@pytest.mark.parametrize("fill", [True, False])
def test_change_over_a_whole_table(spark, fill):
    rng = random.Random(1)
    data = [(rng.randint(0, 40), i, rng.choice([None, None, 0.0, 1.5, 2.0, 7.0])) for i in range(600)]
    data += [(20, i, None if i < 900 else 4.0) for i in range(600, 1000)]  # a third has one key
    df = spark.createDataFrame(data, "k int, i int, v double").repartition(5)
    out = change.ordered_change(df, {"v": "c"}, ["k", "i"], fill)
    assert out.columns == ["k", "i", "v", "c"]
    got = {(r.k, r.i): r.c for r in out.collect()}
    last = before = None
    for k, i, v in sorted(data, key=lambda r: r[:2]):
        now = last if fill and v is None else v
        expected = None if now is None or not before else (now / before - 1) * 100
        assert got[k, i] == (None if expected is None else pytest.approx(expected, abs=1e-12)), (k, i)
        last = before = now
    none = change.ordered_change(df.limit(0), {"v": "c"}, ["k", "i"], fill)
    assert rows(none) == []


def test_change_deals_rows_to_many_tasks(spark):
    merged = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(merged, "false")  # as small ranges are otherwise
    df = spark.range(0, 10_000, numPartitions=4).select(F.col("id").alias("k"), (F.col("id") + 1.0).alias("v"))
    dealt = df.repartitionByRange("k").withColumn("p", F.spark_partition_id()).groupBy("p").count().collect()
    assert len(dealt) > 4 and max(r["count"] for r in dealt) < 3000
    out = {r.k: r.c for r in change.ordered_change(df, {"v": "c"}, ["k"]).collect()}
    assert out[0] is None
    spark.conf.set(merged, "true")
    assert all(out[k] == pytest.approx(((k + 1) / k - 1) * 100) for k in range(1, 10_000))


@pytest.mark.parametrize("partitions", [1, 3, 17])
def test_sums_of_doubles_have_no_order(spark, partitions):
    rng = random.Random(2)
    one_bin = [rng.uniform(-1e9, 1e9) for _ in range(500)] + [2.0**-40 * 3, 2.0**39]
    data = [("one", x) for x in rng.choices([v for v in one_bin if abs(v) >= 1], k=2000)]
    wide = [rng.choice([1, -1]) * math.ldexp(rng.random() + 0.5, rng.randint(-1070, 1000)) for _ in range(400)]
    data += [("wide", x) for x in wide]
    data += [("pow", math.ldexp(1.0, k)) for k in range(-45, 45)] + [("none", None), (None, -0.0), (None, 0.1)]
    data += [("inf", math.inf), ("inf", 1.0), ("nan", math.inf), ("nan", -math.inf), ("nan2", math.nan)]
    rng.shuffle(data)
    df = spark.createDataFrame(data, "k string, v double").withColumn("w", F.col("v")).repartition(partitions)
    got = {r.k: r.v for r in exact_sums.exact_sums(df, ["v", "w"], ["k"]).collect()}
    assert got["one"] == math.fsum(x for k, x in data if k == "one")
    assert got["wide"] == pytest.approx(math.fsum(wide), rel=1e-15)
    assert got["pow"] == math.fsum(x for k, x in data if k == "pow")
    assert got["none"] == 0.0 and got[None] == 0.1 and got["inf"] == math.inf
    assert math.isnan(got["nan"]) and math.isnan(got["nan2"])
    assert got["wide"] == SEEN.setdefault("wide", got["wide"])  # whatever the partitions
    assert [tuple(r) for r in exact_sums.exact_sums(df.where("k = 'none'"), ["v"]).collect()] == [(0.0,)]


def test_repeated_rows(spark):
    rng = random.Random(3)
    data = [(rng.choice([None, 1, 2]), rng.choice([None, "a", "b"]), rng.choice([0.5, None])) for _ in range(30)]
    data += [(i, str(i), None) for i in range(5000)] + [(77, "x", 1.0)] * 2000
    df = spark.createDataFrame(data, "a int, b string, count double").repartition(4)
    counts = Counter(data)
    got = {tuple(r)[:3]: r.n for r in duplicates.repeated_rows(df, "n").collect()}
    assert got == {row: n for row, n in counts.items() if n > 1}
    assert Counter(rows(duplicates.distinct_rows(df))) == Counter(set(data))
    assert rows(duplicates.repeated_rows(df.limit(0), "n")) == []


def test_only_rows_that_may_repeat_are_shuffled(spark):
    df = spark.range(100_000).select(F.col("id"), F.lit("x").alias("y"))
    shared = duplicates._shared_slots(df)(duplicates._slot(df))
    assert df.where(shared).count() < 6000  # 100,000 rows in four million slots


def test_features(spark):
    data = [(v, level, key) for v, level, key in zip(
        [1.0, 2.0, 2.0, 3.0, 10.0, None, math.nan], ["a", "a", "b", "c", "b", None, "a"], [1, 1, 2, 2, None, 3, 3]
    )]
    df = spark.createDataFrame(data, "v double, level string, key int")
    plan = features.FeaturePlan({"v": 4}, {"level": 2}, ["v"], {"key": "v"})
    state = features.fit_features(df, plan)
    asked = [(2.5, "zz", 9), (1.0, "a", 1), (100.0, "b", 2), (None, None, None), (-math.inf, "c", 3), (math.nan, "a", 1)]
    out = features.apply_features(spark.createDataFrame(asked, "v double, level string, key int"), state)
    assert out.columns == ["v", "level", "key", "v_bin", "level_code", "v_z", "v_by_key"]
    got = {r.level or "": tuple(r)[3:] for r in out.collect() if r.v is None or not math.isnan(r.v)}
    mean, std = 3.6, math.sqrt(sum((x - 3.6) ** 2 for x in (1, 2, 2, 3, 10)) / 4)
    # cut points 2, 2, 3: two distinct ones
    assert got["zz"][:2] == (2, 0) and got["zz"][3] == pytest.approx(mean)
    assert got["a"][:2] == (1, 1) and got["a"][2] == pytest.approx((1 - mean) / std) and got["a"][3] == 1.5
    assert got["b"][:2] == (3, 2) and got["b"][3] == 2.5
    assert got[""] == (None, None, None, pytest.approx(mean))
    assert got["c"][:2] == (1, 0) and got["c"][3] == pytest.approx(mean)
    [nan] = [r for r in out.collect() if r.v is not None and math.isnan(r.v)]
    assert nan.v_bin is None and nan.v_z is None and nan.level_code == 1


def test_features_of_nothing(spark):
    df = spark.createDataFrame([], "v double, level string, key int")
    plan = features.FeaturePlan({"v": 4}, {"level": 2}, ["v"], {"key": "v"})
    state = features.fit_features(df, plan)
    one = spark.createDataFrame([(1.0, "a", 1)], "v double, level string, key int")
    assert rows(features.apply_features(one, state)) == [(1.0, "a", 1, None, 0, None, None)]
    same = spark.createDataFrame([(5.0, "a", 1)] * 3, "v double, level string, key int")
    state = features.fit_features(same, plan)
    assert rows(features.apply_features(one, state)) == [(1.0, "a", 1, 1, 1, None, 5.0)]


def test_the_state_is_one_row_whatever_the_table(spark):
    df = spark.range(20_000).select(F.col("id").cast("double").alias("v"), F.col("id").cast("string").alias("level"))
    state = features.fit_features(df, features.FeaturePlan({"v": 8}, {"level": 50}, ["v"]))
    [row] = state.single.collect()
    assert len(row["level|codes"]) == 50 and len(row["v|cuts"]) == 7
    plan = plan_of(features.apply_features(df, state))
    assert "Join" not in plan and "Exchange hashpartitioning" not in plan.split("Subquery")[0]
