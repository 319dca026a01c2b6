"""How the plans behave on hot keys, and where intermediate results go."""

import os

import pytest
from conftest import plan_of, rows
from pyspark.sql import functions as F

from supplypanel import session
from supplypanel.operators import charts
from catalogue import order_panel as op


@pytest.fixture
def small_skew_limits(spark, no_broadcast):
    """Limits scaled down as far as the data, so that skew handling shows."""
    limits = {
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "100KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "100KB",
    }
    before = {k: spark.conf.get(k) for k in limits}
    for k, v in limits.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def hot_tables(spark, n=200_000):
    """A third of all lines belong to one order, one customer, one part, one supplier."""
    i = F.col("id")
    hot = i % 3 == 0
    lines = spark.range(n).select(
        F.when(hot, 0).otherwise(i % 5000).alias("l_orderkey"),
        F.when(hot, 0).otherwise(i % 700).alias("l_partkey"),
        F.when(i % 6 == 0, 1).otherwise(i % 997).alias("l_suppkey"),
        (F.rand(7) * 90_000).alias("l_extendedprice"),  # random, so that size follows rows
        F.lit(0.1).alias("l_discount"),
        F.lit("R").alias("l_returnflag"),
        F.lit("F").alias("l_linestatus"),
        F.lit("2000-05-05").cast("timestamp_ntz").alias("l_shipdate"),
    )
    tables = {
        "lineitem": lines,
        "orders": spark.range(5000).select(
            i.alias("o_orderkey"), (i % 40).alias("o_custkey"), F.lit("2-HIGH").alias("o_orderpriority")
        ),
        "part": spark.range(700).select(
            i.alias("p_partkey"), F.element_at(F.array(*map(F.lit, op.TYPE_BIT)), (i % 6 + 1).cast("int")).alias("p_type")
        ),
        "customer": spark.range(40).select(i.alias("c_custkey"), (i * 200.0).alias("c_acctbal")),
    }
    return tables.__getitem__


def test_skewed_joins_are_split(spark, small_skew_limits):
    panel = op.order_panel(hot_tables(spark), [*op.AGE_COLUMNS, *op.PAYMENT_COLUMNS])
    panel.collect()
    plan = plan_of(panel)
    assert "isFinalPlan=true" in plan
    assert plan.count("SortMergeJoin(skew=true)") == 2, plan  # on part and on order


def test_hot_groups_are_reduced_before_the_shuffle(spark):
    plan = plan_of(op.order_panel(hot_tables(spark), [*op.CLAIM_COLUMNS, *op.AGE_COLUMNS]))
    steps = [line.split("[")[0] + line for line in plan.splitlines() if "HashAggregate(" in line]
    assert len(steps) == 6  # order, customer, supplier-year: each before and after a shuffle
    assert sum("partial_" in step for step in steps) == 3


def test_shares_shuffle_the_counts_once(spark):
    df = spark.range(1000).select(F.concat(F.lit("c"), F.col("id") % 7).alias(charts.RUCA))
    out = charts.ruca_share(df)
    assert sum(r["Suppliers"] for r in out.collect()) == 1000
    assert "ReusedExchange" in plan_of(out) or plan_of(out).count("Exchange hashpartitioning") == 1


def test_settled_results_are_read_from_the_shared_folder(spark):
    df = spark.createDataFrame([(1, None)], "a int, b string")
    settled = session.settle(df, "small")
    assert rows(settled) == [(1, None)]
    assert settled.schema == df.schema
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        assert shared.rstrip("/") in settled.inputFiles()[0]


class Settings:
    def __init__(self, **values):
        self.conf = self
        self.values = {k.replace("_", "."): v for k, v in values.items()}

    def get(self, key, default=None):
        return self.values.get(key, default)


def test_scratch_folder_follows_the_session():
    named = session.scratch_folder(Settings(**{"spark.checkpoint.dir": "hdfs://x/y/"}), "n")
    assert named.startswith("hdfs://x/y/n-")
    unset = Settings(**{"spark.sql.warehouse.dir": "hdfs://x/warehouse"})
    first, second = session.scratch_folder(unset, "n"), session.scratch_folder(unset, "n")
    assert first != second and first.startswith("hdfs://x/warehouse/_scratch/n-")
    for path in (named, first, second):
        session._MADE.remove(path)


def test_scratch_is_deleted(spark):
    kept = session.settle(spark.range(3), "kept")
    folder = session._MADE[-1]
    assert kept.count() == 3
    session.drop_folder(spark, folder)
    assert folder not in session._MADE and not os.path.exists(folder.removeprefix("file:"))


def test_shuffle_partitions_grow_with_the_input():
    assert session.shuffle_partitions(1) == 200
    assert session.shuffle_partitions(10**12) == 7451
    assert session.shuffle_partitions(100 * 10**12) == 745_059
