"""Every registered query agrees, row by row, with its SQL; the plans look as intended."""

import os
import re

import duckdb
import pytest
from conftest import plan_of
from oracle_compare import connect, differences
from pyspark.sql import functions as F

import __spark_entry__ as contract
from catalogue import queries as q
from catalogue.oracle import ORACLE
from supplypanel.operators import topk

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


def test_keys():
    assert set(q.QUERIES) == set(ORACLE)
    assert set(q.QUERIES) <= set(contract.queries()) and set(ORACLE) <= set(contract.oracle_sql())


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_sql(spark, con, name):
    df = contract.queries()[name](spark, FOLDER)
    assert differences(df, con, contract.oracle_sql()[name]) == []


@pytest.mark.parametrize("name", ["spending_patterns", "demographic_shares", "dictionary_join"])
def test_query_matches_sql_without_broadcast(spark, con, no_broadcast, name):
    df = contract.queries()[name](spark, FOLDER)
    assert differences(df, con, contract.oracle_sql()[name]) == []


def test_entry(spark):
    out = contract.entry(spark)
    assert out.columns == ["section_no", "line", "section", "item", "metric", "text"]
    assert out.count() > 0


@pytest.mark.parametrize("name", sorted(q.QUERIES))
def test_plans_stay_in_the_engine(spark, name):
    plan = plan_of(contract.queries()[name](spark, FOLDER))
    for bad in ("Python", "CartesianProduct", "BroadcastNestedLoopJoin"):
        assert bad not in plan


def test_top_k_is_bounded_per_task(spark):
    for query in (q.top_suppliers, q.top_suppliers_chart, q.top_states):
        plan = plan_of(query(spark, FOLDER))
        assert "TakeOrderedAndProject" in plan and "rangepartitioning" not in plan
    assert "WindowGroupLimit" in plan_of(q.top_conditions(spark, FOLDER))
    assert "WindowGroupLimit" in plan_of(q.name_categories(spark, FOLDER))


def test_large_joins_do_not_broadcast(spark, no_broadcast):
    plan = plan_of(q.demographic_shares(spark, FOLDER))
    assert "BroadcastExchange" not in plan and plan.count("SortMergeJoin") == 3


def scans(plan):
    return set(re.findall(r"/sf0\.001/(\w+)\.parquet", plan))


def test_only_needed_tables_and_columns_are_read(spark):
    plan = plan_of(q.top_states(spark, FOLDER))
    assert scans(plan) == {"lineitem", "supplier", "nation"}
    plan = plan_of(q.spending_patterns(spark, FOLDER))
    assert scans(plan) == {"lineitem", "orders", "part"}
    assert "l_tax" not in plan and "o_totalprice" not in plan and "o_orderpriority" not in plan


def test_later_expressions_do_not_undo_top_k(spark):
    top = topk.top_rows(q.table(spark, FOLDER, "orders"), "o_totalprice", ["o_orderkey"], 5000)
    text = F.concat(F.col("twice").cast("string"), F.col("twice").cast("string"))
    plan = plan_of(top.withColumn("twice", F.col("o_totalprice") * 2).withColumn("text", text))
    assert "TakeOrderedAndProject" in plan and "rangepartitioning" not in plan


@pytest.mark.parametrize("name", ["top_states", "year_filter", "latest_year"])
def test_years_reach_the_scan(spark, name):
    plan = plan_of(q.QUERIES[name](spark, FOLDER))
    pushed = re.search(r"PushedFilters: \[[^\]]*l_shipdate[^\]]*\]", plan).group()
    assert "GreaterThanOrEqual" in pushed and "LessThan" in pushed


def test_union_of_years_reads_each_part_once(spark):
    plan = plan_of(q.panel_union(spark, FOLDER))
    assert scans(plan) == set()  # the order lines were read once, for the stored panel
    assert len(re.findall(r"PartitionFilters: \[isnotnull\(year", plan)) == 7


@pytest.fixture
def shifted(spark, tmp_path):
    """The tables with all ship dates three years later."""
    for path in os.listdir(FOLDER):
        if path != "lineitem.parquet":
            os.symlink(f"{FOLDER}/{path}", tmp_path / path)
    lines = spark.read.parquet(f"{FOLDER}/lineitem.parquet")
    later = F.expr("cast(l_shipdate + interval 3 years as timestamp_ntz)")
    path = str(tmp_path / "lineitem.parquet")
    lines.withColumn("l_shipdate", later).coalesce(1).write.parquet(path)
    return str(tmp_path)


@pytest.mark.parametrize("name", ["panel_union", "panel_load", "full_report", "chart_bundle", "latest_year"])
def test_other_years(spark, shifted, name):
    con = duckdb.connect()
    for table in os.listdir(shifted):
        path = f"{shifted}/{table}" + "/*.parquet" * os.path.isdir(f"{shifted}/{table}")
        con.execute(f"CREATE VIEW {table.split('.')[0]} AS SELECT * FROM '{path}'")
    sql = ORACLE[name]
    assert differences(q.QUERIES[name](spark, shifted), con, sql) == []
    assert con.execute("SELECT max(year(l_shipdate)) FROM lineitem").fetchall() == [(2004,)]


def test_aggregates_come_before_rows_are_multiplied(spark):
    plan = plan_of(q.demographic_shares(spark, FOLDER))
    assert plan.index("Generate inline") < plan.index("HashAggregate")
