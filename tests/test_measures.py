"""Totals, shares, weighted means, change and ranking on small hand-made tables."""

import pytest
from conftest import rows
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from supplypanel.operators import categories, change, charts, measures, topk
from supplypanel.operators.selection import select_latest_year, select_year
from supplypanel.sources.dictionary import column_table, dictionary_table

DICTIONARY = {"a": "First - long text", "b": "Second", "c": "Third"}
SLOW = settings(
    max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture]
)


def test_sum_of_nothing_is_zero(spark):
    df = spark.createDataFrame([(1, None), (1, None), (2, 5)], "year int, a bigint")
    assert sorted(rows(measures.column_totals(df, ["a"], ["year"]))) == [(1, 0), (2, 5)]
    with pytest.raises(KeyError):
        measures.column_totals(df, ["missing"])


def test_weighted_mean_keeps_the_weight_of_missing_values(spark):
    df = spark.createDataFrame(
        [(3.5, 20), (None, None), (0.2, 11), (None, 15)], "a double, w bigint"
    )
    out = measures.weighted_means(df, {"g": ["a"]}, "w", dictionary=DICTIONARY)
    [(group, ordinal, label, value)] = rows(out)
    assert (group, ordinal, label) == ("g", 1, "First")
    assert value == pytest.approx(72.2 / 46)


def test_weighted_mean_without_weight_is_missing(spark):
    df = spark.createDataFrame([(1.0, None), (2.0, 0)], "a double, w bigint")
    out = measures.weighted_means(df, {"g": ["a"]}, "w", dictionary=DICTIONARY)
    assert rows(out)[0][3] is None


def test_condition_columns_need_prefix_and_ending(spark):
    df = spark.createDataFrame(
        [(1.0, 2.0, 3.0, 4)],
        "Bene_CC_PH_Asthma_V2_Pct double, Bene_CC_PH_Other double,"
        " Bene_CC_BH_PD_V1_Pct double, DME_Tot_Suplr_Benes bigint",
    )
    out = rows(measures.weighted_means(df))
    assert [(r[0], r[2], r[3]) for r in out] == [
        ("Physical Health Conditions", "Percent with Asthma", 1.0),
        ("Behavioral Health Conditions", "Percent with Personality Disorders", 3.0),
    ]


def test_unknown_condition_column_is_an_error(spark):
    df = spark.createDataFrame(
        [(1.0, 4)], "Bene_CC_PH_New_Pct double, DME_Tot_Suplr_Benes bigint"
    )
    with pytest.raises(KeyError):
        measures.weighted_means(df)


def test_shares_round_half_even(spark):
    # 1 of 800 is 0.125 %, 3 of 800 is 0.375 %
    df = spark.createDataFrame([(1, 3, 796)], "a bigint, b bigint, c bigint")
    out = measures.group_shares(df, {"g": ["a", "b", "c"]}, dictionary=DICTIONARY)
    assert [r[3] for r in rows(out)] == [0.12, 0.38, 99.5]


def test_shares_of_an_empty_group_are_missing(spark):
    df = spark.createDataFrame([(0, None)], "a bigint, b bigint")
    out = measures.group_shares(df, {"g": ["a", "b"]}, dictionary=DICTIONARY)
    assert [r[3] for r in rows(out)] == [None, None]


@SLOW
@given(st.lists(st.tuples(st.integers(0, 10**6), st.integers(0, 10**6), st.integers(0, 10**6)), min_size=1))
def test_shares_total_one_hundred(spark, data):
    df = spark.createDataFrame(data, "a bigint, b bigint, c bigint")
    out = [r[3] for r in rows(measures.group_shares(df, {"g": ["a", "b", "c"]}, dictionary=DICTIONARY))]
    if any(sum(row) for row in data):
        assert abs(sum(out) - 100) <= 0.05
    else:
        assert out == [None] * 3


@SLOW
@given(
    st.lists(
        st.tuples(st.none() | st.floats(-100, 100), st.none() | st.integers(0, 1000)), min_size=1
    )
)
def test_weighted_mean_stays_in_range(spark, data):
    df = spark.createDataFrame(data, "a double, w bigint")
    value = rows(measures.weighted_means(df, {"g": ["a"]}, "w", dictionary=DICTIONARY))[0][3]
    known = [a for a, _ in data if a is not None]
    if value is not None:
        assert min([0, *known]) - 1e-9 <= value <= max([0, *known]) + 1e-9


def panel(spark, data):
    return spark.createDataFrame(
        data,
        "year int, Suplr_NPI string, DME_Tot_Suplr_Benes bigint, DME_Tot_Suplr_Clms bigint,"
        " DME_Suplr_Mdcr_Pymt_Amt double, POS_Suplr_Mdcr_Pymt_Amt double,"
        " Drug_Suplr_Mdcr_Pymt_Amt double",
    )


def test_yearly_tables(spark):
    df = panel(
        spark,
        [
            (2021, "1", 10, 20, 100.0, 1.0, None),
            (2021, "2", None, 5, None, 2.0, None),
            (2022, "1", None, None, 50.0, None, 7.0),
        ],
    )
    overview = measures.yearly_overview(df).orderBy("Year")
    assert rows(overview) == [(2021, 2, 10, 25, 100.0), (2022, 1, 0, 0, 50.0)]
    spending = measures.spending_patterns(df).orderBy("Year")
    assert rows(spending) == [
        (2021, 10, 100.0, 10.0, 100.0, 3.0, 0.0),
        (2022, 0, 50.0, 0.0, 50.0, 0.0, 7.0),
    ]
    changes = dict(rows(change.two_year_change(overview, 2021, 2022)))
    assert changes == {
        "Suppliers": -50.0,
        "Beneficiaries": -100.0,
        "Claims": -100.0,
        "Payments": -50.0,
    }
    assert rows(change.two_year_change(overview, 2020, 2022)) == []
    billions = charts.spending_by_category(spending).where("Year = 2021")
    assert sorted(r[1:] for r in rows(billions)) == [
        ("DME Spending", 1e-7),
        ("Drug Spending", 0.0),
        ("Prosthetic/Orthotic Spending", 3e-9),
    ]


def test_splitting_and_stacking_changes_nothing(spark):
    df = panel(spark, [(y, str(i), i, 2 * i, 1.0 * i, 0.0, 0.0) for y in (1, 2) for i in range(5)])
    from supplypanel.sources.yearly import stack_years

    again = stack_years({y: select_year(df, y).drop("year") for y in (2, 1)})
    assert sorted(rows(measures.spending_patterns(again))) == sorted(
        rows(measures.spending_patterns(df))
    )


def test_percent_change_fills_gaps_and_skips_absent_years(spark):
    df = spark.createDataFrame(
        [(2017, None), (2018, 10.0), (2020, None), (2021, 15.0), (2022, 0.0), (2023, 1.0)],
        "y int, x double",
    ).selectExpr("y", "x", "'one' AS k")
    out = rows(change.pct_change(df, {"x": "d"}, "y", ["k"]).orderBy("y"))
    assert [r[3] for r in out] == [None, None, 0.0, 50.0, -100.0, None]
    raw = rows(change.pct_change(df, {"x": "d"}, "y", ["k"], fill=False).orderBy("y"))
    assert [r[3] for r in raw] == [None, None, None, None, -100.0, None]
    with pytest.raises(ValueError, match="one task"):
        change.pct_change(df, {"x": "d"}, "y", [])


def test_percent_change_per_entity(spark):
    df = spark.createDataFrame(
        [("a", 1, 2.0), ("b", 1, 5.0), ("a", 2, 3.0), ("b", 2, 4.0)], "k string, y int, x double"
    )
    out = rows(change.pct_change(df, {"x": "d"}, "y", ["k"]).orderBy("k", "y"))
    assert [r[3] for r in out] == [None, 50.0, None, pytest.approx(-20.0)]


def test_yoy_series_drops_the_first_year(spark):
    df = panel(spark, [(2020, "1", 10, 1, 100.0, 0.0, 0.0), (2022, "1", 20, 1, 150.0, 0.0, 0.0)])
    out = charts.yoy_series(measures.spending_patterns(df))
    assert sorted(rows(out)) == [
        (2022, "Beneficiaries", 100.0),
        (2022, "Per Beneficiary", -25.0),
        (2022, "Spending", 50.0),
    ]


def suppliers(spark):
    return spark.createDataFrame(
        [
            ("3", "C", 5, 1, 30.005),
            ("1", "A", 5, 2, 1000.0),
            ("2", "B", 9, 3, None),
            ("4", "D", None, 4, 5.0),
        ],
        "Suplr_NPI string, Suplr_Prvdr_Last_Name_Org string, DME_Tot_Suplr_Benes bigint,"
        " DME_Tot_Suplr_Clms bigint, DME_Suplr_Mdcr_Pymt_Amt double",
    )


def test_top_suppliers_break_ties_and_put_missing_last(spark):
    out = rows(topk.top_suppliers(suppliers(spark)))
    assert out == [
        ("B", 9, 3, None),
        ("A", 5, 2, "$1,000.00"),
        ("C", 5, 1, "$30.00"),
        ("D", None, 4, "$5.00"),
    ]
    for n in (1, 2, 3):
        assert rows(topk.top_suppliers(suppliers(spark), n)) == out[:n]


def test_top_suppliers_chart_is_chosen_by_beneficiaries(spark):
    out = {r[0]: r[1:] for r in rows(charts.top_suppliers_chart(suppliers(spark), 3))}
    # supplier: numeric payments, place by payments, place by beneficiaries
    assert {k: v[3:] for k, v in out.items()} == {
        "C": (30.0, 1, 2),
        "A": (1000.0, 2, 1),
        "B": (None, 3, 3),
    }


def test_value_counts_drop_missing_keys(spark):
    df = spark.createDataFrame([("x",), ("y",), (None,), ("x",)], "s string")
    assert sorted(rows(measures.value_counts(df, "s"))) == [("x", 2), ("y", 1)]
    shares = {r[0]: r[2] for r in rows(measures.value_shares(df, "s"))}
    assert shares == {"x": pytest.approx(200 / 3), "y": pytest.approx(100 / 3)}


def test_top_states_and_absent_ruca(spark):
    data = [(s,) for s in "AABBC"] + [(None,)] * 9
    df = spark.createDataFrame(data, "Suplr_Prvdr_State_Abrvtn string")
    assert rows(topk.top_states(df, 2)) == [("A", 2), ("B", 2)]
    absent = charts.ruca_share(df)
    assert absent.columns == ["RUCA Description", "Suppliers", "share", "slice"]
    assert rows(absent) == []


def test_top_per_group(spark):
    df = spark.createDataFrame(
        [("g", 1, 5.0), ("g", 2, 7.0), ("g", 3, None), ("h", 1, 1.0), ("h", 2, 1.0)],
        "g string, k int, v double",
    )
    out = rows(topk.top_per_group(df, ["g"], "v", ["k"], 2).orderBy("g", "rank"))
    assert out == [("g", 2, 7.0, 1), ("g", 1, 5.0, 2), ("h", 1, 1.0, 1), ("h", 2, 1.0, 2)]


def test_demographic_slices(spark):
    names = [c for group in measures.DEMOGRAPHIC_GROUPS.values() for c in group]
    values = [1, 1, 1, 0, 3, 1, 2, 5, 2, 1, 0, 0]
    df = spark.createDataFrame([tuple(values)], ", ".join(f"{n} bigint" for n in names))
    out = charts.demographic_chart(df).orderBy("group", "position")
    race = [(r["label"].split()[2], r["pct"], r["slice"]) for r in out.collect() if "Race" in r["group"]]
    assert race == [
        ("Black", 50.0, "50.0%"),
        ("White", 20.0, "20.0%"),
        ("Asian/PI", 20.0, "20.0%"),
        ("Hispanic", 10.0, "10.0%"),
        ("Native", 0.0, "0.0%"),
        ("Other", 0.0, "0.0%"),
    ]
    age = [(r["pct"], r["slice"]) for r in out.collect() if "Age" in r["group"]]
    assert age == [(33.33, "33.3%")] * 3 + [(0.0, "0.0%")]


def test_year_selection(spark):
    df = spark.createDataFrame([(2017, 1), (2019, 2)], "year int, v int")
    assert rows(select_latest_year(df)) == [(2019, 2)]
    assert rows(select_year(df, 2017, [2017, 2019])) == [(2017, 1)]
    with pytest.raises(ValueError):
        select_year(df, 2018, [2017, 2019])


def test_category_overview(spark):
    df = spark.createDataFrame(
        [tuple(range(7))],
        "Suplr_NPI int, zzz int, Bene_x int, Suplr_Prvdr_MI int, Suplr_a int, Suplr_b int, DME_q int",
    )
    out = {
        r["category"]: (r["columns"], r["examples"], r["descriptions"])
        for r in categories.category_overview(column_table(df), dictionary_table(spark)).collect()
    }
    assert set(out) == {
        "Supplier Information",
        "Other",
        "Beneficiary Demographics",
        "Durable Medical Equipment",
    }
    count, examples, descriptions = out["Supplier Information"]
    assert (count, examples) == (4, "Suplr_NPI, Suplr_Prvdr_MI, Suplr_a")
    assert descriptions[0].startswith("Supplier NPI - ") and descriptions[2] is None
    assert out["Other"] == (1, "zzz", [None])


def test_observed_columns(spark):
    df = spark.createDataFrame([(1, None, "x"), (None, None, "y")], "a int, b int, c string")
    assert rows(categories.observed_columns(df)) == [(1, "a", 1), (3, "c", 2)]
