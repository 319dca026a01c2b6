"""Rules for parsing and display, with expected values written out by hand."""

import pytest
from conftest import rows
from pyspark.sql import functions as F

from supplypanel.functions import arithmetic, parsing, text
from supplypanel.sources import dictionary


def texts(spark, values):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")


def apply(spark, values, expression, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in rows(df.orderBy("i").select(expression(F.col("v"))))]


def test_null_tokens(spark):
    values = [*parsing.NULL_TOKENS, "none", "Nan", " NA", "x", None]
    out = apply(spark, values, parsing.blank_to_null)
    assert out == [None] * 19 + ["none", "Nan", " NA", "x", None]


def test_money_text(spark):
    values = [" 7 ", "1e3", ".5", "5.", "-2.25", "+4", "inf", "-Infinity"]
    assert apply(spark, values, parsing.parse_number) == [
        7.0,
        1000.0,
        0.5,
        5.0,
        -2.25,
        4.0,
        float("inf"),
        float("-inf"),
    ]
    bad = ["*", "#", "$5", "1,234", "1d", "1f", "0x10", "1_000", "True", "nan", "", None, "1e"]
    assert apply(spark, bad, parsing.parse_number) == [None] * len(bad)


def test_count_text(spark):
    values = ["12", " 12 ", "12.0", "12.", "1e3", "-3", "*", "", None, "NA", "123456789012345678"]
    assert apply(spark, values, parsing.parse_count) == [
        12,
        12,
        12,
        12,
        1000,
        -3,
        None,
        None,
        None,
        None,
        123456789012345678,
    ]


@pytest.mark.parametrize("value", ["12.5", "inf"])
def test_fractional_count_is_refused(spark, value):
    with pytest.raises(Exception, match="not a whole count"):
        apply(spark, [value], parsing.parse_count)


def test_money_columns_by_name():
    names = ["DME_Suplr_Mdcr_Pymt_Amt", "X_Pymt", "Amt_Y", "DME_Suplr_Sbmtd_Chrgs", "Pay"]
    assert parsing.money_columns(names) == names[:3]
    matched = parsing.money_columns(list(dictionary.COLUMN_DESCRIPTIONS))
    assert len(matched) == 12


def test_coerce_money_leaves_other_columns(spark):
    df = spark.createDataFrame([("*", "*", 1.5)], "a_Amt string, name string, b_Pymt double")
    assert parsing.coerce_money(df).collect()[0].asDict() == {
        "a_Amt": None,
        "name": "*",
        "b_Pymt": 1.5,
    }


def test_column_types():
    kinds = {c: parsing.column_type(c) for c in dictionary.COLUMN_DESCRIPTIONS}
    assert kinds["Suplr_Prvdr_Zip5"] == kinds["Suplr_NPI"] == kinds["DME_Sprsn_Ind"] == "string"
    assert kinds["DME_Tot_Suplr_Benes"] == kinds["Bene_Dual_Cnt"] == "bigint"
    assert kinds["Tot_Suplr_HCPCS_Cds"] == kinds["POS_Tot_Suplr_Clms"] == "bigint"
    assert kinds["Bene_Avg_Age"] == kinds["Bene_Avg_Risk_Scre"] == "double"
    assert kinds["Drug_Tot_Suplr_Srvcs"] == kinds["Suplr_Sbmtd_Chrgs"] == "double"
    assert sum(kind == "string" for kind in kinds.values()) == 21


def test_rounding_is_half_even_on_the_scaled_double(spark):
    out = apply(
        spark, [0.125, 2.675, 1.005, 0.375, -0.125], arithmetic.round_half_even, "double"
    )
    assert out == [0.12, 2.68, 1.0, 0.38, -0.12]


def test_division_by_zero_is_missing(spark):
    df = spark.createDataFrame([(1, 0), (0, 0), (3, 2), (None, 2)], "a int, b int")
    out = rows(df.select(arithmetic.safe_div(F.col("a"), F.col("b"))))
    assert [r[0] for r in out] == [None, None, 1.5, None]


def test_currency_text(spark):
    values = [0.125, 2.675, 1234.565, -5.0, 1e16, -0.001, None, float("inf")]
    python = ["${:,.2f}".format(v) if v is not None else None for v in values]
    assert apply(spark, values, text.format_currency, "double") == python


def test_count_percent_and_scaled_text(spark):
    values = [0.5, 1.5, 2022.0, 1234567.5]
    assert apply(spark, values, text.format_count, "double") == [f"{v:,.0f}" for v in values]
    assert apply(spark, values, text.format_percent, "double") == [f"{v:.2f}%" for v in values]
    billions = apply(spark, [2.25e9, 1.25e12], lambda c: text.format_scaled(c, 1e9, 1, suffix="B"), "double")
    assert billions == ["$2.2B", "$1250.0B"]


def test_currency_round_trip(spark):
    values = ["$1,234.50", "$-5.00", "7", "$", "n/a", None]
    assert apply(spark, values, parsing.parse_currency) == [1234.5, -5.0, 7.0, None, None, None]


def test_label_stops_at_the_padded_dash(spark):
    values = ["Number of Beneficiaries 65-74 - Count - more", "Percent with Asthma", "a-b"]
    assert apply(spark, values, text.label_of) == [
        "Number of Beneficiaries 65-74",
        "Percent with Asthma",
        "a-b",
    ]


def test_prefix_category_takes_the_first_match(spark):
    values = ["Bene_CC_BH_x", "Bene_CC_PH_x", "Bene_x", "Suplr_x", "Tot_Suplr_x", "", None]
    category = lambda c: text.prefix_category(c, dictionary.CATEGORY_PREFIXES)
    assert apply(spark, values, category) == [
        "Beneficiary Behavioral Health Conditions",
        "Beneficiary Physical Health Conditions",
        "Beneficiary Demographics",
        "Supplier Information",
        "Other",
        "Other",
        "Other",
    ]


def test_dictionary_table(spark):
    table = dictionary.dictionary_table(spark)
    counts = dict(rows(table.groupBy("category").count()))
    assert table.count() == 94
    assert counts == {
        "Supplier Information": 22,
        "Durable Medical Equipment": 9,
        "Prosthetics and Orthotics": 9,
        "Drug and Nutritional Products": 9,
        "Beneficiary Behavioral Health Conditions": 11,
        "Beneficiary Physical Health Conditions": 14,
        "Beneficiary Demographics": 16,
        "Other": 4,
    }


def test_dictionary_join_lenient_and_strict(spark):
    long = spark.createDataFrame([("Bene_Feml_Cnt", 1), ("Unknown", 2)], "column string, v int")
    table = dictionary.dictionary_table(spark)
    lenient = {r["column"]: r["label"] for r in dictionary.dictionary_join(long, table).collect()}
    assert lenient == {"Bene_Feml_Cnt": "Number of Female Beneficiaries", "Unknown": None}
    with pytest.raises(Exception, match="not in the dictionary: Unknown"):
        dictionary.dictionary_join(long, table, strict=True).collect()


def test_year_suffix(spark):
    assert apply(spark, [2017, 1999], text.year_suffix, "int") == ["17", "99"]
