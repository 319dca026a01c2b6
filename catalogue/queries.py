"""One query per operator, each over whole tables of the given folder."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalogue import order_panel as op
from supplypanel.functions.arithmetic import percent_of, total
from supplypanel.functions.parsing import blank_to_null, coerce_money, parse_currency
from supplypanel.functions.text import (
    format_count,
    format_currency,
    format_percent,
    format_scaled,
    label_of,
    prefix_category,
    year_suffix,
)
from supplypanel.operators import (
    categories,
    change,
    charts,
    duplicates,
    exact_sums,
    features,
    measures,
    profile,
    topk,
)
from supplypanel.operators.selection import latest_year_of, select_year
from supplypanel.plans import report, sinks
from supplypanel.session import drop_folder, scratch_folder, settle
from supplypanel.sources import incremental, json_records, quarantine
from supplypanel.sources.dictionary import dictionary_join, dictionary_table
from supplypanel.sources.yearly import (
    load_panel,
    read_table,
    read_text_table,
    shape,
    stack_years,
    store_panel,
)

Query = Callable[[SparkSession, str], DataFrame]

CHANGE_YEARS = (1999, 2000)
ONE_YEAR = 2000
FOLDER_PER_YEAR = "{root}/year={year}"
# Published files leave values out; here by rules on the keys.
MISSING = {c: "Suplr_NPI % 7 = 3" for c in op.BENE_COLUMNS} | {
    c: "(Suplr_NPI + year) % 5 = 0" for c in (*op.PRIORITY_COLUMNS, *op.RETURN_COLUMNS)
}
LINE_KEYS = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
REPEATING = ["l_linenumber", "l_returnflag", "l_linestatus", "l_quantity", "l_discount", "l_tax"]
LINE_RULES = (("l_line", "Line"), ("l_ship", "Shipping"), ("l_", "Rest"))
PRIORITY_RULES = (("1-", "Pressing"), ("2-", "Pressing"), ("3-M", "Normal"), ("3", "Never"))

DEMOGRAPHICS = op.AGE_COLUMNS + op.GENDER_COLUMNS + op.RACE_COLUMNS
CONDITIONS = op.PRIORITY_COLUMNS + op.RETURN_COLUMNS
SPENDING = (measures.BENES, *op.PAYMENT_COLUMNS)
OVERVIEW = (measures.BENES, measures.CLAIMS, measures.DME_PAID)


def panel(
    spark: SparkSession,
    folder: str,
    columns: Iterable[str],
    years: Sequence[int] | None = None,
) -> DataFrame:
    return op.order_panel(op.parquet_tables(spark, folder), columns, years, MISSING)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return op.parquet_tables(spark, folder)(name)


def payments_as_double(df: DataFrame) -> DataFrame:
    names = [c for c in op.PAYMENT_COLUMNS if c in df.columns]
    return df.withColumns({c: F.col(c).cast("double") for c in names})


def numbers_as_double(df: DataFrame) -> DataFrame:
    """Decimals as doubles, the type that yearly files give."""
    names = [c for c, kind in df.dtypes if kind.startswith("decimal")]
    return df.withColumns({c: F.col(c).cast("double") for c in names})


# Yearly summaries.


def yearly_overview(spark, folder):
    return measures.yearly_overview(panel(spark, folder, OVERVIEW))


def overview_report(spark, folder):
    return report.overview_display(yearly_overview(spark, folder))


def column_sums(spark, folder):
    names = op.BENE_COLUMNS + op.CLAIM_COLUMNS + op.PAYMENT_COLUMNS
    totals = measures.column_totals(panel(spark, folder, names), names, ["year"])
    return payments_as_double(totals)


def spending_patterns(spark, folder):
    return measures.spending_patterns(panel(spark, folder, SPENDING))


def spending_report(spark, folder):
    return report.spending_display(spending_patterns(spark, folder))


def spending_by_category(spark, folder):
    return charts.spending_by_category(spending_patterns(spark, folder))


# Change.


def pct_change(spark, folder):
    rows = payments_as_double(panel(spark, folder, (measures.BENES, measures.DME_PAID)))
    changed = change.pct_change(
        rows,
        {measures.BENES: "benes_change", measures.DME_PAID: "paid_change"},
        "year",
        ["Suplr_NPI"],
    )
    return changed.select("Suplr_NPI", "year", "benes_change", "paid_change")


def yoy_series(spark, folder):
    return charts.yoy_series(spending_patterns(spark, folder))


def two_year_change(spark, folder):
    rows = panel(spark, folder, OVERVIEW, CHANGE_YEARS)
    return change.two_year_change(measures.yearly_overview(rows), *CHANGE_YEARS)


def change_report(spark, folder):
    return report.change_display(two_year_change(spark, folder))


# Shares and prevalence.


def demographic_shares(spark, folder):
    return measures.group_shares(panel(spark, folder, DEMOGRAPHICS), by=["year"])


def demographics_report(spark, folder):
    shares = measures.group_shares(panel(spark, folder, DEMOGRAPHICS, [ONE_YEAR]))
    return report.percent_display(shares, "pct").select("group", "label", "pct")


def demographic_chart(spark, folder):
    return charts.demographic_chart(panel(spark, folder, DEMOGRAPHICS), ["year"])


def weighted_prevalence(spark, folder):
    rows = panel(spark, folder, (*CONDITIONS, measures.BENES))
    return measures.weighted_means(rows, by=["year"])


def top_conditions(spark, folder):
    rows = panel(spark, folder, (*CONDITIONS, measures.BENES))
    return charts.top_conditions(rows, 2, ["year"])


def conditions_report(spark, folder):
    rows = panel(spark, folder, (*CONDITIONS, measures.BENES), [ONE_YEAR])
    return report.percent_display(charts.top_conditions(rows), "value")


# Ranking and counting.


def supplier_rows(spark, folder):
    return panel(spark, folder, (*OVERVIEW, topk.SUPPLIER_NAME), [ONE_YEAR])


def top_suppliers(spark, folder):
    return topk.top_suppliers(supplier_rows(spark, folder))


def top_suppliers_chart(spark, folder):
    return charts.top_suppliers_chart(supplier_rows(spark, folder))


def top_states(spark, folder):
    return topk.top_states(panel(spark, folder, [topk.STATE], [ONE_YEAR]))


def value_counts(spark, folder):
    return measures.value_counts(
        panel(spark, folder, [topk.STATE]), topk.STATE, ["year"], "State", "Suppliers"
    )


def ruca_share(spark, folder):
    return charts.ruca_share(panel(spark, folder, [charts.RUCA], [ONE_YEAR]))


# Selecting years, shapes.


def year_filter(spark, folder):
    rows = panel(spark, folder, SPENDING, [ONE_YEAR])
    return payments_as_double(select_year(rows, ONE_YEAR))


def latest_year(spark, folder):
    latest = latest_year_of(table(spark, folder, "lineitem"), "l_shipdate")
    return payments_as_double(panel(spark, folder, SPENDING, [latest] if latest else []))


def panel_shape(spark, folder):
    return shape(panel(spark, folder, op.PANEL_COLUMNS), ("year",))


# Names, categories, labels.


def prefix_categories(spark, folder):
    orders = table(spark, folder, "orders").select(
        prefix_category("o_orderpriority", PRIORITY_RULES).alias("category"), "o_orderpriority"
    )
    return orders.groupBy("category", "o_orderpriority").agg(F.count(F.lit(1)).alias("orders"))


def category_overview(spark, folder):
    """The columns of the order lines that have a value anywhere, by prefix; one pass."""
    observed = categories.observed_columns(table(spark, folder, "lineitem"))
    overview = categories.category_overview(observed, dictionary_table(spark), LINE_RULES)
    return overview.withColumn("descriptions", F.array_join("descriptions", " | ", "-"))


def name_categories(spark, folder):
    """The same overview over a large table of names: parts by the words of their name."""
    names = table(spark, folder, "part").select(
        F.col("p_partkey").alias("ordinal"),
        F.concat_ws("_", "p_type", "p_name", F.col("p_partkey").cast("string")).alias("column"),
    )
    rules = (("SMALL_red", "Small red"), ("SMALL", "Small"), ("LARGE", "Large"))
    return categories.category_overview(names, None, rules).select(
        "category", "columns", "examples"
    )


def dictionary_lookup(spark, folder):
    names = op.BENE_COLUMNS + op.CLAIM_COLUMNS + DEMOGRAPHICS
    rows = panel(spark, folder, (*names, topk.STATE))
    totals = measures.column_totals(rows, names, ["year", topk.STATE])
    long = totals.unpivot(["year", topk.STATE], list(names), "column", "value")
    return dictionary_join(long, dictionary_table(spark), strict=True)


def label_split(spark, folder):
    orders = table(spark, folder, "orders")
    description = F.concat_ws(" - ", "o_orderpriority", "o_orderstatus", "o_orderkey")
    return (
        orders.select(label_of(description).alias("label"))
        .groupBy("label")
        .agg(F.count(F.lit(1)).alias("orders"))
    )


# Display text.


def currency_text(spark, folder):
    orders = table(spark, folder, "orders")
    return orders.select("o_orderkey", format_currency("o_totalprice").alias("text"))


def count_text(spark, folder):
    orders = table(spark, folder, "orders")
    return orders.select("o_orderkey", format_count("o_totalprice").alias("text"))


def percent_text(spark, folder):
    price = F.col("l_extendedprice").cast("decimal(18,2)")
    discount = F.col("l_discount").cast("decimal(4,2)")
    rates = (
        table(spark, folder, "lineitem")
        .groupBy("l_suppkey")
        .agg(
            F.sum(price * discount).cast("double").alias("reduced"),
            F.sum(price).cast("double").alias("full"),
        )
    )
    rate = F.col("reduced") / F.col("full") * F.lit(100.0)
    return rates.select(
        "l_suppkey",
        percent_of(F.col("reduced"), F.col("full")).alias("rate"),
        format_percent(rate).alias("two_places"),
        format_percent(rate, 1).alias("one_place"),
    )


def scaled_text(spark, folder):
    rows = payments_as_double(panel(spark, folder, op.PAYMENT_COLUMNS))
    paid = F.col(measures.DME_PAID)
    return rows.select(
        "Suplr_NPI",
        year_suffix("year").alias("yy"),
        format_scaled(paid, 1e9, 1, suffix="B").alias("billions"),
        format_scaled(paid, 1e6, 1, suffix="M").alias("millions"),
        format_scaled(paid, 1, 0).alias("dollars"),
        format_scaled(paid, 1, 0, prefix="").alias("plain"),
    )


def currency_parse(spark, folder):
    text = currency_text(spark, folder)
    return text.select("o_orderkey", parse_currency("text").alias("amount"))


def money_coercion(spark, folder):
    """Prices written the way suppliers' files write them, read back as numbers."""
    price = F.col("l_extendedprice")
    plain = F.translate(F.format_number(price, 2), ",", "")
    written = (
        F.when(F.col("l_linenumber") == 1, F.lit("*"))
        .when(F.col("l_linenumber") == 2, F.concat(F.lit("$"), plain))
        .when(F.col("l_linenumber") == 3, F.concat(F.lit(" "), plain, F.lit(" ")))
        .when(F.col("l_linenumber") == 4, F.concat(plain, F.lit("d")))
        .when(F.col("l_linenumber") == 5, F.concat(plain, F.lit("e1")))
        .when(F.col("l_linenumber") == 6, F.lit("nan"))
        .otherwise(plain)
    )
    lines = table(spark, folder, "lineitem").select(
        "l_suppkey", "l_linenumber", written.alias("Line_Pymt"), plain.alias("Line_Text")
    )
    number = F.col("Line_Pymt").cast("decimal(18,2)")
    return (
        coerce_money(lines)
        .groupBy("l_suppkey", "l_linenumber")
        .agg(
            F.count("Line_Pymt").alias("numbers"),
            F.count("Line_Text").alias("texts"),
            total(number).cast("double").alias("amount"),
        )
    )


# Files.


def csv_scan(spark, folder):
    """Whole order lines through delimited text with quotes, line by line, and back."""
    token = (
        F.when(F.col("l_linenumber") == 1, F.lit("None"))
        .when(F.col("l_linenumber") == 2, F.lit("n/a"))
        .when(F.col("l_linenumber") == 3, F.concat(F.col("l_returnflag"), F.lit(', "x"')))
        .otherwise(F.col("l_returnflag"))
    )
    lines = table(spark, folder, "lineitem").select(
        F.format_string("%09d", "l_suppkey").alias("zip"),
        "l_orderkey",
        "l_linenumber",
        token.alias("mark"),
        F.format_number("l_extendedprice", 2).alias("price"),
    )
    path = scratch_folder(spark, "csv_scan")
    lines.write.option("header", True).option("escape", '"').csv(path)
    scanned = read_text_table(spark, path)
    return scanned.select(
        "zip",
        F.col("l_orderkey").cast("bigint").alias("l_orderkey"),
        F.col("l_linenumber").cast("int").alias("l_linenumber"),
        blank_to_null("mark").alias("mark"),
        "price",
    )


def written_panel(spark, folder, name):
    """The derived panel as one folder of delimited text per year."""
    path = scratch_folder(spark, name)
    rows = panel(spark, folder, op.PANEL_COLUMNS).hint("rebalance", "year")
    rows.write.partitionBy("year").option("header", True).option("escape", '"').csv(path)
    return path


def panel_load(spark, folder):
    path = written_panel(spark, folder, "panel_load")
    loaded = load_panel(spark, path, template=FOLDER_PER_YEAR).data
    out = settle(loaded, "panel_load")
    drop_folder(spark, path)
    return out


def panel_union(spark, folder):
    """Yearly tables with differing columns and column order, stacked by name. The panel is
    derived and written once, and every year reads its own part."""
    rows = panel(spark, folder, (*OVERVIEW, topk.SUPPLIER_NAME))
    stored = store_panel(rows, scratch_folder(spark, "panel_union"))
    yearly = {}
    for year in stored.years:
        one = stored.year(year).drop("year")
        if year % 2:
            one = one.select(*reversed(one.columns))
        if year % 3 == 0:
            one = one.drop(measures.CLAIMS)
        if year == stored.latest_year:
            one = one.withColumn("Extra", F.col(measures.BENES) + 1)
        yearly[year] = one
    return payments_as_double(stack_years(yearly))


def save_results(spark, folder):
    spending = spending_patterns(spark, folder)
    out = scratch_folder(spark, "results")
    paths = sinks.save_results({"spending": spending}, out)
    return sinks.read_results(spark, paths)["spending"]


def panel_refresh(spark, folder):
    """A stored panel brought up to date after one year's file changed and another went."""
    files, path = scratch_folder(spark, "files"), scratch_folder(spark, "refreshed")
    rows = panel(spark, folder, (*OVERVIEW, topk.SUPPLIER_NAME)).hint("rebalance", "year")
    text = settle(rows, "panel_rows").write.partitionBy("year").option("header", True).option("escape", '"')
    text.csv(files)
    before = incremental.refresh_panel(spark, files, path, FOLDER_PER_YEAR).panel
    first, last = min(before.years), max(before.years)
    gone = f"{files}/year={first}"
    grown = before.year(last).drop("year").withColumn(measures.CLAIMS, F.col(measures.CLAIMS) + 1)
    drop_folder(spark, gone)
    changed = settle(grown, "changed_year")
    drop_folder(spark, f"{files}/year={last}")
    changed.write.option("header", True).option("escape", '"').csv(f"{files}/year={last}")
    after = incremental.refresh_panel(spark, files, path, FOLDER_PER_YEAR)
    out = settle(after.panel.data.withColumn("rewritten", F.col("year").isin(list(after.written))), "refreshed")
    for folder_made in (files, path):
        drop_folder(spark, folder_made)
    return out


def panel_quarantine(spark, folder):
    """Yearly text in which some records have a field too many: rows that are kept, and
    records that are left out with their reason, by year."""
    files, path = scratch_folder(spark, "files"), scratch_folder(spark, "tolerant")
    rows = panel(spark, folder, OVERVIEW).select("Suplr_NPI", "year", *OVERVIEW[:2])
    note = F.when(F.col("Suplr_NPI") % 10 == 3, "late,corrected").otherwise("ok").alias("Note")
    text = rows.select("*", note).hint("rebalance", "year").write.partitionBy("year")
    text.option("header", True).option("quote", "").csv(files)
    loaded = quarantine.load_tolerant(spark, files, path, template=FOLDER_PER_YEAR)
    kept = loaded.panel.data.groupBy("year").agg(
        F.lit("kept").alias("outcome"), F.count(F.lit(1)).alias("records"), total(measures.CLAIMS).alias("claims")
    )
    left = loaded.quarantine.groupBy("year", F.col("reason").alias("outcome")).agg(
        F.count("record").alias("records"), F.sum(F.split("record", ",")[2].cast("bigint")).alias("claims")
    )
    out = settle(kept.unionByName(left), "quarantined")
    for folder_made in (files, path):
        drop_folder(spark, folder_made)
    return out


def json_scan(spark, folder):
    """Whole orders through JSON lines and back, every field as text, then typed."""
    orders = table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("Order_NPI"),
        F.col("o_custkey").alias("Order_Cnt"),
        F.col("o_totalprice").alias("Order_Pymt"),
        F.when(F.col("o_orderstatus") == "P", "n/a").otherwise(F.col("o_orderstatus")).alias("mark"),
    )
    path = scratch_folder(spark, "json_scan")
    orders.write.json(path)
    return read_table(spark, path, "json")


def drifting_orders(spark, folder):
    """Orders as JSON lines whose fields and kinds of values differ, some of them broken; parsed
    once, then stored."""
    key, spent = F.col("o_orderkey"), F.col("o_totalprice")
    text = key.cast("string").alias("Order_NPI")
    lines = (
        F.when(key % 28 == 3, F.concat(F.lit('{"Order_NPI": '), text))
        .when(
            key % 4 == 0,
            F.to_json(F.struct(key.alias("Order_NPI"), F.col("o_custkey").alias("Order_Cnt"), spent.alias("Order_Pymt"))),
        )
        .when(
            key % 4 == 1,
            F.to_json(
                F.struct(
                    text,
                    F.concat(F.col("o_custkey").cast("string"), F.lit(".0")).alias("Order_Cnt"),
                    F.col("o_orderstatus").alias("mark"),
                )
            ),
        )
        .when(
            key % 4 == 2,
            F.to_json(
                F.struct(
                    text,
                    spent.cast("string").alias("Order_Pymt"),
                    F.struct(F.col("o_orderpriority").alias("priority")).alias("note"),
                )
            ),
        )
        .otherwise(F.to_json(F.struct(key.alias("Order_NPI"))))
    )
    path = scratch_folder(spark, "drifting")
    table(spark, folder, "orders").select(lines.alias("value")).write.text(path)
    records = settle(json_records.json_records(spark, path), "records")
    drop_folder(spark, path)
    return records


def json_drift(spark, folder):
    records = drifting_orders(spark, folder)
    return json_records.typed_records(records, json_records.field_names(records))


def json_field_kinds(spark, folder):
    """The fields of all records, with how many have them as text, number or object."""
    found = json_records.json_fields(drifting_orders(spark, folder)).where("field is not null")
    kind = (
        F.when(F.col("kind") == "STRING", "text")
        .when(F.col("kind").startswith("OBJECT"), "object")
        .otherwise("number")
    )
    return found.groupBy("field", kind.alias("kind")).agg(F.sum("records").alias("records"))


def json_bad_records(spark, folder):
    bad = drifting_orders(spark, folder).select(F.col(json_records.BAD_RECORD).alias("line"))
    return bad.where("line is not null")


# Cleaning and first looks.


def missing_values(spark, folder):
    return profile.missing_counts(panel(spark, folder, op.PANEL_COLUMNS), ["year"])


def fill_missing(spark, folder):
    rows = panel(spark, folder, (measures.BENES, measures.CLAIMS, op.RETURN_COLUMNS[0]))
    kept = profile.drop_missing(numbers_as_double(rows), [op.RETURN_COLUMNS[0]])
    return profile.fill_missing(kept, {measures.BENES: 0})


def drop_duplicates(spark, folder):
    orders = table(spark, folder, "orders").select(
        "o_custkey", "o_orderkey", "o_orderpriority", "o_totalprice"
    )
    order = [F.col("o_orderpriority"), F.col("o_orderkey")]
    return profile.first_per_key(orders, ["o_custkey"], order)


MEASURED = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def describe(spark, folder):
    lines = table(spark, folder, "lineitem")
    summary = profile.describe_columns(lines, MEASURED, ["l_returnflag"])
    rounded = {c: F.round(c, 4) for c in ("mean", "std")}
    return summary.withColumns(rounded)


def correlation(spark, folder):
    lines = table(spark, folder, "lineitem")
    pairs = profile.correlations(lines, MEASURED, ["l_linestatus"])
    return pairs.withColumn("correlation", F.round("correlation", 6))


WIDE = (
    op.BENE_COLUMNS + op.CLAIM_COLUMNS + op.PAYMENT_COLUMNS + op.AGE_COLUMNS
    + op.GENDER_COLUMNS + op.RACE_COLUMNS + op.PRIORITY_COLUMNS + op.RETURN_COLUMNS
)


def panel_correlation(spark, folder):
    """Every pair of the panel's measures, by year; columns without variance have no correlation."""
    pairs = profile.correlations(panel(spark, folder, WIDE), WIDE, ["year"])
    value = F.round("correlation", 6)
    return pairs.withColumn("correlation", F.when(~F.isnan(value), value + 0.0))


def outliers(spark, folder):
    lines = table(spark, folder, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_quantity", "l_returnflag", "l_extendedprice"
    )
    return profile.outliers(lines, "l_extendedprice", ["l_returnflag"], 0.5)


# The panel's operators on the large tables themselves.

LINE_LABELS = {
    "returned": "Returned - lines with flag R",
    "accepted": "Accepted - lines with flag A",
    "neither": "Neither - lines with another flag",
    "discount": "Discount - share of the price",
    "tax": "Tax - share of the price",
}


def line_measures(spark, folder):
    flag = F.col("l_returnflag")
    return table(spark, folder, "lineitem").select(
        "l_suppkey",
        "l_linestatus",
        *[
            F.col(f"l_{c}").cast(f"decimal(18,{places})").alias(c)
            for c, places in (("quantity", 2), ("extendedprice", 2), ("discount", 2), ("tax", 2))
        ],
        (flag == "R").cast("long").alias("returned"),
        (flag == "A").cast("long").alias("accepted"),
        (~flag.isin("R", "A")).cast("long").alias("neither"),
    )


def line_sums(spark, folder):
    names = ["quantity", "extendedprice", "returned"]
    totals = measures.column_totals(line_measures(spark, folder), names, ["l_suppkey"])
    return numbers_as_double(totals)


def line_shares(spark, folder):
    groups = {"Return flag": ["returned", "accepted", "neither"]}
    return measures.group_shares(
        line_measures(spark, folder), groups, ["l_suppkey"], LINE_LABELS
    )


def line_means(spark, folder):
    groups = {"Rates": ["discount", "tax"]}
    rows = line_measures(spark, folder)
    return measures.weighted_means(rows, groups, "quantity", ["l_suppkey"], LINE_LABELS)


def top_orders(spark, folder):
    orders = table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    return topk.top_rows(orders, "o_totalprice", ["o_orderkey"], 100)


def order_change(spark, folder):
    """Percent change of the price from each customer's order before."""
    orders = table(spark, folder, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    return change.pct_change(orders, {"o_totalprice": "price_change"}, "o_orderkey", ["o_custkey"])


def line_change(spark, folder):
    """Percent change of the price from the order line before, in the order of the table."""
    keys = [*LINE_KEYS, "l_extendedprice"]  # lines that are equal in all of them may swap
    lines = table(spark, folder, "lineitem").select(*keys)
    return change.ordered_change(lines, {"l_extendedprice": "price_change"}, keys)


def double_sums(spark, folder):
    """Sums of doubles as they are, the same whatever the partitioning."""
    lines = table(spark, folder, "lineitem")
    return exact_sums.exact_sums(lines, ["l_extendedprice", "l_tax"], ["l_suppkey"])


def repeated_lines(spark, folder):
    """Order lines that repeat as a whole: lines without their order, and how often."""
    lines = table(spark, folder, "lineitem")
    return duplicates.repeated_rows(lines.select(*REPEATING), "lines")


def distinct_lines(spark, folder):
    shipped = F.col("l_shipdate").cast("date").cast("string")
    return duplicates.distinct_rows(table(spark, folder, "lineitem").withColumn("l_shipdate", shipped))


FEATURES = features.FeaturePlan(
    bins={"o_totalprice": 4},
    levels={"o_orderpriority": 3, "o_orderstatus": 5},
    scores=["o_totalprice"],
    means={"o_custkey": "o_totalprice"},
)


def order_features(spark, folder):
    """Features of all orders, learned from those of the earlier years."""
    orders = table(spark, folder, "orders")
    state = features.fit_features(orders.where("o_orderdate < timestamp_ntz '1998-01-01'"), FEATURES)
    derived = features.apply_features(orders, state)
    rounded = {c: F.round(c, 5) for c in ("o_totalprice_z", "o_totalprice_by_o_custkey")}
    return derived.withColumns(rounded).drop("o_orderdate")


# Everything together.


def full_report(spark, folder):
    """The report from yearly files of text to saved tables, and these as text lines."""
    files = written_panel(spark, folder, "files")
    store, out = scratch_folder(spark, "store"), scratch_folder(spark, "report")
    report.run_report(
        spark, files, out=out, store=store, change_years=CHANGE_YEARS, template=FOLDER_PER_YEAR
    )
    saved = sinks.read_result_set(spark, out)
    lines = settle(report.report_lines(saved), "report_lines")
    for path in (files, store, out):
        drop_folder(spark, path)
    return lines


def chart_bundle(spark, folder):
    """Every chart table as text lines, from a panel that is derived once, written by year,
    and read back with only the columns and years each chart needs."""
    path = scratch_folder(spark, "charts")
    stored = store_panel(panel(spark, folder, op.PANEL_COLUMNS), path)
    lines = settle(report.chart_lines(charts.chart_tables(stored.data, stored.latest())), "chart_lines")
    drop_folder(spark, path)
    return lines


QUERIES: dict[str, Query] = {
    "yearly_overview": yearly_overview,
    "overview_report": overview_report,
    "column_sums": column_sums,
    "spending_patterns": spending_patterns,
    "spending_report": spending_report,
    "spending_by_category": spending_by_category,
    "pct_change": pct_change,
    "yoy_series": yoy_series,
    "two_year_change": two_year_change,
    "change_report": change_report,
    "demographic_shares": demographic_shares,
    "demographics_report": demographics_report,
    "demographic_chart": demographic_chart,
    "weighted_prevalence": weighted_prevalence,
    "top_conditions": top_conditions,
    "conditions_report": conditions_report,
    "top_suppliers": top_suppliers,
    "top_suppliers_chart": top_suppliers_chart,
    "top_states": top_states,
    "value_counts": value_counts,
    "ruca_share": ruca_share,
    "year_filter": year_filter,
    "latest_year": latest_year,
    "shape": panel_shape,
    "prefix_category": prefix_categories,
    "category_overview": category_overview,
    "name_categories": name_categories,
    "dictionary_join": dictionary_lookup,
    "label_split": label_split,
    "format_currency": currency_text,
    "format_count": count_text,
    "format_percent": percent_text,
    "format_scaled": scaled_text,
    "parse_currency": currency_parse,
    "coerce_money": money_coercion,
    "csv_scan": csv_scan,
    "panel_load": panel_load,
    "panel_union": panel_union,
    "panel_refresh": panel_refresh,
    "panel_quarantine": panel_quarantine,
    "save_results": save_results,
    "json_scan": json_scan,
    "json_drift": json_drift,
    "json_field_kinds": json_field_kinds,
    "json_bad_records": json_bad_records,
    "missing_values": missing_values,
    "fill_missing": fill_missing,
    "drop_duplicates": drop_duplicates,
    "describe": describe,
    "correlation": correlation,
    "panel_correlation": panel_correlation,
    "outliers": outliers,
    "line_sums": line_sums,
    "line_shares": line_shares,
    "line_means": line_means,
    "top_orders": top_orders,
    "order_change": order_change,
    "line_change": line_change,
    "double_sums": double_sums,
    "repeated_lines": repeated_lines,
    "distinct_lines": distinct_lines,
    "order_features": order_features,
    "full_report": full_report,
    "chart_bundle": chart_bundle,
}
