"""The full report: yearly overview, change, column categories, top suppliers,
demographics, conditions, spending and chart tables.

Two aggregates feed nearly all of it: one with a few sums over all years, one with many
sums over the latest year. Both are a handful of rows and are computed first, so that the
panel is not read again for every section.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from supplypanel.functions.text import format_count, format_currency, format_percent
from supplypanel.operators.categories import category_overview
from supplypanel.operators.change import CHANGE_METRICS, two_year_change
from supplypanel.operators.charts import (
    demographic_slices,
    RUCA,
    ruca_share,
    spending_by_category,
    suppliers_chart,
    top_of_means,
    yoy_series,
)
from supplypanel.operators.measures import (
    BENES,
    aggregate,
    flat,
    means_of_totals,
    overview_of_totals,
    product_expressions,
    shares_of_totals,
    spending_of_totals,
    total_expressions,
    yearly_expressions,
)
from supplypanel.operators.selection import require_columns, to_rows
from supplypanel.operators.topk import STATE, suppliers_display, top_states, top_suppliers_raw
from supplypanel.plans.sinks import save_result_set
from supplypanel.session import settle
from supplypanel.sources.dictionary import (
    CONDITION_PREFIXES,
    DEMOGRAPHIC_GROUPS,
    column_table,
    condition_groups,
    dictionary_table,
)
from supplypanel.sources.yearly import YearlyPanel, load_panel, store_panel

# Which report columns are shown as currency and which as counts.
CURRENCY_COLUMNS = (
    "Total Spending",
    "Spending Per Beneficiary",
    "DME Spending",
    "Prosthetic/Orthotic Spending",
    "Drug Spending",
)
COUNT_COLUMNS = ("Year", "Total Beneficiaries")


@dataclass(frozen=True)
class Report:
    """The panel and the result tables by name."""

    panel: YearlyPanel
    tables: dict[str, DataFrame]


def overview_display(overview: DataFrame) -> DataFrame:
    return overview.select(
        "Year",
        "Suppliers",
        *[
            format_count(f"`{c}`").alias(c)
            for c in ("Total Beneficiaries", "Total Claims", "Total Payments ($)")
        ],
    )


def spending_display(spending: DataFrame) -> DataFrame:
    """Spending as text. The year, too, gets a thousands separator."""
    shown = {c: format_currency(f"`{c}`") for c in CURRENCY_COLUMNS if c in spending.columns}
    shown |= {c: format_count(f"`{c}`") for c in COUNT_COLUMNS if c in spending.columns}
    return spending.select(*[shown.get(c, F.col(f"`{c}`")).alias(c) for c in spending.columns])


def change_display(change: DataFrame) -> DataFrame:
    value = next(c for c in change.columns if c != "Metric")
    return change.select("Metric", format_percent(f"`{value}`").alias(value))


def percent_display(rows: DataFrame, value: str) -> DataFrame:
    """Share or prevalence rows with the value as text."""
    return rows.withColumn(value, format_percent(value))


def report_tables(
    panel: YearlyPanel, change_years: tuple[int, int] = (2021, 2022), top_n: int = 10
) -> Report:
    """Every table of the report. The two aggregates are computed here, the rest when
    a table is used."""
    latest = panel.latest()
    conditions = condition_groups(latest.columns)
    demographic_columns = flat(DEMOGRAPHIC_GROUPS)
    require_columns(latest, demographic_columns)

    by_year = settle(aggregate(panel.data, ["year"], yearly_expressions()), "by_year")
    sums = total_expressions([*demographic_columns, BENES])
    products = product_expressions(flat(conditions), BENES)
    of_latest = settle(aggregate(latest, [], sums | products), "of_latest")

    overview = overview_of_totals(by_year)
    spending = spending_of_totals(by_year)
    shares = shares_of_totals(of_latest)
    means = means_of_totals(of_latest, conditions, BENES)
    names = column_table(latest.drop("year"))
    # rows of the latest year are read once more for each of these, so they are kept
    best = settle(top_suppliers_raw(latest, top_n), "best")
    places = [c for c in (STATE, RUCA) if c in latest.columns]
    placed = settle(latest.groupBy(*places).agg(F.count(F.lit(1)).alias("Suppliers")), "places")
    tables = {
        "overview": overview,
        "two_year_change": two_year_change(overview, *change_years),
        "categories": category_overview(names, dictionary_table(names.sparkSession)),
        "top_suppliers": suppliers_display(best),
        "demographics": shares,
        "conditions": means,
        "spending": spending,
        "spending_by_category": spending_by_category(spending),
        "demographic_chart": demographic_slices(shares),
        "top_conditions": top_of_means(means, top_n),
        "top_suppliers_chart": suppliers_chart(best),
        "top_states": top_states(placed, weight="Suppliers"),
        "ruca_share": ruca_share(placed, weight="Suppliers"),
        "yoy_changes": yoy_series(spending),
    }
    return Report(panel, tables)


def report_lines(tables: dict[str, DataFrame]) -> DataFrame:
    """The printed sections of a report as rows of text in reading order: number of the
    section, line in it, section, item, metric, text."""

    def lines(df: DataFrame, order: Column, item: Column, metrics: dict[str, Column]) -> DataFrame:
        cells = [
            {
                "|order": order,
                "|place": F.lit(place),
                "item": item.cast("string"),
                "metric": F.lit(metric),
                "text": c.cast("string"),
            }
            for place, (metric, c) in enumerate(metrics.items())
        ]
        return to_rows(df, [], cells)

    def every(df: DataFrame, *leave_out: str) -> dict[str, Column]:
        return {c: F.col(f"`{c}`") for c in df.columns if c not in leave_out}

    def labelled(df: DataFrame, order: Column, value: str) -> DataFrame:
        return df.select(
            order.alias("|order"),
            F.lit(0).alias("|place"),
            F.col("group").alias("item"),
            F.col("label").alias("metric"),
            F.col(value).alias("text"),
        )

    overview = overview_display(tables["overview"])
    change = change_display(tables["two_year_change"])
    change_value = next(c for c in change.columns if c != "Metric")
    categories = tables["categories"]
    counts = {"columns": F.col("columns"), "examples": F.col("examples")}
    described = categories.select(
        "category",
        F.posexplode(F.arrays_zip(F.split("examples", ", ").alias("name"), "descriptions")).alias("i", "e"),
    ).where("e.descriptions is not null")
    suppliers = tables["top_suppliers_chart"]
    shares = percent_display(tables["demographics"], "pct")
    means = percent_display(tables["top_conditions"], "value")
    spending = spending_display(tables["spending"])
    metric_place = F.array_position(F.array(*[F.lit(m) for m in CHANGE_METRICS]), F.col("Metric"))
    most_first = F.struct(
        F.col("Beneficiaries").isNull(), -F.col("Beneficiaries"), F.col("Supplier")
    )
    groups = F.array(*[F.lit(g) for g in CONDITION_PREFIXES])
    sections = {
        "Overview": lines(
            overview, F.struct("Year"), F.col("Year"), every(overview, "Year")
        ),
        "Change": change.select(
            F.struct(metric_place.alias("o")).alias("|order"),
            F.lit(0).alias("|place"),
            F.lit(change_value).alias("item"),
            F.col("Metric").alias("metric"),
            F.col(f"`{change_value}`").alias("text"),
        ),
        "Column categories": lines(
            categories, F.struct("category"), F.col("category"), counts
        ).unionByName(
            described.select(
                F.struct("category").alias("|order"),
                (F.col("i") + len(counts)).alias("|place"),
                F.col("category").alias("item"),
                F.col("e.name").alias("metric"),
                F.col("e.descriptions").alias("text"),
            )
        ),
        "Top suppliers": lines(
            suppliers,
            most_first,
            F.col("Supplier"),
            {c: F.col(f"`{c}`") for c in ("Beneficiaries", "Claims", "Medicare Payments")},
        ),
        "Demographics": labelled(shares, F.struct("ordinal"), "pct"),
        "Health conditions": labelled(
            means, F.struct(F.array_position(groups, F.col("group")).alias("g"), "rank"), "value"
        ),
        "Spending": lines(spending, F.struct("Year"), F.col("Year"), every(spending, "Year")),
    }
    numbered = [
        df.select(
            F.lit(number).alias("section_no"),
            # a section has a few dozen rows
            F.row_number()
            .over(Window.partitionBy(F.lit(number)).orderBy("|order", "|place"))
            .alias("line"),
            F.lit(section).alias("section"),
            "item",
            "metric",
            "text",
        )
        for number, (section, df) in enumerate(sections.items(), 1)
    ]
    return reduce(DataFrame.unionByName, numbered)


def chart_lines(charts: dict[str, DataFrame]) -> DataFrame:
    """Chart tables as rows of text: chart, line, column, text. Lines follow the order of the
    chart; numbers that are not whole have four places."""
    ordered = {
        "spending_trends": ["Year"],
        "spending_by_category": ["Year", "Category"],
        "demographics": ["group", "position"],
        "health_conditions": ["group", "rank"],
        "top_suppliers": ["payments_place"],
        "top_states": [F.col("Suppliers").desc(), F.col("State")],
        "ruca_share": [F.col("Suppliers").desc(), F.col("RUCA Description")],
    }
    out = []
    for name, chart in charts.items():
        # a chart has a few dozen rows
        line = F.row_number().over(Window.partitionBy(F.lit(name)).orderBy(*ordered[name]))
        numbered = chart.withColumn("|line", line)
        cells = [
            {
                "chart": F.lit(name),
                "line": F.col("|line"),
                "column": F.lit(c),
                "text": F.format_number(F.col(f"`{c}`"), 4)
                if kind == "double"
                else F.col(f"`{c}`").cast("string"),
            }
            for c, kind in chart.dtypes
        ]
        out.append(to_rows(numbered, [], cells))
    return reduce(DataFrame.unionByName, out)


def run_report(
    spark: SparkSession,
    root: str,
    years: Iterable[int] | None = None,
    out: str | None = None,
    store: str | None = None,
    change_years: tuple[int, int] = (2021, 2022),
    top_n: int = 10,
    **load_options,
) -> Report:
    """Load the yearly files, build every table and, with ``out``, save them all as a set
    (``read_result_set`` reads the last one).

    With ``store`` the parsed panel is first written there as one table partitioned by
    year, and the report reads only the columns and years it needs from it; text is then
    parsed once.
    """
    panel = load_panel(spark, root, years, **load_options)
    if store:
        panel = store_panel(panel, store)
    report = report_tables(panel, change_years, top_n)
    if out:
        save_result_set(report.tables, out)
    return report
