"""The tables behind the charts. Each takes a panel of one or more years, or a yearly
summary, and returns rows ready to draw."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from supplypanel.functions.arithmetic import safe_div
from supplypanel.functions.parsing import parse_currency
from supplypanel.functions.text import format_currency, format_percent
from supplypanel.operators.change import CHANGE_ENDING, SPENDING_CHANGES, yearly_changes
from supplypanel.operators.measures import (
    group_shares,
    spending_patterns,
    value_shares,
    weighted_means,
)
from supplypanel.operators.selection import to_rows
from supplypanel.operators.topk import top_per_group, top_states, top_suppliers_raw

RUCA = "Suplr_Prvdr_RUCA_Desc"
SORTED_GROUP = "Race Distribution"
BILLION = 1e9

# The series of the spending chart.
SPENDING_SERIES = ("DME Spending", "Prosthetic/Orthotic Spending", "Drug Spending")


def spending_by_category(spending: DataFrame) -> DataFrame:
    """One row per year and spending category, in billions."""
    cells = [
        {
            "Category": F.lit(name),
            "Spending (Billions $)": F.col(f"`{name}`") / F.lit(BILLION),
        }
        for name in SPENDING_SERIES
    ]
    return to_rows(spending, ["Year"], cells)


def demographic_slices(shares: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Pie slices: the position in each pie, and shares scaled to fill it."""
    pie = Window.partitionBy(*by, "group")
    largest_first = F.when(F.col("group") == SORTED_GROUP, F.col("pct"))
    ordered = pie.orderBy(largest_first.desc_nulls_last(), "ordinal")
    # Two-decimal shares add up exactly as decimals, in whatever order they come.
    whole = F.sum(F.col("pct").cast("decimal(9,2)")).over(pie)
    share = safe_div(F.col("pct"), whole) * F.lit(100.0)
    return shares.select(
        *by,
        "group",
        F.row_number().over(ordered).alias("position"),
        "label",
        "pct",
        format_percent(share, 1).alias("slice"),
    )


def demographic_chart(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return demographic_slices(group_shares(df, by=by), by)


def top_of_means(means: DataFrame, n: int = 10, by: Sequence[str] = ()) -> DataFrame:
    best = top_per_group(means, [*by, "group"], "value", ["ordinal"], n)
    return best.select(*by, "group", "rank", "label", "value")


def top_conditions(df: DataFrame, n: int = 10, by: Sequence[str] = ()) -> DataFrame:
    """The n most common conditions of each group."""
    return top_of_means(weighted_means(df, by=by), n, by)


def top_suppliers_chart(df: DataFrame, n: int = 10) -> DataFrame:
    """The n suppliers with the most beneficiaries, with their place by payments and by
    beneficiaries, smallest first. The choice is by beneficiaries in both cases, and
    payments are whole cents, as read back from their display text."""
    return suppliers_chart(top_suppliers_raw(df, n))


def suppliers_chart(best: DataFrame) -> DataFrame:
    """The chart of the rows of ``top_suppliers_raw``."""
    chosen = best.withColumn("Medicare Payments", format_currency("payments"))
    chosen = chosen.withColumn(
        "Medicare Payments (Numeric)", parse_currency("Medicare Payments")
    )

    def place(measure: str):
        # At most n rows are left, so one ordering over all of them is safe.
        window = Window.orderBy(F.col(f"`{measure}`").asc_nulls_last(), "key")
        return F.row_number().over(window)

    return chosen.select(
        "Supplier",
        "Beneficiaries",
        "Claims",
        "Medicare Payments",
        "Medicare Payments (Numeric)",
        place("Medicare Payments (Numeric)").alias("payments_place"),
        place("Beneficiaries").alias("beneficiaries_place"),
    )


def ruca_share(df: DataFrame, weight: str | None = None) -> DataFrame:
    """Suppliers per rural-urban class and their share; no rows when the table does not
    have the class."""
    if RUCA not in df.columns:
        return df.sparkSession.createDataFrame(
            [], "`RUCA Description` string, Suppliers bigint, share double, slice string"
        )
    counts = value_shares(df, RUCA, "RUCA Description", "Suppliers", weight=weight)
    return counts.withColumn("slice", format_percent("share", 1))


def yoy_series(spending: DataFrame) -> DataFrame:
    """Year-over-year percent change of three metrics, first year left out."""
    first_first = Window.orderBy("Year")
    changes = (
        yearly_changes(spending)
        .withColumn("place", F.row_number().over(first_first))
        .where(F.col("place") > 1)
    )
    cells = [
        {
            "Metric": F.replace(F.lit(name), F.lit(CHANGE_ENDING), F.lit("")),
            "Percentage Change (%)": F.col(f"`{name}`"),
        }
        for name in SPENDING_CHANGES.values()
    ]
    return to_rows(changes, ["Year"], cells)


def chart_tables(panel: DataFrame, latest: DataFrame) -> dict[str, DataFrame]:
    """All chart tables, from the whole panel and its latest year."""
    spending = spending_patterns(panel)
    return {
        "spending_trends": spending,
        "spending_by_category": spending_by_category(spending),
        "demographics": demographic_chart(latest),
        "health_conditions": top_conditions(latest),
        "top_suppliers": top_suppliers_chart(latest),
        "top_states": top_states(latest),
        "ruca_share": ruca_share(latest),
    }
