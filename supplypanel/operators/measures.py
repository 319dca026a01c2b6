"""Totals, shares, weighted means, yearly summaries and frequency counts.

Each summary has two halves: the aggregate expressions, and a projection of the
aggregated rows. A report can so collect the expressions of many summaries and read the
panel once.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from supplypanel.functions.arithmetic import percent_of, safe_div, total
from supplypanel.operators.selection import grouped_cells, require_columns, to_rows
from supplypanel.sources.dictionary import (
    COLUMN_DESCRIPTIONS,
    DEMOGRAPHIC_GROUPS,
    condition_groups,
)

BENES = "DME_Tot_Suplr_Benes"
CLAIMS = "DME_Tot_Suplr_Clms"
DME_PAID = "DME_Suplr_Mdcr_Pymt_Amt"
POS_PAID = "POS_Suplr_Mdcr_Pymt_Amt"
DRUG_PAID = "Drug_Suplr_Mdcr_Pymt_Amt"
ROWS = "row_count"
PRODUCT = "weighted:"


def flat(groups: Mapping[str, Sequence[str]]) -> list[str]:
    return [name for names in groups.values() for name in names]


def total_expressions(names: Sequence[str]) -> dict[str, Column]:
    return {name: total(name) for name in names}


def product_expressions(names: Sequence[str], weight: str) -> dict[str, Column]:
    return {PRODUCT + name: total(F.col(name) * F.col(weight)) for name in names}


def aggregate(df: DataFrame, by: Sequence[str], measures: Mapping[str, Column]) -> DataFrame:
    return df.groupBy(*by).agg(*[c.alias(name) for name, c in measures.items()])


def column_totals(df: DataFrame, names: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Null-skipping sums of many columns in one pass; a sum of nothing is zero."""
    require_columns(df, names)
    return aggregate(df, by, total_expressions(names))


# Shares of a total within groups of columns.


def shares_of_totals(
    totals: DataFrame,
    groups: Mapping[str, Sequence[str]] = DEMOGRAPHIC_GROUPS,
    by: Sequence[str] = (),
    dictionary: Mapping[str, str] = COLUMN_DESCRIPTIONS,
) -> DataFrame:
    shares = {}
    for names in groups.values():
        whole = sum((F.col(name) for name in names[1:]), F.col(names[0]))
        shares |= {name: percent_of(F.col(name), whole) for name in names}
    return to_rows(totals, by, grouped_cells(groups, shares, "pct", dictionary))


def group_shares(
    df: DataFrame,
    groups: Mapping[str, Sequence[str]] = DEMOGRAPHIC_GROUPS,
    by: Sequence[str] = (),
    dictionary: Mapping[str, str] = COLUMN_DESCRIPTIONS,
) -> DataFrame:
    """Percent of the group's total held by each of its columns, to two decimals."""
    totals = column_totals(df, flat(groups), by)
    return shares_of_totals(totals, groups, by, dictionary)


# Weighted means of many columns.


def means_of_totals(
    totals: DataFrame,
    groups: Mapping[str, Sequence[str]],
    weight: str,
    by: Sequence[str] = (),
    dictionary: Mapping[str, str] = COLUMN_DESCRIPTIONS,
) -> DataFrame:
    means = {name: safe_div(F.col(PRODUCT + name), F.col(weight)) for name in flat(groups)}
    return to_rows(totals, by, grouped_cells(groups, means, "value", dictionary))


def weighted_means(
    df: DataFrame,
    groups: Mapping[str, Sequence[str]] | None = None,
    weight: str = BENES,
    by: Sequence[str] = (),
    dictionary: Mapping[str, str] = COLUMN_DESCRIPTIONS,
) -> DataFrame:
    """``sum(x * weight) / sum(weight)`` for every column of every group.

    The divisor is the weight of all rows: a row whose value is missing adds nothing to
    the numerator but still counts in the divisor.
    """
    groups = condition_groups(df.columns) if groups is None else groups
    names = flat(groups)
    require_columns(df, [*names, weight])
    measures = product_expressions(names, weight) | total_expressions([weight])
    return means_of_totals(aggregate(df, by, measures), groups, weight, by, dictionary)


# Yearly summaries.


def yearly_expressions() -> dict[str, Column]:
    paid = [BENES, CLAIMS, DME_PAID, POS_PAID, DRUG_PAID]
    return {ROWS: F.count(F.lit(1))} | total_expressions(paid)


def overview_of_totals(totals: DataFrame) -> DataFrame:
    return totals.select(
        F.col("year").alias("Year"),
        F.col(ROWS).alias("Suppliers"),
        F.col(BENES).alias("Total Beneficiaries"),
        F.col(CLAIMS).alias("Total Claims"),
        F.col(DME_PAID).cast("double").alias("Total Payments ($)"),
    )


def yearly_overview(panel: DataFrame) -> DataFrame:
    """Suppliers, beneficiaries, claims and payments per year. Payments are those of the
    DME family only."""
    names = [BENES, CLAIMS, DME_PAID]
    measures = {ROWS: F.count(F.lit(1))} | total_expressions(names)
    return overview_of_totals(aggregate(panel, ["year"], measures))


def spending_of_totals(totals: DataFrame) -> DataFrame:
    benes, spend = F.col(BENES), F.col(DME_PAID).cast("double")
    return totals.select(
        F.col("year").alias("Year"),
        benes.alias("Total Beneficiaries"),
        spend.alias("Total Spending"),
        F.when(benes > 0, safe_div(spend, benes)).otherwise(0.0).alias("Spending Per Beneficiary"),
        spend.alias("DME Spending"),
        F.col(POS_PAID).cast("double").alias("Prosthetic/Orthotic Spending"),
        F.col(DRUG_PAID).cast("double").alias("Drug Spending"),
    )


def spending_patterns(panel: DataFrame) -> DataFrame:
    """Spending per year, per beneficiary and by family. "Total Spending" is the DME
    family alone, so it equals "DME Spending"."""
    return spending_of_totals(column_totals(panel, [BENES, DME_PAID, POS_PAID, DRUG_PAID], ["year"]))


# Frequency counts.


def value_counts(
    df: DataFrame,
    column: str,
    by: Sequence[str] = (),
    value_name: str | None = None,
    count_name: str = "count",
    weight: str | None = None,
) -> DataFrame:
    """Rows per value, missing values left out. Unordered; see ``topk`` for ranking. Where
    rows are counts already, ``weight`` names the column that has them."""
    require_columns(df, [column])
    return (
        df.where(F.col(column).isNotNull())
        .groupBy(*by, F.col(column).alias(value_name or column))
        .agg((F.sum(weight) if weight else F.count(F.lit(1))).alias(count_name))
    )


def value_shares(
    df: DataFrame,
    column: str,
    value_name: str | None = None,
    count_name: str = "count",
    share_name: str = "share",
    weight: str | None = None,
) -> DataFrame:
    """Rows per value and their percent of all rows that have a value. The total is a
    scalar subquery over the counts, which are shuffled once for both, so the values are
    never gathered in one task."""
    counts = value_counts(
        df, column, value_name=value_name, count_name=count_name, weight=weight
    )
    whole = counts.select(F.sum(count_name)).scalar()
    return counts.withColumn(share_name, safe_div(F.col(count_name), whole) * F.lit(100.0))
