"""Change between ordered rows and between two given years."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from supplypanel.functions.arithmetic import percent_change, safe_div
from supplypanel.operators.selection import to_rows
from supplypanel.session import settle

# Reported metrics and their columns.
CHANGE_METRICS = {
    "Suppliers": "Suppliers",
    "Beneficiaries": "Total Beneficiaries",
    "Claims": "Total Claims",
    "Payments": "Total Payments ($)",
}
SPENDING_CHANGES = {
    "Total Beneficiaries": "Beneficiaries % Change",
    "Total Spending": "Spending % Change",
    "Spending Per Beneficiary": "Per Beneficiary % Change",
}
CHANGE_ENDING = " % Change"


def pct_change(
    df: DataFrame,
    columns: Mapping[str, str],
    order_by: str,
    partition_by: Sequence[str],
    fill: bool = True,
) -> DataFrame:
    """Percent change of each column from the previous row that exists.

    ``columns`` maps an input column to the new one. With ``fill`` a missing value
    stands for the last one before it. ``partition_by`` names the entity, whose rows are
    as many as there are years; see ``yearly_changes`` for totals over all.
    """
    if not partition_by:
        raise ValueError("no keys: one task would take all rows; ordered_change takes the order of a whole table")
    return _changes(df, columns, order_by, partition_by, fill)


def _changes(
    df: DataFrame,
    columns: Mapping[str, str],
    order_by: str,
    partition_by: Sequence[str],
    fill: bool,
) -> DataFrame:
    ordered = Window.partitionBy(*partition_by).orderBy(order_by)
    so_far = ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    current = {c: f"{new}|now" for c, new in columns.items()}
    previous = {c: f"{new}|before" for c, new in columns.items()}
    filled = df.withColumns(
        {current[c]: F.last(c, ignorenulls=True).over(so_far) if fill else F.col(c) for c in columns}
    )
    lagged = filled.withColumns({previous[c]: F.lag(current[c]).over(ordered) for c in columns})
    changed = lagged.withColumns(
        {
            new: (safe_div(F.col(f"`{current[c]}`"), F.col(f"`{previous[c]}`")) - 1.0) * 100.0
            for c, new in columns.items()
        }
    )
    return changed.drop(*current.values(), *previous.values())


def ordered_change(
    df: DataFrame,
    columns: Mapping[str, str],
    order_by: Sequence[str],
    fill: bool = True,
) -> DataFrame:
    """Percent change of each column from the row before it in the order of the whole table.

    Rows are dealt to ranges of ``order_by`` and sorted inside them, so no task has all rows;
    what the first row of a range compares with comes from the ranges before it, of each of
    which one row is kept. Missing keys come first. Rows that are equal in all of ``order_by``
    may be in any order, so the last of the keys should tell rows apart. ``fill`` as in
    ``pct_change``.
    """
    if not order_by:
        raise ValueError("no column to order by")
    own = {c: f"{new}|own" for c, new in columns.items()}
    # written: the ranges come from a sample, which another run would draw differently
    dealt = settle(
        df.repartitionByRange(*[F.col(f"`{c}`") for c in order_by]).withColumn(
            "|range", F.spark_partition_id()
        ),
        "ranges",
    )
    inside = Window.partitionBy("|range").orderBy(*[F.col(f"`{c}`") for c in order_by])
    so_far = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = inside.rowsBetween(Window.unboundedPreceding, -1)
    place = F.struct(*[F.col(f"`{c}`") for c in order_by])
    lasts = {}
    for c, name in own.items():
        value = F.col(f"`{c}`")
        known = value.isNotNull() if fill else F.lit(True)
        lasts[name] = F.max_by(F.when(known, F.struct(value.alias("v"))), F.when(known, place))
    # one row for each range
    earlier = Window.orderBy("|range").rowsBetween(Window.unboundedPreceding, -1)
    carried = (
        dealt.groupBy("|range")
        .agg(*[e.alias(name) for name, e in lasts.items()])
        .select(
            F.col("|range").alias("|r"),
            *[F.last(name, ignorenulls=True).over(earlier).getField("v").alias(f"{name}|carried") for name in own.values()],
        )
    )
    joined = dealt.join(carried, dealt["|range"] == carried["|r"])
    changed = {}
    for c, new in columns.items():
        value, carry = F.col(f"`{c}`"), F.col(f"`{own[c]}|carried`")
        first = F.row_number().over(inside) == 1
        if fill:
            now = F.coalesce(F.last(value, ignorenulls=True).over(so_far), carry)
            previous = F.coalesce(F.last(value, ignorenulls=True).over(before), carry)
        else:
            now, previous = value, F.when(first, carry).otherwise(F.lag(value).over(inside))
        changed[new] = (safe_div(now, previous) - 1.0) * 100.0
    out = joined.withColumns(changed)
    return out.drop("|range", "|r", *[f"{name}|carried" for name in own.values()])


def two_year_change(
    overview: DataFrame,
    first: int,
    second: int,
    metrics: Mapping[str, str] = CHANGE_METRICS,
    year: str = "Year",
) -> DataFrame:
    """Percent change of each metric between two years, one row per metric; no rows when
    either year is absent. One pass over the yearly totals, without a join."""
    pair = overview.where(F.col(year).isin(first, second)).agg(
        F.count_distinct(year).alias("years"),
        *[
            F.max(F.when(F.col(year) == y, F.col(f"`{c}`"))).alias(f"{metric}|{y}")
            for metric, c in metrics.items()
            for y in (first, second)
        ],
    )
    cells = [
        {
            "Metric": F.lit(metric),
            f"Change {first}-{second} (%)": percent_change(
                F.col(f"`{metric}|{first}`"), F.col(f"`{metric}|{second}`")
            ),
        }
        for metric in metrics
    ]
    return to_rows(pair.where(F.col("years") == 2), [], cells)


def yearly_changes(spending: DataFrame) -> DataFrame:
    """Spending per year, one row for each year, with the three change columns appended."""
    return _changes(spending, SPENDING_CHANGES, "Year", (), True)
