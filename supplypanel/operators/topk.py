"""Top rows with a total order: ties are broken by key and missing values go last."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from supplypanel.functions.text import format_currency
from supplypanel.operators.measures import BENES, CLAIMS, DME_PAID, value_counts
from supplypanel.operators.selection import require_columns

SUPPLIER_KEY = "Suplr_NPI"
SUPPLIER_NAME = "Suplr_Prvdr_Last_Name_Org"
STATE = "Suplr_Prvdr_State_Abrvtn"


def descending(measure: str, *ties: str) -> list[Column]:
    return [F.col(measure).desc_nulls_last(), *[F.col(t).asc_nulls_last() for t in ties]]


def top_rows(df: DataFrame, measure: str, ties: Sequence[str], n: int = 10) -> DataFrame:
    """The n largest rows, with their ``rank``.

    Every task keeps n rows and only those are merged. The rank over the n rows stands
    between the limit and whatever is computed next: projections that Spark moves below
    a limit can otherwise turn it into a sort of the whole table.
    """
    require_columns(df, [measure, *ties])
    order = descending(measure, *ties)
    ranked = F.row_number().over(Window.orderBy(*order))
    return df.orderBy(*order).limit(n).withColumn("rank", ranked).where(F.col("rank") <= n)


def top_per_group(
    df: DataFrame, group: Sequence[str], measure: str, ties: Sequence[str], n: int
) -> DataFrame:
    """The n largest rows of every group, with their ``rank``. The bound on the rank lets
    Spark drop rows beyond n in each task before the shuffle."""
    ordered = Window.partitionBy(*group).orderBy(*descending(measure, *ties))
    return df.withColumn("rank", F.row_number().over(ordered)).where(F.col("rank") <= n)


def top_suppliers_raw(df: DataFrame, n: int = 10, key: str = SUPPLIER_KEY) -> DataFrame:
    best = top_rows(
        df.select(key, SUPPLIER_NAME, BENES, CLAIMS, DME_PAID), BENES, [key], n
    )
    return best.select(
        F.col(key).alias("key"),
        F.col(SUPPLIER_NAME).alias("Supplier"),
        F.col(BENES).alias("Beneficiaries"),
        F.col(CLAIMS).alias("Claims"),
        F.col(DME_PAID).cast("double").alias("payments"),
    )


def top_suppliers(df: DataFrame, n: int = 10, key: str = SUPPLIER_KEY) -> DataFrame:
    """The suppliers with the most beneficiaries, with payments as display text."""
    return suppliers_display(top_suppliers_raw(df, n, key))


def suppliers_display(best: DataFrame) -> DataFrame:
    """The rows of ``top_suppliers_raw`` for display."""
    return best.select(
        "Supplier",
        "Beneficiaries",
        "Claims",
        format_currency("payments").alias("Medicare Payments"),
    )


def top_values(
    df: DataFrame, column: str, n: int, value_name: str, count_name: str, weight: str | None = None
) -> DataFrame:
    """The n most frequent values."""
    counts = value_counts(
        df, column, value_name=value_name, count_name=count_name, weight=weight
    )
    return top_rows(counts, count_name, [value_name], n).drop("rank")


def top_states(df: DataFrame, n: int = 15, weight: str | None = None) -> DataFrame:
    return top_values(df, STATE, n, "State", "Suppliers", weight)
