"""Overview of the categories that a table of names falls into."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from supplypanel.functions.text import prefix_category
from supplypanel.operators.selection import to_rows
from supplypanel.sources.dictionary import CATEGORY_PREFIXES


def observed_columns(df: DataFrame, names: Sequence[str] | None = None) -> DataFrame:
    """The columns of a table that hold at least one value, as rows: ordinal, column,
    filled. One aggregate over the table, turned into rows afterwards."""
    names = list(names or df.columns)
    filled = df.agg(*[F.count(F.col(f"`{c}`")).alias(c) for c in names])
    cells = [
        {"ordinal": F.lit(i), "column": F.lit(c), "filled": F.col(f"`{c}`")}
        for i, c in enumerate(names, 1)
    ]
    return to_rows(filled, [], cells).where(F.col("filled") > 0)


def category_overview(
    names: DataFrame,
    dictionary: DataFrame | None = None,
    rules: Sequence[tuple[str, str]] = CATEGORY_PREFIXES,
    examples: int = 3,
) -> DataFrame:
    """Per category: how many names it has, the first few by ordinal, and what the
    dictionary says about those (NULL where it says nothing).

    ``names`` has ``ordinal`` and ``column``. One row per category, example text joined
    by commas, example descriptions as an array in the same order. Only the bounded
    examples are gathered into a row, never a whole category.
    """
    tagged = names.select("ordinal", "column", prefix_category("column", rules).alias("category"))
    sizes = tagged.groupBy("category").agg(F.count(F.lit(1)).alias("columns"))
    ordered = Window.partitionBy("category").orderBy("ordinal", "column")
    first = tagged.withColumn("rank", F.row_number().over(ordered)).where(
        F.col("rank") <= examples
    )
    if dictionary is None:
        first = first.withColumn("description", F.lit(None).cast("string"))
    else:
        known = dictionary.select("column", "description")
        first = first.join(known, "column", "left")
    picked = first.groupBy("category").agg(
        F.sort_array(F.collect_list(F.struct("rank", "column", "description"))).alias("picked")
    )
    return sizes.join(picked, "category").select(
        "category",
        "columns",
        F.array_join(F.col("picked.column"), ", ").alias("examples"),
        F.col("picked.description").alias("descriptions"),
    )
