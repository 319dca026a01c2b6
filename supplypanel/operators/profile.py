"""Cleaning and first looks: missing values, repeated keys, outliers, summaries."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from supplypanel.functions.arithmetic import percent_of
from supplypanel.operators.quantiles import (
    bracket_expressions,
    quantiles,
    quantiles_in,
    same_keys,
)
from supplypanel.operators.selection import require_columns, to_rows
from supplypanel.session import settle


def missing_counts(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Missing values per column: column, missing, percent. One pass over the table."""
    names = [c for c in df.columns if c not in by]
    counts = df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("|rows"), *[F.count(F.col(f"`{c}`")).alias(c) for c in names]
    )
    cells = []
    for c in names:
        missing = F.col("|rows") - F.col(f"`{c}`")
        cells.append(
            {
                "column": F.lit(c),
                "missing": missing,
                "percent": percent_of(missing, F.col("|rows")),
            }
        )
    return to_rows(counts, by, cells)


def fill_missing(df: DataFrame, values: Mapping[str, object]) -> DataFrame:
    """Replace missing values, per column."""
    return df.na.fill(dict(values))


def drop_missing(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Leave out rows that miss a value in one of the columns."""
    return df.na.drop(subset=list(columns) if columns else None)


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """One row per key, the first in the given order. Tasks drop all but their own first
    row of a key before the shuffle, so a key with very many rows is no burden."""
    ordered = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("|n", F.row_number().over(ordered)).where(F.col("|n") == 1).drop("|n")


QUARTILES = {"q1": 0.25, "median": 0.5, "q3": 0.75}


def describe_columns(
    df: DataFrame, columns: Sequence[str], by: Sequence[str] = (), quartiles: bool = True
) -> DataFrame:
    """Count, mean, sample standard deviation, minimum, quartiles and maximum per column.
    Quartiles are values that occur (the lowest that a quarter, half, three quarters of the
    values do not exceed)."""
    require_columns(df, columns)
    measures = {
        "count": F.count,
        "mean": F.avg,
        "std": F.stddev_samp,
        "min": F.min,
        "max": F.max,
    }
    sought = bracket_expressions(columns, list(QUARTILES.values())) if quartiles else {}
    values = df.groupBy(*by).agg(
        *[f(F.col(c).cast("double")).alias(f"{c}|{m}") for c in columns for m, f in measures.items()],
        *[e.alias(name) for name, e in sought.items()],
    )
    if quartiles:
        values = settle(values, "summary")  # one row for each key
    cells = [
        {"column": F.lit(c)} | {m: F.col(f"`{c}|{m}`") for m in measures} for c in columns
    ]
    summary = to_rows(values, by, cells)
    if not quartiles:
        return summary
    found = quantiles_in(df, values, columns, by, list(QUARTILES.values()))
    wide = found.groupBy(*by, "|column").agg(
        *[F.max(F.when(F.col("quantile") == q, F.col("value"))).alias(m) for m, q in QUARTILES.items()]
    )
    same = same_keys(summary, wide, [*((c, c) for c in by), ("column", "|column")])
    return summary.join(wide, same, "left").select(
        *[summary[c] for c in summary.columns], *[wide[m] for m in QUARTILES]
    )


# Spark generates code for operators of at most 100 fields; a correlation keeps six of them.
BLOCK = 4


def correlations(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Pearson correlation of every pair of columns, all in one scan. Rows that miss one
    of the two values do not count for that pair.

    Columns are cut into blocks of ``BLOCK``. A row is taken once for each pair of blocks, and
    one aggregate of fixed width, by keys and pair of blocks, holds the moments of the pairs
    between them; so a panel of any width stays within generated code, and a task sends as many
    rows for a key as there are pairs of blocks. Without keys an empty table has missing
    correlations, with keys no rows.
    """
    require_columns(df, columns)
    n = len(columns)
    if n < 2:
        raise ValueError("no pair of columns")
    starts = range(0, n, BLOCK)
    blocks = F.array(
        *[
            F.struct(F.lit(i).alias("|i"), F.lit(j).alias("|j"))
            for i in starts
            for j in starts
            if i <= j
        ]
    )
    keys = [f"|k{k}" for k in range(len(by))]
    # a null key is a key of its own
    values = df.select(
        *[F.col(c).alias(k) for c, k in zip(by, keys)],
        F.array(*[F.col(f"`{c}`").cast("double") for c in columns]).alias("|v"),
    )
    sides = [(x, y) for x in range(min(BLOCK, n)) for y in range(min(BLOCK, n))]
    if n <= BLOCK:
        sides = [(x, y) for x, y in sides if x < y]  # the one block with itself
    found = (
        values.select(*keys, "|v", F.inline(blocks))
        .groupBy(*keys, "|i", "|j")
        .agg(
            *[
                F.corr(F.get("|v", F.col("|i") + x), F.get("|v", F.col("|j") + y)).alias(f"|{x}|{y}")
                for x, y in sides
            ]
        )
    )
    if not by:
        every = df.sparkSession.range(1).select(F.inline(blocks))
        found = every.join(found, ["|i", "|j"], "left")
    names = F.array(*[F.lit(c) for c in columns])
    cells = [
        {
            "|a": F.col("|i") + x,
            "|b": F.col("|j") + y,
            "correlation": F.col(f"|{x}|{y}"),
        }
        for x, y in sides
    ]
    pairs = to_rows(found, keys, cells).where((F.col("|a") < F.col("|b")) & (F.col("|b") < n))
    return pairs.select(
        *[F.col(k).alias(c) for c, k in zip(by, keys)],
        F.get(names, F.col("|a")).alias("first"),
        F.get(names, F.col("|b")).alias("second"),
        "correlation",
    )


def outlier_fences(
    df: DataFrame, column: str, by: Sequence[str] = (), width: float = 1.5
) -> DataFrame:
    """Per key: lower and upper fence, ``width`` quartile distances beyond the quartiles. A
    fence that infinite quartiles leave undefined is missing, and nothing lies beyond it."""
    found = quantiles(df, column, by, [0.25, 0.75])
    quartiles = found.groupBy(*by).agg(F.min("value").alias("q1"), F.max("value").alias("q3"))
    distance = F.lit(width) * (F.col("q3") - F.col("q1"))
    lower, upper = F.col("q1") - distance, F.col("q3") + distance
    return quartiles.select(
        *by,
        F.when(~F.isnan(lower), lower).alias("lower"),
        F.when(~F.isnan(upper), upper).alias("upper"),
    )


def outliers(
    df: DataFrame, column: str, by: Sequence[str] = (), width: float = 1.5
) -> DataFrame:
    """Rows whose value lies beyond the fences of their key, also of a missing key; without
    keys, beyond those of all rows. Spark chooses the join by the size of the fences, one
    row per key."""
    fences = outlier_fences(df, column, by, width)
    fences = fences.withColumnsRenamed({c: f"|{c}" for c in by})
    value = df[column].cast("double")
    beyond = ~F.isnan(value) & (value < fences["lower"]) | (~F.isnan(value) & (value > fences["upper"]))
    same = same_keys(df, fences, [(c, f"|{c}") for c in by])
    if by:
        return df.join(fences, same & beyond).select(*[df[c] for c in df.columns])
    low, high = fences.select("lower").scalar(), fences.select("upper").scalar()
    return df.where(~F.isnan(value) & ((value < low) | (value > high)))
