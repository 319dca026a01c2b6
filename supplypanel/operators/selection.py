"""Choosing rows, columns and labels before and after an aggregate."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from supplypanel.sources.dictionary import column_label


def require_columns(df: DataFrame, names: Iterable[str]) -> None:
    missing = [name for name in names if name not in df.columns]
    if missing:
        raise KeyError(f"no such column: {missing}")


def select_year(df: DataFrame, year: int, known_years: Iterable[int] | None = None) -> DataFrame:
    """Rows of one year. With the list of known years (from the file listing) an absent
    year is an error and no data is read to find that out."""
    if known_years is not None and year not in set(known_years):
        raise ValueError(f"year {year} is not in {sorted(known_years)}")
    return df.where(F.col("year") == year)


def select_latest_year(df: DataFrame, years: DataFrame | None = None) -> DataFrame:
    """Rows of the largest year present, found by a scalar subquery.

    ``years`` is a cheaper table with the same ``year`` values to look in, such as the
    stored table that ``df`` is computed from. Where the year list is known,
    ``YearlyPanel.latest`` needs no scan at all.
    """
    source = df if years is None else years
    return df.where(F.col("year") == source.select(F.max("year")).scalar())


def latest_year_of(df: DataFrame, column: str) -> int | None:
    """The year of the latest date in a column, found from file statistics or one scan of
    that column; None without rows. Known while a plan is built, it can limit a scan."""
    latest = df.agg(F.max(column)).first()[0]
    return None if latest is None else latest.year


def to_rows(
    df: DataFrame,
    by: Sequence[str],
    cells: Sequence[Mapping[str, Column]],
) -> DataFrame:
    """Wide to long without a join or shuffle: each input row becomes one row per cell,
    and a cell is a mapping from output name to expression. Meant for aggregated rows."""
    if not cells:
        raise ValueError("no column to turn into rows")
    structs = [F.struct(*[c.alias(name) for name, c in cell.items()]) for cell in cells]
    return df.select(*by, F.inline(F.array(*structs)))


def grouped_cells(
    groups: Mapping[str, Sequence[str]],
    values: Mapping[str, Column],
    value_name: str,
    dictionary: Mapping[str, str],
) -> list[dict[str, Column]]:
    """Cells ``group, ordinal, label, value`` for every column of every group. Labels are
    known when the plan is built; a column without one raises ``KeyError``."""
    ordinal = 0
    cells = []
    for group, names in groups.items():
        for name in names:
            ordinal += 1
            cells.append(
                {
                    "group": F.lit(group),
                    "ordinal": F.lit(ordinal),
                    "label": F.lit(column_label(name, dictionary)),
                    value_name: values[name],
                }
            )
    return cells
