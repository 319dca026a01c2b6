"""Tolerant loading of yearly files in one scan.

Every record is read once and written once: those that fit the header as rows of the panel,
all others as text in a quarantine table, with year, file and reason. How many there were is
observed in the same pass. A year that cannot be read at all, or in which records have line
breaks inside quotes (whose halves may look whole), is left out of the panel and listed with
its reason.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from supplypanel.functions.parsing import type_columns
from supplypanel.sources.yearly import (
    BAD_RECORD,
    PATH_TEMPLATE,
    YearlyPanel,
    discover_years,
    read_text_table,
    record_problem,
    stack_years,
    year_path,
)

FILE, KEPT, FIELDS = "_file", "_kept", "_fields"
QUARANTINE = "year int, file string, reason string, record string"


@dataclass(frozen=True)
class TolerantLoad:
    """The panel of the years that could be read, the records that were left out (year, file,
    reason, record; no record where a whole year was), and the counts ``rows`` and
    ``left_out``."""

    panel: YearlyPanel
    quarantine: DataFrame
    counts: Mapping[str, int]


def load_tolerant(
    spark: SparkSession,
    root: str,
    path: str,
    years: Iterable[int] | None = None,
    template: str = PATH_TEMPLATE,
    types: Mapping[str, str] | None = None,
) -> TolerantLoad:
    """Load the yearly delimited files under ``root`` and store panel and quarantine under
    ``path``."""
    found = discover_years(spark, root, template)
    problems: list[tuple[int, str, str, str | None]] = []
    tables: dict[int, DataFrame] = {}
    for year in found if years is None else list(years):
        file = year_path(root, year, template)
        try:
            table = read_text_table(spark, file, bad="keep")
        except AnalysisException as problem:
            problems.append((year, file, problem.getCondition() or str(problem), None))
            continue
        if not table.columns:
            problems.append((year, file, "no header", None))
            continue
        tables[year] = table.withColumns(
            {FILE: F.input_file_name(), FIELDS: F.lit(len(table.columns) - 1)}
        )
    if not tables:
        raise ValueError(f"no yearly file could be read under {root}")
    names = {y: [c for c in t.columns if c not in (BAD_RECORD, FILE, FIELDS)] for y, t in tables.items()}
    extra = {"year": "keep", BAD_RECORD: "keep", FILE: "keep", FIELDS: "keep"}
    stacked = type_columns(stack_years(tables), extra | dict(types or {}))
    marked = stacked.withColumn(KEPT, F.col(BAD_RECORD).isNull())
    seen = Observation("records")
    counted = marked.observe(
        seen, F.count_if(KEPT).alias("rows"), F.count_if(~F.col(KEPT)).alias("left_out")
    )
    counted.write.mode("errorifexists").partitionBy(KEPT, "year").parquet(path)
    stored = spark.read.schema(marked.schema).parquet(path)

    reason = record_problem(F.col(BAD_RECORD), F.col(FIELDS))
    bad = stored.where(~F.col(KEPT)).select(
        "year",
        F.col(FILE).alias("file"),
        F.rtrim(F.rtrim(reason), F.lit(":")).alias("reason"),
        F.col(BAD_RECORD).alias("record"),
    )
    broken = F.regexp_count(F.col("record"), F.lit('"')) % 2 == 1
    # one row for each year
    halves = {r.year for r in bad.where(broken).select("year").distinct().collect()}
    problems += [
        (y, year_path(root, y, template), "line breaks inside quotes; read it with multiline=True", None)
        for y in sorted(halves)
    ]
    good = tuple(sorted(y for y in tables if y not in halves))
    own = [c for c in marked.columns if c not in (BAD_RECORD, FILE, FIELDS, KEPT)]
    data = stored.where(F.col(KEPT) & F.col("year").isin(list(good))).select(*[F.col(f"`{c}`") for c in own])
    quarantine = bad.unionByName(spark.createDataFrame(problems, QUARANTINE))
    panel = YearlyPanel(data, good, {y: names[y] for y in good})
    return TolerantLoad(panel, quarantine, dict(seen.get))
