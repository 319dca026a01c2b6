"""One delimited or JSON file set per year, stacked by column name into one panel."""

from __future__ import annotations

import re
import warnings
from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from supplypanel.functions.parsing import type_columns

# The published file layout.
PATH_TEMPLATE = "{root}/{year}/mup_dme_ry24_p05_v10_dy{yy}_supr.csv"

BYTE_ORDER_MARK = "\ufeff"
# The text of a record that does not fit the header, where it was asked for.
BAD_RECORD = "_bad_record"


@dataclass(frozen=True)
class YearlyPanel:
    """One DataFrame with a ``year`` column, the years it was read from and, where they
    differ, the columns that each year has."""

    data: DataFrame
    years: tuple[int, ...]
    columns: Mapping[int, Sequence[str]] = field(default_factory=dict)

    @property
    def latest_year(self) -> int:
        return max(self.years)

    def year(self, year: int) -> DataFrame:
        """Rows of one year, with the columns of that year; the other years' files are
        not read."""
        if year not in self.years:
            raise ValueError(f"year {year} is not in the panel, which has {list(self.years)}")
        rows = self.data.where(F.col("year") == year)
        if year not in self.columns:
            return rows
        return rows.select(*[F.col(f"`{c}`") for c in self.columns[year]], "year")

    def latest(self) -> DataFrame:
        return self.year(self.latest_year)


def record_problem(record: Column, fields: int | Column) -> Column:
    """What is wrong with a record that has not as many fields as the header; NULL if it
    merely misses the last ones."""
    quotes = F.regexp_count(record, F.lit('"'))
    separators = F.regexp_count(F.regexp_replace(record, '"[^"]*"', ""), F.lit(","))
    return (
        F.when(quotes % 2 == 1, "line break inside quotes (read it with multiline=True): ")
        .when(separators >= fields, "more fields than the header: ")
    )


def read_text_table(
    spark: SparkSession,
    path: str,
    fmt: str = "csv",
    multiline: bool = False,
    columns: Sequence[str] | None = None,
    bad: str = "fail",
) -> DataFrame:
    """Read a file, or a folder of files with one header, with every column as text.

    Columns follow the header. Part files whose header disagrees fail the job instead
    of shifting values. A record with too few fields misses the last ones. A record with
    surplus fields, or half of one that has a line break inside quotes, fails the job;
    with ``bad="keep"`` its text is in the column ``BAD_RECORD``, NULL for all others (of a
    record with a line break inside quotes the other half may look whole).
    ``multiline`` allows line breaks inside quotes, at the price of one task per file.

    JSON lines are read twice unless ``columns`` names their fields: once to find them.
    """
    if fmt == "json":
        reader = spark.read.option("multiLine", multiline)
        if columns is None:
            return reader.option("primitivesAsString", True).json(path)
        return reader.schema(", ".join(f"`{c}` string" for c in columns)).json(path)
    reader = (
        spark.read.option("header", True)
        .option("quote", '"')
        .option("escape", '"')
        .option("enforceSchema", False)
        .option("multiLine", multiline)
    )
    names = reader.csv(path).columns
    if not names:
        return reader.csv(path)
    # all fields are looked at, or surplus ones would go unseen
    table = (
        reader.option("columnPruning", False)
        .option("columnNameOfCorruptRecord", BAD_RECORD)
        .schema(", ".join(f"`{c}` string" for c in [*names, BAD_RECORD]))
        .csv(path)
    )
    # Spark refuses to look at bad records alone; this always holds
    looked = F.coalesce(F.col(f"`{names[0]}`"), F.lit("")) >= ""
    problem = F.when(looked, record_problem(F.col(BAD_RECORD), len(names)))
    if bad == "keep":
        kept = F.when(problem.isNotNull(), F.col(BAD_RECORD))
        table = table.withColumn(BAD_RECORD, kept)
    else:
        refused = F.raise_error(F.concat(problem, F.substr(F.col(BAD_RECORD), F.lit(1), F.lit(200))))
        table = table.where(F.when(problem.isNotNull(), refused.cast("boolean")).otherwise(True))
        table = table.drop(BAD_RECORD)
    marked = [c for c in names if c.startswith(BYTE_ORDER_MARK)]
    return table.withColumnsRenamed({c: c.removeprefix(BYTE_ORDER_MARK) for c in marked})


def read_table(
    spark: SparkSession,
    path: str,
    fmt: str = "csv",
    multiline: bool = False,
    types: Mapping[str, str] | None = None,
    columns: Sequence[str] | None = None,
) -> DataFrame:
    """Read one year's file with missing values, numbers and money in place."""
    return type_columns(read_text_table(spark, path, fmt, multiline, columns), types)


def year_path(root: str, year: int, template: str = PATH_TEMPLATE) -> str:
    return template.format(root=root.rstrip("/"), year=year, yy=str(year)[-2:])


def stack_years(tables: Mapping[int, DataFrame]) -> DataFrame:
    """Tag each table with its year and stack them by column name; a column that a year
    lacks is NULL there."""
    if not tables:
        raise ValueError("no yearly table to stack")
    tagged = [
        table.withColumn("year", F.lit(year).cast("int")) for year, table in sorted(tables.items())
    ]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)


def discover_years(spark: SparkSession, root: str, template: str = PATH_TEMPLATE) -> list[int]:
    """The years that have a file or folder where the template says, by a listing."""
    pattern = template.format(root=root.rstrip("/"), year="*", yy="*")
    folder = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    found = folder.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(folder)
    after_root = re.escape(template).replace(r"\{root\}", ".*").replace(r"\{yy\}", r"\d\d")
    year = re.compile(after_root.replace(r"\{year\}", r"(\d{4})", 1).replace(r"\{year\}", r"\d{4}"))
    matches = [year.fullmatch(status.getPath().toString()) for status in found or []]
    return sorted({int(m.group(1)) for m in matches if m})


def load_panel(
    spark: SparkSession,
    root: str,
    years: Iterable[int] | None = None,
    template: str = PATH_TEMPLATE,
    fmt: str = "csv",
    strict: bool = True,
    multiline: bool = False,
    types: Mapping[str, str] | None = None,
    columns: Sequence[str] | None = None,
) -> YearlyPanel:
    """Read all years found under the root, or the given ones.

    Of given years, one without a file is a warning, and so is a file of a year that is
    not given. A file that cannot be read is an error, or with ``strict=False`` a warning;
    records that do not fit the header are then left out and counted in a warning, and a
    file with line breaks inside quotes is left out as a whole. ``columns`` are the fields
    of JSON lines.
    """
    found = discover_years(spark, root, template)
    asked = found if years is None else list(years)
    for year in set(found) - set(asked):
        warnings.warn(f"{year_path(root, year, template)} is not asked for", stacklevel=2)
    tables: dict[int, DataFrame] = {}
    for year in asked:
        path = year_path(root, year, template)
        try:
            table = read_text_table(
                spark, path, fmt, multiline, columns, "fail" if strict else "keep"
            )
        except AnalysisException as problem:
            missing = problem.getCondition() == "PATH_NOT_FOUND"
            if strict and not missing:
                raise
            warnings.warn(f"no data for {year}: {path if missing else problem}", stacklevel=2)
            continue
        if not table.columns:
            if strict:
                raise ValueError(f"{path} has no header")
            warnings.warn(f"no data for {year}: {path} has no header", stacklevel=2)
            continue
        if BAD_RECORD in table.columns:
            bad = F.col(BAD_RECORD)
            odd = F.regexp_count(bad, F.lit('"')) % 2 == 1
            records, halves = table.agg(F.count(bad), F.count_if(odd)).first()
            if halves:
                warnings.warn(
                    f"no data for {year}: {path} has line breaks inside quotes; use multiline=True",
                    stacklevel=2,
                )
                continue
            if records:
                warnings.warn(f"{records} records of {path} are left out", stacklevel=2)
            table = table.where(bad.isNull()).drop(BAD_RECORD)
        tables[year] = table
    if not tables:
        raise ValueError(f"no yearly file found under {root}")
    # Stacked as text and typed once: one projection to plan instead of one per year.
    stacked = type_columns(stack_years(tables), {"year": "keep"} | dict(types or {}))
    names = {year: table.columns for year, table in tables.items()}
    return YearlyPanel(stacked, tuple(sorted(tables)), names)


STORED_YEAR = "{root}/year={year}"


def store_panel(data: DataFrame | YearlyPanel, path: str) -> YearlyPanel:
    """Write a parsed panel once, partitioned by year, and read it back: later passes
    then skip text parsing, unused columns and other years. The years are those written."""
    panel = data if isinstance(data, YearlyPanel) else YearlyPanel(data, ())
    spark = panel.data.sparkSession
    # few files per year, and a large year in several
    dealt = panel.data.hint("rebalance", "year")
    dealt.write.mode("errorifexists").partitionBy("year").parquet(path)
    years = tuple(discover_years(spark, path, STORED_YEAR))
    # with the schema given, an empty panel can be read too
    stored = spark.read.schema(panel.data.schema).parquet(path)
    same_order = stored.select(*[F.col(f"`{c}`") for c in panel.data.columns])
    return YearlyPanel(same_order, years, panel.columns)


def shape(df: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Row and column counts, optionally per key."""
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("rows")).withColumn(
        "columns", F.lit(len(df.columns))
    )
