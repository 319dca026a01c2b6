"""Text to typed values, tolerant of blanks, suppression marks and currency text."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from supplypanel.functions.arithmetic import as_column

# Text that a delimited file may use for "missing".
NULL_TOKENS = (
    "",
    "#N/A",
    "#N/A N/A",
    "#NA",
    "-1.#IND",
    "-1.#QNAN",
    "-NaN",
    "-nan",
    "1.#IND",
    "1.#QNAN",
    "<NA>",
    "N/A",
    "NA",
    "NULL",
    "NaN",
    "None",
    "n/a",
    "nan",
    "null",
)

# Accepts 7, " 7 ", 1e3, .5, 5., inf, -Infinity. Spark's own cast would also take
# 1d, 1f and nan, so the text is checked before it is cast.
NUMBER_TEXT = r"^\s*[+-]?((\d+\.?\d*|\.\d+)([eE][+-]?\d+)?|(?i:inf(inity)?))\s*$"
WHOLE_TEXT = r"^\s*[+-]?\d+(\.0*)?\s*$"

# A column is money when its name contains one of these.
MONEY_MARKS = ("Pymt", "Amt")

# Column-name endings and the type they stand for. Everything else stays text, so
# that identifiers such as ZIP codes keep their leading zeros.
COUNT_ENDINGS = ("_Cnt", "_Benes", "_Clms", "_HCPCS_Cds")
MEASURE_ENDINGS = ("_Pct", "_Srvcs", "_Sbmtd_Chrgs", "_Avg_Age", "_Avg_Risk_Scre")


def blank_to_null(c: Column | str) -> Column:
    c = as_column(c)
    return F.when(~c.isin(*NULL_TOKENS), c)


def parse_number(c: Column | str) -> Column:
    """Text to DOUBLE; text that is not a number becomes NULL."""
    c = as_column(c)
    return F.when(c.rlike(NUMBER_TEXT), c.try_cast("double"))


def parse_count(c: Column | str) -> Column:
    """Text to BIGINT. Whole numbers in another notation (``12.0``, ``1e3``) are read
    too; a fractional count fails the job rather than being truncated."""
    c = as_column(c)
    number = parse_number(c)
    refused = F.raise_error(F.concat(F.lit("not a whole count: "), c)).cast("bigint")
    return (
        F.when(c.rlike(WHOLE_TEXT), F.regexp_replace(F.trim(c), r"\.0*$", "").cast("bigint"))
        .when(number % 1 != 0, refused)
        .otherwise(number.cast("bigint"))
    )


def parse_currency(c: Column | str) -> Column:
    """``$1,234.50`` to 1234.5."""
    return parse_number(F.translate(as_column(c), "$,", ""))


def is_money(name: str) -> bool:
    return any(mark in name for mark in MONEY_MARKS)


def money_columns(names: Sequence[str]) -> list[str]:
    return [name for name in names if is_money(name)]


def coerce_money(df: DataFrame) -> DataFrame:
    """Turn every text column whose name says money into DOUBLE."""
    text = {name for name, kind in df.dtypes if kind == "string"}
    return df.withColumns({c: parse_number(c) for c in money_columns(df.columns) if c in text})


def column_type(name: str) -> str:
    """``double``, ``bigint`` or ``string``, from the column name alone."""
    if is_money(name) or name.endswith(MEASURE_ENDINGS):
        return "double"
    return "bigint" if name.endswith(COUNT_ENDINGS) else "string"


def type_columns(df: DataFrame, overrides: Mapping[str, str] | None = None) -> DataFrame:
    """Clean and type an all-text table in one projection.

    ``overrides`` maps a column to ``double``, ``bigint``, ``string`` or ``keep`` where
    the naming rule is not wanted (for example a count column that holds fractions).
    """
    # A missing-value token is not a number, so only text columns look for tokens.
    parsers = {
        "double": parse_number,
        "bigint": parse_count,
        "string": blank_to_null,
        "keep": as_column,
    }
    overrides = overrides or {}
    return df.select(
        *[
            parsers[overrides.get(name, column_type(name))](F.col(f"`{name}`")).alias(name)
            for name in df.columns
        ]
    )
