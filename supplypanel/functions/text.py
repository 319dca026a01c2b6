"""Display text: numbers, currency, percentages, labels and prefix categories."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from supplypanel.functions.arithmetic import as_column

LABEL_BREAK = " - "


def format_fixed(c: Column | str, places: int, separators: bool = True) -> Column:
    """Fixed decimals, half-even on the exact value, optional thousands separators."""
    text = F.format_number(as_column(c), places)
    if not separators:
        text = F.translate(text, ",", "")
    return F.replace(text, F.lit("∞"), F.lit("inf"))


def format_count(c: Column | str) -> Column:
    return format_fixed(c, 0)


def format_currency(c: Column | str) -> Column:
    return F.concat(F.lit("$"), format_fixed(c, 2))


def format_percent(c: Column | str, places: int = 2) -> Column:
    return F.concat(format_fixed(c, places, separators=False), F.lit("%"))


def format_scaled(
    c: Column | str, divisor: float, places: int, prefix: str = "$", suffix: str = ""
) -> Column:
    """Axis-style text such as ``$1.2B`` (divisor 1e9) or ``$3.4M`` (divisor 1e6)."""
    scaled = as_column(c).cast("double") / F.lit(float(divisor))
    return F.concat(F.lit(prefix), format_fixed(scaled, places, separators=False), F.lit(suffix))


def label_of(description: Column | str) -> Column:
    """The part of a description before its first space-padded dash."""
    return F.split(as_column(description), LABEL_BREAK, 2)[0]


def prefix_category(
    c: Column | str, rules: Sequence[tuple[str, str]], default: str = "Other"
) -> Column:
    """Category of the first rule ``(prefix, category)`` that the text starts with."""
    c = as_column(c)
    if not rules:
        return F.lit(default)
    chain = F.when(c.startswith(rules[0][0]), rules[0][1])
    for prefix, category in rules[1:]:
        chain = chain.when(c.startswith(prefix), category)
    return chain.otherwise(default)


def year_suffix(year: Column | str) -> Column:
    """The last two digits of a year, as used in yearly file names."""
    return F.substring(as_column(year).cast("string"), -2, 2)
