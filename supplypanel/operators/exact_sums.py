"""Sums of doubles that do not depend on the order of the rows.

Every double is cut into whole numbers without loss: its exponent gives a bin of ``WIDTH``
binary places, and the value, scaled to the bin, two whole numbers. These are added as decimals,
so the sum of each bin is exact whatever the partitioning. A sum within one bin is the exact sum,
rounded once; several bins are added from the largest down, in that order always.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from supplypanel.operators.selection import require_columns

WIDTH = 40
# A scaled value is below 2^(WIDTH + 1), or twice that where the logarithm is off by one, and
# its last binary place is 2^-53 or more; so many places go to the high part, the rest to the low.
HIGH_PLACES, LOW_PLACES = 8, 46


def _power(exponent: Column) -> Column:
    return F.pow(F.lit(2.0), exponent)


def _scaled(value: Column, exponent: Column) -> Column:
    """``value`` times a power of two, in two steps, as the power alone may overflow."""
    half = F.floor(exponent / 2)
    return value * _power(half) * _power(exponent - half)


def exact_sums(df: DataFrame, names: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """The keys and the sum of each column; missing values are skipped, the sum of nothing is
    0. NaN, or infinities of both signs, give NaN, else an infinity itself. Equal keys and
    rows give the same bits over any partitioning."""
    require_columns(df, names)
    keys = [f"|k{i}" for i in range(len(by))]
    value = F.col("|x")
    entries = [
        F.struct(F.lit(i).alias("|c"), F.col(f"`{c}`").cast("double").alias("|x")) for i, c in enumerate(names)
    ]
    long = df.select(
        *[F.col(f"`{c}`").alias(k) for c, k in zip(by, keys)], F.inline(F.array(*entries))
    )
    finite = ~F.isnan(value) & (F.abs(value) < float("inf"))
    usual = finite & (value != 0)
    bin_of = F.when(usual, F.floor(F.floor(F.log2(F.abs(value))) / WIDTH))
    scaled = _scaled(value, F.col("|bin") * -WIDTH) * float(2**HIGH_PLACES)
    cut = (
        long.withColumn("|bin", bin_of)
        .withColumn("|s", scaled)
        .withColumn("|high", F.floor("|s").cast("decimal(20,0)"))
        .withColumn("|low", ((F.col("|s") - F.floor("|s").cast("double")) * float(2**LOW_PLACES)).cast("bigint"))
    )
    sums = cut.groupBy(*keys, "|c", "|bin").agg(
        F.sum("|high").alias("|high"),
        F.sum(F.col("|low").cast("decimal(20,0)")).alias("|low"),
        # of infinities and NaN only, whose sum has no order
        F.sum(F.when(~finite, value)).alias("|odd"),
    )
    whole = F.col("|high").cast("decimal(38,0)") * F.lit(2**LOW_PLACES).cast("decimal(15,0)") + F.col("|low")
    parts = sums.select(
        *keys,
        "|c",
        "|bin",
        "|odd",
        _scaled(whole.cast("double"), F.col("|bin") * WIDTH - (HIGH_PLACES + LOW_PLACES)).alias("|part"),
    )
    # a column has a few dozen bins at most
    ordered = F.array_sort(F.collect_list(F.when(F.col("|part").isNotNull(), F.struct(-F.col("|bin"), "|part"))))
    total = F.aggregate(ordered, F.lit(0.0), lambda acc, e: acc + e["|part"])
    per_column = parts.groupBy(*keys, "|c").agg(F.coalesce(F.sum("|odd"), total).alias("|total"))
    wide = per_column.groupBy(*keys).agg(
        *[F.max(F.when(F.col("|c") == i, F.col("|total"))).alias(c) for i, c in enumerate(names)]
    )
    out = wide.select(
        *[F.col(k).alias(c) for c, k in zip(by, keys)], *[F.coalesce(f"`{c}`", F.lit(0.0)).alias(c) for c in names]
    )
    return out
