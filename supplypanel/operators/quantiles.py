"""Exact quantiles of many columns, per key, in two scans.

The first scan brackets every quantile with a mergeable sketch whose rank error is known. The
second counts, in one aggregate, the values below the brackets and the equal values inside them;
the quantile is found among these by rank. Whether the rank lies inside is checked, and where
it does not, a third scan takes all values of that column for the bracket. Values are only
compared, never subtracted, so that infinities and values near the largest double are like any
other. Missing values and NaN do not count.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from supplypanel.session import drop_folder, scratch_folder, settle

# Ranks of the sketch are off by one row in so many at most.
ACCURACY = 10_000


def number_of(column: str) -> Column:
    value = F.col(f"`{column}`").cast("double")
    return F.when(~F.isnan(value), value)


def bracket_expressions(columns: Sequence[str], shares: Sequence[float]) -> dict[str, Column]:
    """Aggregates of the first scan, to be read by ``quantiles_in`` together with others.
    ``shares`` rise."""
    reach = 2 / ACCURACY
    points = [p for q in shares for p in (max(q - reach, 0.0), min(q + reach, 1.0))]
    return {f"{c}|known": F.count(number_of(c)) for c in columns} | {
        f"{c}|points": F.percentile_approx(number_of(c), points, ACCURACY) for c in columns
    }


def same_keys(left: DataFrame, right: DataFrame, keys: Sequence[tuple[str, str]]) -> Column:
    """Equality of keys, a missing one being equal to a missing one."""
    same = F.lit(True)
    for a, b in keys:
        same &= left[a].eqNullSafe(right[b])
    return same


def _ranked(
    df: DataFrame, brackets: DataFrame, columns: Sequence[str], by: Sequence[str], shares: Sequence[float]
) -> DataFrame:
    """One scan of ``df``: by key, column and quantile ``|value``, NULL where its rank is not in
    the bracket. ``brackets`` is a written table."""
    keys = [f"|k{i}" for i in range(len(by))]
    values = [f"|v{i}" for i in range(len(columns))]
    rows = df.select(
        *[F.col(f"`{c}`").alias(k) for c, k in zip(by, keys)],
        *[number_of(c).alias(v) for c, v in zip(columns, values)],
    )
    bounds = brackets.select(
        *[F.col(f"`{c}`").alias(f"{k}b") for c, k in zip(by, keys)],
        *[F.col(f"`{c}|points`").alias(f"{v}b") for c, v in zip(columns, values)],
    )
    if by:
        near = rows.join(bounds, same_keys(rows, bounds, [(k, f"{k}b") for k in keys]))
    else:
        near = rows.withColumns({c: bounds.select(c).scalar() for c in bounds.columns})

    # one entry for each column of a row: how many brackets its value lies below and, if it lies
    # inside one, the value; equal entries are counted before they are shuffled
    entries = []
    for i, v in enumerate(values):
        lows = [F.get(f"{v}b", F.lit(2 * j)) for j in range(len(shares))]
        highs = [F.get(f"{v}b", F.lit(2 * j + 1)) for j in range(len(shares))]
        below, inside = F.lit(0), F.lit(False)
        for low, high in zip(lows, highs):
            below += F.when(F.col(v) < low, 1).otherwise(0)
            inside |= (F.col(v) >= low) & (F.col(v) <= high)
        known = F.when(F.col(v).isNotNull(), below)
        entries.append(
            F.struct(F.lit(i).alias("c"), known.alias("below"), F.when(inside, F.col(v)).alias("v"))
        )
    counts = (
        near.select(*keys, F.inline(F.array(*entries)))
        .where("below is not null")
        .groupBy(*keys, "c", "below", "v")
        .agg(F.count(F.lit(1)).alias("n"))
    )

    wanted = []
    for i, c in enumerate(columns):
        for j, share in enumerate(shares):
            rank = F.greatest(F.ceil(F.lit(share) * F.col(f"`{c}|known`")), F.lit(1)).cast("long")
            low, high = (F.get(f"`{c}|points`", F.lit(2 * j + k)) for k in (0, 1))
            wanted.append(
                F.struct(
                    F.lit(i).alias("i"), F.lit(j).alias("j"), rank.alias("rank"),
                    low.alias("low"), high.alias("high"),
                )
            )
    # a column without any value has no quantile
    ranks = brackets.select(
        *[F.col(f"`{c}`").alias(f"{k}w") for c, k in zip(by, keys)], F.inline(F.array(*wanted))
    ).where("low is not null")
    # lows rise with the share, so a value below so many brackets lies below the last ones
    under = F.col("below") >= len(shares) - F.col("j")
    near_rank = ranks.join(
        counts, (F.col("i") == F.col("c")) & same_keys(ranks, counts, [(f"{k}w", k) for k in keys])
    ).where(under | ((F.col("v") >= F.col("low")) & (F.col("v") <= F.col("high"))))
    own = [*[f"{k}w" for k in keys], "i", "j"]
    upto = Window.partitionBy(*own).orderBy(under.desc(), "v").rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    hit = (
        near_rank.withColumn("upto", F.sum("n").over(upto))
        .where(~under & (F.col("upto") >= F.col("rank")) & (F.col("upto") - F.col("n") < F.col("rank")))
        .select(*own, F.col("v").alias("|value"))
    )
    names = [f"{c}f" for c in own]
    hit = hit.withColumnsRenamed(dict(zip(own, names)))
    out = ranks.join(hit, same_keys(ranks, hit, list(zip(own, names))), "left")
    name = F.get(F.array(*[F.lit(c) for c in columns]), F.col("i"))
    share = F.get(F.array(*[F.lit(float(q)) for q in shares]), F.col("j"))
    return out.select(
        *[F.col(f"{k}w").alias(c) for c, k in zip(by, keys)],
        name.alias("|column"),
        share.alias("quantile"),
        F.col("|value"),
    )


def quantiles_in(
    df: DataFrame, brackets: DataFrame, columns: Sequence[str], by: Sequence[str], shares: Sequence[float]
) -> DataFrame:
    """Exact quantiles with ``brackets``, a written aggregate of ``bracket_expressions``: by
    key, ``|column`` and ``quantile`` the lowest value that at least this share of the values
    does not exceed, ``value``."""
    found = settle(_ranked(df, brackets, columns, by, shares), "quantiles")
    if found.where("`|value` is null").limit(1).count():
        whole = F.array(*[F.lit(float(x)) for _ in shares for x in ("-inf", "inf")])
        opened = settle(brackets.withColumns({f"{c}|points": whole for c in columns}), "brackets")
        found = settle(_ranked(df, opened, columns, by, shares), "quantiles")
    return found.withColumnRenamed("|value", "value")


def quantiles(
    df: DataFrame, column: str, by: Sequence[str], shares: Sequence[float]
) -> DataFrame:
    """Exact quantiles of one column per key: the keys, ``quantile`` and ``value``."""
    shares = sorted(shares)
    measures: Mapping[str, Column] = bracket_expressions([column], shares)
    path = scratch_folder(df.sparkSession, "brackets")
    found = df.groupBy(*by).agg(*[e.alias(name) for name, e in measures.items()])
    found.write.parquet(path)
    brackets = df.sparkSession.read.schema(found.schema).parquet(path)
    out = quantiles_in(df, brackets, [column], by, shares).drop("|column")
    drop_folder(df.sparkSession, path)
    return out
