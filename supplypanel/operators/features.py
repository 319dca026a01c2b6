"""Feature derivation: learn a state from one table, apply it to any.

``fit_features`` learns cut points, level codes, means and deviations, and means by key from a
table; ``apply_features`` adds the derived columns to a table with these columns, the same or
another. What is learned for single columns is one row of bounded size (a level beyond the
``keep`` most frequent ones is "other"), so applying it needs no join; means by key are a table
with a row per key, joined by Spark's choice.

* Bin: 1 for values up to the first cut point, and one more for each cut point below the
  value. Cut points are exact quantiles of the fitted values, equal ones count once. NULL for
  a missing value or NaN, also where nothing was fitted.
* Level code: 1 for the most frequent fitted level, ties in the order of the text; ``OTHER``
  for a level that is not kept or was not seen; NULL for a missing level.
* Z-score: distance from the fitted mean in sample deviations; NULL where a value is missing or
  the deviation is missing or 0.
* Mean by key: the fitted mean of a value for the row's key, the mean over all fitted rows for
  a key that was not seen or is missing, or whose values are all missing.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from supplypanel.functions.arithmetic import safe_div
from supplypanel.operators.quantiles import bracket_expressions, number_of, quantiles_in
from supplypanel.operators.selection import require_columns
from supplypanel.session import settle

OTHER = 0


@dataclass(frozen=True)
class FeaturePlan:
    """What to derive: ``bins`` (column to number of bins), ``levels`` (column to number of
    levels kept), ``scores`` (columns) and ``means`` (key column to value column)."""

    bins: Mapping[str, int] = field(default_factory=dict)
    levels: Mapping[str, int] = field(default_factory=dict)
    scores: Sequence[str] = ()
    means: Mapping[str, str] = field(default_factory=dict)

    @property
    def columns(self) -> list[str]:
        every = [*self.bins, *self.levels, *self.scores, *self.means, *self.means.values()]
        return list(dict.fromkeys(every))


@dataclass(frozen=True)
class FeatureState:
    """What was learned, as written tables: ``single`` has one row, ``by_key`` one table for
    each key column, with ``key`` and ``mean``."""

    plan: FeaturePlan
    single: DataFrame
    by_key: Mapping[str, DataFrame]


def fit_features(df: DataFrame, plan: FeaturePlan) -> FeatureState:
    require_columns(df, plan.columns)
    shares = {c: [k / n for k in range(1, n)] for c, n in plan.bins.items()}
    every_share = sorted({q for qs in shares.values() for q in qs})
    measures: dict[str, Column] = {}
    for c in dict.fromkeys([*plan.scores, *plan.means.values()]):
        measures |= {f"{c}|mean": F.avg(number_of(c)), f"{c}|std": F.stddev_samp(number_of(c))}
    if every_share:
        measures |= bracket_expressions(list(plan.bins), every_share)
    state = settle(df.agg(F.count(F.lit(1)).alias("rows"), *[e.alias(n) for n, e in measures.items()]), "numbers")

    # at most ``keep`` levels of a column stay: one row, whatever the table
    single = state
    if every_share:
        cuts = quantiles_in(df, state, list(plan.bins), [], every_share)
        own = F.lit(False)
        for c, qs in shares.items():
            own |= (F.col("|column") == c) & F.col("quantile").isin(qs)
        points = cuts.where(own).groupBy("|column").agg(F.array_sort(F.collect_set("value")).alias("cuts"))
        for c in plan.bins:
            found = points.where(F.col("|column") == c).select("cuts").scalar()
            single = single.withColumn(f"{c}|cuts", found)
    if plan.levels:
        codes = _codes(df, plan.levels)
        for c in plan.levels:
            own_codes = codes.where(F.col("|column") == c)
            pairs = F.map_from_entries(F.array_sort(F.collect_list(F.struct("level", "code"))))
            single = single.withColumn(f"{c}|codes", own_codes.agg(pairs.alias("codes")).scalar())
    by_key = {
        key: settle(
            df.where(F.col(f"`{key}`").isNotNull())
            .groupBy(F.col(f"`{key}`").alias("key"))
            .agg(F.avg(number_of(value)).alias("mean")),
            "means-by-key",
        )
        for key, value in plan.means.items()
    }
    return FeatureState(plan, settle(single, "features"), by_key)


def _codes(df: DataFrame, levels: Mapping[str, int]) -> DataFrame:
    """``|column``, ``level`` and ``code`` of the levels kept; one scan for all columns."""
    entries = [F.struct(F.lit(c).alias("|column"), F.col(f"`{c}`").cast("string").alias("level")) for c in levels]
    counts = (
        df.select(F.inline(F.array(*entries)))
        .where("level is not null")
        .groupBy("|column", "level")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    # tasks keep the first few levels of each column before they are shuffled
    most = Window.partitionBy("|column").orderBy(F.col("n").desc(), "level")
    ranked = counts.withColumn("code", F.row_number().over(most)).where(F.col("code") <= max(levels.values()))
    kept = F.lit(False)
    for c, n in levels.items():
        kept |= (F.col("|column") == c) & (F.col("code") <= n)
    return settle(ranked.where(kept).select("|column", "level", "code"), "codes")


def apply_features(df: DataFrame, state: FeatureState) -> DataFrame:
    """``df`` with ``<column>_bin``, ``<column>_code``, ``<column>_z`` and
    ``<value>_by_<key>`` appended."""
    plan, learned = state.plan, state.single
    require_columns(df, [*plan.bins, *plan.levels, *plan.scores, *plan.means])

    def known(name: str) -> Column:
        return learned.select(F.col(f"`{name}`")).scalar()

    out = df
    for c in plan.bins:
        value = number_of(c)
        cuts, bin_number = known(f"{c}|cuts"), F.lit(1)
        for k in range(plan.bins[c] - 1):
            bin_number += F.when(F.get(cuts, F.lit(k)) < value, 1).otherwise(0)
        fitted = F.get(cuts, F.lit(0)).isNotNull()
        out = out.withColumn(f"{c}_bin", F.when(value.isNotNull() & fitted, bin_number))
    for c in plan.levels:
        text = F.col(f"`{c}`").cast("string")
        code = F.coalesce(F.try_element_at(known(f"{c}|codes"), text), F.lit(OTHER))
        out = out.withColumn(f"{c}_code", F.when(text.isNotNull(), code))
    for c in plan.scores:
        off = number_of(c) - known(f"{c}|mean")
        out = out.withColumn(f"{c}_z", safe_div(off, known(f"{c}|std")))
    for key, value in plan.means.items():
        own = state.by_key[key].select(F.col("key").alias("|key"), F.col("mean").alias("|mean"))
        out = out.join(own, out[key] == own["|key"], "left")
        mean = F.coalesce(F.col("|mean"), known(f"{value}|mean"))
        out = out.withColumn(f"{value}_by_{key}", mean).drop("|key", "|mean")
    return out
