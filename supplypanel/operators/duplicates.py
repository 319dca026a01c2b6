"""Rows that repeat as a whole.

Rows are told apart by a fingerprint first: a slot of a fixed-size table that only one row falls
into holds no repeated row, and such rows are not shuffled. All others are compared in full, by
every column, missing values being equal to missing ones.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# 2^22 slots, a bit each: half a megabyte reaches the tasks, whatever the table.
SLOT_WORDS = 1 << 16


def _slot(df: DataFrame) -> Column:
    return F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]), F.lit(SLOT_WORDS * 64))


def _shared_slots(df: DataFrame) -> Callable[[Column], Column]:
    """A test for slots that two rows or more fall into. Rows are counted by slot, two being
    enough, and the slots sent on as one array of fixed size."""
    slots = df.select(_slot(df).alias("s")).groupBy("s").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    words = (
        slots.select(F.shiftright("s", 6).cast("int").alias("w"), F.pmod("s", F.lit(64)).cast("int").alias("b"))
        .groupBy("w")
        .agg(F.bit_or(F.expr("shiftleft(1L, b)")).alias("bits"))
    )
    every = df.sparkSession.range(SLOT_WORDS).select(F.col("id").cast("int").alias("w"), F.lit(0).cast("long").alias("bits"))
    filled = words.union(every).groupBy("w").agg(F.bit_or("bits").alias("bits"))
    table = filled.agg(F.sort_array(F.collect_list(F.struct("w", "bits"))).getField("bits").alias("a")).scalar()

    def shared(slot: Column) -> Column:
        word = F.get(table, F.shiftright(slot, 6).cast("int"))
        return F.getbit(word, F.pmod(slot, F.lit(64)).cast("int")) == 1

    return shared


def repeated_rows(df: DataFrame, count_name: str = "count") -> DataFrame:
    """Every row that occurs more than once, once, with how often it does."""
    may = df.where(_shared_slots(df)(_slot(df)))
    names = [F.col(f"`{c}`") for c in df.columns]
    return may.groupBy(*names).agg(F.count(F.lit(1)).alias(count_name)).where(F.col(f"`{count_name}`") > 1)


def distinct_rows(df: DataFrame) -> DataFrame:
    """Every row once. Only rows that may repeat are shuffled. ``df`` must give the same rows
    when it is read again."""
    shared = _shared_slots(df)(_slot(df))
    return df.where(~shared).unionByName(df.where(shared).distinct())
