"""What several operators need: numbering, membership tests, components."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W

from ..session import drop_folder, scratch_folder

__all__ = [
    "drop_folder",
    "scratch_folder",
    "table",
    "written",
    "number_rows",
    "bitmap",
    "among",
    "maybe_in",
    "components",
    "dense",
    "without",
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Write ``df`` to the shared scratch folder; the copy read back, and its folder."""
    path = scratch_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


# Groups are numbered in so many independent buckets each.
NUMBER_BUCKETS = 512


def number_rows(
    df: DataFrame, group: Column, order: Sequence[Column], name: str, buckets: int = NUMBER_BUCKETS
) -> DataFrame:
    """Number the rows of each group without gaps, from 0, in a column ``name``.

    Rows are dealt to ``buckets`` buckets of each group by a hash of ``order`` and numbered
    inside them; a bucket starts where the earlier buckets of its group end. No task needs
    a whole group. ``df`` must give the same rows when it is read again (a table); rows
    that are equal in ``order`` may swap numbers. ``group`` is never null.
    """
    dealt = df.withColumn("_group", group).withColumn(
        "_bucket", F.pmod(F.xxhash64(*order), F.lit(buckets)).cast("int")
    )
    counts = dealt.groupBy("_group", "_bucket").agg(F.count("*").alias("_n"))
    earlier = W.partitionBy("_group").orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    starts = counts.select(
        F.col("_group").alias("_g"),
        F.col("_bucket").alias("_b"),
        F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_start"),
    )
    inside = F.row_number().over(W.partitionBy("_group", "_bucket").orderBy(*order))
    return (
        dealt.withColumn("_row", inside)
        .join(starts, (F.col("_group") == F.col("_g")) & (F.col("_bucket") == F.col("_b")))
        .withColumn(name, (F.col("_start") + F.col("_row") - 1).cast("long"))
        .drop("_group", "_bucket", "_g", "_b", "_start", "_row")
    )


# 2^22 bits in 65,536 numbers: half a megabyte, whatever the data.
FILTER_WORDS = 1 << 16


def dense(counts: DataFrame, place: str, value: str, size: int, kind: str) -> Column:
    """A column of ``counts`` as one array of ``size`` values by place, 0 where none is
    given; a scalar subquery, so that the array is sent once and is no part of plans."""
    every = counts.sparkSession.range(size).select(
        F.col("id").cast("int").alias("p"), F.lit(0).cast(kind).alias("v")
    )
    own = counts.select(F.col(place).cast("int").alias("p"), F.col(value).cast(kind).alias("v"))
    # zeros come first, so that a given value is the last of its place
    filled = own.union(every).groupBy("p").agg(F.max_by("v", F.col("v") != 0).alias("v"))
    return filled.agg(F.sort_array(F.collect_list(F.struct("p", "v"))).getField("v").alias("a")).scalar()


def _spot(value: Column) -> Column:
    return F.pmod(F.xxhash64(value, F.lit(7)), F.lit(FILTER_WORDS * 64))


def bitmap(keys: DataFrame, column: str) -> Column:
    """What ``among`` tests against: the values in ``keys``, marked in a bitmap of fixed size.
    A scalar subquery, computed anew by each query that uses it."""
    marked = (
        keys.select(_spot(F.col(column)).alias("s"))
        .select(
            F.shiftright("s", 6).cast("int").alias("w"), F.pmod("s", F.lit(64)).cast("int").alias("b")
        )
        .groupBy("w")
        .agg(F.bit_or(F.expr("shiftleft(1L, b)")).alias("bits"))
    )
    return dense(marked, "w", "bits", FILTER_WORDS, "long")


def among(bits: Column) -> Callable[[Column], Column]:
    def holds(value: Column) -> Column:
        at = _spot(value)
        word = F.get(bits, F.shiftright(at, 6).cast("int"))
        return F.getbit(word, F.pmod(at, F.lit(64)).cast("int")) == 1

    return holds


def maybe_in(keys: DataFrame, column: str) -> Callable[[Column], Column]:
    """A test that holds for every value in ``keys`` and for few others.

    The keys are marked in a bitmap of fixed size, so that what reaches the tasks does not
    grow with the data; with very many keys the test lets more rows pass. A join that
    follows keeps results exact.
    """
    return among(bitmap(keys, column))


def without(docs: DataFrame, ids: DataFrame, column: str) -> DataFrame:
    """The rows of ``docs`` whose ``column`` is not in ``ids`` (a written table). Only rows
    that may be in it are shuffled."""
    may = F.coalesce(maybe_in(ids, column)(F.col(column)), F.lit(False))
    gone = ids.select(F.col(column).alias("_gone"))
    asked = docs.where(may).join(gone, F.col(column) == F.col("_gone"), "left_anti")
    return docs.where(~may).unionByName(asked)


def _settled(edges: DataFrame) -> bool:
    """Whether every edge leads to the smallest node of its component: each node has one
    edge down, and none that edges lead to has any."""
    ends = edges.select(F.col("u").alias("node"), F.col("v").alias("below")).union(
        edges.select(F.col("v").alias("node"), F.lit(None).cast("long").alias("below"))
    )
    seen = ends.groupBy("node").agg(
        F.min("below").alias("low"), F.max("below").alias("high"), F.count("below").alias("down"),
        F.count("*").alias("all"),
    )
    open_ends = seen.where("low != high or (down > 0 and all > down)")
    return open_ends.limit(1).count() == 0


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """The connected components of a graph: ``node`` and ``component``, the smallest node
    reachable, for every node that has a link.

    Alternates two steps until every edge leads to the smallest node: each node passes its
    smallest neighbour to its larger neighbours, then to its smaller ones. The number of
    rounds grows with the logarithm of the longest path. Each round is written, so that its
    lineage stays short.
    """
    spark = edges.sparkSession
    now, path = written(
        edges.where(F.col(a) != F.col(b))
        .select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .distinct(),
        "links",
    )
    while not _settled(now):
        both = now.union(now.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(
            F.col("u").alias("w"), F.least("u", "m").alias("m")
        )
        large = (
            both.join(least, F.col("u") == F.col("w"))
            .where("v > u")
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
        )
        down = large.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), "m")
        small = (
            large.join(down, F.col("u") == F.col("w"))
            .select(
                F.explode(
                    F.array(
                        F.struct(F.col("v").alias("u"), F.col("m").alias("v")),
                        F.struct(F.col("u").alias("u"), F.col("m").alias("v")),
                    )
                ).alias("e")
            )
            .select("e.u", "e.v")
            .where("u != v")
            .distinct()
        )
        before = path
        now, path = written(small, "links")
        drop_folder(spark, before)
    stars = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.union(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
