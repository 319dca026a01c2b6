"""Sharding: a hierarchical weighted hash tree.

A row descends from the root to a region, a rack and a shard. At each level every child
draws a number from the row's key and its own path, scaled by its weight, and the smallest
draw wins; so a child's share is its weight, and a draw changes for no other child. Where
weights change, rows move only into or out of the subtrees whose weights changed.

A new shard opens a region of its own (``grown``): the draws of all earlier regions stay
as they are, and the only rows that move are those that the new region draws.

Rows without a key all get the same draws. Equal keys share a shard, repeated rows too.
An empty table gives an empty table; other columns of the input are not read.
"""

from __future__ import annotations

from collections.abc import Sequence

import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame, SparkSession

from .common import number_rows, table, written

# Weights of the shards, by rack, by region.
Topology = Sequence[Sequence[Sequence[float]]]


def uniform(regions: int, racks: int, shards: int) -> Topology:
    return tuple(tuple((1.0,) * shards for _ in range(racks)) for _ in range(regions))


def grown(topology: Topology, weight: float = 1.0) -> Topology:
    """The same tree with one more shard, in a region of its own."""
    return (*topology, ((weight,),))


def shard_count(topology: Topology) -> int:
    return sum(len(rack) for region in topology for rack in region)


def _drawn(key: Column, path: str, weights: Sequence[float]) -> Column:
    """The child that wins among ``weights``; a child without weight never does."""
    draws = []
    for child, weight in enumerate(weights):
        if weight < 0:
            raise ValueError("weights are not negative")
        if weight > 0:
            bits = F.shiftrightunsigned(F.xxhash64(key, F.lit(f"{path}{child}")), 11)
            uniform_draw = (bits + F.lit(1)) / F.lit(float(2**53))
            draws.append(F.struct((-F.ln(uniform_draw) / F.lit(weight)).alias("d"), F.lit(child).alias("c")))
    if not draws:
        raise ValueError(f"no child of '{path}' has weight")
    return F.array_min(F.array(*draws))["c"]


def _chosen(by: Column, options: Sequence[Column]) -> Column:
    out = options[-1]
    for i in reversed(range(len(options) - 1)):
        out = F.when(by == i, options[i]).otherwise(out)
    return out


def shard_of(key: Column, topology: Topology) -> Column:
    """The shard, from 0 in the order of the tree, that ``key`` belongs to."""
    weight_of = [[sum(rack) for rack in region] for region in topology]
    regions = [r for r, racks in enumerate(weight_of) if sum(racks) > 0]
    region = _drawn(key, "", [sum(racks) for racks in weight_of])
    first = 0
    by_region = []
    for r, racks in enumerate(topology):
        by_rack = []
        for k, shards in enumerate(racks):
            if sum(shards) > 0:
                by_rack.append(F.lit(first) + _drawn(key, f"{r}/{k}/", shards))
            else:
                by_rack.append(F.lit(None).cast("int"))
            first += len(shards)
        if r in regions:
            by_region.append(_chosen(_drawn(key, f"{r}/", weight_of[r]), by_rack))
        else:
            by_region.append(F.lit(None).cast("int"))
    return _chosen(region, by_region).cast("int")


def shard_documents(docs: DataFrame, topology: Topology) -> DataFrame:
    """``docs`` with ``shard``, ``grown_shard`` (with one more shard) and ``slot``, the
    row's place in its shard, from 0 without gaps. ``docs`` needs ``doc_id``, and only
    columns that may be written once: it is settled before rows are numbered."""
    placed = docs.withColumns(
        {
            "shard": shard_of(F.col("doc_id"), topology),
            "grown_shard": shard_of(F.col("doc_id"), grown(topology)),
        }
    )
    slim, _ = written(placed, "shards")
    return number_rows(slim, F.col("shard"), [F.col(c) for c in docs.columns], "slot")


# Three regions of two racks of four shards.
PRODUCTION = uniform(3, 2, 4)


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in shards 0 to 23 by the law ``key``. A null text counts as empty."""
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    docs = table(spark, sf_dir, "documents").select(
        "doc_id",
        (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
    )
    return shard_documents(docs, PRODUCTION).select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard"
    )
