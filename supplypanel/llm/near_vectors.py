"""Embedding near-dedup: NN-descent.

Equal vectors are one node. A neighbour graph starts from vectors that are close in the
order of a random-hyperplane code, and is refined in rounds: the neighbours of each node,
in either direction, are compared with each other and every node keeps the best it met.
Rounds end when the links (pairs at or above the threshold) grow no more.

A list that holds only links is saturated: it may have no room for others. So vectors with
saturated lists are searched again the same way, with lists that hold vectors of other
components only, and components that link are joined, until such a search finds no link.
Then lists are enlarged to all of the node's component, whose members are compared in
blocks, in double precision; links are counted there, none below the threshold. Last,
recall is audited: the links of ``AUDITED`` vectors, chosen by a hash, are compared with
brute force over all rows, and while fewer than ``RECALL`` of them are found the graph is
refined further, from more orders. If ``ATTEMPTS`` do not suffice, all vectors are compared
in blocks, which takes time with the square of their number but misses nothing.

Vectors that are null, empty, zero or hold a null or non-finite component link with
nothing and are classes of their own; so are rows without a ``vec_id`` whose vectors link
with nothing. Of vectors of different lengths, the shorter one counts as filled up with
zeros. Repeated rows are vectors that link with each other. An empty table gives an empty
table; other columns of the input are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyspark.sql.functions as F
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W

from .common import components, drop_folder, number_rows, table, written

THRESHOLD = 0.95
NEIGHBOURS = 8
ORDERS = 4
CHUNK = 96
BLOCK = 512
ROUNDS = 6
GROWTH = 0.002
AUDITED = 512
RECALL = 0.97
ATTEMPTS = 3
# Vectors of each component that are also put in orders of their own.
SPOKESMEN = 8
_BITS = 60


def unit_vectors(column: pa.Array) -> np.ndarray:
    """The vectors of an Arrow column, of length 1, as rows of doubles."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return np.zeros((0, 1))
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    sizes = np.diff(column.offsets.to_numpy())
    width = int(sizes.max())
    if (sizes == width).all():
        rows = values.reshape(len(sizes), width)
    else:
        rows = np.zeros((len(sizes), width))
        rows[np.repeat(np.arange(len(sizes)), sizes), _within(sizes)] = values
    # scaled first, so that squares neither overflow nor vanish
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


def _within(sizes: np.ndarray) -> np.ndarray:
    begins = np.cumsum(sizes) - sizes
    return np.arange(int(sizes.sum())) - np.repeat(begins, sizes)


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    width = min(a.shape[1], b.shape[1])
    return a[:, :width] @ b[:, :width].T


def _codes(rows: np.ndarray, order: int) -> np.ndarray:
    planes = np.random.default_rng(1000 + order).normal(size=(rows.shape[1], _BITS))
    bits = (rows @ planes > 0).astype(np.int64)
    return bits @ (1 << np.arange(_BITS, dtype=np.int64)[::-1])


def _best(
    sims: np.ndarray, least: np.ndarray, k: int, parts: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of the ``k`` highest entries of each row that exceed ``least``; those
    of one part do not count."""
    sims[parts[:, None] == parts[None, :]] = -2.0
    if sims.shape[1] > k:
        top = np.argpartition(-sims, k - 1, axis=1)[:, :k]
    else:
        top = np.tile(np.arange(sims.shape[1]), (len(sims), 1))
    rows = np.repeat(np.arange(len(sims)), top.shape[1])
    columns = top.ravel()
    good = (sims[rows, columns] > least[rows]) & (parts[rows] != parts[columns])
    return rows[good], columns[good]


EDGES = "u bigint, v bigint, c double"


def _edge_batch(u: np.ndarray, v: np.ndarray, c: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(u), pa.array(v), pa.array(c, type=pa.float64())], names=["u", "v", "c"]
    )


def runs(
    batches: Iterator[pa.RecordBatch], keys: int, most: int
) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Sorted rows as tables that hold whole groups (equal in the first ``keys`` columns),
    with the borders of the groups; groups of over ``most`` rows come in portions."""
    rest: pa.Table | None = None

    def borders(now: pa.Table) -> np.ndarray:
        change = np.zeros(len(now), dtype=bool)
        change[0] = True
        for k in range(keys):
            column = now.column(k).to_numpy()
            change[1:] |= column[1:] != column[:-1]
        begins = np.flatnonzero(change)
        sizes = np.diff(np.append(begins, len(now)))
        inside = [np.arange(0, n, most) + b for b, n in zip(begins, sizes)]
        return np.append(np.concatenate(inside), len(now))

    for batch in batches:
        if not len(batch):
            continue
        now = pa.Table.from_batches([batch])
        now = pa.concat_tables([rest, now]).combine_chunks() if rest is not None else now
        cut = borders(now)
        rest = now.slice(cut[-2])
        if len(cut) > 2:
            yield now.slice(0, cut[-2]), cut[:-1]
    if rest is not None and len(rest):
        yield rest, borders(rest)


def _from_order(nodes: DataFrame, order: int, k: int) -> DataFrame:
    """Edges between nodes of different parts that are near in one order."""
    kind = nodes.schema["vector"].dataType.simpleString()

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = _codes(unit_vectors(batch.column(1)), order)
            yield pa.RecordBatch.from_arrays(
                [pa.array(found), *batch.columns], names=["code", "node", "vector", "part"]
            )

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for now, cut in runs(batches, 0, CHUNK):
            ids, parts = now.column("node").to_numpy(), now.column("part").to_numpy()
            rows = unit_vectors(now.column("vector"))
            for a, b in zip(cut, cut[1:]):
                sims = cosines(rows[a:b], rows[a:b])
                r, c = _best(sims, np.full(b - a, -1.5), k, parts[a:b])
                yield _edge_batch(ids[a:b][r], ids[a:b][c], sims[r, c])

    return (
        nodes.select("node", "vector", "part")
        .mapInArrow(code, f"code bigint, node bigint, vector {kind}, part bigint")
        .repartitionByRange("code", "node")
        .sortWithinPartitions("code", "node")
        .mapInArrow(near, EDGES)
    )


def _top(edges: DataFrame, k: int) -> DataFrame:
    best = W.partitionBy("u").orderBy(F.col("c").desc(), "v")
    return (
        edges.groupBy("u", "v")
        .agg(F.max("c").alias("c"))
        .withColumn("r", F.row_number().over(best))
        .where(F.col("r") <= k)
        .drop("r")
    )


def _refined(
    nodes: DataFrame, edges: DataFrame, k: int, turn: int, inside: DataFrame | None
) -> DataFrame:
    """One round: neighbours of neighbours, those by edges ``inside`` parts too, where they
    are better than what a node has."""
    worst = edges.groupBy("u").agg(
        F.when(F.count("*") >= k, F.min("c")).otherwise(F.lit(-1.5)).alias("least")
    )
    known = nodes.join(worst.withColumnRenamed("u", "node"), "node", "left").select(
        "node", "vector", "part", F.coalesce("least", F.lit(-1.5)).alias("least")
    )
    ways = edges if inside is None else edges.union(inside)
    around = ways.select("u", "v").union(ways.select(F.col("v").alias("u"), F.col("u").alias("v")))
    around = around.union(nodes.select(F.col("node").alias("u"), F.col("node").alias("v"))).distinct()

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for now, cut in runs(batches, 1, CHUNK):
            ids, least, parts = (now.column(c).to_numpy() for c in ("v", "least", "part"))
            rows = unit_vectors(now.column("vector"))
            found: list[tuple[np.ndarray, ...]] = []
            for a, b in zip(cut, cut[1:]):
                sims = cosines(rows[a:b], rows[a:b])
                r, c = _best(sims, least[a:b], k, parts[a:b])
                found.append((ids[a:b][r], ids[a:b][c], sims[r, c]))
            yield _edge_batch(*(np.concatenate(x) for x in zip(*found)))

    met = (
        around.join(known, F.col("v") == F.col("node"))
        .select("u", "v", "least", "part", "vector")
        .repartition(F.col("u"))
        .sortWithinPartitions(F.col("u"), F.xxhash64(F.col("v"), F.lit(turn)))
        .mapInArrow(join, EDGES)
    )
    return _top(edges.union(met), k)


def _searched(
    nodes: DataFrame, orders: range, threshold: float, k: int,
    known: DataFrame | None = None, inside: DataFrame | None = None,
) -> tuple[DataFrame, str]:
    """The lists of ``nodes`` (``node``, ``vector``, ``part``) with nodes of other parts,
    from ``orders`` and lists already ``known``, and their folder."""
    spark = nodes.sparkSession
    starts = [] if known is None else [known]
    for order in orders:
        starts.append(_from_order(nodes, order, k))
        if inside is not None:
            # long runs of one part in an order would hide the parts beyond them
            slot = F.pmod(F.xxhash64("node", F.lit(order)), F.lit(SPOKESMEN))
            few = nodes.groupBy("part", slot.alias("slot")).agg(F.min("node").alias("node"))
            starts.append(_from_order(nodes.join(few.select("node"), "node"), order, k))
    fresh = starts[0]
    for more in starts[1:]:
        fresh = fresh.union(more)
    edges, folder = written(_top(fresh, k), "neighbours")
    links = edges.where(F.col("c") >= threshold).count()
    for turn in range(ROUNDS):
        better, better_folder = written(_refined(nodes, edges, k, turn, inside), "neighbours")
        drop_folder(spark, folder)
        edges, folder = better, better_folder
        before, links = links, edges.where(F.col("c") >= threshold).count()
        if links - before <= GROWTH * before and (links or turn):
            break
    return edges, folder


def _joined_parts(
    nodes: DataFrame, edges: DataFrame, threshold: float, k: int
) -> tuple[DataFrame, str]:
    """The components of the links in ``edges`` and of those that saturated lists had no
    room for, and their folder. A link is in the list of either end that has room, so only
    ends with saturated lists are searched."""
    spark = nodes.sparkSession
    full = (
        edges.where(F.col("c") >= threshold).groupBy("u").count().where(F.col("count") >= k)
        .select(F.col("u").alias("node"))
    )
    links = edges.where(F.col("c") >= threshold).select("u", "v")
    parts, folder = written(components(links, "u", "v"), "components")
    first = ORDERS * ATTEMPTS  # orders that the first search does not use
    while True:
        saturated, saturated_folder = written(
            full.join(parts, "node").join(nodes.select("node", "vector"), "node")
            .select("node", "vector", F.col("component").alias("part")),
            "saturated",
        )
        some = saturated.agg(F.min("part"), F.max("part")).first()
        if some[0] == some[1]:  # of one component, or none at all
            drop_folder(spark, saturated_folder)
            return parts, folder
        found, found_folder = _searched(
            saturated, range(first, first + ORDERS), threshold, k, inside=edges
        )
        first += ORDERS
        new = found.where(F.col("c") >= threshold).select("u", "v")
        more = new.limit(1).count() > 0
        if more:
            ties = parts.select(F.col("node").alias("u"), F.col("component").alias("v")).union(new)
            joined, joined_folder = written(components(ties, "u", "v"), "components")
            drop_folder(spark, folder)
            parts, folder = joined, joined_folder
        drop_folder(spark, found_folder)
        drop_folder(spark, saturated_folder)
        if not more:
            return parts, folder


def _roots(link: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """For every row of a symmetric matrix of links the smallest id it leads to."""
    roots = ids.copy()
    while True:
        lower = np.minimum(roots, np.where(link, roots[None, :], roots[:, None]).min(axis=1))
        if (lower == roots).all():
            return roots
        roots = lower


def _links_by_node(
    nodes: DataFrame, parts: DataFrame, threshold: float, roots: bool = False
) -> DataFrame:
    """``node`` and ``others``: rows linked with it by vectors other than its own, counted
    inside its component in blocks. With ``roots``, a row per pair of blocks instead, with
    ``root``: a node that it is joined with by the links of the two."""
    placed, folder = written(
        number_rows(parts, F.col("component"), [F.col("node")], "place", buckets=16).withColumn(
            "block", (F.col("place") / BLOCK).cast("int")
        ),
        "places",
    )
    sizes = placed.groupBy("component").agg(F.max("block").alias("last"))
    rows = (
        placed.join(sizes, "component")
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("last"))))
        .join(nodes, "node")
        .select(
            "component",
            F.least("block", "other").alias("i"),
            F.greatest("block", "other").alias("j"),
            "block",
            "node",
            "copies",
            "vector",
        )
    )

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for now, cut in runs(batches, 3, 1 << 30):
            vectors = unit_vectors(now.column("vector"))
            first, second, block, node, copies = (
                now.column(c).to_numpy() for c in ("i", "j", "block", "node", "copies")
            )
            ids, counts, ends = [], [], []
            for a, b in zip(cut, cut[1:]):
                left = np.arange(a, b)[block[a:b] == first[a]]
                right = np.arange(a, b)[block[a:b] == second[a]]
                link = cosines(vectors[left], vectors[right]) >= threshold
                if first[a] == second[a]:
                    np.fill_diagonal(link, False)
                    both, square = left, link
                else:
                    ids.append(node[right])
                    counts.append(link.T @ copies[left])
                    both = np.append(right, left)
                    square = np.zeros((len(both), len(both)), dtype=bool) if roots else link
                    if roots:
                        square[: len(right), len(right) :] = link.T
                        square[len(right) :, : len(right)] = link
                ids.append(node[left])
                counts.append(link @ copies[right])
                ends.append(_roots(square, node[both]) if roots else node[both])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate(ids)),
                    pa.array(np.concatenate(counts).astype(np.int64)),
                    pa.array(np.concatenate(ends)),
                ],
                names=["node", "others", "root"],
            )

    found = (
        rows.repartition("component", "i", "j")
        .sortWithinPartitions("component", "i", "j", "node")
        .mapInArrow(count, "node bigint, others bigint, root bigint")
    )
    if not roots:
        found = found.groupBy("node").agg(F.sum("others").alias("others"))
    out, _ = written(found, "counts")
    drop_folder(nodes.sparkSession, folder)
    return out


def _exact(nodes: DataFrame, threshold: float) -> tuple[DataFrame, str, DataFrame]:
    """Components, their folder and links by node from the comparison of all vectors."""
    whole = nodes.select("node", F.lit(0).cast("long").alias("component"))
    pairs = _links_by_node(nodes, whole, threshold, roots=True)
    parts, folder = written(components(pairs, "node", "root"), "components")
    return parts, folder, pairs.groupBy("node").agg(F.sum("others").alias("others"))


def _recall(nodes: DataFrame, counted: DataFrame, threshold: float, audited: int) -> float:
    """The share of the audited nodes' links that were found. ``audited`` vectors are sent
    to all tasks, each of which returns one number per audited node and batch."""
    chosen = nodes.orderBy(F.xxhash64("node", F.lit(3)), "node").limit(audited)
    rows = chosen.join(counted, "node", "left").select("node", "vector", "others").toArrow()
    if not len(rows):
        return 1.0
    wanted, ids = unit_vectors(rows.column("vector")), rows.column("node").to_numpy()

    def brute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(ids), dtype=np.int64)
        for batch in batches:
            link = cosines(wanted, unit_vectors(batch.column(1))) >= threshold
            link[ids[:, None] == batch.column(0).to_numpy()[None, :]] = False
            total += link @ batch.column(2).to_numpy()
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(total)], names=["node", "others"])

    true = (
        nodes.select("node", "vector", "copies")
        .mapInArrow(brute, "node bigint, others bigint")
        .groupBy("node")
        .agg(F.sum("others").alias("others"))
        .toPandas()
        .set_index("node")["others"]
    )
    found = {n: o or 0 for n, o in zip(ids.tolist(), rows.column("others").to_pylist())}
    total = int(true.sum())
    return sum(min(found[n], int(true.get(n, 0))) for n in found) / total if total else 1.0


def valid(vector: F.Column) -> F.Column:
    finite = F.forall(
        vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))
    )
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def near_vectors(
    rows: DataFrame, threshold: float = THRESHOLD, neighbours: int = NEIGHBOURS
) -> tuple[DataFrame, float]:
    """``vec_id``, ``n_links``, ``component_id`` and ``kept`` for every row of ``rows``
    (``vec_id``, ``embedding``); and the recall that the audit measured."""
    spark = rows.sparkSession
    kind = rows.schema["embedding"].dataType.simpleString()
    vector = F.col("embedding").cast(kind if kind == "array<float>" else "array<double>")
    named, named_folder = written(
        rows.select(
            F.col("vec_id").cast("long").alias("vec_id"),
            F.when(valid(vector), F.xxhash64(vector)).alias("node"),
            vector.alias("vector"),
        ),
        "vectors",
    )
    nodes, nodes_folder = written(
        named.where("node is not null")
        .groupBy("node")
        .agg(F.first("vector").alias("vector"), F.count("*").alias("copies"), F.min("vec_id").alias("least_id")),
        "nodes",
    )
    searched = nodes.select("node", "vector", F.col("node").alias("part"))
    edges, edges_folder = None, None
    for attempt in range(ATTEMPTS):
        before_folder = edges_folder
        orders = range(ORDERS * attempt, ORDERS * (attempt + 1))
        edges, edges_folder = _searched(searched, orders, threshold, neighbours, known=edges)
        if before_folder:
            drop_folder(spark, before_folder)
        parts, parts_folder = _joined_parts(nodes, edges, threshold, neighbours)
        counted = _links_by_node(nodes, parts, threshold)
        recall = _recall(nodes, counted, threshold, AUDITED)
        if recall >= RECALL:
            break
        drop_folder(spark, parts_folder)
    else:
        parts, parts_folder, counted = _exact(nodes, threshold)
        recall = _recall(nodes, counted, threshold, AUDITED)
    classes = (
        nodes.select("node", "copies", "least_id")
        .join(parts, "node", "left")
        .withColumn("component", F.coalesce("component", "node"))
    )
    named_class = classes.groupBy("component").agg(F.min("least_id").alias("component_id"))
    by_node = (
        classes.join(named_class, "component")
        .join(counted, "node", "left")
        .select("node", (F.coalesce("others", F.lit(0)) + F.col("copies") - 1).alias("n"), "component_id")
    )
    out = (
        named.select("vec_id", "node")
        .join(by_node, "node", "left")
        .select(
            "vec_id",
            F.coalesce("n", F.lit(0)).cast("long").alias("n_links"),
            F.coalesce("component_id", "vec_id").alias("component_id"),
        )
        .withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
    )
    done, _ = written(out, "classes")
    for path in (named_folder, nodes_folder, edges_folder, parts_folder):
        drop_folder(spark, path)
    return done, recall


def op7_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The class and the number of links of every embedding."""
    return near_vectors(table(spark, sf_dir, "embeddings"))[0]
