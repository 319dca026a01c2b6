"""N-gram Jaccard join: a blocked sparse matrix product of document by n-gram incidence.

Two documents link if their sets of word 4-grams have a Jaccard similarity of at least
``THRESHOLD`` percent. The result is exact; how the product is kept sparse:

* Columns (n-grams, as 64-bit hashes) are ordered by rarity, rare ones first: by counters of a
  fixed-size table, then by hash. Of a set of s n-grams, two linked ones share one of their
  first ``s - ceil(threshold * s) + 1``, so only these columns are multiplied at first. Passages
  that very many documents share come last and are hardly ever among them; no column stands
  for anything but an n-gram, so unrelated documents do not meet.
* Rows are blocked by set size, in bands; a pair in question lies in one band or at the
  border of two, and a document near a border belongs to both.
* Equal rows are one row. Of the rows that meet in a column and band, each is first paired with
  the smallest; after links merged what they could, the others are paired unless they are
  connected already; of columns with the same rows one is asked, and a pair with many columns in
  common is raised by the first of them. Pairs are left out whose sizes or parities prove too
  many differences.
* For the pairs left, overlap counts accumulate block by block over the sorted n-grams, and
  a pair is discarded as soon as the size-derived bound cannot be met any more.

Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z in lower case; a text of fewer than 4 words is
one n-gram of all of them. Null texts and texts without words have empty sets and link
with nothing. Repeated rows link if their sets are not empty; a ``doc_id`` stands for one
text. Rows without a ``doc_id`` are returned as they are and link with nothing. An empty
table gives an empty table; other columns of the input are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyspark.sql.functions as F
from pyspark.sql import DataFrame, SparkSession

from .common import components, drop_folder, maybe_in, table, written
from .words import lists, mix, utf8, word_hashes

WORDS = 4
THRESHOLD = 85
BAND = 1.5
# Counters that tell frequent n-grams from rare ones; 4 MB of logarithms reach the tasks.
COUNTERS = 1 << 22
SKETCH_WORDS = 8
COLUMN_BLOCKS = 8
# So many of its buckets each row names, by which two rows know the first they have in common.
NAMED_BUCKETS = 16


def ngram_set(words: np.ndarray, n: int = WORDS) -> np.ndarray:
    """The sorted distinct n-gram hashes of a text's word hashes."""
    if not len(words):
        return np.zeros(0, dtype=np.uint64)
    return np.unique(_grams(words, min(n, len(words))))


def _grams(words: np.ndarray, size: int) -> np.ndarray:
    factors = mix(np.arange(1, size + 1, dtype=np.uint64)) | np.uint64(1)
    total = np.full(len(words) - size + 1, size, dtype=np.uint64)
    for k in range(size):
        total += words[k : k + len(total)] * factors[k]
    return mix(total)


def _slots(ngrams: np.ndarray) -> np.ndarray:
    return (ngrams >> np.uint64(64 - COUNTERS.bit_length() + 1)).astype(np.int64)


def rarity(docs: DataFrame, n: int) -> np.ndarray:
    """How frequent the n-grams of each slot are, as logarithms: only an order, which any other
    could replace, so tasks leave out the slots that stand out little from their others."""

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(COUNTERS, dtype=np.int64)
        total = 0
        for batch in batches:
            for _, _, (hashes,), offsets in word_hashes(utf8(batch.column(0))):
                if len(hashes) < n:
                    continue
                grams = np.full(len(hashes) - n + 1, True)
                for edge in offsets[1:-1]:
                    grams[max(edge - n + 1, 0) : edge] = False
                slots = _slots(_grams(hashes, n)[grams])
                seen += np.bincount(slots, minlength=COUNTERS)
                total += len(slots)
        slots = np.flatnonzero(seen > 8 + 3 * total / COUNTERS)
        yield pa.RecordBatch.from_arrays(
            [pa.array(slots.astype(np.int32)), pa.array(seen[slots])], names=["slot", "n"]
        )

    found = docs.select("text").mapInArrow(counts, "slot int, n bigint")
    summed = found.groupBy("slot").agg(F.sum("n").alias("n")).toPandas()
    table = np.zeros(COUNTERS, dtype=np.uint8)
    table[summed["slot"].to_numpy()] = np.minimum(4 * np.log2(1 + summed["n"].to_numpy()), 255)
    return table


def prefix(ngrams: np.ndarray, weights: np.ndarray, threshold: int) -> np.ndarray:
    """The rarest n-grams of a sorted set, so many that two linked sets share one."""
    size = len(ngrams)
    count = size - -(-threshold * size // 100) + 1
    key = (weights[_slots(ngrams)].astype(np.uint64) << np.uint64(56)) | (ngrams >> np.uint64(8))
    return ngrams[np.argsort(key, kind="stable")[:count]]


def band_numbers(number: str, n: str, threshold: int) -> F.Column:
    """A number for each size band that a set belongs to. A pair belongs to the band of its
    smaller set, so a set belongs to its own and, if a linked one may lie there, the one
    below."""
    own = F.floor(F.log(F.col(n).cast("double")) / math.log(BAND) + F.lit(1e-9))
    top = F.ceil(F.pow(F.lit(BAND), own))  # the largest size in the band below
    below = F.when((own > 0) & (F.col(n) * threshold <= top * 100), own - 1)
    both = F.array_compact(F.array(own, below))
    return F.transform(both, lambda band: F.xxhash64(F.col(number), band))


def parities(ngrams: np.ndarray) -> np.ndarray:
    """Parities of the n-grams dealt to bits, more bits for a larger set; two sets differ in
    at least as many n-grams as their parities differ in bits."""
    bits = SKETCH_WORDS * 64
    while 3 * bits < 2 * len(ngrams):
        bits *= 2
    hits = np.bincount((ngrams % np.uint64(bits)).astype(np.int64), minlength=bits)
    return np.packbits((hits & 1).astype(np.uint8))


def halved(parity: np.ndarray, size: int) -> np.ndarray:
    """The parities with fewer bits, ``size`` bytes."""
    while len(parity) > size:
        half = len(parity) // 2
        parity = parity[:half] ^ parity[half:]
    return parity


ROWS = (
    "doc_id bigint, n bigint, h1 bigint, h2 bigint, sketch array<bigint>, parity binary, "
    "numbers array<bigint>"
)


def incidence(docs: DataFrame, n: int, threshold: int) -> DataFrame:
    """One row per document: set size, two hashes of the set, its parities (``sketch``: in a
    fixed number of bits), its rarest n-grams."""
    known = docs.sparkSession.sparkContext.broadcast(rarity(docs, n))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = known.value
        for batch in batches:
            texts = utf8(batch.column(1))
            sizes, h1, h2, sketches, parity, numbers, ends = [], [], [], [], [], [], [0]
            for _, _, (hashes,), offsets in word_hashes(texts):
                for a, b in zip(offsets, offsets[1:]):
                    grams = ngram_set(hashes[a:b], n)
                    sizes.append(len(grams))
                    h1.append(mix(grams).sum(dtype=np.uint64))
                    h2.append((grams * (grams | np.uint64(1))).sum(dtype=np.uint64))
                    bits = parities(grams)
                    parity.append(bits.tobytes())
                    sketches.append(halved(bits, SKETCH_WORDS * 8).view(np.int64))
                    numbers.append(prefix(grams, weights, threshold) if len(grams) else grams)
                    ends.append(ends[-1] + len(numbers[-1]))
            flat = np.concatenate([*numbers, np.zeros(0, np.uint64)]).view(np.int64)
            every = np.arange(len(texts) + 1) * SKETCH_WORDS
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(sizes, type=pa.int64()),
                    pa.array(np.array(h1, dtype=np.uint64).view(np.int64)),
                    pa.array(np.array(h2, dtype=np.uint64).view(np.int64)),
                    lists(np.concatenate([*sketches, np.zeros(0, np.int64)]), every, pa.int64()),
                    pa.array(parity, type=pa.binary()),
                    lists(flat, np.array(ends), pa.int64()),
                ],
                names=["doc_id", "n", "h1", "h2", "sketch", "parity", "numbers"],
            )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(rows, ROWS)


def overlap_reached(a: np.ndarray, b: np.ndarray, threshold: int) -> bool:
    """Whether two sorted sets link: their overlap is counted by column blocks, until the
    threshold is certain or out of reach."""
    need = -(-threshold * (len(a) + len(b)) // (100 + threshold))
    if min(len(a), len(b)) < need:
        return False
    edges = np.linspace(0, 1, COLUMN_BLOCKS + 1)[1:-1] * 2.0**64
    cuts = edges.astype(np.uint64)
    a_cut = [0, *np.searchsorted(a, cuts), len(a)]
    b_cut = [0, *np.searchsorted(b, cuts), len(b)]
    count = 0
    for k in range(COLUMN_BLOCKS):
        x, y = a[a_cut[k] : a_cut[k + 1]], b[b_cut[k] : b_cut[k + 1]]
        if len(x) and len(y):
            at = np.searchsorted(y, x)
            at[at == len(y)] = 0
            count += int((y[at] == x).sum())
        if count + min(len(a) - a_cut[k + 1], len(b) - b_cut[k + 1]) < need:
            return False
    return count >= need


class _Sets:
    """Sets of recently seen texts; rows come sorted, so that most are seen in a row."""

    def __init__(self, n: int, keep: int = 64):
        self.n, self.keep, self.known = n, keep, {}

    def __call__(self, key: int, text: bytes) -> np.ndarray:
        if key not in self.known:
            if len(self.known) >= self.keep:
                self.known.pop(next(iter(self.known)))
            _, _, (hashes,), _ = next(word_hashes([text]))
            self.known[key] = ngram_set(hashes, self.n)
        return self.known[key]


def linked(pairs: DataFrame, texts: DataFrame, n: int, threshold: int) -> DataFrame:
    """The pairs ``a``, ``b`` of documents whose n-gram sets reach the threshold. ``texts``
    holds at least their texts."""
    one = texts.select(F.col("doc_id").alias("ia"), F.col("text").alias("ta"))
    two = texts.select(F.col("doc_id").alias("ib"), F.col("text").alias("tb"))
    both = (
        pairs.join(two, F.col("b") == F.col("ib"))
        .join(one, F.col("a") == F.col("ia"))
        .select("a", "b", "ta", "tb")
    )

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets = _Sets(n)
        for batch in batches:
            a, b, x, y = (batch.column(i) for i in range(4))
            ok = [
                overlap_reached(sets(i, t), sets(j, u), threshold)
                for i, j, t, u in zip(a.to_pylist(), b.to_pylist(), utf8(x), utf8(y))
            ]
            mask = pa.array(ok, type=pa.bool_())
            yield pa.RecordBatch.from_arrays([a.filter(mask), b.filter(mask)], names=["a", "b"])

    return both.mapInArrow(check, "a bigint, b bigint")


def _differing_bits(x: str, y: str) -> F.Column:
    words = [F.bit_count(F.get(x, F.lit(k)).bitwiseXOR(F.get(y, F.lit(k)))) for k in range(SKETCH_WORDS)]
    return sum(words[1:], words[0])


def _plausible(pairs: DataFrame, rows: DataFrame, threshold: int) -> DataFrame:
    """The pairs ``a``, ``b`` whose sizes and parities (``rep``, ``n``, ``sketch``, ``parity``)
    do not rule out the threshold."""
    own = F.struct("n", "sketch", "parity")
    one = rows.select(F.col("rep").alias("a"), own.alias("x"))
    two = rows.select(F.col("rep").alias("b"), own.alias("y"))
    both = pairs.join(one, "a").join(two, "b").where(_may_link("x", "y", threshold))

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, n, x, y = batch.columns
            ok = []
            for size, p, q in zip(n.to_pylist(), x.to_pylist(), y.to_pylist()):
                least = min(len(p), len(q))
                p, q = (halved(np.frombuffer(z, dtype=np.uint8), least) for z in (p, q))
                differ = int(np.bitwise_count(p ^ q).sum())
                ok.append(differ <= size - 2 * (-(-size * threshold // (100 + threshold))))
            mask = pa.array(ok, type=pa.bool_())
            yield pa.RecordBatch.from_arrays([a.filter(mask), b.filter(mask)], names=["a", "b"])

    return both.select(
        "a", "b", (F.col("x.n") + F.col("y.n")).alias("n"), F.col("x.parity").alias("p"), F.col("y.parity").alias("q")
    ).mapInArrow(check, "a bigint, b bigint")


def _may_link(x: str, y: str, threshold: int) -> F.Column:
    both = F.col(f"{x}.n") + F.col(f"{y}.n")
    # the overlap that a linked pair of these sizes has at least
    need = F.floor((both * threshold + (100 + threshold - 1)) / (100 + threshold))
    bits = _differing_bits(f"{x}.sketch", f"{y}.sketch")
    return (F.least(f"{x}.n", f"{y}.n") >= need) & (bits <= both - need * 2)


def unsettled(members: DataFrame) -> DataFrame:
    """The buckets (``number``) whose rows (``rep``) are in different components. Buckets of the
    same rows, told by hashes, raise the same pairs; one of them is asked."""
    own = F.xxhash64("rep")
    spread = F.pmod(F.xxhash64("rep", F.lit(7)), F.lit(1 << 31))
    return (
        members.groupBy("number")
        .agg(
            F.min("component").alias("low"),
            F.max("component").alias("high"),
            F.count(F.lit(1)).alias("size"),
            F.bit_xor(own).alias("mixed"),
            F.sum(spread).alias("total"),
        )
        .where("low < high")
        .groupBy("low", "high", "size", "mixed", "total")
        .agg(F.min("number").alias("number"))
        .select("number")
    )


def open_pairs(members: DataFrame, marks: DataFrame, threshold: int) -> DataFrame:
    """Pairs ``a``, ``b`` of the rows (``rep``) of each bucket (``number``) that are in different
    ``component`` and may link. A bucket leaves a pair to a smaller one that both rows name;
    pairs that have none come once for each bucket."""
    named = members.groupBy("rep").agg(
        F.slice(F.sort_array(F.collect_set("number")), 1, NAMED_BUCKETS).alias("named")
    )
    rows = members.join(named.join(marks, "rep"), "rep")
    x, y = rows.alias("x"), rows.alias("y")
    first = F.array_min(F.array_intersect("x.named", "y.named"))
    return x.join(
        y,
        (F.col("x.number") == F.col("y.number"))
        & (F.col("x.rep") > F.col("y.rep"))
        & (F.col("x.component") != F.col("y.component"))
        & _may_link("x", "y", threshold)
        & (F.coalesce(first, F.col("x.number")) >= F.col("x.number")),
    ).select(F.col("x.rep").alias("a"), F.col("y.rep").alias("b"))


def near_duplicates(docs: DataFrame, n: int = WORDS, threshold: int = THRESHOLD) -> DataFrame:
    """``doc_id``, ``n_shingles`` and ``component_id`` of every row of ``docs`` (``doc_id``,
    ``text``): the smallest ``doc_id`` that links reach."""
    spark = docs.sparkSession
    folders: list[str] = []

    def keep(df: DataFrame, name: str) -> DataFrame:
        out, folder = written(df, name)
        folders.append(folder)
        return out

    rows = keep(incidence(docs, n, threshold), "incidence")
    known = rows.where("n > 0 and doc_id is not null")

    # equal sets are one row, named by its smallest document
    sets = keep(known.groupBy("h1", "h2", "n").agg(F.min("doc_id").alias("rep")), "sets")

    # rows that share a column and a band; sets with one first hash are told apart here
    entries = known.select(F.explode("numbers").alias("number"), "h1").repartition(F.col("number"))
    shared = (
        entries.groupBy("number")
        .agg(F.min("h1").alias("low"), F.max("h1").alias("high"))
        .where("low < high")
        .select(F.col("number").alias("shared_number"))
    )
    buckets = keep(
        entries.join(shared.hint("shuffle_hash"), F.col("number") == F.col("shared_number"))
        .select("number", "h1")
        .distinct()
        .join(sets, "h1")
        .select(F.explode(band_numbers("number", "n", threshold)).alias("number"), "rep"),
        "buckets",
    )
    wanted = maybe_in(buckets, "rep")
    marks = keep(
        known.where(wanted(F.col("doc_id")))
        .select(F.col("doc_id").alias("rep"), "n", "sketch", "parity")
        .dropDuplicates(["rep"]),
        "sketches",
    )
    texts = keep(
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
        .where(wanted(F.col("doc_id")))
        .dropDuplicates(["doc_id"]),
        "texts",
    )

    # each row with the smallest row of its buckets
    hubs = buckets.groupBy("number").agg(F.min("rep").alias("hub"))
    met = keep(
        buckets.join(hubs, "number")
        .where("rep != hub")
        .select(F.col("rep").alias("a"), F.col("hub").alias("b"))
        .distinct(),
        "met",
    )
    links = keep(linked(_plausible(met, marks, threshold), texts, n, threshold), "links")
    merged = keep(components(links, "a", "b"), "components")

    def class_of(pairs: DataFrame, column: str, name: str) -> DataFrame:
        own = merged.select(F.col("node").alias(column), F.col("component").alias(name))
        return pairs.join(own, column, "left").withColumn(name, F.coalesce(name, column))

    # then all rows of a bucket that are still in different components
    members = class_of(buckets, "rep", "component")
    still = keep(members.join(unsettled(members), "number"), "unsettled")
    third = (
        open_pairs(still, marks.drop("parity"), threshold)
        .distinct()
        .join(met, ["a", "b"], "left_anti")
    )
    links = keep(
        links.union(linked(_plausible(third, marks, threshold), texts, n, threshold)), "links"
    )
    merged = keep(components(links, "a", "b"), "components")

    by_set = class_of(sets, "rep", "component").select("h1", "h2", "n", "component")
    out = (
        rows.select("doc_id", "n", "h1", "h2")
        .join(by_set, ["h1", "h2", "n"], "left")
        .select(
            "doc_id",
            F.col("n").alias("n_shingles"),
            F.when(F.col("n") > 0, F.col("component")).alias("component_id"),
        )
        .withColumn("component_id", F.coalesce("component_id", "doc_id"))
    )
    done, _ = written(out, "classes")
    for folder in folders:
        drop_folder(spark, folder)
    return done


def op5_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The class of every document."""
    return near_duplicates(table(spark, sf_dir, "documents"))
