"""Benchmark decontamination: spaced-seed hashing.

Words are runs of letters, digits and non-ASCII characters, A-Z in lower case. Every
window of a benchmark item is hashed once for each fixed mask; a mask ignores some
positions, so that a window whose only changed words lie there still hashes alike. Windows
of documents are hashed the same way and looked up. After a hit the two texts are compared
word by word along the diagonal; an overlap is the longest stretch that begins and ends
with agreeing words, has no three words in a row that differ, and has ``LEAST`` words or
more of which ``SHARE`` agree. Beside it there may be others. An item of fewer words
overlaps as a whole, where ``SHARE`` of its words agree; it has masks of its own.

* The window hashes of items and documents are joined in Spark. A bitmap of fixed size, in
  which the items' hashes are marked, leaves out most windows of documents before that; with
  very many items it leaves out fewer, with the same results.
* Equal texts are searched once. A hit gives a diagonal: a text, an item and the distance
  between their places. The words of texts that have one are dealt out in blocks of ``BLOCK``
  words, and each diagonal meets the blocks beside its item; no task needs a whole text.

Null and empty texts overlap with nothing. Every copy of a repeated row is reported, a null
``doc_id`` too. Without documents or items the result is empty; other columns of the inputs
are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame, SparkSession

from .common import maybe_in, table, written
from .words import lists, mix, utf8, word_hashes

# Which words a mask looks at. Every overlap has a hit. One of which no part
# is an overlap has 13 words with 2 changed, or 5k with k (else it has one word less too).
# The masks hit all of those of 13 and 15 words, by enumeration (see the test). From 20 on,
# the 5k - 5 last words are no overlap, so all changed words are there: the first 5 agree.
MASKS = ((0, 1, 2, 3, 4), (0, 1, 5, 7, 8))
LEAST = 13
SHARE = 0.8
# 2^25 bits, 4 MB, whatever the data
SPOT_BITS = 25
BLOCK = 1024


def window_hashes(words: np.ndarray, mask: tuple[int, ...], size: int = 0) -> np.ndarray:
    """The hash under a mask of every window (of ``size`` words, if not as long as the
    mask) of a run of words."""
    n = len(words) - (size or mask[-1] + 1) + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    total = np.full(n, MASKS.index(mask) + 1 if mask in MASKS else size + 100, dtype=np.uint64)
    for k, m in zip(mask, mix(np.array(mask, dtype=np.uint64) + np.uint64(1)) | np.uint64(1)):
        total += words[k : k + n] * m
    return mix(total)


def wrong_words(size: int) -> int:
    """How many of ``size`` words may differ."""
    return max(w for w in range(size) if size - w >= SHARE * size)


def short_masks(size: int) -> list[tuple[int, ...]]:
    """Masks of a whole item: of two blocks more than words may differ, all but so many."""
    wrong = wrong_words(size)
    blocks = np.array_split(np.arange(size), wrong + 2 if wrong else 1)
    return [
        tuple(np.concatenate(some).tolist()) for some in combinations(blocks, 2 if wrong else 1)
    ]


Mask = tuple[int, tuple[int, ...]]


def all_masks(sizes: Sequence[int]) -> list[Mask]:
    """The masks of windows (size 0), and those of whole items of the given short sizes."""
    return [(0, m) for m in MASKS] + [(n, m) for n in sorted(sizes) for m in short_masks(n)]


def window_seeds(
    words: np.ndarray, offsets: np.ndarray, masks: Sequence[Mask]
) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """For each mask its size and, for every window inside one text of a run, the text, the
    window's begin in the run, and its hash."""
    for size, mask in masks:
        width = size or mask[-1] + 1
        hashes = window_hashes(words, mask, size)
        at = np.arange(len(hashes))
        text = np.searchsorted(offsets, at, "right") - 1
        inside = np.flatnonzero(at + width <= offsets[text + 1])
        yield size, text[inside], at[inside], hashes[inside]


def item_seeds(words: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each mask of an item its size, the begins of windows, and their hashes: an item of
    fewer than ``LEAST`` words is one window."""
    masks = [(0, m) for m in MASKS]
    if len(words) < LEAST:
        masks = [(len(words), m) for m in short_masks(len(words))] if len(words) else []
    for size, _, at, hashes in window_seeds(words, np.array([0, len(words)]), masks):
        yield size, at, hashes


def stretches(equal: np.ndarray) -> list[tuple[int, int]]:
    """The overlaps of a diagonal: begin and end of the longest one, the first if there are
    several, and of those on either side of it."""
    wrong = ~equal
    run = np.flatnonzero(wrong[:-2] & wrong[1:-1] & wrong[2:]) if len(equal) > 2 else []
    borders = [0, *(int(x) + k for x in run for k in (0, 3)), len(equal)]
    open_parts = [(a, b) for a, b in zip(borders[::2], borders[1::2]) if b - a >= LEAST]
    out = []
    while open_parts:
        low, high = open_parts.pop()
        part = equal[low:high]
        # not below 0 where SHARE agree
        level = np.concatenate([[0], np.cumsum(np.where(part, 1, -4))])
        last = np.where(np.append(False, part), level, -5 * len(equal))
        # the highest level from each end on falls; the last end not below a begin's level
        highest = np.maximum.accumulate(last[::-1])
        end = len(part) - np.searchsorted(highest, level[:-1], "left")
        length = np.where(part, end - np.arange(len(part)), 0)
        begin = int(np.argmax(length))
        if length[begin] < LEAST:
            continue
        out.append((low + begin, low + int(end[begin])))
        sides = ((low, low + begin), (low + int(end[begin]), high))
        open_parts += [(a, b) for a, b in sides if b - a >= LEAST]
    return sorted(out)


def judged(equal: np.ndarray, size: int) -> list[tuple[int, int, int]]:
    """The overlaps of a diagonal, or of a whole short item of ``size`` words: begin, end and
    agreeing words."""
    if size:
        same = int(equal.sum())
        return [(0, size, same)] if same >= SHARE * size else []
    return [(a, b, int(equal[a:b].sum())) for a, b in stretches(equal)]


Batches = Iterator[pa.RecordBatch]


def _item_rows(batches: Batches) -> Batches:
    """From ``key`` and ``text``: a row for each seed of an item."""
    for batch in batches:
        for first, stop, (hashes,), offsets in word_hashes(utf8(batch.column(1)), True):
            for i in range(first, stop):
                words = hashes[offsets[i - first] : offsets[i - first + 1]]
                for size, at, found in item_seeds(words):
                    n = len(at)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.repeat(batch.column(0)[i], n),
                            pa.repeat(pa.scalar(len(words), pa.int32()), n),
                            pa.repeat(pa.scalar(size, pa.int32()), n),
                            pa.array(found.view(np.int64)),
                            pa.array(at, type=pa.int32()),
                        ],
                        names=["item", "n", "size", "h", "place"],
                    )


def _text_rows(masks: list[Mask], sent) -> Callable[[Batches], Batches]:
    """From ``key`` and ``text``: the seeds of a text that are marked in the bitmap."""

    def rows(batches: Batches) -> Batches:
        bits = sent.value
        low, one = np.uint64((1 << SPOT_BITS) - 1), np.uint64(1)
        for batch in batches:
            for first, _, (hashes,), offsets in word_hashes(utf8(batch.column(1)), True):
                for size, text, at, found in window_seeds(hashes, offsets, masks):
                    slot = found & low
                    marked = bits[(slot >> np.uint64(6)).astype(np.int64)] >> (slot & np.uint64(63))
                    hit = np.flatnonzero(marked & one)
                    yield pa.RecordBatch.from_arrays(
                        [
                            batch.column(0).take(pa.array(first + text[hit])),
                            pa.repeat(pa.scalar(size, pa.int32()), len(hit)),
                            pa.array(found[hit].view(np.int64)),
                            pa.array(at[hit] - offsets[text[hit]], type=pa.int32()),
                        ],
                        names=["text", "size", "h", "at"],
                    )

    return rows


def _block_rows(block: int) -> Callable[[Batches], Batches]:
    """From ``key`` and ``text``: the text's word hashes, in blocks of so many."""

    def rows(batches: Batches) -> Batches:
        for batch in batches:
            for first, _, (hashes,), offsets in word_hashes(utf8(batch.column(1)), True):
                counts = -(-np.diff(offsets) // block)
                text = np.repeat(np.arange(len(counts)), counts)
                number = np.arange(len(text)) - np.repeat(np.cumsum(counts) - counts, counts)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array(first + text, type=pa.int64())),
                        pa.array(number, type=pa.int32()),
                        lists(
                            hashes.view(np.int64),
                            np.append(offsets[text] + number * block, offsets[-1]),
                            pa.int64(),
                        ),
                    ],
                    names=["text", "block", "words"],
                )

    return rows


def _overlap_rows(batches: Batches) -> Batches:
    """From the agreement along a diagonal: a row for each overlap."""
    for batch in batches:
        rows = batch.to_pydict()
        source, found = [], []
        for i, (size, shift, begin, equal) in enumerate(
            zip(rows["size"], rows["shift"], rows["begin"], rows["equal"])
        ):
            for a, b, same in judged(np.array(equal, dtype=bool), size):
                source.append(i)
                found.append((begin + a, begin + b, begin + a - shift, same))
        columns = list(zip(*found, strict=True)) or [()] * 4
        keys = [batch.column(k).take(pa.array(source, type=pa.int64())) for k in (0, 1)]
        yield pa.RecordBatch.from_arrays(
            [*keys, *(pa.array(c, type=pa.int64()) for c in columns)],
            names=["text", "item", "begin", "end", "item_begin", "same"],
        )


def _bitmap(seeds: DataFrame) -> np.ndarray:
    """The bits that the items' hashes mark, in 64-bit numbers."""
    slot = F.col("h").bitwiseAND(F.lit((1 << SPOT_BITS) - 1))
    marked = (
        seeds.select(F.shiftright(slot, 6).alias("w"), slot.bitwiseAND(F.lit(63)).cast("int").alias("b"))
        .groupBy("w")
        .agg(F.bit_or(F.expr("shiftleft(1L, b)")).alias("bits"))
        .toArrow()
    )
    bits = np.zeros(1 << (SPOT_BITS - 6), dtype=np.uint64)
    bits[marked["w"].to_numpy()] = marked["bits"].to_numpy().view(np.uint64)
    return bits


def _blocks_of(first: str, last: str, size: int) -> Column:
    """The numbers of the blocks that hold the places from ``first`` to before ``last``."""
    return F.expr(f"sequence(cast(({first}) div {size} as int), cast(({last} - 1) div {size} as int))")


def _agreement(lines: DataFrame, blocks: DataFrame, item_blocks: DataFrame, size: int) -> DataFrame:
    """For each diagonal which of the words beside each other agree, from ``begin`` on; blocks
    have ``size`` words."""
    first, last = F.greatest("shift", F.lit(0)), F.col("shift") + F.col("n")
    needed = lines.withColumns({"first": first, "last": last}).withColumn(
        "block", F.explode(_blocks_of("first", "last", size))
    )
    start = F.col("block") * size
    beside = needed.join(blocks, ["text", "block"]).withColumns(
        {"low": F.greatest("first", start), "high": F.least("last", start + F.size("words"))}
    )
    # the item's blocks beside the part of the text, at most two
    part = beside.where("low < high").select(
        "text", "item", "size", "shift", "low",
        F.slice("words", F.col("low") - start + 1, F.col("high") - F.col("low")).alias("words"),
        F.explode(_blocks_of("low - shift", "high - shift", size)).alias("block"),
    )
    own = item_blocks.select(F.col("text").alias("item"), "block", F.col("words").alias("own"))
    # a place in the block of the item for every place in the part of the text
    ahead = F.col("low") - F.col("shift") - start
    skipped, unread = F.greatest(-ahead, F.lit(0)), F.greatest(ahead, F.lit(0))
    length = F.least(F.size("words") - skipped, F.size("own") - unread)
    equal = F.zip_with(
        F.slice("words", skipped + 1, length), F.slice("own", unread + 1, length), lambda x, y: x == y
    )
    return (
        part.join(own, ["item", "block"])
        .select("text", "item", "size", "shift", F.struct((F.col("low") + skipped).alias("at"), equal.alias("e")).alias("p"))
        .groupBy("text", "item", "size", "shift")
        .agg(F.array_sort(F.collect_list("p")).alias("p"))
        .select("text", "item", "size", "shift", F.col("p")[0]["at"].alias("begin"), F.flatten("p.e").alias("equal"))
    )


def overlaps(docs: DataFrame, benchmark: DataFrame, block: int = BLOCK) -> DataFrame:
    """Every overlap of a document (``doc_id``, ``text``) with an item (``item_id``,
    ``text``), in words: ``begin`` to ``end`` in the document, ``item_begin``, and how many
    agree (``same``)."""
    spark = docs.sparkSession

    def key(text: Column) -> Column:
        return F.unhex(F.md5(text.cast("binary")))

    items = benchmark.where("item_id is not null and text is not null").select(
        F.col("item_id").cast("long"), key(F.col("text")).alias("key"), "text"
    )
    texts = docs.where("text is not null").select(
        F.col("doc_id").cast("long"), key(F.col("text")).alias("key"), "text"
    )
    seeds, _ = written(
        items.select("key", "text")
        .mapInArrow(_item_rows, "item binary, n int, size int, h bigint, place int")
        .distinct(),
        "item-seeds",
    )
    sizes = [r[0] for r in seeds.where("size > 0").select("size").distinct().collect()]
    sent = spark.sparkContext.broadcast(_bitmap(seeds))
    found = texts.select("key", "text").mapInArrow(
        _text_rows(all_masks(sizes), sent), "text binary, size int, h bigint, at int"
    )
    lines, _ = written(
        found.join(seeds, ["size", "h"])
        .select("text", "item", "n", "size", (F.col("at") - F.col("place")).alias("shift"))
        .distinct(),
        "diagonals",
    )
    kind = "text binary, block int, words array<bigint>"
    may = maybe_in(lines, "text")
    concerned = texts.where(may(F.col("key")))
    blocks = concerned.select("key", "text").mapInArrow(_block_rows(block), kind).dropDuplicates(["text", "block"])
    item_blocks = items.select("key", "text").mapInArrow(_block_rows(block), kind).dropDuplicates(["text", "block"])
    passages = _agreement(lines, blocks, item_blocks, block).mapInArrow(
        _overlap_rows,
        "text binary, item binary, begin bigint, end bigint, item_begin bigint, same bigint",
    )
    return (
        passages.join(concerned.select("doc_id", F.col("key").alias("text")), "text")
        .join(items.select("item_id", F.col("key").alias("item")), "item")
        .select("doc_id", "item_id", "begin", "end", "item_begin", "same")
    )


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Per document and item with an overlap: the number of overlaps and the longest."""
    return (
        overlaps(docs, benchmark)
        .groupBy("doc_id", "item_id")
        .agg(
            F.count("*").alias("n_overlaps"),
            F.max(F.col("end") - F.col("begin")).alias("longest"),
            F.max("same").alias("same"),
        )
    )


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every pair of a document and a benchmark item that share a passage."""
    return contaminated(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    )
