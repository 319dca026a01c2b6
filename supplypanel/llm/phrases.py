"""Phrase collocation mining: best-first branch-and-bound growth of phrases, per language.

A phrase grows from its prefix word by word. The score of a phrase is that of its worst cut,
``floor(2000000 a / (l + r))``; as the right part of any cut occurs at least ``a`` times and a
phrase no more often than its prefix, a prefix ``q`` of two or more words bounds the scores of
all that begin with it: ``2000000 f(q) / (f(s) + f(q))`` for every shorter prefix ``s`` of
``q``. A suffix bounds what ends with it in the same way.

* Words and pairs of words are counted whole. A pair's score is exact at once, its bounds
  open the frontier.
* Per language, the nodes with the best bounds are expanded first: all prefixes and suffixes
  whose bound reaches ``floor``, the score of the language's pair at place ``FIRST_PLACE``.
  Every phrase of 3 or 4 words that scores ``floor`` or more then has both parts of each of
  its cuts counted, and every phrase that scores so much has all its extensions by one word
  counted, so scores and the rule of the longer phrase are exact down to ``floor``.
* If fewer than ``TOP`` survivors reach ``floor``, it is lowered (``WIDEN`` times as many
  places, at last 0) and the languages that are not settled yet go on. So the 2000th survivor
  and all ties with it are settled.

A longer phrase that holds a candidate is never more frequent than one that is longer by a
single word in between, so the rule "contained in a longer candidate of at least 80 percent"
needs extensions by one word only.

In tasks, words are 64-bit numbers of language and word; a run in which two words had one
number would be done again with other numbers. What tasks get to know of the frontier is a
bitmap of bounded size; it may let more phrases be counted, never fewer, and counts of the
phrases that pass are whole. Sums and products are decimals.

Null texts are empty; a null ``lang`` is ``und``. Repeated rows count each. Phrases never cross
the end of a piece or a text. An empty table, or one without a phrase of ``least`` occurrences,
gives an empty result. Other columns of the input are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import cache

import numpy as np
import pyarrow as pa
import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W

from .common import drop_folder, table, written
from .words import PIECE_BYTES, hash_piece, lists, mix, utf8

LEAST = 30
TOP = 2000
LONGEST = 4
SCALE = 2_000_000
CONTAINED = 80  # percent
FIRST_PLACE = 3 * TOP
WIDEN = 8

# What ends a piece, and what parts the words of one.
BREAKS = (0x2E, 0x2C, 0x3B, 0x3A, 0x21, 0x3F, 0x0A, 0x0B, 0x0C, 0x0D)
BLANKS = (0x20, 0x09)

# Words of a task that are counted together before they leave it.
BUFFERED = 250_000
# Texts are numbered in runs of about this size.
RUN_BYTES = PIECE_BYTES // 4
# Words that a task remembers to have named.
NAMED = 100_000
# Bits of a bitmap: 16 for each key, between these bounds (16 MB at most).
FEWEST_BITS, MOST_BITS = 1 << 20, 1 << 27
# Rows of numbers go to the tasks' Python in batches of this size, a row at least.
BATCH_BYTES = "8m"


@cache
def _ends() -> tuple[np.ndarray, np.ndarray]:
    breaks = np.zeros(256, dtype=bool)
    breaks[list(BREAKS)] = True
    both = breaks.copy()
    both[list(BLANKS)] = True
    return breaks, both


def _chunks(text: bytes) -> Iterator[bytes]:
    """A long text in parts that end before a blank or a break."""
    at, ends = 0, _ends()[1]
    while len(text) - at > PIECE_BYTES:
        stop = at + PIECE_BYTES
        while stop < len(text) and not ends[text[stop]]:
            stop += 1
        yield text[at:stop]
        at = stop
    yield text[at:]


def language_number(lang: str, salt: int) -> np.uint64:
    raw = lang.encode()
    return np.uint64(zlib.crc32(raw) << 32 | zlib.crc32(raw, salt + 1))


def _words_of(
    data: np.ndarray, langs: np.ndarray, edges: np.ndarray, open_piece: bool
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, bool]:
    """The numbers of the words in ``data``, in which texts of the languages ``langs`` begin at
    ``edges``, with a 0 wherever a piece ends; their distinct numbers with start and end of
    one of them; whether the last piece goes on. ``open_piece``: the first one does."""
    breaks, both = _ends()
    starts, words = hash_piece(data, both)
    passed = np.cumsum(breaks[data])
    if not len(starts):
        none = np.zeros(0, dtype=np.int64)
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64), none, none, open_piece and not passed[-1:].any()
    own = langs[np.searchsorted(edges, starts, side="right") - 1]
    words = np.maximum(mix(words ^ own), np.uint64(1))
    piece = passed[starts]
    new = np.concatenate([[piece[0] > 0 or not open_piece], piece[1:] != piece[:-1]])
    flat = np.insert(words, np.flatnonzero(new), np.uint64(0))
    numbers, first = np.unique(words, return_index=True)
    after = np.append(np.flatnonzero(both[data]), len(data))
    begins = starts[first]
    return flat, numbers, begins, after[np.searchsorted(after, begins)], passed[-1] == piece[-1]


def numbered_runs(
    texts: list[bytes], langs: list[str], salt: int
) -> Iterator[tuple[np.ndarray, list[tuple[str, int, bytes]]]]:
    """For texts of about ``RUN_BYTES`` together: the numbers of their words with a 0 wherever
    a piece ends, and language, number and text of their distinct words."""
    first = 0
    while first < len(texts):
        stop, size = first, 0
        while stop < len(texts) and (size == 0 or size + len(texts[stop]) < RUN_BYTES):
            size += len(texts[stop]) + 1
            stop += 1
        run = texts[first:stop]
        # a text's first byte ends the piece before it, except in parts of one long text
        parts = list(_chunks(run[0])) if len(run) == 1 else [b"\n" + b"\n".join(run)]
        edges = np.cumsum([0] + [len(x) + 1 for x in run[:-1]])
        numbers = np.array([language_number(x, salt) for x in langs[first:stop]], dtype=np.uint64)
        found, named, goes_on = [], [], False
        for part in parts:
            data = np.frombuffer(part, dtype=np.uint8)
            flat, ids, begins, ends, goes_on = _words_of(data, numbers, edges, goes_on)
            found.append(flat)
            at = np.searchsorted(edges, begins, side="right") - 1
            lowered = part.lower()
            named += [
                (langs[first + k], i, lowered[a:b])
                for k, i, a, b in zip(at.tolist(), ids.tolist(), begins.tolist(), ends.tolist())
            ]
        yield np.concatenate([*found, np.zeros(1, np.uint64)]), named
        first = stop


def tokenized(docs: DataFrame, salt: int) -> DataFrame:
    """``words``: the numbers of many texts in a row, 0 between pieces; ``lang``, ``ids`` and
    ``names``: what words of one language the task has not named lately."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: set[int] = set()
        for batch in batches:
            langs = batch.column(0).to_pylist()
            for flat, named in numbered_runs([x or b"" for x in utf8(batch.column(1))], langs, salt):
                if len(known) > NAMED:
                    known.clear()
                fresh: dict[str, list[tuple[int, bytes]]] = {}
                for lang, number, name in named:
                    if number not in known:
                        fresh.setdefault(lang, []).append((number, name))
                known.update(number for _, number, _ in named)
                ids = [np.array([i for i, _ in own], dtype=np.uint64).view(np.int64) for own in fresh.values()]
                ends = np.cumsum([0, 0, *map(len, ids)])
                texts = [[]] + [[name.decode() for _, name in own] for own in fresh.values()]
                yield pa.RecordBatch.from_arrays(
                    [
                        lists(flat.view(np.int64), np.array([0] + [len(flat)] * len(texts)), pa.int64()),
                        pa.array([None, *fresh], type=pa.string()),
                        lists(np.concatenate([*ids, np.zeros(0, np.int64)]), ends, pa.int64()),
                        pa.array(texts, type=pa.list_(pa.string())),
                    ],
                    names=["words", "lang", "ids", "names"],
                )

    own = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), "text")
    return own.mapInArrow(rows, "words array<bigint>, lang string, ids array<bigint>, names array<string>")


def gram_keys(*words: np.ndarray) -> np.ndarray:
    key = mix(words[0])
    for word in words[1:]:
        key = mix(key + word * np.uint64(3))
    return key


class Marks:
    """A set of keys as a bitmap."""

    def __init__(self, words: np.ndarray):
        self.words = words
        self.shift = np.uint64(64 - (len(words) * 64).bit_length() + 1)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        spot = keys >> self.shift
        word = self.words[(spot >> np.uint64(6)).astype(np.int64)]
        return (word >> (spot & np.uint64(63))) & np.uint64(1) == 1


def _names(size: int) -> list[str]:
    return [f"w{i}" for i in range(1, size + 1)]


def marked(grams: DataFrame, size: int):
    """The n-grams of a written table (``w1`` to ``w<size>``) as a broadcast bitmap, whose
    size is bounded whatever their number."""
    spark = grams.sparkSession
    bits = min(max(1 << (16 * grams.count()).bit_length(), FEWEST_BITS), MOST_BITS)
    shift = np.uint64(64 - bits.bit_length() + 1)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = [c.to_numpy(zero_copy_only=False).view(np.uint64) for c in batch.columns]
            spot = np.unique(gram_keys(*words) >> shift)
            at, begins = np.unique(spot >> np.uint64(6), return_index=True)
            one = np.uint64(1) << (spot & np.uint64(63))
            own = np.bitwise_or.reduceat(one, begins) if len(at) else one
            yield pa.RecordBatch.from_arrays(
                [pa.array(at.astype(np.int32)), pa.array(own.view(np.int64))], names=["at", "own"]
            )

    every = grams.select(*_names(size)).mapInArrow(rows, "at int, own bigint")
    found = every.groupBy("at").agg(F.bit_or("own").alias("own")).toPandas()
    words = np.zeros(bits // 64, dtype=np.uint64)
    words[found["at"].to_numpy()] = found["own"].to_numpy().astype(np.int64).view(np.uint64)
    return spark.sparkContext.broadcast(words)


def counted(
    tokens: DataFrame, size: int, wanted: Callable[[list[np.ndarray], dict], np.ndarray], known: dict
) -> DataFrame:
    """Occurrences of all n-grams of ``size`` words inside pieces for which ``wanted`` holds:
    ``w1`` to ``w<size>`` and ``a``. ``known`` are broadcast bitmaps by name."""
    names = _names(size)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks = {name: Marks(b.value) for name, b in known.items()}
        held: list[list[np.ndarray]] = []
        kept = 0

        def out():
            words = [np.concatenate(x) for x in zip(*held, strict=True)]
            _, first, at, n = np.unique(
                gram_keys(*words), return_index=True, return_inverse=True, return_counts=True
            )
            if any((w[first][at] != w).any() for w in words):  # two n-grams have one key
                order = np.lexsort(words)
                words = [w[order] for w in words]
                new = np.concatenate([[True], np.any([w[1:] != w[:-1] for w in words], axis=0)])
                first = np.flatnonzero(new)
                n = np.diff(np.append(first, len(order)))
            columns = [pa.array(w[first].view(np.int64)) for w in words]
            return pa.RecordBatch.from_arrays([*columns, pa.array(n.astype(np.int64))], names=[*names, "a"])

        for batch in batches:
            flat = batch.column(0).flatten().to_numpy(zero_copy_only=False).view(np.uint64)
            for begin in range(0, len(flat), BUFFERED):
                # n-grams that begin in this part
                part = flat[begin : begin + BUFFERED + size - 1]
                places = len(part) - size + 1
                if places <= 0:
                    continue
                words = [part[k : k + places] for k in range(size)]
                inside = np.flatnonzero(np.all([w != 0 for w in words], axis=0))
                words = [w[inside] for w in words]
                ok = wanted(words, marks)
                held.append([w[ok] for w in words])
                kept += len(held[-1][0])
                if kept >= BUFFERED:
                    yield out()
                    held, kept = [], 0
        if kept:
            yield out()

    types = ", ".join(f"{c} bigint" for c in [*names, "a"])
    every = tokens.where("size(words) > 0").select("words").mapInArrow(rows, types)
    return every.groupBy(*names).agg(F.sum("a").alias("a"))


def score(a: str, left: str, right: str) -> Column:
    """``floor(SCALE * a / (left + right))``, exact."""
    return F.expr(
        f"cast((cast({SCALE} as decimal(7,0)) * cast({a} as decimal(19,0))) "
        f"div (cast({left} as decimal(19,0)) + cast({right} as decimal(19,0))) as bigint)"
    )


def contained(longer: str, a: str) -> Column:
    return F.expr(
        f"100 * cast({longer} as decimal(19,0)) >= {CONTAINED} * cast({a} as decimal(19,0))"
    )


@contextmanager
def _small_batches(spark: SparkSession) -> Iterator[None]:
    """All steps are written while this holds; the setting is as before afterwards."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, BATCH_BYTES)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def phrases(docs: DataFrame, top: int = TOP, least: int = LEAST, first_place: int = FIRST_PLACE) -> DataFrame:
    """The first ``top`` phrases of every language of ``docs`` (``lang``, ``text``): lang, rank,
    phrase, a, l, r, n, score."""
    with _small_batches(docs.sparkSession):
        return _mined(docs, top, least, first_place)


def _mined(docs: DataFrame, top: int, least: int, first_place: int) -> DataFrame:
    spark = docs.sparkSession
    folders: list[str] = []

    def keep(df: DataFrame, name: str) -> DataFrame:
        out, folder = written(df, f"phrases-{name}")
        folders.append(folder)
        return out

    def every(words, _):
        return np.ones(len(words[0]), dtype=bool)

    salt = 0
    while True:
        tokens = keep(tokenized(docs, salt), "tokens")
        named = tokens.where("lang is not null").select("lang", F.explode(F.arrays_zip("ids", "names")).alias("e"))
        names = keep(
            named.select(F.col("e.ids").alias("w1"), "lang", F.col("e.names").alias("word")).distinct(), "names"
        )
        if not names.groupBy("w1").count().where("count > 1").limit(1).count():
            break
        salt += 1

    counts = keep(counted(tokens, 1, every, {}).join(names, "w1"), "words")
    totals = counts.groupBy("lang").agg(F.sum("a").cast("long").alias("n"))
    words = keep(counts.where(F.col("a") >= least), "frequent")
    known = {"word": marked(words, 1)}

    # pairs, their scores and bounds
    one = words.select("w1", "lang", F.col("a").alias("f1"))
    two = words.select(F.col("w1").alias("w2"), F.col("a").alias("f2"))
    pairs = counted(
        tokens, 2, lambda w, m: m["word"](gram_keys(w[0])) & m["word"](gram_keys(w[1])), known
    ).where(F.col("a") >= least)
    pairs = keep(
        pairs.join(one, "w1")
        .join(two, "w2")
        .select("lang", "w1", "w2", "a", "f1", "f2", score("a", "f1", "f2").alias("score"))
        .withColumn("ahead", score("a", "f1", "a"))
        .withColumn("behind", score("a", "f2", "a")),
        "pairs",
    )
    known["pair"] = marked(pairs, 2)

    open_langs = keep(pairs.select("lang").distinct(), "languages")
    places, done = first_place, []
    while open_langs.limit(1).count():
        rank = F.row_number().over(W.partitionBy("lang").orderBy(F.col("score").desc(), "w1", "w2"))
        own = pairs.join(open_langs, "lang", "left_semi")
        at_place = own.withColumn("_rank", rank).where(F.col("_rank") <= places).groupBy("lang").agg(
            F.min("score").alias("lowest"), F.max("_rank").alias("rows")
        )
        floors = keep(
            at_place.select("lang", F.when(F.col("rows") >= places, F.col("lowest")).otherwise(0).alias("floor")),
            "floors",
        )
        own = keep(own.join(floors, "lang"), "frontier")
        found, survivors = _expanded(tokens, own, known, least, keep)
        reached = survivors.groupBy("lang").agg(F.count("*").alias("found"))
        settled = keep(
            floors.join(reached, "lang", "left").where((F.col("floor") == 0) | (F.col("found") >= top)).select("lang"),
            "settled",
        )
        done.append(survivors.join(settled, "lang", "left_semi"))
        open_langs = keep(open_langs.join(settled, "lang", "left_anti"), "languages")
        places *= WIDEN

    out = done[0] if done else _no_phrases(spark)
    for more in done[1:]:
        out = out.unionByName(more)
    text = words.select("w1", "word")
    for k in range(1, LONGEST + 1):
        out = out.join(text.withColumnsRenamed({"w1": f"w{k}", "word": f"t{k}"}), f"w{k}", "left")
    phrase = F.concat_ws(" ", *[f"t{k}" for k in range(1, LONGEST + 1)])
    order = W.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), "phrase")
    ranked = (
        out.select("lang", phrase.alias("phrase"), "a", "l", "r", "score")
        .withColumn("rank", F.row_number().over(order).cast("long"))
        .where(F.col("rank") <= top)
        .join(totals, "lang")
        .select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
    )
    result, _ = written(ranked, "phrases")
    for folder in folders:
        drop_folder(spark, folder)
    return result


FOUND = "lang string, w1 bigint, w2 bigint, w3 bigint, w4 bigint, a bigint, l bigint, r bigint, score bigint"


def _no_phrases(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], FOUND)


def _expanded(
    tokens: DataFrame, own: DataFrame, known: dict, least: int, keep: Callable[[DataFrame, str], DataFrame]
) -> tuple[DataFrame, DataFrame]:
    """All phrases that score ``floor`` or more, by expanding the nodes whose bound reaches it;
    then those of them that no longer phrase holds."""
    ahead = keep(own.where("ahead >= floor").select("w1", "w2"), "ahead")
    behind = keep(own.where("behind >= floor").select("w1", "w2"), "behind")
    marks = {"pair": known["pair"], "ahead": marked(ahead, 2), "behind": marked(behind, 2)}

    def wanted(w, m):
        x, y = gram_keys(w[0], w[1]), gram_keys(w[1], w[2])
        ok = m["pair"](x) & m["pair"](y)
        return ok & (m["ahead"](x) | m["behind"](y))

    triples = counted(tokens, 3, wanted, marks).where(F.col("a") >= least)
    front = own.select("w1", "w2", "lang", "floor", "f1", F.col("a").alias("f12"))
    back = own.select(F.col("w1").alias("w2"), F.col("w2").alias("w3"), F.col("a").alias("f23"), F.col("f2").alias("f3"))
    triples = triples.join(front, ["w1", "w2"]).join(back, ["w2", "w3"])
    triples = keep(
        triples.withColumns({"s1": score("a", "f1", "f23"), "s2": score("a", "f12", "f3")})
        .withColumn("score", F.least("s1", "s2"))
        .withColumns(
            {
                "l": F.when(F.col("s1") <= F.col("s2"), F.col("f1")).otherwise(F.col("f12")),
                "r": F.when(F.col("s1") <= F.col("s2"), F.col("f23")).otherwise(F.col("f3")),
                "ahead": F.least(score("a", "f1", "a"), score("a", "f12", "a")),
                "behind": F.least(score("a", "f3", "a"), score("a", "f23", "a")),
            }
        )
        .drop("s1", "s2"),
        "triples",
    )
    three = ["w1", "w2", "w3"]
    marks = {
        "pair": known["pair"],
        "ahead": marked(keep(triples.where("ahead >= floor").select(*three), "ahead"), 3),
        "behind": marked(keep(triples.where("behind >= floor").select(*three), "behind"), 3),
    }

    def wanted_four(w, m):
        ok = m["pair"](gram_keys(w[0], w[1])) & m["pair"](gram_keys(w[1], w[2])) & m["pair"](gram_keys(w[2], w[3]))
        return ok & (m["ahead"](gram_keys(*w[:3])) | m["behind"](gram_keys(*w[1:])))

    fours = keep(counted(tokens, 4, wanted_four, marks).where(F.col("a") >= least), "fours")
    front = triples.select(*three, "lang", "floor", "f1", "f12", F.col("a").alias("f123"))
    back = triples.select(
        F.col("w1").alias("w2"), F.col("w2").alias("w3"), F.col("w3").alias("w4"),
        F.col("a").alias("f234"), F.col("f23").alias("f34"), F.col("f3").alias("f4"),
    )
    cuts = [("f1", "f234"), ("f12", "f34"), ("f123", "f4")]
    scored = fours.join(front, three).join(back, ["w2", "w3", "w4"])
    scored = scored.withColumns({f"s{k}": score("a", *cut) for k, cut in enumerate(cuts)})
    worst = F.least("s0", "s1", "s2")
    chosen = [
        F.when(F.col("s0") == worst, F.col(cuts[0][side]))
        .when(F.col("s1") == worst, F.col(cuts[1][side]))
        .otherwise(F.col(cuts[2][side]))
        for side in (0, 1)
    ]
    scored = scored.withColumns({"score": worst, "l": chosen[0], "r": chosen[1]})

    none = F.lit(None).cast("long")
    columns = ["lang", "w1", "w2", "w3", "w4", "a", "l", "r", "score"]
    best = F.col("score") >= F.col("floor")
    in_triples = triples.select("w1", "w2", "a").union(triples.select("w2", "w3", "a"))
    in_fours = fours.select(*three, "a").union(fours.select("w2", "w3", "w4", "a"))
    longer2 = in_triples.groupBy("w1", "w2").agg(F.max("a").alias("longer"))
    longer3 = in_fours.groupBy(*three).agg(F.max("a").alias("longer"))
    free = F.col("longer").isNull() | ~contained("longer", "a")
    twos = own.where(best).withColumns({"w3": none, "w4": none, "l": F.col("f1"), "r": F.col("f2")})
    threes = triples.where(best).withColumn("w4", none)
    survivors = (
        twos.join(longer2, ["w1", "w2"], "left").where(free).select(*columns)
        .unionByName(threes.join(longer3, three, "left").where(free).select(*columns))
        .unionByName(scored.where(best).select(*columns))
    )
    return scored, keep(survivors, "survivors")


def op13_phrase_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best phrases of every language of the documents."""
    return phrases(table(spark, sf_dir, "documents"))


OP13_SQL = """
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[.,;:!?\\x0A-\\x0D]')) AS piece
  FROM documents),
words AS (
  SELECT lang, list_filter(regexp_split_to_array(piece, '[\\x20\\x09]+'), lambda x: x <> '') AS w FROM pieces),
starts AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM words WHERE len(w) > 0),
grams AS (
  SELECT lang, size, array_to_string(w[i : i + size - 1], ' ') AS g, count(*) AS a
  FROM (SELECT lang, w, i, unnest(range(1, least(4, len(w) - i + 1) + 1)) AS size FROM starts)
  GROUP BY ALL),
totals AS (SELECT lang, CAST(sum(a) AS BIGINT) AS n FROM grams WHERE size = 1 GROUP BY lang),
frequent AS MATERIALIZED (SELECT lang, size, g, string_split(g, ' ') AS w, a FROM grams WHERE a >= 30),
cuts AS (
  SELECT lang, g, a, k, array_to_string(w[1 : k], ' ') AS first, array_to_string(w[k + 1 : size], ' ') AS rest
  FROM (SELECT *, unnest(range(1, size)) AS k FROM frequent WHERE size > 1)),
scored AS (
  SELECT c.lang, c.g, c.a, x.a AS l, y.a AS r,
    CAST((CAST(2000000 AS HUGEINT) * c.a) // (x.a + y.a) AS BIGINT) AS score
  FROM cuts c
  JOIN frequent x ON x.lang = c.lang AND x.g = c.first
  JOIN frequent y ON y.lang = c.lang AND y.g = c.rest
  QUALIFY row_number() OVER (PARTITION BY c.lang, c.g ORDER BY score, k) = 1),
parts AS (
  SELECT lang, a, array_to_string(w[i : i + len - 1], ' ') AS g
  FROM (SELECT *, unnest(range(1, size - len + 2)) AS i
    FROM (SELECT *, unnest(range(2, size)) AS len FROM frequent WHERE size > 2))),
held AS (SELECT lang, g, max(a) AS longer FROM parts GROUP BY ALL)
SELECT * FROM (
  SELECT s.lang, row_number() OVER (
      PARTITION BY s.lang ORDER BY s.score DESC, s.a DESC, s.g) AS rank,
    s.g AS phrase, s.a, s.l, s.r, t.n, s.score
  FROM scored s JOIN totals t ON t.lang = s.lang
  LEFT JOIN held h ON h.lang = s.lang AND h.g = s.g
  WHERE h.longer IS NULL OR 100 * CAST(h.longer AS HUGEINT) < 80 * CAST(s.a AS HUGEINT))
WHERE rank <= 2000
"""
