"""Licence scan by diagonal voting.

All hashes of ``GRAM`` consecutive words of a text are joined, in Spark, to the places where
the templates have them. A pair of places is a vote for a diagonal, the distance between
the two; votes are counted by document, template and diagonal. Diagonals of one template that
lie near each other, at places near each other, merge: what was put in or left out of a
notice moves the rest of it to a neighbouring diagonal. A merged group is a span of the text,
and is verified word by word: its coverage is the longest common subsequence of the span and
the template, divided by the template's words. A span of at least ``COVERED`` gives the
template's label; of templates that overlap in a text, the one with the best coverage counts
(the longer one on ties), so that a notice is not also labelled as its near relatives.

Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` with A-Z in lower case, from whole texts. The
places of the fixed phrases are counted apart, by their words; their labels always stay.
``score`` is 1 where a phrase stands, else the best coverage of any span of the text, verified
or not, and 0 without one.

Null texts are empty. Rows with the same ``doc_id`` and text get the same result each; a null
``doc_id`` is returned as it is. Texts of any length are read whole; an empty table gives an
empty result. Other columns of the input are not read. The templates are fixed, so what is
broadcast of them does not grow.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyspark.sql.functions as F
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W

from .common import drop_folder, maybe_in, table, written
from .license_texts import PHRASES, TEMPLATES
from .words import lists, mix, utf8, word_hashes

GRAM = 3
COVERED = 0.7
# Diagonals merge that differ by at most so much, with places at most so far apart.
NEIGHBOURS = 8
NEAR = 40


def gram_hashes(words: np.ndarray) -> np.ndarray:
    """The rolling hashes of ``GRAM`` consecutive words."""
    count = max(len(words) - GRAM + 1, 0)
    key = np.zeros(count, dtype=np.uint64)
    for k in range(GRAM):
        key = mix(key + words[k : k + count])
    return key


def _hashed(text: str) -> np.ndarray:
    _, _, (words,), _ = next(word_hashes([text.encode()], punctuation=True))
    return words


@cache
def templates() -> tuple[tuple[str, np.ndarray], ...]:
    return tuple((label, _hashed(text)) for label, text in TEMPLATES)


@cache
def phrase_words() -> tuple[tuple[str, np.ndarray], ...]:
    return tuple((label, _hashed(phrase)) for phrase, label in PHRASES.items())


def template_places(spark: SparkSession) -> DataFrame:
    """``gram``, ``template`` and ``place`` of every gram of every template."""
    rows = [
        (int(gram), number, place)
        for number, (_, words) in enumerate(templates())
        for place, gram in enumerate(gram_hashes(words).view(np.int64))
    ]
    return spark.createDataFrame(rows, "gram bigint, template int, place int")


def text_key(text: str = "text") -> F.Column:
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")))


def grams(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``key`` (of the text) and ``grams``, all rolling hashes of the text."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, stop, (words,), offsets in word_hashes(utf8(batch.column(2)), punctuation=True):
                own = [gram_hashes(words[a:b]) for a, b in zip(offsets, offsets[1:])]
                ends = np.cumsum([0] + [len(g) for g in own])
                flat = np.concatenate([*own, np.zeros(0, np.uint64)]).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(first, stop - first),
                        batch.column(1).slice(first, stop - first),
                        lists(flat, ends, pa.int64()),
                    ],
                    names=["doc_id", "key", "grams"],
                )

    return docs.select("doc_id", text_key().alias("key"), "text").mapInArrow(
        rows, "doc_id bigint, key bigint, grams array<bigint>"
    )


SPAN = "struct<template:int,first:bigint,last:bigint>"


def spans(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``key`` and ``spans``: the merged diagonals of every text that has votes, as
    template, first and last word of the span in the text."""
    places = F.broadcast(template_places(docs.sparkSession))  # a few hundred rows, fixed
    votes = (
        grams(docs)
        .select("doc_id", "key", F.posexplode("grams").alias("at", "gram"))
        .join(places, "gram")
        .withColumn("diagonal", F.col("at") - F.col("place"))
    )
    diagonals = votes.groupBy("doc_id", "key", "template", "diagonal", F.floor(F.col("at") / NEAR)).agg(
        F.min("at").alias("low"), F.max("at").alias("high"), F.count("*").alias("votes")
    )
    # neighbouring diagonals, in the order of places: a chain ends where the next votes are far
    # away in the text or on another diagonal
    own = W.partitionBy("doc_id", "key", "template").orderBy("low", "high", "diagonal")
    before = F.lag("high").over(own)
    apart = (F.col("low") - before > NEAR) | (
        F.abs(F.col("diagonal") - F.lag("diagonal").over(own)) > NEIGHBOURS
    )
    chains = diagonals.withColumn("new", F.coalesce(apart, F.lit(True)).cast("int")).withColumn(
        "chain", F.sum("new").over(own)
    )
    merged = chains.groupBy("doc_id", "key", "template", "chain").agg(
        F.min("low").alias("low"), F.max("high").alias("high"), F.min("diagonal").alias("least")
    )
    size = F.array(*[F.lit(len(words)) for _, words in templates()])
    # the template may begin before the first vote and end after the last
    first = F.greatest(F.least("least", "low") - NEIGHBOURS, F.lit(0))
    last = F.greatest(F.col("high") + GRAM, F.col("low") + F.get(size, F.col("template"))) + NEIGHBOURS
    one = F.struct("template", first.cast("long").alias("first"), last.cast("long").alias("last"))
    return merged.groupBy("doc_id", "key").agg(F.collect_list(one.cast(SPAN)).alias("spans"))


def common_length(a: np.ndarray, b: np.ndarray) -> tuple[int, int, int]:
    """The length of the longest common subsequence, and the first and last place of it in
    ``a``."""
    row = [(0, -1, -1)] * (len(b) + 1)
    for i, x in enumerate(a):
        corner = row[0]
        for j, y in enumerate(b, 1):
            above = row[j]
            if x == y:
                length, begin, _ = corner
                row[j] = max(above, row[j - 1], (length + 1, begin if length else i, i), key=_longest)
            elif _longest(row[j - 1]) > _longest(above):
                row[j] = row[j - 1]
            corner = above
    return row[-1]


def _longest(found: tuple[int, int, int]) -> tuple[int, int]:
    """Longer first, then the narrower one."""
    length, begin, end = found
    return length, begin - end


def verified(words: np.ndarray, found: list[dict]) -> tuple[set[str], float]:
    """The labels of a text's spans that hold, and the best coverage."""
    held, best = [], 0.0
    for span in found:
        label, template = templates()[span["template"]]
        part = words[span["first"] : span["last"]]
        part_at = np.flatnonzero(np.isin(part, template))
        length, begin, end = common_length(part[part_at], template)
        if not length:
            continue
        coverage = length / len(template)
        best = max(best, coverage)
        if coverage >= COVERED:
            places = span["first"] + part_at
            held.append((coverage, len(template), places[begin], places[end], label))
    taken: list[tuple[int, int]] = []
    labels = set()
    for _, _, begin, end, label in sorted(held, key=lambda h: (-h[0], -h[1], h[2], h[4])):
        if all(end < a or b < begin for a, b in taken):
            taken.append((begin, end))
            labels.add(label)
    return labels, best


def phrase_places(words: np.ndarray) -> list[tuple[str, np.ndarray]]:
    out = []
    for label, phrase in phrase_words():
        count = max(len(words) - len(phrase) + 1, 0)
        ok = np.ones(count, dtype=bool)
        for k, word in enumerate(phrase):
            ok &= words[k : k + count] == word
        out.append((label, np.flatnonzero(ok)))
    return out


RESULT = (
    "doc_id bigint, n_words bigint, n_base bigint, first_word bigint, last_word bigint, "
    "base_labels string, labels string, score double"
)


def _report(docs: DataFrame) -> DataFrame:
    """The result of every row of ``doc_id``, ``text``, ``spans``."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = batch.column(2).to_pylist()
            out: list[list] = [[] for _ in range(7)]
            for first, stop, (words,), offsets in word_hashes(utf8(batch.column(1)), punctuation=True):
                for own, a, b in zip(found[first:stop], offsets, offsets[1:]):
                    text = words[a:b]
                    places = phrase_places(text)
                    base = {label for label, at in places if len(at)}
                    every = np.concatenate([at for _, at in places])
                    more, best = verified(text, own) if own else (set(), 0.0)
                    values = (
                        len(text),
                        len(every),
                        int(every.min()) if len(every) else None,
                        int(every.max()) if len(every) else None,
                        ",".join(sorted(base)),
                        ",".join(sorted(base | more)),
                        1.0 if base else best,
                    )
                    for column, value in zip(out, values, strict=True):
                        column.append(value)
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]
            names = [f.split()[0] for f in RESULT.split(", ")]
            columns = [pa.array(x, type=kind) for x, kind in zip(out, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=names)

    return docs.select("doc_id", "text", "spans").mapInArrow(rows, RESULT)


def scan_licenses(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs`` (``doc_id``, ``text``): n_words, n_base, first_word,
    last_word, base_labels, labels, score."""
    spark = docs.sparkSession
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found, folder = written(spans(own), "license-spans")
    keyed = own.withColumn("_key", text_key())
    # only texts that may have spans are shuffled
    may = F.coalesce(maybe_in(found, "key")(F.col("_key")), F.lit(False))
    spotted = found.select(F.col("doc_id").alias("_doc"), F.col("key").alias("_own"), "spans")
    none = F.lit(None).cast(f"array<{SPAN}>")
    with_spans = keyed.where(may).join(
        spotted, F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("_key") == F.col("_own")), "left"
    )
    every = keyed.where(~may).select("doc_id", "text", none.alias("spans")).unionByName(
        with_spans.select("doc_id", "text", "spans")
    )
    done, _ = written(_report(every), "licenses")
    drop_folder(spark, folder)
    return done


def op12_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The licences of every document."""
    return scan_licenses(table(spark, sf_dir, "documents"))
