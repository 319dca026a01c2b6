"""HTML extraction by wrappers.

The pages of a host are aligned into one wrapper, a union-free regular expression of its
template (see ``wrappers``): each task folds the pages it reads into one wrapper per host,
these are merged per host, and every page is then read through its host's wrapper, which
tells the article's texts from those of the template. So no task holds a host's pages.
Pages of the same html are one page of the wrapper, as copies do not make a template.

The text of a page is the article without menus, headers of the page, footers, sidebars,
notices, adverts, forms, scripts, styles and reader comments; character references are
decoded, white space inside a block is one space, blocks are joined by a line break.

A null html gives an empty text. A url that is null or has no ``://`` belongs to the host
without a name. Very long pages are read whole. Repeated rows are extracted each; an empty
table gives an empty table; other columns of the input are not read.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import pyspark.sql.functions as F
from pyspark.sql import DataFrame, SparkSession

from .common import maybe_in, table, written
from .url_filter import host_and_path
from .wrappers import blocks, merge, page_tree, page_wrapper

# Wrappers that a task holds before it gives them out.
HELD_HOSTS = 2_000

WRAPPERS = "host string, wrapper string"


def _wrapper_rows(found: dict[str, list]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [
            pa.array(list(found), type=pa.string()),
            pa.array([json.dumps(w, separators=(",", ":")) for w in found.values()], type=pa.string()),
        ],
        names=["host", "wrapper"],
    )


def different_pages(pages: DataFrame) -> DataFrame:
    """``host`` and ``html`` of the pages, copies once. Only html that may be of copies is
    shuffled."""
    named = pages.select("host", "html", F.xxhash64("host", "html").alias("_copy"))
    copied, _ = written(
        named.groupBy("_copy").count().where("count > 1").select("_copy"), "copied-pages"
    )
    may = maybe_in(copied, "_copy")(F.col("_copy"))
    once = named.where(may).groupBy("_copy").agg(F.first("host").alias("host"), F.first("html").alias("html"))
    return named.where(~may).select("host", "html").union(once.select("host", "html"))


def infer_wrappers(pages: DataFrame) -> DataFrame:
    """``host`` and ``wrapper`` (JSON) of the different pages (``host``, ``html``)."""

    def of_pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {}
        for batch in batches:
            for host, html in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own = page_wrapper(page_tree(html or ""))
                held[host] = merge(held[host], own) if host in held else own
                if len(held) > HELD_HOSTS:
                    yield _wrapper_rows(held)
                    held = {}
        yield _wrapper_rows(held)

    def of_wrappers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        host, own = None, None
        for batch in batches:
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if name == host:
                    own = merge(own, json.loads(text))
                else:
                    if host is not None:
                        yield _wrapper_rows({host: own})
                    host, own = name, json.loads(text)
        if host is not None:
            yield _wrapper_rows({host: own})

    return (
        different_pages(pages)
        .mapInArrow(of_pages, WRAPPERS)
        .repartition(F.col("host"))
        .sortWithinPartitions("host", "wrapper")
        .mapInArrow(of_wrappers, WRAPPERS)
    )


@lru_cache(maxsize=500)
def _loaded(text: str) -> list:
    return json.loads(text)


def extract(pages: DataFrame, key: str) -> DataFrame:
    """``key``, ``url``, ``text`` and ``n_chars`` of every page (``url``, ``html``)."""
    host, _ = host_and_path(F.col("url"))
    rows = pages.select(F.col(key).alias("key"), "url", "html", host.alias("host"))
    wrappers = infer_wrappers(rows).withColumnRenamed("host", "own_host")
    joined = rows.join(wrappers, F.col("host") == F.col("own_host"), "left")
    kind = pages.schema[key].dataType.simpleString()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [
                "\n".join(blocks(page_tree(html), _loaded(wrapper))) if html else ""
                for html, wrapper in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())
            ]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(1),
                    pa.array(texts, type=pa.string()),
                    pa.array([len(t) for t in texts], type=pa.int64()),
                ],
                names=["key", "url", "text", "n_chars"],
            )

    return (
        joined.select("key", "url", "html", "wrapper")
        .mapInArrow(read, f"key {kind}, url string, text string, n_chars bigint")
        .withColumnRenamed("key", key)
    )


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return extract(table(spark, sf_dir, "pages"), "page_id")
