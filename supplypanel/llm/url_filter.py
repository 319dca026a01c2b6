"""URL filters: rules by host and path, and a logistic regression on hashed character
n-grams of host and path for what no rule decides.

Host: what follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower
case. Path: what follows the host up to ``?``, ``#`` or the end. A url that is null or has
no ``://`` has an empty host and path; the classifier then sees no n-gram and allows.

A rule fits its host and all hosts below it, if the path starts with the rule's path. Of
the rules that fit, the longest (host and path) wins.

Repeated rows are judged each; a null id stays null; an empty table gives an empty table;
other columns of the input are not read.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import cache

import numpy as np
import pyarrow as pa
import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame, SparkSession

from .common import table
from .url_examples import ALLOWED, BLOCKED
from .words import PIECE_BYTES, mix, utf8

Rule = tuple[str, str, str]  # verdict, host, path

# The rules of the registered query.
RULES: tuple[Rule, ...] = (
    ("block", "net", "/"),
    ("allow", "example.net", "/en/"),
    ("block", "example.com", "/de/"),
    ("allow", "org", "/fr/"),
)

BUCKETS = 1 << 15
SIZES = (3, 4, 5)
ROUNDS = 1500
RATE = 4.0
DECAY = 2e-5

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def host_and_path(url: Column) -> tuple[Column, Column]:
    begin = F.locate("://", url)
    rest = F.when(begin > 0, F.substr(url, begin + 3)).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), _UPPER, _UPPER.lower())
    return host, F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def rule_for(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """The rule that wins, as a struct of its name and verdict; null if none fits."""
    out = F.lit(None)
    for verdict, own, prefix in sorted(rules, key=lambda r: len(r[1]) + len(r[2])):
        fits = ((host == own) | F.endswith(host, F.lit(f".{own}"))) & F.startswith(path, F.lit(prefix))
        chosen = F.struct(F.lit(own + prefix).alias("rule"), F.lit(verdict).alias("verdict"))
        out = F.when(fits, chosen).otherwise(out)
    return out


@cache
def _steps() -> np.ndarray:
    return mix(np.arange(1, max(SIZES) + 1, dtype=np.uint64)) | np.uint64(1)


def features(hosts: list[bytes], paths: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the n-grams of every url, and where each url's begin. Host and path are
    framed by marks that neither holds as bytes, so that n-grams know where they are."""
    framed = [b"\x01" + h + b"\x02" + p + b"\x03" if h or p else b"" for h, p in zip(hosts, paths)]
    data = np.frombuffer(b"".join(framed), dtype=np.uint8).astype(np.uint64) + np.uint64(1)
    edges = np.cumsum([0] + [len(x) for x in framed])
    url = np.repeat(np.arange(len(framed)), np.diff(edges))
    buckets, owners = [], []
    for n in SIZES:
        if len(data) < n:
            continue
        whole = url[: len(url) - n + 1] == url[n - 1 :]
        total = np.full(len(data) - n + 1, n, dtype=np.uint64)
        for k in range(n):
            total += mix(data[k : len(data) - n + 1 + k]) * _steps()[k]
        buckets.append((mix(total) % np.uint64(BUCKETS))[whole].astype(np.int64))
        owners.append(url[: len(url) - n + 1][whole])
    if not buckets:
        return np.zeros(0, np.int64), np.zeros(len(framed) + 1, np.int64)
    bucket, owner = np.concatenate(buckets), np.concatenate(owners)
    order = np.argsort(owner, kind="stable")
    return bucket[order], np.searchsorted(owner[order], np.arange(len(framed) + 1))


def _sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    totals = np.concatenate([[0.0], np.cumsum(values)])
    return totals[offsets[1:]] - totals[offsets[:-1]]


def train(urls: Sequence[tuple[str, str]], labels: Sequence[int]) -> tuple[np.ndarray, float]:
    """Weights of the buckets and the constant, by gradient descent from zero."""
    bucket, offsets = features([h.encode() for h, _ in urls], [p.encode() for _, p in urls])
    size = np.maximum(np.diff(offsets), 1)
    row = np.repeat(np.arange(len(urls)), np.diff(offsets))
    value = 1 / np.sqrt(size[row])
    truth = np.array(labels, dtype=float)
    share = np.where(truth == 1, 0.5 / max(truth.sum(), 1), 0.5 / max((1 - truth).sum(), 1))
    weights, constant = np.zeros(BUCKETS), 0.0
    for _ in range(ROUNDS):
        score = _sums(weights[bucket] * value, offsets) + constant
        error = (1 / (1 + np.exp(-score)) - truth) * share
        step = np.bincount(bucket, weights=error[row] * value, minlength=BUCKETS)
        weights -= RATE * (step + DECAY * weights)
        constant -= RATE * 0.1 * error.sum()
    return weights, constant


def _parts(url: str) -> tuple[str, str]:
    host, _, path = url.partition("/")
    return host, "/" + path


@cache
def default_model() -> tuple[np.ndarray, float]:
    urls = [_parts(u) for u in (*ALLOWED, *BLOCKED)]
    return train(urls, [0] * len(ALLOWED) + [1] * len(BLOCKED))


def scores(hosts: list[bytes], paths: list[bytes], model: tuple[np.ndarray, float]) -> np.ndarray:
    weights, constant = model
    out = []
    first = 0
    while first < len(hosts):  # in pieces, so that memory stays bounded
        stop, size = first, 0
        while stop < len(hosts) and (stop == first or size < PIECE_BYTES):
            size += len(hosts[stop]) + len(paths[stop])
            stop += 1
        bucket, offsets = features(hosts[first:stop], paths[first:stop])
        sums = _sums(weights[bucket], offsets) / np.sqrt(np.maximum(np.diff(offsets), 1))
        blank = np.diff(offsets) == 0
        out.append(np.where(blank, 0.0, 1 / (1 + np.exp(-sums - constant))))
        first = stop
    return np.concatenate(out) if out else np.zeros(0)


def judge(
    pages: DataFrame, key: str, rules: Sequence[Rule], model: tuple[np.ndarray, float]
) -> DataFrame:
    """``key``, ``host``, ``path``, ``rule``, ``verdict`` and the classifier's ``score``
    (0 to 1, higher: rather block) of every row's ``url``."""
    host, path = host_and_path(F.col("url"))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = scores(utf8(batch.column(1)), utf8(batch.column(2)), model)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(found, type=pa.float64())], names=["k", "h", "p", "score"]
            )

    kind = pages.schema[key].dataType.simpleString()
    scored = pages.select(F.col(key).alias("k"), host.alias("h"), path.alias("p")).mapInArrow(
        score, f"k {kind}, h string, p string, score double"
    )
    rule = rule_for(F.col("h"), F.col("p"), rules)
    by_score = F.when(F.col("score") >= 0.5, "block").otherwise("allow")
    return scored.withColumn("r", rule).select(
        F.col("k").alias(key),
        F.col("h").alias("host"),
        F.col("p").alias("path"),
        "r.rule",
        F.coalesce("r.verdict", by_score).alias("verdict"),
        "score",
    )


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict on the url of every page."""
    return judge(table(spark, sf_dir, "pages"), "page_id", RULES, default_model())
