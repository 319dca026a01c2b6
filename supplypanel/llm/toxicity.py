"""Toxicity: a convolutional text classifier, trained in numpy.

Words (runs of letters, digits and non-ASCII characters, A-Z in lower case) and their first
4 and 5 bytes are hashed to rows of an embedding table; a word's vector is the sum of the
three. Filters over 1, 2 and 3 words run over the whole text, the highest response of each
is kept (max pooling), and a logistic output weighs these. Embeddings start from the class
counts of their words and are trained with everything else.

The threshold is calibrated by language on rows kept out of the training, and subtracted
from the output, so that a score of 0.5 is the threshold. Language here is what the text
itself shows by its function words; the columns ``lang``, ``source`` and ``doc_id`` and the
labels are no input of a score.

Training takes at most ``MOST_TOXIC`` and ``MOST_CLEAN`` labelled rows, those with the
lowest hashes of their ids, and never rows whose crc32 of the id, as text, is divisible by
``HELD_OUT``. Every row is scored, over its whole text. A null or empty text gets the score
of no words at all. Labels that are null or name no document are not used; without any
label of one of the classes, all scores are the share of toxic labels (0 if there are no
labels). Repeated rows are scored each; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame, SparkSession

from .common import table
from .words import utf8, word_hashes

HELD_OUT = 5
MOST_TOXIC = 1200
MOST_CLEAN = 2400
BUCKETS = 1 << 15
PREFIXES = (4, 5)
DIMENSIONS = 12
WIDTHS = (1, 2, 3)
FILTERS = 8
EPOCHS = 14
BATCH = 32
RATE = 0.01
# Rows per language that a threshold of its own needs, of each class.
LEAST_FOR_LANGUAGE = 5

# Frequent function words that tell languages apart.
FUNCTION_WORDS = {
    "en": "the and of to is with that this for was are in by it from".split(),
    "fr": "le les et des que un une pour dans qui du est pas avec au sur".split(),
    "de": "der die und das von mit zu ist ein den nicht sich auf im auch".split(),
    "es": "el los las y por para con como una su lo al más pero sus".split(),
}
LANGUAGES = ("other", *FUNCTION_WORDS)


def _columns() -> list[slice]:
    """Where the filters of each width and offset are in the projection."""
    slices, at = [], 0
    for width in WIDTHS:
        for _ in range(width):
            slices.append(slice(at, at + FILTERS))
            at += FILTERS
    return slices


@dataclass
class Model:
    embedding: np.ndarray  # buckets x dimensions
    filters: np.ndarray  # dimensions x (width, offset, filter)
    bias: np.ndarray  # width x filter
    output: np.ndarray  # width x filter
    constant: float
    thresholds: np.ndarray = field(default_factory=lambda: np.zeros(len(LANGUAGES)))
    flat: float | None = None  # the score of every row, where nothing can be trained

    def projection(self) -> np.ndarray:
        return (self.embedding @ self.filters).astype(np.float32)


def _language_of_bucket() -> np.ndarray:
    out = np.zeros(BUCKETS, dtype=np.int8)
    for code, words in enumerate(FUNCTION_WORDS.values(), start=1):
        _, _, (hashes,), _ = next(word_hashes([" ".join(words).encode()], True))
        out[(hashes % np.uint64(BUCKETS)).astype(np.int64)] = code
    return out


def _buckets(arrays: Sequence[np.ndarray]) -> np.ndarray:
    """Embedding rows of each word: its own and those of its prefixes."""
    return np.stack([(a % np.uint64(BUCKETS)).astype(np.int32) for a in arrays], axis=1)


PADS = max(WIDTHS) - 1


def _spread(offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows for the words of a run of texts with padding behind each: where words go, where
    padding is, where texts begin."""
    begins = offsets[:-1] + PADS * np.arange(len(offsets) - 1)
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    places = np.arange(offsets[-1] - offsets[0]) + PADS * text
    ends = offsets[1:] + PADS * np.arange(len(offsets) - 1)
    return places, (ends[:, None] + np.arange(PADS)).ravel(), begins


def _responses(rows: np.ndarray, bias: np.ndarray) -> list[np.ndarray]:
    """The filters of each width at every word; ``rows`` are projections with padding."""
    out, slices, at = [], _columns(), 0
    for w, width in enumerate(WIDTHS):
        total = rows[:, slices[at]] + bias[w]
        for k in range(1, width):
            total[: len(total) - k] += rows[k:, slices[at + k]]
        out.append(total)
        at += width
    return out


def logits(
    model: Model, projection: np.ndarray, buckets: np.ndarray, offsets: np.ndarray
) -> np.ndarray:
    """The output for every text of a run."""
    places, pads, begins = _spread(offsets)
    rows = np.zeros((len(places) + len(pads), projection.shape[1]), dtype=np.float32)
    total = projection[buckets[:, 0]]
    for k in range(1, buckets.shape[1]):
        total += projection[buckets[:, k]]
    rows[places] = total
    empty = np.diff(offsets) == 0
    out = np.full(len(begins), model.constant)
    for w, found in enumerate(_responses(rows, model.bias.astype(np.float32))):
        found[pads] = -np.inf
        best = np.maximum.reduceat(found, begins, axis=0)
        best[empty] = model.bias[w]
        out += np.maximum(best, 0).astype(np.float64) @ model.output[w]
    return out


def languages(words: np.ndarray, offsets: np.ndarray, of_bucket: np.ndarray) -> np.ndarray:
    """The code of the language whose function words each text of a run has most of."""
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    code = of_bucket[words]
    hits = np.bincount(text * len(LANGUAGES) + code, minlength=(len(offsets) - 1) * len(LANGUAGES))
    hits = hits.reshape(-1, len(LANGUAGES))
    hits[:, 0] = 0
    return np.argmax(hits, axis=1)


def _start(rows: list[np.ndarray], truth: np.ndarray, random: np.random.Generator) -> Model:
    seen = np.zeros((2, BUCKETS))
    for own, label in zip(rows, truth, strict=True):
        seen[int(label), np.unique(own)] += 1
    model = Model(
        embedding=random.normal(0, 0.05, (BUCKETS, DIMENSIONS)),
        filters=random.normal(0, 0.3, (DIMENSIONS, FILTERS * sum(WIDTHS))),
        bias=np.full((len(WIDTHS), FILTERS), -0.2),
        output=random.normal(0, 0.2, (len(WIDTHS), FILTERS)),
        constant=-1.0,
    )
    # dimension 0 begins as the class balance of the words, the first filter reads it
    model.embedding[:, 0] = np.log((1 + seen[1]) / (1 + seen[0])) * 0.5
    model.filters[:, 0] = np.eye(DIMENSIONS)[0]
    model.bias[0, 0], model.output[0, 0] = -1.0, 1.0
    return model


class _Adam:
    def __init__(self, shape: tuple[int, ...]):
        self.m, self.v, self.t = np.zeros(shape), np.zeros(shape), 0

    def step(self, value: np.ndarray, grad: np.ndarray) -> None:
        self.t += 1
        self.m += 0.1 * (grad - self.m)
        self.v += 0.01 * (grad * grad - self.v)
        scale = RATE * np.sqrt(1 - 0.99**self.t) / (1 - 0.9**self.t)
        value -= scale * self.m / (np.sqrt(self.v) + 1e-7)


def train(rows: list[np.ndarray], truth: np.ndarray) -> Model:
    """Fit the model to texts given as embedding rows of their words."""
    random = np.random.default_rng(7)
    model = _start(rows, truth, random)
    # texts without words teach nothing
    usable = [i for i in range(len(rows)) if len(rows[i])]
    adams = {
        name: _Adam(np.shape(getattr(model, name))) for name in ("embedding", "filters", "bias", "output")
    }
    slices = _columns()
    for _ in range(EPOCHS):
        order = random.permutation(usable)
        for at in range(0, len(order), BATCH):
            chosen = order[at : at + BATCH]
            grads = {name: np.zeros_like(getattr(model, name)) for name in adams}
            step = 0.0
            for i in chosen:
                own = rows[i]
                vectors = np.zeros((len(own) + PADS, DIMENSIONS))
                vectors[: len(own)] = model.embedding[own].sum(axis=1)
                found = _responses(vectors @ model.filters, model.bias)
                peak = [r[: len(own)].argmax(axis=0) for r in found]
                best = np.array([r[p, np.arange(FILTERS)] for r, p in zip(found, peak)])
                pooled = np.maximum(best, 0)
                logit = (pooled * model.output).sum() + model.constant
                error = 1 / (1 + np.exp(-np.clip(logit, -30, 30))) - truth[i]
                error *= 2.0 if truth[i] else 1.0
                step += error
                grads["output"] += error * pooled
                back = error * model.output * (best > 0)
                grads["bias"] += back
                column = 0
                for w, width in enumerate(WIDTHS):
                    for k in range(width):
                        here = peak[w] + k
                        cols = slices[column]
                        grads["filters"][:, cols] += vectors[here].T * back[w]
                        pull = model.filters[:, cols].T * back[w][:, None]
                        inside = here < len(own)
                        for b in range(own.shape[1]):
                            np.add.at(grads["embedding"], own[here[inside], b], pull[inside])
                        column += 1
            for name, adam in adams.items():
                adam.step(getattr(model, name), grads[name] / len(chosen))
            model.constant -= RATE * step / len(chosen)
    return model


def _best_threshold(values: np.ndarray, truth: np.ndarray) -> float:
    """The middle of the gap with fewest errors; of equal ones the widest."""
    order = np.argsort(values, kind="stable")
    v, y = values[order], truth[order]
    edges = np.concatenate([[v[0] - 1], v, [v[-1] + 1]])
    missed = np.concatenate([[0], np.cumsum(y)])
    alarms = (1 - y).sum() - np.concatenate([[0], np.cumsum(1 - y)])
    gap = np.diff(edges)
    at = np.lexsort((-gap, missed + alarms))[0]
    return float((edges[at] + edges[at + 1]) / 2)


def calibrate(model: Model, values: np.ndarray, truth: np.ndarray, language: np.ndarray) -> None:
    """Set the thresholds: one for each language with enough rows, one for the others."""
    if not 0 < truth.sum() < len(truth):
        return
    model.thresholds[:] = _best_threshold(values, truth)
    for code in range(1, len(LANGUAGES)):
        own = language == code
        toxic = truth[own].sum()
        if min(toxic, own.sum() - toxic) >= LEAST_FOR_LANGUAGE:
            model.thresholds[code] = _best_threshold(values[own], truth[own])


def held_out(doc_id: Column) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string")), F.lit(HELD_OUT)) == 0


def _sample(labels: DataFrame, toxic: int, most: int) -> DataFrame:
    own = labels.where(F.col("toxic") == toxic).where("doc_id is not null")
    return (
        own.where(~held_out(F.col("doc_id")))
        .select("doc_id", F.col("toxic").cast("int").alias("toxic"))
        .distinct()
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(most)
    )


def fit(
    docs: DataFrame, labels: DataFrame, most_toxic: int = MOST_TOXIC, most_clean: int = MOST_CLEAN
) -> Model:
    """Train and calibrate on labelled rows of ``docs`` (``doc_id``, ``text``)."""
    # at most most_toxic + most_clean rows of two numbers
    chosen = _sample(labels, 1, most_toxic).union(_sample(labels, 0, most_clean))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for _, _, arrays, offsets in word_hashes(utf8(batch.column(1)), True, PREFIXES):
                rows = _buckets(arrays).astype("<u2")
                found += [rows[a:b].tobytes() for a, b in zip(offsets, offsets[1:])]
            columns = [batch.column(0), batch.column(2), pa.array(found, type=pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "toxic", "words"])

    got = (
        docs.select("doc_id", "text")
        .join(F.broadcast(chosen.withColumnRenamed("doc_id", "own")), F.col("doc_id") == F.col("own"))
        .select(F.col("doc_id").cast("long"), "text", "toxic")
        .mapInArrow(hashed, "doc_id bigint, toxic int, words binary")
        .toPandas()
        .sort_values(["doc_id", "toxic", "words"], kind="stable")
    )
    width = 1 + len(PREFIXES)
    rows = [np.frombuffer(x, dtype="<u2").astype(np.int32).reshape(-1, width) for x in got["words"]]
    truth = got["toxic"].to_numpy(dtype=float)
    if not 0 < truth.sum() < len(truth):
        return _untrained(truth)
    aside = np.array([int(i) * 2654435761 % (1 << 32) % 5 == 0 for i in got["doc_id"]])
    if not 0 < truth[~aside].sum() < (~aside).sum():
        aside[:] = False
    model = train([r for r, a in zip(rows, aside) if not a], truth[~aside])
    kept = aside if aside.any() else ~aside
    offsets = np.cumsum([0] + [len(r) for r, k in zip(rows, kept) if k])
    words = np.concatenate([r for r, k in zip(rows, kept) if k])
    values = logits(model, model.projection(), words, offsets)
    calibrate(model, values, truth[kept], languages(words[:, 0], offsets, _language_of_bucket()))
    return model


def _untrained(truth: np.ndarray) -> Model:
    none = np.zeros((len(WIDTHS), FILTERS))
    share = float(truth.mean()) if len(truth) else 0.0
    return Model(np.zeros((BUCKETS, 1)), np.zeros((1, FILTERS * sum(WIDTHS))), none, none, 0.0, flat=share)


def score_documents(
    docs: DataFrame, model: Model, keep: Sequence[str], names: tuple[str, str] = ("score", "predicted")
) -> DataFrame:
    """The columns ``keep`` of ``docs`` with the score and the prediction behind them."""
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast((model, model.projection(), _language_of_bucket()))
    read = list(dict.fromkeys([*keep, "text"]))
    inside = [f"c{i}" for i in range(len(read))]
    source = docs.select(*[F.col(f"`{c}`").alias(i) for c, i in zip(read, inside, strict=True)])
    kinds = [docs.schema[c].dataType.simpleString() for c in keep]
    schema = ", ".join([*(f"c{i} {k}" for i, k in enumerate(kinds)), "score double, predicted int"])
    text, n = read.index("text"), len(keep)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, projection, of_bucket = sent.value
        for batch in batches:
            values = []
            for _, _, arrays, offsets in word_hashes(utf8(batch.column(text)), True, PREFIXES):
                # long runs in portions of texts, so that memory stays bounded
                values.append(_in_portions(own, projection, of_bucket, _buckets(arrays), offsets))
            flat = np.concatenate([*values, np.zeros(0)])
            if own.flat is not None:
                flat[:] = own.flat
            found = [pa.array(flat), pa.array((flat >= 0.5).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:n], *found], names=[*inside[:n], "score", "predicted"]
            )

    scored = source.mapInArrow(score, schema)
    own_names = [F.col(i).alias(c) for c, i in zip(keep, inside)]
    return scored.select(*own_names, F.col("score").alias(names[0]), F.col("predicted").alias(names[1]))


PORTION = 60_000


def _in_portions(model, projection, of_bucket, rows, offsets) -> np.ndarray:
    out = []
    first = 0
    while first < len(offsets) - 1:
        stop = int(np.searchsorted(offsets, offsets[first] + PORTION, "right")) - 1
        stop = min(max(stop, first + 1), len(offsets) - 1)
        words = rows[offsets[first] : offsets[stop]]
        cut = offsets[first : stop + 1] - offsets[first]
        value = logits(model, projection, words, cut)
        value -= model.thresholds[languages(words[:, 0], cut, of_bucket)]
        out.append(1 / (1 + np.exp(-np.clip(value, -30, 30))))
        first = stop
    return np.concatenate([*out, np.zeros(0)])


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The toxicity of every document."""
    docs = table(spark, sf_dir, "documents")
    model = fit(docs, table(spark, sf_dir, "labels"))
    return score_documents(docs.select("doc_id", "text"), model, ["doc_id"]).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted"
    )
