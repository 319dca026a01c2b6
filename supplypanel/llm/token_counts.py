"""Token counts: count-only Viterbi over a unigram vocabulary.

An Aho-Corasick automaton enumerates every vocabulary piece that ends at each character;
dynamic programming keeps, for each position, the best score of a segmentation that ends
there and how many tokens it has. No segmentation is built.

Ties are broken as in the ``Unigram`` model of the ``tokenizers`` library: a candidate
replaces another only by a higher score and candidates come by start position, so that of
equal scores the longest last piece stays. A character that is no piece itself may be
unknown, at the lowest score of all less 10; unknown characters in a row count as their
UTF-8 bytes where the vocabulary has all bytes, else as one token.

Scores of the vocabulary file are whole numbers, so sums are exact. No piece holds the
space mark behind another character, and some characters (the line break) are in no piece;
every segmentation has a border there. So a text is cut at these places, the best score
and count of the parts add up, and a part's count is kept for the next time.

Each text is counted whole. A null or empty text has 0 tokens. Repeated rows are counted
each; a null ``doc_id`` stays null; an empty table gives an empty table; other columns of
the input are not read.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import cache

import ahocorasick
import pyarrow as pa
import pyspark.sql.functions as F
from pyspark.sql import DataFrame, SparkSession

from .common import table

VOCABULARY = "piece_bpe_32k.model"
SPACE_MARK = "▁"
UNKNOWN_PENALTY = 10.0
# Parts whose counts a worker keeps; a matter of speed and memory only.
KEPT_PARTS = 400_000

Piece = tuple[str, float]


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


def read_pieces(path: str) -> list[Piece]:
    """Pieces and scores of a vocabulary file, in the order of their ids."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [(model.id_to_piece(i), model.get_score(i)) for i in range(model.get_piece_size())]


class Counter:
    """Counts tokens of texts for one vocabulary; id 0 is the unknown piece."""

    def __init__(self, pieces: list[Piece]):
        self.unknown = min(score for _, score in pieces) - UNKNOWN_PENALTY
        names = {name for name, _ in pieces}
        self.has_bytes = all(f"<0x{i:02X}>" in names for i in range(256))
        self.automaton = ahocorasick.Automaton()
        for name, score in pieces:
            self.automaton.add_word(name, (len(name), score))
        self.automaton.make_automaton()
        for name in names:
            if SPACE_MARK in name.lstrip(SPACE_MARK):
                raise ValueError(f"piece {name!r} crosses a space")
        known = set("".join(names))
        self.parts = re.compile(
            f"{SPACE_MARK}*[^{SPACE_MARK}\n]+|{SPACE_MARK}+|\n+"
            if "\n" not in known
            else f"{SPACE_MARK}*[^{SPACE_MARK}]+|{SPACE_MARK}+"
        )
        self.kept: dict[str, tuple[int, bool, bool]] = {}

    def _part(self, text: str) -> tuple[int, bool, bool]:
        """Tokens of a part, an unknown run at either end not fused with its neighbours;
        whether the part begins and ends with one."""
        n = len(text)
        best = [-math.inf] * (n + 1)
        count = [0] * (n + 1)
        unknown = [False] * (n + 1)  # whether the last token is unknown
        starts_unknown = [False] * (n + 1)
        best[0] = 0.0
        found: list[list[tuple[int, float]]] = [[] for _ in range(n + 1)]
        for end, match in self.automaton.iter(text):
            found[end + 1].append(match)
        for end in range(1, n + 1):
            single = False
            # from the longest piece to the shortest, that is by start position
            for length, score in sorted(found[end], reverse=True):
                start = end - length
                single = single or length == 1
                if best[start] + score > best[end]:
                    best[end] = best[start] + score
                    count[end] = count[start] + 1
                    unknown[end] = False
                    starts_unknown[end] = starts_unknown[start] if start else False
            if not single and best[end - 1] + self.unknown > best[end]:
                best[end] = best[end - 1] + self.unknown
                if self.has_bytes:
                    count[end] = count[end - 1] + len(text[end - 1].encode())
                else:
                    count[end] = count[end - 1] + (not unknown[end - 1])
                unknown[end] = True
                starts_unknown[end] = starts_unknown[end - 1] if end > 1 else True
        return count[n], starts_unknown[n], unknown[n]

    def part(self, text: str) -> tuple[int, bool, bool]:
        out = self.kept.get(text)
        if out is None:
            out = self._part(text)
            if len(self.kept) < KEPT_PARTS and len(text) < 64:
                self.kept[text] = out
        return out

    def __call__(self, text: str | None) -> int:
        if not text:
            return 0
        marked = SPACE_MARK + text.replace(" ", SPACE_MARK)
        parts = [self.part(x) for x in self.parts.findall(marked)]
        total = sum(n for n, _, _ in parts)
        if not self.has_bytes:
            # an unknown run across a border is one token
            total -= sum(a[2] and b[1] for a, b in zip(parts, parts[1:]))
        return total


@cache
def _counter(path: str) -> Counter:
    return Counter(read_pieces(path))


def token_counts(docs: DataFrame, vocabulary: str) -> DataFrame:
    """``doc_id``, ``n_tokens`` and ``n_chars`` (code points) of every text."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(vocabulary)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([counter(t) for t in texts], type=pa.int64()),
                    pa.array([len(t or "") for t in texts], type=pa.int64()),
                ],
                names=["doc_id", "n_tokens", "n_chars"],
            )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        count, "doc_id bigint, n_tokens bigint, n_chars bigint"
    )


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document."""
    return token_counts(table(spark, sf_dir, "documents"), vocabulary_path())
