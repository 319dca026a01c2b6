"""Best-fit packing: bin completion with branch and bound.

Documents become token ids with an end mark; longer ones are cut into pieces of the
sequence length, the first piece taking the rest. How pieces share sequences depends on
their lengths alone, so the search works on the number of pieces of each length (at most
as many numbers as a sequence has tokens, whatever the data) and gives patterns: lengths
that fill one sequence, and how many sequences use them. Every piece then finds its place
from its number among the pieces of its length, in parallel.

A null text counts as empty and is one end mark. Repeated rows are packed each. An empty
table gives an empty table; other columns of the input are not read.
"""

from __future__ import annotations

import base64
import os
import re
import struct
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyspark.sql.functions as F
from pyspark.sql import DataFrame, SparkSession

from .common import number_rows, table, written

SEQUENCE = 1024
END = 2
VOCABULARY = "byte_bpe_50k.json"
RANKS = "byte_bpe_50k.tiktoken"
# Words whose ids a worker keeps; a matter of speed and memory only.
KEPT_WORDS = 400_000
# Nodes that the search may visit beyond the first descent.
SEARCH_NODES = 2_000


def vocabulary_paths() -> tuple[str, str]:
    """The tokenizer's file, and the same vocabulary as ranks."""
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY), public_tokenizers.path(RANKS)


_OTHER_SPACE = re.compile(r"[^\S \n]")
_MARKS = frozenset(".,;:!?")


class Encoder:
    """Token ids of texts as little-endian 32-bit bytes.

    The tokenizer splits at a space between two other characters before it merges, and
    likewise at a line break, so a text that has no other white space is the sum of its
    words. Ids of words are kept; a word not yet known goes through the same vocabulary as
    a rank file, other texts and those that hold a special token to the tokenizer whole.
    """

    def __init__(self, path: str, ranks: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        with open(ranks, "rb") as lines:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.words = tiktoken.Encoding(
            "ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={}
        )
        self.marks = {m: self._word(m) for m in _MARKS}
        self.kept: dict[str, bytes] = {}

    def _whole(self, text: str) -> bytes:
        ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        return np.array(ids, dtype="<u4").tobytes()

    def _word(self, text: str) -> bytes:
        ids = self.words.encode_ordinary(text)
        return struct.pack(f"<{len(ids)}I", *ids)

    def _plain(self, text: str) -> bool:
        return not (
            "  " in text
            or "\n\n" in text
            or " \n" in text
            or "\n " in text
            or text[0] in " \n"
            or text[-1] in " \n"
            or any(s in text for s in self.special)
            or _OTHER_SPACE.search(text)
        )

    def _learn(self, word: str) -> bytes:
        """Ids of a word after a space or, if it begins with one, a line break."""
        stem = word[:-1]
        if word[-1] in _MARKS and stem.isalpha():
            # letters and marks are split before merges
            known = self.kept.get(stem)
            return (self._learn(stem) if known is None else known) + self.marks[word[-1]]
        ids = self._word(word if word[0] == "\n" else " " + word)
        if len(self.kept) < KEPT_WORDS:
            self.kept[word] = ids
        return ids

    def __call__(self, text: str | None) -> bytes:
        if not text:
            return b""
        if not self._plain(text):
            return self._whole(text)
        first, *rest = text.replace("\n", " \n").split(" ")
        found = list(map(self.kept.get, rest))
        if None in found:
            learn = self._learn
            found = [learn(w) if ids is None else ids for w, ids in zip(rest, found, strict=True)]
        return self._word(first) + b"".join(found)


@cache
def _encoder(path: str, ranks: str) -> Encoder:
    return Encoder(path, ranks)


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """Start and length of the pieces of ``n`` tokens; only the first may be shorter."""
    first = n % capacity or capacity
    return [(0, min(first, n)), *((s, capacity) for s in range(first, n, capacity))]


PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"


def pieces_of(docs: DataFrame, vocabulary: tuple[str, str], end: int, capacity: int) -> DataFrame:
    """One row per piece of every document (``doc_id``, ``text``)."""
    tail = np.array([end], dtype="<u4").tobytes()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(*vocabulary)
        for batch in batches:
            rows: list[tuple] = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = memoryview(encoder(text) + tail)
                for piece, (start, length) in enumerate(cut(len(ids) // 4, capacity)):
                    part = ids[4 * start : 4 * (start + length)]
                    rows.append((doc_id, piece, start, length, zlib.crc32(part)))
            columns = list(zip(*rows, strict=True)) or [()] * 5
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, type=k) for c, k in zip(columns, kinds, strict=True)],
                names=["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    return docs.select("doc_id", "text").mapInArrow(encode, PIECES)


def _reach(room: int, counts: dict[int, int], lengths: list[int]) -> list[int]:
    """Which sums up to ``room`` the first lengths give, as bits, after each length."""
    full = (1 << (room + 1)) - 1
    now = 1
    out = [now]
    for length in lengths:
        many = min(counts[length], room // length)
        step = 1
        while many > 0:
            take = min(step, many)
            now |= (now << (take * length)) & full
            many -= take
            step *= 2
        out.append(now)
    return out


def _exactly(
    target: int, reach: list[int], counts: dict[int, int], lengths: list[int], top: int
) -> Iterator[tuple[int, ...]]:
    """All ways to add up to ``target`` from the first ``top`` lengths (given in ascending
    order), those with most of the largest first: what is hard to place goes first."""
    if not target:
        yield ()
        return
    for i in range(top - 1, -1, -1):
        if not reach[i + 1] >> target & 1:
            return
        length = lengths[i]
        for used in range(min(counts[length], target // length), 0, -1):
            if reach[i] >> (target - used * length) & 1:
                for rest in _exactly(target - used * length, reach, counts, lengths, i):
                    yield (length,) * used + rest


def fillings(room: int, counts: dict[int, int]) -> Iterator[tuple[int, ...]]:
    """Undominated fillings of ``room``, the fullest first. A filling is dominated if a
    length left over fits beside it, so those up to the room left are all used."""
    lengths = sorted(n for n, c in counts.items() if c and n <= room)
    forced: tuple[int, ...] = ()
    used = 0
    reach = _reach(room, counts, lengths)
    for target in range(room, -1, -1):
        while used < len(lengths) and lengths[used] <= room - target:
            forced += (lengths[used],) * min(counts[lengths[used]], room)
            used += 1
            reach = []
        need = sum(forced)
        if need > target:
            return
        rest = lengths[used:]
        reach = reach or _reach(room, counts, rest)
        if reach[-1] >> (target - need) & 1:
            for chosen in _exactly(target - need, reach, counts, rest, len(rest)):
                yield chosen + forced


def best_fit_decreasing(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """The patterns of best fit: every piece, the longest first, goes where least room is
    left, into a new sequence if it fits nowhere."""
    open_by_room: dict[int, list[tuple[tuple[int, ...], int]]] = {capacity: []}
    for n in sorted(counts, reverse=True):
        pieces = counts[n]
        while pieces:
            room = min((r for r, found in open_by_room.items() if found and r >= n), default=capacity)
            pattern, times = open_by_room[room].pop() if open_by_room[room] else ((), pieces)
            # the next of the same length fit best where one went
            each = min(room // n, pieces)
            used = min(times, pieces // each)
            open_by_room.setdefault(room - each * n, []).append((pattern + (n,) * each, used))
            if pattern and times > used:
                open_by_room[room].append((pattern, times - used))
            pieces -= each * used
    return [x for found in open_by_room.values() for x in found]


def lower_bound(counts: dict[int, int], capacity: int) -> int:
    """Sequences that any packing needs: by total length, and by the space that pieces
    over a threshold must leave unused."""
    best = -(-sum(n * c for n, c in counts.items()) // capacity)
    for least in {n for n in counts if n <= capacity // 2}:
        alone = sum(c for n, c in counts.items() if n > capacity - least)
        half = [(n, c) for n, c in counts.items() if capacity // 2 < n <= capacity - least]
        small = sum(n * c for n, c in counts.items() if least <= n <= capacity // 2)
        free = sum((capacity - n) * c for n, c in half)
        many = alone + sum(c for _, c in half)
        best = max(best, many + max(0, -(-(small - free) // capacity)))
    return best


def bin_completion(
    counts: dict[int, int], capacity: int, nodes: int = SEARCH_NODES
) -> list[tuple[tuple[int, ...], int]]:
    """Patterns and how many sequences use each, for pieces given as a count by length.

    Always completes the sequence of the largest piece left. The incumbent is best fit
    decreasing; the first descent takes the fullest filling each time, for as many sequences
    as there are pieces. The search then goes back over the other undominated fillings and
    over fewer sequences (a half, a quarter and so on), as long as the space wasted so far
    would still allow fewer sequences than the incumbent; first over descents that depart
    from the first choices by one step, then by two and so on, until the lower bound is met,
    nothing is left out or ``nodes`` are visited.
    """
    counts = {n: c for n, c in counts.items() if c}
    if not counts:
        return []
    total = sum(n * c for n, c in counts.items())
    goal = lower_bound(counts, capacity)
    best = best_fit_decreasing(counts, capacity)
    best_size = sum(times for _, times in best)
    visited = 0
    size = wasted = 0
    left = dict(counts)

    def options() -> Iterator[tuple[int, int, tuple[int, ...], int]]:
        now = dict(left)
        largest = max(n for n, c in now.items() if c)
        now[largest] -= 1
        for rank, rest in enumerate(fillings(capacity - largest, now)):
            pattern = (largest, *rest)
            have = {n: now[n] + (n == largest) for n in pattern}
            times = min(c // pattern.count(n) for n, c in have.items())
            halved = 0
            while times:
                yield rank, halved, pattern, times
                times, halved = times // 2, halved + 1

    steps, more = 0, True
    while more and best_size > goal and visited <= nodes:
        more = False
        stack = [(options(), steps)]
        taken: list[tuple[tuple[int, ...], int]] = []
        while stack and best_size > goal and visited <= nodes:
            choices, may = stack[-1]
            rank, halved, pattern, times = next(choices, (-1, 0, (), 0))
            if rank > may or rank < 0:
                more |= rank > may
                stack.pop()
            elif rank + halved > may:
                more = True
                continue
            else:
                visited += steps > 0
                waste = times * (capacity - sum(pattern))
                # the last sequence of all may be part empty, so waste is bound by the total
                if steps and wasted + waste > (best_size - 1) * capacity - total:
                    continue
                for n in pattern:
                    left[n] -= times
                taken.append((pattern, times))
                size, wasted = size + times, wasted + waste
                if any(left.values()):
                    stack.append((options(), may - rank - halved))
                    continue
                if size < best_size:
                    best, best_size = list(taken), size
            if not taken:
                continue
            pattern, times = taken.pop()
            for n in pattern:
                left[n] += times
            size, wasted = size - times, wasted - times * (capacity - sum(pattern))
        for pattern, times in taken:  # of a search that was ended
            for n in pattern:
                left[n] += times
        size = wasted = 0
        steps += 1
    return best


def _places(patterns: list[tuple[tuple[int, ...], int]]) -> tuple[np.ndarray, ...]:
    """For every slot of every pattern: its length, the first number among the pieces of
    that length that it takes, its first sequence and its offset; by length and number."""
    used: dict[int, int] = {}
    rows = []
    sequence = 0
    for lengths, times in patterns:
        offset = 0
        for n in lengths:
            rows.append((n, used.get(n, 0), sequence, offset))
            used[n] = used.get(n, 0) + times
            offset += n
        sequence += times
    rows.sort()
    return tuple(np.array(c, dtype=np.int64) for c in zip(*rows, strict=True))


def pack(
    docs: DataFrame, vocabulary: tuple[str, str], end: int = END, capacity: int = SEQUENCE
) -> DataFrame:
    """Pieces of all documents (``doc_id``, ``text``) with ``sequence_id`` and ``offset``."""
    pieces, _ = written(pieces_of(docs, vocabulary, end, capacity), "pieces")
    counted = pieces.groupBy("length").count().collect()  # one row per length at most
    patterns = bin_completion({r["length"]: r["count"] for r in counted}, capacity)
    numbered = number_rows(
        pieces, F.col("length"), [F.col("doc_id"), F.col("piece"), F.col("ids_crc32")], "_number",
        buckets=64,
    )
    if not patterns:
        blank = F.lit(0).cast("long")
        return pieces.withColumns({"sequence_id": blank, "offset": blank})
    length_of, first, sequence, offset = _places(patterns)

    @F.pandas_udf("sequence_id bigint, offset bigint")
    def place(length: pd.Series, number: pd.Series) -> pd.DataFrame:
        keys = length_of * (1 << 42) + first
        at = np.searchsorted(keys, length.to_numpy() * (1 << 42) + number.to_numpy(), "right") - 1
        return pd.DataFrame(
            {"sequence_id": sequence[at] + number.to_numpy() - first[at], "offset": offset[at]}
        )

    return numbered.withColumn("_place", place("length", "_number")).select(
        *pieces.columns, "_place.sequence_id", "_place.offset"
    )


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 1024 tokens."""
    return pack(table(spark, sf_dir, "documents"), vocabulary_paths())
