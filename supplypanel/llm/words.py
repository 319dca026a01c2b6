"""Hashed words of many texts at once, as numpy arrays.

Texts are handled as UTF-8 bytes. A word is a longest run of bytes that are no
separators, its hash a polynomial over a fixed table of byte values, computed for all
words of a piece of text by one running sum. Everything is a function of the bytes alone,
so that tasks, retries and runs agree.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa

PIECE_BYTES = 1 << 20
_STEP = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))

# The ASCII white space of the contracts, bytes 0x20 and 0x09 to 0x0D.
SPACES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers (a bijection)."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


@cache
def _byte_values() -> np.ndarray:
    """One 64-bit number for each byte; A-Z count as a-z."""
    codes = np.arange(256, dtype=np.uint64)
    upper = (codes >= 65) & (codes <= 90)
    return mix((np.where(upper, codes + np.uint64(32), codes) + np.uint64(1)) * _STEP)


@cache
def separators(punctuation: bool) -> np.ndarray:
    """Which bytes end a word: white space or, with ``punctuation``, every ASCII
    character that is no letter and no digit."""
    table = np.zeros(256, dtype=bool)
    table[list(SPACES)] = True
    if punctuation:
        table[:128] = [not chr(i).isalnum() for i in range(128)]
    return table


class _Powers:
    steps = np.ones(1, dtype=np.uint64)
    inverses = np.ones(1, dtype=np.uint64)

    @classmethod
    def upto(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.steps) < n:
            n = max(n, PIECE_BYTES + 1)
            for name, factor in (("steps", _STEP), ("inverses", _INVERSE)):
                row = np.full(n, factor, dtype=np.uint64)
                row[0] = 1
                setattr(cls, name, np.multiply.accumulate(row))
        return cls.steps, cls.inverses


def _spans(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    inside = np.zeros(len(data) + 2, dtype=np.int8)
    inside[1:-1] = ~ends[data]
    change = np.diff(inside)
    return np.flatnonzero(change == 1), np.flatnonzero(change == -1)


def _sums(data: np.ndarray) -> np.ndarray:
    steps, _ = _Powers.upto(len(data) + 1)
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_byte_values()[data] * steps[: len(data)], out=sums[1:])
    return sums


def hash_piece(
    data: np.ndarray, ends: np.ndarray, prefixes: tuple[int, ...] = ()
) -> tuple[np.ndarray, ...]:
    """Start and hash of every word, then for each of ``prefixes`` the hash of the word's
    first so many bytes (all of a shorter word)."""
    starts, stops = _spans(data, ends)
    sums = _sums(data)
    back = _Powers.inverses[starts]
    found = [starts, mix((sums[stops] - sums[starts]) * back)]
    for k in prefixes:
        cut = np.minimum(stops, starts + k)
        found.append(mix((sums[cut] - sums[starts]) * back + np.uint64(k)))
    return tuple(found)


def _cut(text: bytes, ends: np.ndarray) -> Iterator[bytes]:
    """A long text in pieces that end between words."""
    at = 0
    while len(text) - at > PIECE_BYTES:
        stop = at + PIECE_BYTES
        while stop < len(text) and not ends[text[stop]]:
            stop += 1
        yield text[at:stop]
        at = stop
    yield text[at:]


def word_hashes(
    texts: list[bytes | None], punctuation: bool = False, prefixes: tuple[int, ...] = ()
) -> Iterator[tuple[int, int, list[np.ndarray], np.ndarray]]:
    """Runs of texts ``first`` to ``stop`` of about ``PIECE_BYTES`` together, as
    ``(first, stop, arrays, offsets)``: the arrays (word hashes, then prefix hashes) hold
    the words of all of the run; text ``first + i`` has words ``offsets[i]`` to
    ``offsets[i + 1]``. A longer text makes a run of its own. A null text has no words."""
    ends = separators(punctuation)
    first = 0
    while first < len(texts):
        stop, size = first, 0
        while stop < len(texts) and (size == 0 or size + len(texts[stop] or b"") < PIECE_BYTES):
            size += len(texts[stop] or b"") + 1
            stop += 1
        if stop == first + 1:
            parts = [
                hash_piece(np.frombuffer(x, dtype=np.uint8), ends, prefixes)[1:]
                for x in _cut(texts[first] or b"", ends)
            ]
            arrays = [np.concatenate(x) for x in zip(*parts, strict=True)]
            offsets = np.array([0, len(arrays[0])])
        else:
            run = [x or b"" for x in texts[first:stop]]
            data = np.frombuffer(b"\n".join(run), dtype=np.uint8)
            begun, *arrays = hash_piece(data, ends, prefixes)
            edges = np.cumsum([0] + [len(x) + 1 for x in run])
            offsets = np.searchsorted(begun, edges)
        yield first, stop, list(arrays), offsets
        first = stop


def utf8(column: pa.Array) -> list[bytes | None]:
    """The texts of an Arrow column as bytes."""
    return column.cast(pa.binary()).to_pylist()


def lists(values: np.ndarray, offsets: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    """An Arrow column of lists over one flat array."""
    return pa.ListArray.from_arrays(
        pa.array(offsets, type=pa.int32()), pa.array(values, type=kind)
    )
