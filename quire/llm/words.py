"""Vectorised word spans and word n-gram hashes over Arrow text columns.

A text column is walked in chunks of bounded bytes (one text is never split),
and all words of a chunk are found and hashed with array operations on its
UTF-8 bytes.  The two word patterns used by the operators only name ASCII
separators, so byte positions and code-point positions agree on what a word is.

Hashes are 64-bit: a polynomial over the bytes with odd base, finished by a
bijective mixer.  Two different word sequences share a hash with a chance of
about 2**-64.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 1 << 19

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15          # odd, so it has an inverse modulo 2**64
_BASE_INV = pow(_BASE, -1, 1 << 64)
_STEP = 0xD6E8FEB86659FD93          # odd multiplier between the words of an n-gram


def _table(is_word) -> np.ndarray:
    return np.array([bool(is_word(b)) for b in range(256)])


#: ``[^\x20\x09-\x0D]+``
NOT_SPACE = _table(lambda b: b != 0x20 and not 0x09 <= b <= 0x0D)
#: ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` once A-Z are lower-cased
ALNUM = _table(lambda b: b >= 0x80 or chr(b).isalnum())
#: bytes with A-Z lower-cased
LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], dtype=np.uint8)


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit mixer (the splitmix64 finaliser)."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


class _Powers:
    """Powers of the base and of its inverse, grown when a longer text comes."""

    up = np.ones(1, dtype=_U)
    down = np.ones(1, dtype=_U)

    @classmethod
    def upto(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            size = max(n, CHUNK_BYTES)
            ones = np.full(size, _U(_BASE), dtype=_U)
            ones[0] = 1
            cls.up = np.multiply.accumulate(ones)
            ones = np.full(size, _U(_BASE_INV), dtype=_U)
            ones[0] = 1
            cls.down = np.multiply.accumulate(ones)
        return cls.up[:n], cls.down[:n]


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string column; null counts as empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, dtype=np.int64)[column.offset:column.offset + len(column) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    return raw, off


def chunks(column: pa.Array, max_bytes: int = CHUNK_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, row offsets from 0) for runs of whole texts."""
    if not len(column):
        return
    raw, off = utf8(column)
    row, rows = 0, len(off) - 1
    while row < rows:
        end = max(row + 1, int(np.searchsorted(off, off[row] + max_bytes, side="right")) - 1)
        yield row, raw[off[row]:off[end]], off[row:end + 1] - off[row]
        row = end


def spans(data: np.ndarray, off: np.ndarray, table: np.ndarray):
    """Byte starts and ends of the words, and the index of each row's first word (rows + 1 values)."""
    n = len(data)
    if not n:
        none = np.zeros(0, dtype=np.int64)
        return none, none, np.zeros(len(off), dtype=np.int64)
    mask = table[data]
    before = np.empty(n, dtype=bool)
    before[0] = False
    before[1:] = mask[:-1]
    heads = off[:-1]
    before[heads[heads < n]] = False
    after = np.empty(n, dtype=bool)
    after[-1] = False
    after[:-1] = mask[1:]
    tails = off[1:]
    after[tails[tails > 0] - 1] = False
    start = np.flatnonzero(mask & ~before)
    end = np.flatnonzero(mask & ~after) + 1
    return start, end, np.searchsorted(start, off)


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """One 64-bit hash a word."""
    up, down = _Powers.upto(len(data) + 1)
    total = np.zeros(len(data) + 1, dtype=_U)
    np.cumsum((data.astype(_U) + _U(1)) * up[:len(data)], out=total[1:])
    return mix((total[end] - total[start]) * down[start] + (end - start).astype(_U))


def ngram_hashes(words: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all n-grams that lie within a row, and the index of each one's first word."""
    if len(words) < n:
        return np.zeros(0, dtype=_U), np.zeros(0, dtype=np.int64)
    size = len(words) - n + 1
    out = np.zeros(size, dtype=_U)
    for j in range(n):
        out = out * _U(_STEP) + words[j:j + size]
    inside = np.zeros(len(words), dtype=bool)
    counts = np.diff(first)
    full = np.flatnonzero(counts >= n)
    # mark, row by row, the first words that have n - 1 followers in the row
    edge = np.zeros(len(words) + 1, dtype=np.int64)
    np.add.at(edge, first[full], 1)
    np.add.at(edge, first[full + 1] - n + 1, -1)
    inside = np.cumsum(edge)[:size] > 0
    at = np.flatnonzero(inside)
    return mix(out[at] + _U(n)), at


def rows_of(at: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Row of each word index."""
    return np.searchsorted(first, at, side="right") - 1
