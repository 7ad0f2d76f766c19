"""Vectorised word kernels on Arrow text columns, used inside tasks.

A word is a run of bytes outside ``[\\x20\\x09-\\x0D]``.  Its fingerprint is a
64-bit polynomial over a random value per byte, computed for all words of a
column at once from prefix sums.  Columns are worked through in pieces, so the
temporary arrays stay a few MB however long a text is.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PIECE = 1 << 18
SLICE_BYTES = 4 << 20

_random = np.random.default_rng(20240229)
_RAW = _random.integers(1, 2**63, 256, dtype=np.uint64)
_FOLDED = _RAW.copy()
_FOLDED[ord("A"):ord("Z") + 1] = _RAW[ord("a"):ord("z") + 1]
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 2**64)


def powers(base: int, size: int) -> np.ndarray:
    """``base ** i`` modulo 2**64 for i below ``size``."""
    out = np.full(size, base % 2**64, dtype=np.uint64)
    out[:1] = 1
    with np.errstate(over="ignore"):
        return np.multiply.accumulate(out)


_UP, _DOWN = powers(_BASE, PIECE), powers(_INVERSE, PIECE)


def mix(h: np.ndarray) -> np.ndarray:
    """Finalizer: every input bit reaches every output bit."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def text_slices(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows that hold at most ``limit`` bytes of text, or one longer text."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    start = held = 0
    for i, size in enumerate(sizes):
        if held + size > limit and i > start:
            yield start, i
            start, held = i, 0
        held += int(size)
    if start < len(sizes):
        yield start, len(sizes)


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and the offsets of its rows; null is empty."""
    texts = pc.fill_null(pc.cast(texts, pa.large_string()), "")
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset:texts.offset + len(texts) + 1]
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None else np.zeros(0, dtype=np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


@dataclass
class Words:
    """Words of some rows: fingerprints, byte ranges, and the first word of every row (one more at the end)."""

    hashes: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray
    data: np.ndarray

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def rows(self) -> np.ndarray:
        """Row number of every word."""
        return np.repeat(np.arange(self.first.size - 1), self.counts())


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last byte (exclusive) of every word; a word ends with its row."""
    solid = ~SPACE[data]
    cut = np.zeros(data.size + 1, dtype=bool)
    cut[offsets] = True
    before = np.zeros(data.size, dtype=bool)
    before[1:] = solid[:-1]
    starts = np.flatnonzero(solid & (~before | cut[:-1]))
    after = np.zeros(data.size, dtype=bool)
    after[:-1] = solid[1:]
    ends = np.flatnonzero(solid & (~after | cut[1:])) + 1
    return starts, ends


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: bool = True) -> np.ndarray:
    """Fingerprints of byte ranges in ascending order, computed piece by piece."""
    values = _FOLDED if fold else _RAW
    out = np.empty(starts.size, dtype=np.uint64)
    at = 0
    with np.errstate(over="ignore"):
        while at < starts.size:
            origin = starts[at]
            upto = int(np.searchsorted(ends, origin + PIECE, side="right"))
            if upto <= at:  # one range longer than a piece
                out[at] = _long_hash(data[origin:ends[at]], values)
                at += 1
                continue
            piece = data[origin:ends[upto - 1]]
            sums = np.zeros(piece.size + 1, dtype=np.uint64)
            np.cumsum(values[piece] * _UP[:piece.size], out=sums[1:])
            s, e = starts[at:upto] - origin, ends[at:upto] - origin
            out[at:upto] = mix((sums[e] - sums[s]) * _DOWN[s] + (e - s).astype(np.uint64))
            at = upto
    return out


def _long_hash(data: np.ndarray, values: np.ndarray) -> np.uint64:
    total, scale = np.uint64(0), np.uint64(1)
    step = np.uint64(pow(_BASE, PIECE, 2**64))
    for i in range(0, data.size, PIECE):
        piece = data[i:i + PIECE]
        total = total + scale * np.sum(values[piece] * _UP[:piece.size], dtype=np.uint64)
        scale = scale * step
    return mix(np.array([total + np.uint64(data.size)], dtype=np.uint64))[0]


def words_of(texts: pa.Array, fold: bool = True) -> Words:
    """All words of a column; ``fold`` ignores the case of A-Z."""
    data, offsets = text_bytes(texts)
    starts, ends = word_bounds(data, offsets)
    return Words(span_hashes(data, starts, ends, fold), starts, ends, np.searchsorted(starts, offsets), data)


def shingles(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints of all runs of ``size`` words and the row of each.

    A row with fewer words, but at least one, has its whole sequence as its only run.
    """
    h, counts = words.hashes, words.counts()
    mixed = _shingle_hashes(h, size)
    row = words.rows()
    inside = (np.arange(h.size) + size <= words.first[row + 1]) if h.size else np.zeros(0, dtype=bool)
    out, rows = mixed[np.flatnonzero(inside)], row[inside]
    short = np.flatnonzero((counts > 0) & (counts < size))
    if short.size:
        with np.errstate(over="ignore"):
            extra = np.zeros(short.size, dtype=np.uint64)
            for k in range(size - 1):
                has = counts[short] > k
                at = words.first[short[has]] + k
                extra[has] = mix(extra[has] * np.uint64(0xD6E8FEB86659FD93) + h[at] + np.uint64(k + 1))
        out, rows = np.concatenate([out, extra]), np.concatenate([rows, short])
        order = np.argsort(rows, kind="stable")
        out, rows = out[order], rows[order]
    return out, rows


def _shingle_hashes(h: np.ndarray, size: int) -> np.ndarray:
    n = max(0, h.size - size + 1)
    total = np.zeros(n, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for k in range(size):
            total = total * np.uint64(0x9FB21C651E98DF25) + h[k:k + n]
        total = mix(total)
    return np.concatenate([total, np.zeros(h.size - n, dtype=np.uint64)])
