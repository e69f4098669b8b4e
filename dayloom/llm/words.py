"""Words of whole texts as numpy arrays, for use inside Arrow tasks.

A word is a run of bytes other than space and 0x09-0x0D, so it never cuts a UTF-8 character.
Hashes are 64-bit polynomials over random byte values (arithmetic modulo 2**64, odd base),
finished by a mixing step. ``table(seed)`` gives independent hash functions.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_BLOCK = 1 << 20
_U = np.uint64


def blob(values: np.ndarray) -> bytes:
    return np.ascontiguousarray(values).tobytes()


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every input bit."""
    h = h ^ (h >> _U(30))
    h *= _U(0xBF58476D1CE4E5B9)
    h ^= h >> _U(27)
    h *= _U(0x94D049BB133111EB)
    h ^= h >> _U(31)
    return h


@lru_cache(maxsize=8)
def _base(seed: int) -> int:
    return int(np.random.default_rng(7000 + seed).integers(1 << 40, 1 << 62)) * 8 + 5 & (1 << 64) - 1


@lru_cache(maxsize=8)
def _powers(seed: int, n: int) -> np.ndarray:
    p = np.full(n, _base(seed), dtype=_U)
    p[0] = 1
    return np.multiply.accumulate(p)


@lru_cache(maxsize=16)
def table(seed: int = 0, lower: bool = False) -> np.ndarray:
    t = np.random.default_rng(9000 + seed).integers(0, 1 << 63, 256, dtype=_U) * _U(2) + _U(1)
    if lower:
        t[65:91] = t[97:123]
    return t


def text_bytes(column) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, row offsets) of a string column; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):  # no chunk at all, or more than fit in one
        column = pa.concat_arrays([c.cast(pa.large_string()) for c in column.chunks]) if column.num_chunks else pa.array([], pa.large_string())
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    return data[off[0] : off[-1]], off - off[0]


def steps(batches: Iterator[pa.RecordBatch], column: str = "text", step_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``step_bytes`` of text; a longer text comes alone or last."""
    for b in batches:
        size = np.cumsum(pc.fill_null(pc.binary_length(b.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 64)
        cuts = np.unique(np.append(np.flatnonzero(np.diff(size // step_bytes)) + 1, b.num_rows))
        for lo, hi in zip([0, *cuts[:-1]], cuts, strict=True):
            if hi > lo:
                yield b.slice(lo, hi - lo)


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def find_words(data: np.ndarray, off: np.ndarray, inside: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first): word spans in bytes, and the index of each row's first word (n + 1 values)."""
    if len(data) == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    word = ~_SPACE[data] if inside is None else inside[data]
    edge = np.empty(len(data) + 1, bool)
    edge[0] = edge[-1] = True
    np.not_equal(word[1:], word[:-1], out=edge[1:-1])
    cut = off[(off > 0) & (off < len(data))]
    edge[cut] = True
    bounds = np.flatnonzero(edge)
    keep = word[bounds[:-1]]
    starts, ends = bounds[:-1][keep], bounds[1:][keep]
    return starts, ends, np.searchsorted(starts, off)


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """Hash of values[starts:ends] for sorted, non-empty spans (they may overlap)."""
    out = np.empty(len(starts), _U)
    lo = 0
    while lo < len(starts):
        base = int(starts[lo])
        hi = max(lo + 1, int(np.searchsorted(ends, base + _BLOCK, "right")))
        size = int(ends[lo:hi].max()) - base
        p = _powers(seed, max(_BLOCK + 1, size + 1))
        run = np.zeros(size + 1, _U)
        np.cumsum(values[base : base + size] * p[:size], out=run[1:])
        s = starts[lo:hi] - base
        out[lo:hi] = (run[ends[lo:hi] - base] - run[s]) * p[_BLOCK - s]
        lo = hi
    return mix(out)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0, lower: bool = False) -> np.ndarray:
    """Hash of each word. Byte values are looked up block-wise to bound memory."""
    t = table(seed, lower)
    out = np.empty(len(starts), _U)
    lo = 0
    while lo < len(starts):
        base = int(starts[lo])
        hi = max(lo + 1, int(np.searchsorted(ends, base + _BLOCK, "right")))
        out[lo:hi] = span_hashes(t[data[base : ends[hi - 1]]], starts[lo:hi] - base, ends[lo:hi] - base, seed)
        lo = hi
    return out


def windows(first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(start, row) of every run of ``size`` consecutive items inside one row."""
    counts = np.maximum(np.diff(first) - size + 1, 0)
    row = np.repeat(np.arange(len(counts)), counts)
    begin = np.repeat(first[:-1] - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts) + np.arange(int(counts.sum()))
    return begin, row


def shingle_hashes(words: np.ndarray, first: np.ndarray, size: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of each ``size``-word shingle; a shorter row with words gives its whole sequence."""
    begin, row = windows(first, size)
    counts = np.diff(first)
    short = np.flatnonzero((counts > 0) & (counts < size))
    h = span_hashes(words, begin, begin + size, seed)
    if len(short):
        h = np.concatenate([h, span_hashes(words, first[short], first[short] + counts[short], seed)])
        row = np.concatenate([row, short])
    return h, row
