"""Vectorised word segmentation and hashing over Arrow string arrays.

A word is a maximal run of bytes other than space and U+0009-U+000D. Hashes are polynomial sums
modulo 2**64 over randomised byte codes, taken for all words of a block at once from one cumulative
sum, then mixed; two different words share one with a chance of about 2**-64.
Blocks hold about ``BLOCK`` bytes, so memory doesn't depend on the batch or on one text's length.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

BLOCK = 1 << 19
_M = (1 << 64) - 1
_P = 0x9E3779B97F4A7C15 | 1


def _splitmix(x: int) -> int:
    x = (x + 0x9E3779B97F4A7C15) & _M
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & _M
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & _M
    return x ^ (x >> 31)


_CODES = np.array([_splitmix(i + 1) for i in range(256)], np.uint64)
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SHAPE = np.arange(256, dtype=np.uint8)
_SHAPE[65:91] = ord("A")
_SHAPE[97:123] = ord("a")
_SHAPE[128:] = ord("a")
_SHAPE[48:58] = ord("0")
COMBINE = np.array([_splitmix(1000 + i) | 1 for i in range(16)], np.uint64)
_powers: dict[str, np.ndarray] = {}


def _power(base: int, n: int, name: str) -> np.ndarray:
    if len(_powers.get(name, ())) < n:
        size = max(n, BLOCK + 1024)
        out = np.full(size, base & _M, np.uint64)
        out[0] = 1
        _powers[name] = np.multiply.accumulate(out)
    return _powers[name][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on unsigned 64-bit values."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def span_hashes(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray, keep: np.ndarray | None = None) -> np.ndarray:
    """Hashes of codes[start:end] for every span; with ``keep``, of the kept codes alone."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    rank = None if keep is None else np.cumsum(keep)
    n = len(codes) + 1
    powers = _power(_P, n, "p")
    values = _CODES[codes] * (powers[: n - 1] if rank is None else powers[rank])
    if keep is not None:
        values[~keep] = 0
    total = np.empty(n, np.uint64)
    total[0] = 0
    np.cumsum(values, out=total[1:])
    back = _power(pow(_P, -1, 1 << 64), n, "inverse")
    return mix((total[ends] - total[starts]) * back[starts if rank is None else rank[starts]])


@dataclass
class Words:
    """Words of rows lo..hi of an array: byte spans in ``data``, hashes, and offsets by row."""

    lo: int
    hi: int
    data: np.ndarray
    rows: np.ndarray  # byte offsets of the rows in data
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    off: np.ndarray
    shape: np.ndarray | None = None

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.off)

    @property
    def row(self) -> np.ndarray:
        return np.repeat(np.arange(self.hi - self.lo), self.counts)


def raw(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string array; a null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    kind = np.int64 if pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type) else np.int32
    _, offsets, data = texts.buffers()
    if offsets is None or not len(texts):
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    off = np.frombuffer(offsets, kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    return np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8), off


def _segment(data: np.ndarray, breaks: np.ndarray, lower: bool, shape: bool) -> tuple[np.ndarray, ...]:
    space = _SPACE[data]
    n = len(data)
    first = np.ones(n, bool)
    first[1:] = space[:-1]
    first[breaks[breaks < n]] = True
    first &= ~space
    last = np.ones(n, bool)
    last[:-1] = space[1:]
    inner = breaks[(breaks > 0) & (breaks <= n)] - 1
    last[inner] = True
    last &= ~space
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    hashes = span_hashes(_LOWER[data] if lower else data, starts, ends)
    shapes = None
    if shape:
        kinds = _SHAPE[data]
        keep = np.ones(n, bool)
        keep[1:] = kinds[1:] != kinds[:-1]
        keep[starts] = True
        shapes = span_hashes(kinds, starts, ends, keep)
    return starts, ends, hashes, shapes


def words(texts: pa.Array, lower: bool = False, shape: bool = False) -> Iterator[Words]:
    """The words of every row, in blocks of whole rows; a row longer than a block is cut at white space inside."""
    data, off = raw(texts)
    n, i = len(off) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + BLOCK, "right")) - 1)
        lo, hi = int(off[i]), int(off[j])
        block, rows = data[lo:hi], off[i : j + 1] - lo
        if hi - lo <= 2 * BLOCK:
            starts, ends, hashes, shapes = _segment(block, rows[:-1], lower, shape)
        else:  # one long row
            parts, at = [], 0
            while at < hi - lo:
                to = min(at + BLOCK, hi - lo)
                while to < hi - lo and not _SPACE[block[to]]:
                    to += 1
                s, e, h, k = _segment(block[at:to], np.zeros(1, np.int64), lower, shape)
                parts.append((s + at, e + at, h, k))
                at = to
            starts, ends, hashes = (np.concatenate([p[k] for p in parts]) for k in range(3))
            shapes = np.concatenate([p[3] for p in parts]) if shape else None
        yield Words(i, j, block, rows, starts, ends, hashes, np.searchsorted(starts, rows), shapes)
        i = j


def combine(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hashes of the runs of ``width`` hashes that begin at each place; the last width-1 places are left out."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = hashes[:n] * COMBINE[0]
    for k in range(1, width):
        out = out + mix(hashes[k : n + k] + COMBINE[k])  # the order counts, by a constant for each place
    return mix(out + np.uint64(width))


def sums(values: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Sums of values[off[i]:off[i+1]] for every i; empty ranges give 0."""
    total = np.zeros(len(values) + 1, values.dtype if values.dtype.kind in "uf" else np.int64)
    np.cumsum(values, out=total[1:])
    return total[off[1:]] - total[off[:-1]]


def shingle_sets(texts: pa.Array, width: int = 5) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct hashes) of the lower-cased word shingles; a text of fewer words gives its whole sequence, no word an empty set."""
    for block in words(texts, lower=True):
        runs = combine(block.hash, width)
        for i in range(block.hi - block.lo):
            a, b = int(block.off[i]), int(block.off[i + 1])
            if b - a >= width:
                yield block.lo + i, np.unique(runs[a : b - width + 1])
            elif b > a:
                yield block.lo + i, combine(block.hash[a:b], b - a)
            else:
                yield block.lo + i, np.zeros(0, np.uint64)
