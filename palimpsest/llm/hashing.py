"""64-bit hashes of words and of runs of words, for whole Arrow batches at a time.

A word's hash is a polynomial in its bytes modulo 2**64, read off one running sum over the batch, and mixed. Hashes of runs are
polynomials in word hashes, mixed again. seed: another gives an independent hash.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

U = np.uint64


def mixed(x: np.ndarray) -> np.ndarray:
    """A permutation of 64-bit words that spreads every bit (the finalizer of MurmurHash3)."""
    x = x ^ (x >> U(33))
    x = x * U(0xFF51AFD7ED558CCD)
    x = x ^ (x >> U(33))
    x = x * U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U(33))


@lru_cache(8)
def _tables(seed: int, lower: bool) -> tuple[np.ndarray, np.ndarray, int, int]:
    """A value for each byte, which bytes separate words, the base and its inverse."""
    rng = np.random.default_rng(1234 + seed)
    value = rng.integers(1, 1 << 63, 256, dtype=np.uint64) | U(1)
    if lower:
        value[65:91] = value[97:123]
    separates = np.zeros(256, bool)
    separates[[0x20, *range(0x09, 0x0E)]] = True
    base = int(rng.integers(1 << 62, 1 << 63)) // 8 * 8 + 5
    return value, separates, base, pow(base, -1, 1 << 64)


@lru_cache(8)
def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, U)
    out[0] = 1
    return np.cumprod(out, dtype=U)


def powers(base: int, n: int) -> np.ndarray:
    return _powers(base, 1 << max(4, n.bit_length()))[:n]


def text_slices(column: pa.StringArray, most: int = 1 << 19) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs (from, to) of a column's rows with about so many bytes each, their bytes, and where each row starts in them, the end included."""
    column = column.cast(pa.string()) if column.type != pa.string() else column
    n = len(column)
    if not n:
        return
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data else np.empty(0, np.uint8)
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
        to = min(to, n)
        yield at, to, data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to


def word_spans(data: np.ndarray, starts: np.ndarray, lower: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First byte and end of each word, and the number of words in each row."""
    _, separates, _, _ = _tables(0, lower)
    inside = ~separates[data]
    fresh = np.zeros(len(data) + 1, bool)
    fresh[starts] = True
    before = np.concatenate(([False], inside[:-1])) if len(data) else inside
    after = np.concatenate((inside[1:], [False])) if len(data) else inside
    first = np.flatnonzero(inside & (~before | fresh[:-1]))
    end = np.flatnonzero(inside & (~after | fresh[1:])) + 1
    return first, end, np.diff(np.searchsorted(first, starts))


def word_hashes(data: np.ndarray, first: np.ndarray, end: np.ndarray, lower: bool = False, seed: int = 0) -> np.ndarray:
    value, _, base, inverse = _tables(seed, lower)
    if not len(first):
        return np.empty(0, U)
    sums = np.concatenate((np.zeros(1, U), np.cumsum(value[data] * powers(base, len(data)), dtype=U)))
    return mixed((sums[end] - sums[first]) * powers(inverse, len(data))[first])


def run_hashes(words: np.ndarray, k: int, seed: int = 0) -> np.ndarray:
    """Hashes of all runs of k words; there are k - 1 fewer than words."""
    n = len(words) - k + 1
    if n <= 0:
        return np.empty(0, U)
    _, _, base, _ = _tables(seed + 100, False)
    p = powers(base, k)
    out = words[:n] * p[0]
    for i in range(1, k):
        out += words[i : i + n] * p[i]
    return mixed(out)


def rows_of_runs(counts: np.ndarray, k: int) -> np.ndarray:
    """Places, among all runs of k words of a batch, of those that lie within one row."""
    own = np.maximum(counts - k + 1, 0)
    first = np.cumsum(counts) - counts
    return np.arange(int(own.sum())) + np.repeat(first - (np.cumsum(own) - own), own)
