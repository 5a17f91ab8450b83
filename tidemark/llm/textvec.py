"""Word and shingle hashes of whole Arrow batches of text, as numpy arrays.

A word is a maximal run of bytes other than 0x20 and 0x09-0x0D of the UTF-8 text. A word's hash is a polynomial in
2**64 over random byte codes, taken from running sums, so its cost doesn't depend on word length, and then mixed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text handled at once; one longer document is handled alone.
CHUNK = 1 << 20
U = np.uint64
_rng = np.random.Generator(np.random.PCG64(20240229))
_CODES = _rng.integers(1, 2**63, 256, dtype=np.uint64) * U(2) + U(1)
_LOWER = _CODES.copy()
_LOWER[65:91] = _CODES[97:123]
_P = 0x9E3779B97F4A7C15
_P_INV = pow(_P, -1, 1 << 64)
SPACE = np.zeros(256, bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit integers."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse."""
    if len(_powers[0]) < n:
        n = max(n, CHUNK + 1)
        for i, base in enumerate((_P, _P_INV)):
            steps = np.full(n, U(base))
            steps[0] = U(1)
            _powers[i] = np.multiply.accumulate(steps)
    return _powers[0], _powers[1]


def text_chunks(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Of a string column: (first row, bytes, offsets) of runs of rows with about CHUNK bytes. Null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    if column.null_count:
        lengths = np.where(column.is_null().to_numpy(zero_copy_only=False), 0, np.diff(offsets))
        if (lengths != np.diff(offsets)).any():
            yield from text_chunks(column.fill_null(""))
            return
    row = 0
    while row < len(column):
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + CHUNK, "right")) - 1)
        end = min(end, len(column))
        yield row, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def words(data: np.ndarray, offsets: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, start, end, words before each document) of the words of a chunk."""
    inside = ~SPACE[data]
    before = np.empty(len(data), bool)
    before[:1] = False
    before[1:] = inside[:-1]
    first = offsets[:-1][np.diff(offsets) > 0]
    before[first] = False
    start = np.flatnonzero(inside & ~before)
    after = np.empty(len(data), bool)
    after[-1:] = False
    after[:-1] = inside[1:]
    last = offsets[1:][np.diff(offsets) > 0] - 1
    after[last] = False
    end = np.flatnonzero(inside & ~after) + 1
    p, inverse = powers(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((_LOWER if lower else _CODES)[data] * p[: len(data)], out=total[1:])
    h = mix((total[end] - total[start]) * inverse[start] + (end - start).astype(np.uint64))
    return h, start, end, np.searchsorted(start, offsets)


def ngrams(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the n-grams that start at each word but the last n-1, whatever document they lie in."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(h) - n + 1, np.uint64)
    for k in range(n):
        out += h[k : len(h) - n + 1 + k] * U(pow(0xD6E8FEB86659FD93, k + 1, 1 << 64))
    return mix(out + U(n))


def shingle_sets(column: pa.Array, n: int) -> Iterator[np.ndarray]:
    """For each row the sorted distinct hashes of its n-word shingles; with fewer words, of its whole sequence."""
    for _, data, offsets in text_chunks(column):
        h, _, _, at = words(data, offsets)
        grams = ngrams(h, n)
        for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
            if b - a >= n:
                s = np.sort(grams[a : b - n + 1])
                yield s[np.concatenate(([True], s[1:] != s[:-1]))]
            else:
                yield ngrams(h[a:b], b - a) if b > a else np.zeros(0, np.uint64)
