"""Vectorised word and shingle hashing over Arrow batches.

Words are maximal runs of bytes other than space and U+0009..U+000D, after
A-Z is lower-cased; everything else is kept as it is.  All work happens on the
UTF-8 bytes of a chunk of documents at once, so the per-word cost is a few
numpy passes and no Python loop over words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

SHINGLE = 5
_CHUNK_BYTES = 1 << 18

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True

_RNG = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _RNG.integers(1, 2**64, 256, dtype=np.uint64)[_LOWER] | np.uint64(1)
_SLOT = _RNG.integers(1, 2**64, SHINGLE, dtype=np.uint64) | np.uint64(1)
_COUNT = _RNG.integers(1, 2**64, SHINGLE + 1, dtype=np.uint64)
_BASE = 0x9E3779B97F4A7C15
_BASE_INV = pow(_BASE, -1, 2**64)
_powers: list[np.ndarray] = []


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power_tables(n: int) -> list[np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, at least n long."""
    global _powers
    if not _powers or len(_powers[0]) < n:
        size = 1 << max(16, int(n - 1).bit_length())
        tables = []
        for base in (_BASE, _BASE_INV):
            table = np.full(size, base, dtype=np.uint64)
            table[0] = 1
            np.multiply.accumulate(table, out=table)
            tables.append(table)
        _powers = tables
    return _powers


def _chunks(values: list[bytes]) -> Iterator[list[bytes]]:
    chunk, size = [], 0
    for v in values:
        if chunk and size + len(v) > _CHUNK_BYTES:
            yield chunk
            chunk, size = [], 0
        chunk.append(v)
        size += len(v) + 1
    if chunk:
        yield chunk


def _shingles(chunk: list[bytes]) -> Iterator[np.ndarray]:
    data = np.frombuffer(b"\n".join(chunk) + b"\n", dtype=np.uint8)
    first = np.cumsum([0] + [len(v) + 1 for v in chunk])[:-1]
    gap = _SPACE[data]
    edge = np.flatnonzero(np.diff(gap, prepend=True))
    start, end = edge[0::2], edge[1::2]
    power, inverse = _power_tables(len(data) + 1)
    total = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_BYTE[data] * power[: len(data)], out=total[1:])
    word = mix((total[end] - total[start]) * inverse[start])
    at = np.searchsorted(start, np.append(first, len(data)))
    full = np.zeros(max(0, len(word) - SHINGLE + 1), dtype=np.uint64)
    for k in range(SHINGLE):
        full += word[k : k + len(full)] * _SLOT[k]
    full = mix(full + _COUNT[SHINGLE])
    for lo, hi in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        n = hi - lo
        if n >= SHINGLE:
            yield np.unique(full[lo : hi - SHINGLE + 1])
        elif n:
            yield mix((word[lo:hi] * _SLOT[:n]).sum(keepdims=True, dtype=np.uint64) + _COUNT[n])
        else:
            yield np.zeros(0, dtype=np.uint64)


def shingle_sets(texts: list[str | None]) -> Iterator[np.ndarray]:
    """For each text its sorted distinct 64-bit shingle hashes.

    A text of fewer than five words is one shingle (the whole sequence); a
    null text or one without words has none.
    """
    for chunk in _chunks([b"" if t is None else t.encode("utf-8", "surrogatepass") for t in texts]):
        yield from _shingles(chunk)
