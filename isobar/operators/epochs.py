"""The order of training windows in an epoch, without a sort.

A keyed permutation of window numbers turns a position into a window in constant
time and memory, so any part of an epoch (a rank's share, the rest of an interrupted
run) is made on its own, from its positions alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

_ROUNDS = 6


def _scramble(x: np.ndarray, key: int) -> np.ndarray:
    x = (x + np.uint64(key)) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def permuted(positions: np.ndarray, n: int, seed: int, epoch: int) -> np.ndarray:
    """Where each of the positions 0 <= p < n goes: a permutation of them chosen by seed and epoch.

    A Feistel network permutes the numbers of 2 k bits, of which there are less than
    4 n; a result beyond n is sent through again until it lies within (cycle walking,
    two or three times on average).
    """
    return _walked(positions, n, seed, epoch, False)


def position_of(windows: np.ndarray, n: int, seed: int, epoch: int) -> np.ndarray:
    """The inverse of ``permuted``: the positions that go to the windows 0 <= w < n."""
    return _walked(windows, n, seed, epoch, True)


def _walked(numbers: np.ndarray, n: int, seed: int, epoch: int, back: bool) -> np.ndarray:
    if n < 1:
        raise ValueError("nothing to permute")
    half = np.uint64(max(1, (int(n - 1).bit_length() + 1) // 2))
    mask = (np.uint64(1) << half) - np.uint64(1)
    with np.errstate(over="ignore"):
        keys = [int(k) for k in _scramble(np.arange(1, _ROUNDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed % 2**64) * np.uint64(31), epoch % 2**63)]
        out = np.asarray(numbers, np.uint64).copy()
        todo = np.arange(len(out))
        while len(todo):
            left, right = out[todo] >> half, out[todo] & mask
            for key in reversed(keys) if back else keys:
                if back:
                    left, right = right ^ (_scramble(left, key) & mask), left
                else:
                    left, right = right, left ^ (_scramble(right, key) & mask)
            out[todo] = left << half | right
            todo = todo[out[todo] >= n]
    return out.astype(np.int64)


def epoch_order(spark: SparkSession, n: int, seed: int, epoch: int, rank: int = 0, ranks: int = 1, done: int = 0) -> DataFrame:
    """position, sample_idx of the windows that ``rank`` of ``ranks`` takes in an epoch, from its ``done``-th on.

    A rank takes every ``ranks``-th position; together they take each window once.
    No exchange, and no row for what is not asked for.
    """
    if not 0 <= rank < ranks or done < 0:
        raise ValueError("needs 0 <= rank < ranks and done >= 0")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.column("id")
            yield pa.RecordBatch.from_arrays([at, pa.array(permuted(at.to_numpy(zero_copy_only=False), n, seed, epoch))], ["position", "sample_idx"])

    return spark.range(rank + done * ranks, max(n, rank + done * ranks), ranks).mapInArrow(run, "position long, sample_idx long")
