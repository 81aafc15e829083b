"""Spherical harmonic analysis, synthesis and filters of pole-to-pole grids.

Coefficients are those of orthonormal harmonics with the Condon-Shortley phase.
Longitudes are transformed by FFT, latitudes by Clenshaw-Curtis quadrature
with the normalised Legendre functions of one order at a time, so a task needs memory
for a batch of fields, not for all degrees times orders times latitudes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def quadrature(n: int) -> np.ndarray:
    """Clenshaw-Curtis weights of n colatitudes from pole to pole; they sum to 2."""
    if n < 3:
        raise ValueError("needs at least three latitudes")
    k, top = np.arange(n), n - 1
    j = np.arange(1, top // 2 + 1)
    share = np.where(2 * j == top, 1.0, 2.0) / (4.0 * j * j - 1)
    inner = 1 - (share * np.cos(2 * np.pi * np.outer(k, j) / top)).sum(axis=1)
    return np.where((k == 0) | (k == top), 1.0, 2.0) / top * inner


def legendre(lats: int, degrees: int) -> Iterator[np.ndarray]:
    """For every order m: the functions of degrees m to degrees - 1 at the colatitudes."""
    theta = np.pi * np.arange(lats) / (lats - 1)
    x, s = np.cos(theta), np.sin(theta)
    sectoral = np.full(lats, math.sqrt(1 / (4 * math.pi)))
    for m in range(degrees):
        if m:
            sectoral = -math.sqrt(1 + 1 / (2 * m)) * s * sectoral
        out = [sectoral]
        for l in range(m + 1, degrees):  # noqa: E741
            a = math.sqrt((4 * l * l - 1) / (l * l - m * m))
            b = math.sqrt(((l - 1) ** 2 - m * m) / (4 * (l - 1) ** 2 - 1)) if l > m + 1 else 0.0
            out.append(a * (x * out[-1] - b * (out[-2] if l > m + 1 else 0.0)))
        yield np.array(out)


def _transform(x: np.ndarray, table: list[np.ndarray]) -> list[np.ndarray]:
    """By order m the coefficients (fields x degrees from m) of ``x`` (fields x latitudes x longitudes).

    The quadrature sees a field's departure from the middle of its range: a constant
    field departs by nothing at all, and large levels do not wash out small waves.  The
    level itself is a multiple of the first harmonic, which it is added to.
    """
    weights = 2 * math.pi * quadrature(x.shape[1])
    level = (x.max(axis=(1, 2)) + x.min(axis=(1, 2))) / 2
    waves = np.fft.rfft(x - level[:, None, None], norm="forward")
    out = [np.einsum("nk,lk->nl", waves[:, :, m] * weights, p) for m, p in enumerate(table)]
    out[0][:, 0] += level / table[0][0, 0]
    return out


def _inverse(coefficients: list[np.ndarray], table: list[np.ndarray], w: int) -> np.ndarray:
    """Fields x latitudes x longitudes from coefficients by order; higher orders are nought."""
    waves = np.zeros((len(coefficients[0]), table[0].shape[1], w // 2 + 1), complex)
    for m, (c, p) in enumerate(zip(coefficients, table, strict=True)):
        waves[:, :, m] = c @ p
    return np.fft.irfft(waves, n=w, norm="forward")


def _stacked(batch: pa.RecordBatch, shape: tuple[int, int]) -> np.ndarray:
    return batch.column("field").flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, *shape)


def _degrees(shape: tuple[int, int], degrees: int | None) -> int:
    degrees = shape[0] if degrees is None else degrees
    if not 1 <= degrees <= shape[0]:
        raise ValueError("degrees must lie between 1 and the number of latitudes")
    return degrees


def analyse(fields: DataFrame, shape: tuple[int, int], degrees: int | None = None) -> DataFrame:
    """``fields(t_idx, channel_idx, field)`` -> t_idx, channel_idx, l, m, re, im (m >= 0).

    A constant field has exactly one non-zero coefficient whatever its size.  Degrees:
    all that the latitudes hold, unless fewer are asked for; orders end where the
    longitudes do.
    """
    degrees = _degrees(shape, degrees)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = list(islice(legendre(shape[0], degrees), shape[1] // 2 + 1))  # once a task
        for batch in batches:
            x = _stacked(batch, shape)
            for m, c in enumerate(_transform(x, table) if len(x) else []):
                row = pa.array(np.repeat(np.arange(len(x)), degrees - m))
                degree = np.tile(np.arange(m, degrees, dtype=np.int32), len(x))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("t_idx").take(row), batch.column("channel_idx").take(row), pa.array(degree), pa.array(np.full(len(degree), m, np.int32)), pa.array(c.real.ravel()), pa.array(c.imag.ravel())],
                    ["t_idx", "channel_idx", "l", "m", "re", "im"],
                )

    return fields.select("t_idx", "channel_idx", "field").mapInArrow(run, "t_idx long, channel_idx int, l int, m int, re double, im double")


def filtered(fields: DataFrame, shape: tuple[int, int], multipliers: Sequence[float]) -> DataFrame:
    """``fields(..., field)`` with the part of degree l multiplied by ``multipliers[l]``, beyond them by nought.

    Analysis, a number per degree, and synthesis in one narrow map: coefficients are
    never rows.  Ones keep a field of these degrees as it is, up to half the number of
    latitudes (the quadrature is exact there); a smoothing or a Laplacian
    (``-l (l + 1)``) is a list of numbers.  Other columns stay.
    """
    degrees = _degrees(shape, len(multipliers))
    others = [c for c in fields.columns if c != "field"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = list(islice(legendre(shape[0], degrees), shape[1] // 2 + 1))
        factor = np.asarray(multipliers, float)
        size = shape[0] * shape[1]
        for batch in batches:
            x = _stacked(batch, shape)
            if len(x):
                x = _inverse([c * factor[m:] for m, c in enumerate(_transform(x, table))], table, shape[1])
            out = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * size), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in others), out], [*others, "field"])

    told = fields.select(*others, "field")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in told.schema.fields if f.name != "field")
    return told.mapInArrow(run, f"{kinds}, field array<double>")


def synthesise(coefficients: DataFrame, shape: tuple[int, int]) -> DataFrame:
    """``coefficients(t_idx, channel_idx, l, m, re, im)`` -> t_idx, channel_idx, field.

    One exchange brings a field's coefficients together (at most as many as it has
    cells).  Coefficients that are not given are nought; one given twice counts twice.
    """
    own = F.collect_list(F.struct("l", "m", "re", "im")).alias("c")
    rows = coefficients.groupBy("t_idx", "channel_idx").agg(own)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h, w = shape
        table = list(islice(legendre(h, h), w // 2 + 1))
        for batch in batches:
            out = []
            for told in batch.column("c").to_pylist():
                c = [np.zeros((1, h - m), complex) for m in range(len(table))]
                for x in told:
                    c[x["m"]][0, x["l"] - x["m"]] += complex(x["re"], x["im"])
                out.append(_inverse(c, table, w).ravel().tolist())
            yield pa.RecordBatch.from_arrays([batch.column("t_idx"), batch.column("channel_idx"), pa.array(out, pa.list_(pa.float64()))], ["t_idx", "channel_idx", "field"])

    return rows.mapInArrow(run, "t_idx long, channel_idx int, field array<double>")
