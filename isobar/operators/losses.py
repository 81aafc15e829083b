"""Training objectives as aggregates over ``pairs(sample_idx, lead, cell, prediction, target)``."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F



def _weighted(pairs: DataFrame, lat: DataFrame) -> DataFrame:
    return pairs.join(F.broadcast(lat.select("lat_idx", "area_w")), "lat_idx").withColumn("e", F.col("prediction") - F.col("target"))


def _combine(per: DataFrame, by: list[str], weights: DataFrame | None, name: str) -> DataFrame:
    """Over channels: the plain mean, or the sum with given weights."""
    if weights is None:
        return per.groupBy(*by).agg(F.avg("x").alias(name))
    return per.join(F.broadcast(weights), "channel_idx").groupBy(*by).agg(F.sum(F.col("weight") * F.col("x")).alias(name))


def area_mse(pairs: DataFrame, lat: DataFrame, by: list[str], weights: DataFrame | None = None) -> DataFrame:
    per = _weighted(pairs, lat).groupBy(*by, "channel_idx").agg(F.avg(F.col("area_w") * F.col("e") * F.col("e")).alias("x"))
    return _combine(per, by, weights, "loss")


def area_l1(pairs: DataFrame, lat: DataFrame, by: list[str]) -> DataFrame:
    return _weighted(pairs, lat).groupBy(*by).agg(F.avg(F.col("area_w") * F.abs("e")).alias("loss"))


def relative_l2(pairs: DataFrame, lat: DataFrame, by: list[str], eps: float = 1e-8) -> DataFrame:
    """by, channel_idx, loss: per sample root ratio of error and truth, averaged over samples."""
    w = _weighted(pairs, lat)
    one = w.groupBy(*by, "sample_idx", "channel_idx").agg(
        (F.sqrt(F.sum(F.col("area_w") * F.col("e") * F.col("e"))) / F.greatest(F.sqrt(F.sum(F.col("area_w") * F.col("target") * F.col("target"))), F.lit(eps))).alias("x")
    )
    return one.groupBy(*by, "channel_idx").agg(F.avg("x").alias("loss"))


def tendency_mse(pairs: DataFrame, lat: DataFrame, scale: DataFrame, weights: DataFrame, by: list[str]) -> DataFrame:
    """Sum over channels of weight times the mean of w (e / scale)^2: the primary objective."""
    r = F.col("e") / F.col("scale")
    per = _weighted(pairs, lat).join(F.broadcast(scale), "channel_idx").groupBy(*by, "channel_idx").agg(F.avg(F.col("area_w") * r * r).alias("x"))
    return _combine(per, by, weights, "loss")


def discounted(losses: DataFrame, discount: float) -> DataFrame:
    g = F.pow(F.lit(discount), F.col("lead") - 1)
    return losses.agg((F.sum(g * F.col("loss")) / F.greatest(F.sum(g), F.lit(1e-8))).alias("loss"))


def spectral(pairs: DataFrame, by: list[str], shape: tuple[int, int], order: int = 1) -> DataFrame:
    """Distance of the planar spectra (orthonormal real FFT), mean over fields.

    Order 2 equals the plain mean squared error.  Fields travel as arrays, one per
    sample, lead and channel, and are transformed in Arrow batches.
    """
    h, w = shape
    keys = [*by, "sample_idx", "channel_idx"]
    field = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("lat_idx", "lon_idx", c))), lambda x: x[c])
    fields = pairs.groupBy(*dict.fromkeys(keys)).agg(field("prediction").alias("p"), field("target").alias("y"))
    twice = np.full(w // 2 + 1, 2.0)
    twice[0] = 1.0
    if w % 2 == 0:
        twice[-1] = 1.0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (batch.column(c).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, h, w) for c in ("p", "y"))
            gap = np.abs(np.fft.rfft2(a, norm="ortho") - np.fft.rfft2(b, norm="ortho")) ** order
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in by), pa.array((gap * twice).sum(axis=(1, 2)) / (h * w))], [*by, "x"])

    kinds = dict(fields.dtypes)
    return fields.mapInArrow(run, ", ".join([*(f"{c} {kinds[c]}" for c in by), "x double"])).groupBy(*by).agg(F.avg("x").alias("loss"))


def combined(pairs: DataFrame, lat: DataFrame, by: list[str], shape: tuple[int, int], spectral_weight: float, weights: DataFrame | None = None) -> DataFrame:
    """Area MSE plus a share of the spectral L1."""
    mse = area_mse(pairs, lat, by, weights)
    if not spectral_weight:
        return mse
    s = spectral(pairs, by, shape, 1).withColumnRenamed("loss", "s")
    return mse.join(s, by).select(*by, (F.col("loss") + spectral_weight * F.col("s")).alias("loss"))
