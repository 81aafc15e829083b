"""Normalisation and channel weighting."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from isobar.schema import PRESSURE_VARIABLES, SURFACE_WEIGHTS


def normalize(cells: DataFrame, stats: DataFrame) -> DataFrame:
    """value becomes (value - mean) / std of its channel."""
    return cells.join(F.broadcast(stats.select("channel_idx", "mean", "std")), "channel_idx").withColumn("value", (F.col("value") - F.col("mean")) / F.col("std")).drop("mean", "std")


def denormalize(cells: DataFrame, stats: DataFrame) -> DataFrame:
    return cells.join(F.broadcast(stats.select("channel_idx", "mean", "std")), "channel_idx").withColumn("value", F.col("value") * F.col("std") + F.col("mean")).drop("mean", "std")


def normalized_climatology(clim: DataFrame, stats: DataFrame) -> DataFrame:
    return clim.join(F.broadcast(stats.select("channel_idx", "mean", "std")), "channel_idx").select("channel_idx", "lat_idx", "lon_idx", ((F.col("clim") - F.col("mean")) / F.col("std")).alias("clim"))


def tendency_scale(stats: DataFrame) -> DataFrame:
    """channel_idx, scale: std of the time difference over std of the state."""
    return stats.select("channel_idx", (F.col("diff_std") / F.col("std")).alias("scale"))


def _surface(channel):
    out = F.lit(None).cast("double")
    for name, w in SURFACE_WEIGHTS.items():
        out = F.when(channel == name, w).otherwise(out)
    return out


def _unit_sum(df: DataFrame) -> DataFrame:
    return df.select("channel_idx", (F.col("w") / F.sum("w").over(Window.partitionBy())).alias("weight"))


def balanced_weights(channels: DataFrame) -> DataFrame:
    """Fixed surface weights; each upper-air variable shares 1 over its levels by pressure; sum 1.

    An unknown channel or a pressure that is not positive gives an error.
    """
    share = F.col("pressure_hpa") / F.sum("pressure_hpa").over(Window.partitionBy("variable"))
    known = F.col("variable").isin(*PRESSURE_VARIABLES) & (F.col("pressure_hpa") > 0)
    bad = F.raise_error(F.concat(F.lit("no weight for channel "), F.col("channel"))).cast("double")
    return _unit_sum(channels.select("channel_idx", F.coalesce(_surface(F.col("channel")), F.when(known, share).otherwise(bad)).alias("w")))


def legacy_weights(channels: DataFrame, stats: DataFrame | None = None, eps: float = 1e-6) -> DataFrame:
    """Surface weights, 0.001 per hPa aloft, 0.01 for anything else; sum 1.

    With statistics (channel_idx, std, diff_std) each is scaled by std over
    the difference's std (at least eps), without normalising again.
    """
    aloft = F.when(F.col("variable").isin(*PRESSURE_VARIABLES) & (F.col("pressure_hpa") > 0), 0.001 * F.col("pressure_hpa"))
    out = _unit_sum(channels.select("channel_idx", F.coalesce(_surface(F.col("channel")), aloft, F.lit(0.01)).alias("w")))
    if stats is None:
        return out
    return out.join(F.broadcast(stats), "channel_idx").select("channel_idx", (F.col("weight") * F.col("std") / F.greatest(F.col("diff_std"), F.lit(eps))).alias("weight"))


def constant_weights(channels: DataFrame) -> DataFrame:
    return channels.select("channel_idx", (F.lit(1.0) / F.count("*").over(Window.partitionBy())).alias("weight"))


def add_noise(cells: DataFrame, std: float, seed: int) -> DataFrame:
    """Gaussian input noise (training inputs only): a function of cell and seed, however rows are partitioned."""
    keys = [c for c in ("sample_idx", "t_idx", "channel_idx", "lat_idx", "lon_idx") if c in cells.columns]
    unit = lambda k: (F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.lit(k), *keys), 11).cast("double") + 0.5) / float(1 << 53)
    normal = F.sqrt(-2 * F.log(unit(0))) * F.cos(2 * F.pi() * unit(1))  # Box-Muller
    return cells.withColumn("value", F.col("value") + std * normal)
