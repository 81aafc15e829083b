"""Training statistics: spherical moments, time differences, climatology."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def merge_moments(parts: DataFrame, by: list[str]) -> DataFrame:
    """by, w, mean, m2 of ``parts(by, w, mean, m2)``: weights, means and centred squares of disjoint parts.

    The general pairwise update: the spread of the parts' means adds to their own.
    Only differences to the joint mean are squared, so large offsets do not cancel.
    One shuffle, of the parts (a few numbers each).
    """
    group = Window.partitionBy(*by)
    joint = F.sum(F.col("w") * F.col("mean")).over(group) / F.sum("w").over(group)
    d = F.col("mean") - F.col("joint")
    told = parts.withColumn("joint", joint)
    return told.groupBy(*by).agg(F.sum("w").alias("w"), F.max("joint").alias("mean"), F.sum(F.col("m2") + F.col("w") * d * d).alias("m2"))


def row_moments(cells: DataFrame, lat: DataFrame, by: list[str]) -> DataFrame:
    """by, lat_idx, w, mean, m2: one scan, combined map-side; a latitude has one weight, so the
    centred moments of its cells are the plain ones."""
    rows = cells.groupBy(*by, "lat_idx").agg(F.count("*").alias("n"), F.avg("value").alias("mean"), F.var_pop("value").alias("v"))
    w = rows.join(F.broadcast(lat.select("lat_idx", "area_w")), "lat_idx").withColumn("w", F.col("n") * F.col("area_w"))
    return w.select(*by, "lat_idx", "w", "mean", (F.col("w") * F.col("v")).alias("m2"))


def field_moments(fields: DataFrame, area_w: list[float], n_lon: int) -> DataFrame:
    """t_idx, channel_idx, w, mean, m2 of ``fields(t_idx, channel_idx, field)``: a narrow map over row-major arrays."""
    weight = F.lit([w for w in area_w for _ in range(n_lon)]).cast("array<double>")
    pair = F.zip_with("field", weight, lambda x, w: F.struct(x.cast("double").alias("x"), w.alias("w")))
    total = float(sum(area_w)) * n_lon
    mean = F.aggregate(pair, F.lit(0.0), lambda s, p: s + p["w"] * p["x"]) / total
    held = fields.select("t_idx", "channel_idx", pair.alias("pair"), mean.alias("mean"))
    d = lambda p: p["x"] - F.col("mean")
    return held.select("t_idx", "channel_idx", F.lit(total).alias("w"), "mean", F.aggregate("pair", F.lit(0.0), lambda s, p: s + p["w"] * d(p) * d(p)).alias("m2"))


def mean_std(moments: DataFrame, by: list[str]) -> DataFrame:
    return moments.select(*by, "mean", F.sqrt(F.col("m2") / F.col("w")).alias("std"))


def area_moments(cells: DataFrame, lat: DataFrame, by: list[str]) -> DataFrame:
    """by, mean, std: area-weighted, population; NaN poisons its group.  One scan."""
    return mean_std(merge_moments(row_moments(cells, lat, by), by), by)


def slice_moments(cells: DataFrame, lat: DataFrame) -> DataFrame:
    """channel_idx, t_idx, m, v: weighted mean and variance of every slice."""
    keys = ["channel_idx", "t_idx"]
    return merge_moments(row_moments(cells, lat, keys), keys).select(*keys, F.col("mean").alias("m"), (F.col("m2") / F.col("w")).alias("v"))


def two_stage_moments(cells: DataFrame, lat: DataFrame) -> DataFrame:
    """channel_idx, mean, std by the law of total variance over slices.

    Equals the pooled moments when every slice has the same weights; memory does
    not grow with the number of times.
    """
    return slice_moments(cells, lat).groupBy("channel_idx").agg(F.avg("m").alias("mean"), F.sqrt(F.avg("v") + F.var_pop("m")).alias("std"))


def time_difference(cells: DataFrame, step: int) -> DataFrame:
    """x[t + step] - x[t] by position, at t; where there is no t + step there is no row.

    One shuffle: a window over the times of a cell.
    """
    cell = ["channel_idx", "lat_idx", "lon_idx"]
    at = Window.partitionBy(*cell).orderBy("t_idx").rangeBetween(step, step)
    later = F.first(F.struct("value")).over(at)
    return cells.select("t_idx", *cell, "value", later.alias("later")).where("later IS NOT NULL").select("t_idx", *cell, (F.col("later.value") - F.col("value")).alias("value"))


def climatology(cells: DataFrame) -> DataFrame:
    """channel_idx, lat_idx, lon_idx, clim: long-term mean of every cell."""
    return cells.groupBy("channel_idx", "lat_idx", "lon_idx").agg(F.avg("value").alias("clim"))


def profile(cells: DataFrame) -> DataFrame:
    """Unweighted min, max, mean, population std and NaN count per channel; NaN left out."""
    ok = F.when(~F.isnan("value"), F.col("value"))
    return cells.groupBy("channel_idx").agg(
        F.min(ok).alias("min_value"), F.max(ok).alias("max_value"), F.avg(ok).alias("mean_value"), F.stddev_pop(ok).alias("std_value"), F.count_if(F.isnan("value")).alias("n_nan")
    )


def channel_stats(cells: DataFrame, lat: DataFrame, step: int = 1) -> DataFrame:
    """channel_idx, mean, std, diff_mean, diff_std of a training slice."""
    d = area_moments(time_difference(cells, step), lat, ["channel_idx"])
    return area_moments(cells, lat, ["channel_idx"]).join(d.select("channel_idx", F.col("mean").alias("diff_mean"), F.col("std").alias("diff_std")), "channel_idx")


def check_stats(stats: DataFrame) -> DataFrame:
    """Rows whose std is not finite and positive or whose mean is not finite (must be none)."""
    from isobar.functions.scalars import is_finite

    return stats.where(~is_finite(F.col("mean")) | ~is_finite(F.col("std")) | (F.col("std") <= 0))


def benchmark_norms(cells: DataFrame) -> DataFrame:
    """Unweighted mean and sample std per channel, the std at least 1e-6."""
    return cells.groupBy("channel_idx").agg(F.avg("value").alias("mean"), F.greatest(F.stddev_samp("value"), F.lit(1e-6)).alias("std"))
