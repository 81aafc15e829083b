"""Selection: date ranges, splits, strides, crops, samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Logical splits, inclusive days.
SPLITS = {"train": ("1995-01-01", "2018-12-31"), "valid": ("2019-01-01", "2019-12-31"), "test": ("2020-01-01", "2020-12-31")}


def _bound(text: str) -> Column:
    return F.lit(text).cast("timestamp_ntz")


def date_slice(df: DataFrame, start: str | None, end: str | None, column: str = "ts") -> DataFrame:
    """Both ends inclusive at the granularity written: a bare end date takes the whole day."""
    if start is not None:
        df = df.where(F.col(column) >= _bound(start))
    if end is not None:
        day = len(end) <= 10
        df = df.where(F.col(column) < _bound(end) + F.expr("interval 1 day") if day else F.col(column) <= _bound(end))
    return df


def split_range(name: str) -> tuple[str, str]:
    if name not in SPLITS:
        raise ValueError(f"unknown split {name!r}")
    return SPLITS[name]


def split_of(ts: Column, train_end: str, valid_end: str) -> Column:
    """train / valid / test by instants; a bare date ends at 23:59:59."""
    last = lambda e: _bound(e if len(e) > 10 else f"{e} 23:59:59")
    return F.when(ts <= last(train_end), "train").when(ts <= last(valid_end), "valid").otherwise("test")


def split_by_fraction(t_idx: Column, n: Column) -> Column:
    """60 % train, 20 % valid, 20 % test by position."""
    return F.when(t_idx * 10 < F.floor(n * 6 / 10) * 10, "train").when(t_idx * 10 < F.floor(n * 8 / 10) * 10, "valid").otherwise("test")


def time_stride(df: DataFrame, step: int) -> DataFrame:
    return df.where(F.col("t_idx") % step == 0)


def crop(df: DataFrame, h: int, w: int) -> DataFrame:
    """The leading h x w rectangle."""
    if h < 1 or w < 1:
        raise ValueError("a crop needs at least one row and column")
    return df.where((F.col("lat_idx") < h) & (F.col("lon_idx") < w))


def subsample(df: DataFrame, lat_step: int, lon_step: int) -> DataFrame:
    """Every lat_step-th latitude and lon_step-th longitude, renumbered."""
    kept = df.where((F.col("lat_idx") % lat_step == 0) & (F.col("lon_idx") % lon_step == 0))
    return kept.withColumns({"lat_idx": F.floor(F.col("lat_idx") / lat_step).cast("int"), "lon_idx": F.floor(F.col("lon_idx") / lon_step).cast("int")})


def pick_levels(df: DataFrame, levels: DataFrame) -> DataFrame:
    """Rows of the requested ``levels(ordinal, pressure_hpa)``, in that order's ordinal."""
    return df.join(F.broadcast(levels), "pressure_hpa")


def valid_windows(total: int, history: int, rollout: int, step: int, targets: bool = True) -> int:
    n = total - history * step - (rollout * step if targets else 0)
    if n <= 0:
        raise ValueError("no valid window")
    return n


def first_samples(df: DataFrame, n: int) -> DataFrame:
    return df.where(F.col("sample_idx") < n)


def evenly_spaced(spark, valid: int, n: int) -> DataFrame:
    """sample_idx of n windows spread over 0..valid-1, truncated like an integer linspace."""
    n = min(n, valid)
    i = F.col("id").cast("double")
    at = F.floor(i * ((valid - 1) / max(n - 1, 1)))
    last = F.when((F.col("id") == n - 1) & F.lit(n > 1), F.lit(valid - 1)).otherwise(at)
    return spark.range(n).select(F.col("id").alias("ordinal"), last.cast("long").alias("sample_idx"))


def shuffle_order(df: DataFrame, seed: int, epoch: int) -> DataFrame:
    """A reproducible permutation of the windows of an epoch."""
    return df.orderBy(F.xxhash64(F.lit(seed), F.lit(epoch), "sample_idx"), "sample_idx")
