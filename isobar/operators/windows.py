"""History and target windows as index tables; states are joined lazily."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def window_index(starts: DataFrame, history: int, rollout: int, step: int) -> DataFrame:
    """``starts(sample_idx, base_t)`` -> sample_idx, base_t, role, k, t_idx.

    role input: k = -history..0, oldest first; role target: k = 1..rollout.
    """
    k = F.explode(F.sequence(F.lit(-history), F.lit(rollout)))
    return starts.select("sample_idx", "base_t", k.alias("k")).select(
        "sample_idx", "base_t", F.when(F.col("k") <= 0, "input").otherwise("target").alias("role"), "k", (F.col("base_t") + F.col("k") * step).cast("long").alias("t_idx")
    )


def starts(spark, valid: int, history: int, step: int) -> DataFrame:
    """sample_idx, base_t of all consecutive windows."""
    return spark.range(valid).select(F.col("id").alias("sample_idx"), (F.col("id") + history * step).alias("base_t"))


def stacked_inputs(index: DataFrame, cells: DataFrame, history: int, channels: int) -> DataFrame:
    """Inputs with history stacked on the channel axis, oldest first."""
    rows = index.where("role = 'input'").join(cells, "t_idx")
    return rows.select("sample_idx", ((F.col("k") + history) * channels + F.col("channel_idx")).cast("int").alias("channel_idx"), "lat_idx", "lon_idx", "value")


def targets(index: DataFrame, cells: DataFrame, lead: int | None = None) -> DataFrame:
    """sample_idx, lead and truth; one lead only when asked, so truth is never replicated."""
    rows = index.where("role = 'target'")
    if lead is not None:
        rows = rows.where(F.col("k") == lead)
    return rows.join(cells, "t_idx").select("sample_idx", F.col("k").alias("lead"), "channel_idx", "lat_idx", "lon_idx", "value")


def batches(index: DataFrame, size: int) -> DataFrame:
    """Adds batch = floor(sample_idx / size)."""
    return index.withColumn("batch", F.floor(F.col("sample_idx") / size))
