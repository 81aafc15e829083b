"""Autoregressive forecasts with pluggable forecasters.

A forecaster maps the newest states of every sample to the next one.  The
closed forms (``rollout``) need one join for all leads; ``rollout_steps`` runs any
forecaster lead by lead, each lead cut with ``checkpoint`` when asked.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CELL = ["sample_idx", "channel_idx", "lat_idx", "lon_idx"]


class Forecaster(Protocol):
    """state(sample_idx, channel_idx, lat_idx, lon_idx, now, before) -> same keys and ``next``."""

    def __call__(self, state: DataFrame) -> DataFrame: ...


def persistence_step(state: DataFrame) -> DataFrame:
    return state.withColumn("next", F.col("now"))


def linear_step(state: DataFrame) -> DataFrame:
    return state.withColumn("next", 2 * F.col("now") - F.col("before"))


def climatology_step(clim: DataFrame) -> Forecaster:
    return lambda state: state.join(clim, ["channel_idx", "lat_idx", "lon_idx"]).withColumn("next", F.col("clim")).drop("clim")


def residual_step(tendency: Callable[[DataFrame], DataFrame], scale: DataFrame) -> Forecaster:
    """now + tendency * scale of the channel; ``tendency`` adds a column of that name."""
    return lambda state: tendency(state).join(F.broadcast(scale), "channel_idx").withColumn("next", F.col("now") + F.col("tendency") * F.col("scale")).drop("tendency", "scale")


def arrow_step(function: Callable) -> Forecaster:
    """A user function over Arrow batches of (keys, now, before) that appends ``next``."""
    schema = "sample_idx long, channel_idx int, lat_idx int, lon_idx int, now double, before double, next double"
    return lambda state: state.select(*CELL, "now", "before").mapInArrow(function, schema)


def initial_state(starts: DataFrame, cells: DataFrame, step: int = 1) -> DataFrame:
    """The last two observed states of every sample."""
    value = lambda name: cells.select("t_idx", "channel_idx", "lat_idx", "lon_idx", F.col("value").alias(name))
    now = F.broadcast(starts.select("sample_idx", "base_t")).join(value("now"), F.col("base_t") == F.col("t_idx")).drop("t_idx")
    back = value("before").withColumn("base_t", F.col("t_idx") + step).drop("t_idx")
    return now.join(back, ["base_t", "channel_idx", "lat_idx", "lon_idx"], "left").select(*CELL, "base_t", "now", "before")


def rollout(initial: DataFrame, model: str, leads: int, clim: DataFrame | None = None) -> DataFrame:
    """model, sample_idx, base_t, lead, cell, prediction: the closed form of a built-in model."""
    rows = initial.withColumn("lead", F.explode(F.sequence(F.lit(1), F.lit(leads))))
    if model == "persistence":
        value = F.col("now")
    elif model == "linear_tendency":
        value = F.col("now") + F.col("lead") * (F.col("now") - F.col("before"))
    elif model == "climatology":
        rows, value = rows.join(clim, ["channel_idx", "lat_idx", "lon_idx"]), F.col("clim")
    else:
        raise ValueError(f"unknown model {model!r}")
    return rows.select(F.lit(model).alias("model"), "sample_idx", "base_t", "lead", "channel_idx", "lat_idx", "lon_idx", value.alias("prediction"))


def rollout_steps(initial: DataFrame, forecaster: Forecaster, leads: int, model: str = "custom", checkpoint: bool = False) -> DataFrame:
    """The same table from any forecaster: each prediction becomes the newest state."""
    state, out = initial, None
    for lead in range(1, leads + 1):
        stepped = forecaster(state)
        if checkpoint:
            stepped = stepped.checkpoint()
        rows = stepped.select(F.lit(model).alias("model"), *CELL, F.lit(lead).alias("lead"), F.col("next").alias("prediction"))
        out = rows if out is None else out.unionByName(rows)
        state = stepped.select(*CELL, F.col("next").alias("now"), F.col("now").alias("before"))
    return out.join(F.broadcast(initial.select("sample_idx", "base_t").distinct()), "sample_idx")


def paired(forecast: DataFrame, cells: DataFrame, step: int = 1) -> DataFrame:
    """The forecast with the truth at its valid time (inner: targets must exist)."""
    truth = cells.select(F.col("t_idx").alias("valid_t"), "channel_idx", "lat_idx", "lon_idx", F.col("value").alias("target"))
    return forecast.withColumn("valid_t", F.col("base_t") + F.col("lead") * step).join(truth, ["valid_t", "channel_idx", "lat_idx", "lon_idx"])
