"""The relational part of training a forecaster.

Gradients, norms and losses are long tables, so balancing, clipping and fitting are
aggregates.  ``fit_tendency`` trains the linear forecaster in one pass of
sums: its memory does not grow with the number of states.
"""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from isobar.functions.scalars import differences, is_finite
from isobar.operators.forecast import Forecaster
from isobar.sources.publish import Folder


def balanced_gradients(gradients: DataFrame, eps: float = 1e-5) -> DataFrame:
    """``gradients(sample_idx, channel_idx, lat_idx, lon_idx, value)`` with every channel of a
    sample scaled inversely to its norm; the factors of a sample average to one.

    The norms are aggregated before the share is taken, so no task holds a field.
    """
    if eps <= 0:
        raise ValueError("eps must be positive")
    inverse = gradients.groupBy("sample_idx", "channel_idx").agg((1 / F.greatest(F.sqrt(F.sum(F.col("value") ** 2)), F.lit(eps))).alias("inverse"))
    sample = Window.partitionBy("sample_idx")
    factor = F.count("*").over(sample) * F.col("inverse") / F.greatest(F.sum("inverse").over(sample), F.lit(eps))
    scaled = gradients.join(inverse.select("sample_idx", "channel_idx", factor.alias("factor")), ["sample_idx", "channel_idx"])
    return scaled.withColumn("value", F.col("value") * F.col("factor")).drop("factor")


def global_norm(parameters: DataFrame) -> DataFrame:
    """The Euclidean norm over all rows of ``parameters(value)``; 0 without rows."""
    return parameters.agg(F.sqrt(F.coalesce(F.sum(F.col("value") ** 2), F.lit(0.0))).alias("norm"))


def clip_statistics(updates: DataFrame, limit: float) -> DataFrame:
    """Of ``updates(epoch, norm)``: per epoch the mean and largest norm before clipping,
    the share above ``limit`` and the number of non-finite norms, which take no other part."""
    good = is_finite(F.col("norm"))
    n = F.count_if(good)
    norm = F.when(good, F.col("norm"))
    share = lambda x: F.coalesce(x / F.greatest(n, F.lit(1)), F.lit(0.0))
    return updates.groupBy("epoch").agg(
        n.alias("measured"),
        share(F.sum(norm)).alias("mean_norm"),
        F.coalesce(F.max(norm), F.lit(0.0)).alias("max_norm"),
        share(F.count_if(good & (F.col("norm") > limit))).alias("clip_fraction"),
        F.count_if(~good).alias("non_finite"),
    )


def tendencies(cells: DataFrame, step: int = 1) -> DataFrame:
    """Cells with ``x = v[t] - v[t-step]`` and ``y = v[t+step] - v[t]``, where both exist."""
    keys = ["t_idx", "channel_idx", "lat_idx", "lon_idx"]
    cell = Window.partitionBy(*keys[1:]).orderBy("t_idx")  # one shuffle for both neighbours
    near = {f"{n}{i}": F.lag(c, by).over(cell) for c, n in (("value", "v"), ("t_idx", "t")) for i, by in ((0, step), (1, -step))}
    both = cells.select(*keys, "value").withColumns(near).where((F.col("t0") == F.col("t_idx") - step) & (F.col("t1") == F.col("t_idx") + step))
    return both.select(*keys, (F.col("value") - F.col("v0")).alias("x"), (F.col("v1") - F.col("value")).alias("y"))


def fit_tendency(cells: DataFrame, lat: DataFrame, step: int = 1) -> DataFrame:
    """channel_idx, slope, n: the area-weighted least-squares slope of the next tendency on
    the last one.  A channel that never changes has slope 0."""
    weighted = tendencies(cells, step).join(F.broadcast(lat.select("lat_idx", "area_w")), "lat_idx")
    sums = weighted.groupBy("channel_idx").agg(
        F.sum(F.col("area_w") * F.col("x") * F.col("y")).alias("xy"), F.sum(F.col("area_w") * F.col("x") ** 2).alias("xx"), F.count("*").alias("n")
    )
    return sums.select("channel_idx", F.when(F.col("xx") > 1e-12, F.try_divide("xy", "xx")).otherwise(F.lit(0.0)).alias("slope"), "n")


def tendency_step(model: DataFrame) -> Forecaster:
    """The forecaster of a fitted model: now + slope * (now - before).  A row per channel."""
    slopes = model.select("channel_idx", "slope")
    return lambda state: state.join(F.broadcast(slopes), "channel_idx").withColumn("next", F.col("now") + F.col("slope") * (F.col("now") - F.col("before"))).drop("slope")


def precision_rmse(rows: DataFrame, full: str, reduced: str) -> DataFrame:
    """How far a reduced-precision column is from the full one: rmse, largest error, rows."""
    e = F.col(reduced).cast("double") - F.col(full).cast("double")
    return rows.agg(F.sqrt(F.avg(e * e)).alias("rmse"), F.max(F.abs(e)).alias("max_error"), F.count(e).alias("n"))


CHECKPOINT_VERSION = 1
_REQUIRED = ("version", "boundary", "epoch", "update", "training_config", "data_signature")


def checkpoint_problems(payload: dict) -> list[str]:
    """What is wrong with a checkpoint's manifest; empty if nothing."""
    out = [f"missing {k}" for k in _REQUIRED if k not in payload]
    if not out:
        if payload["version"] != CHECKPOINT_VERSION:
            out.append(f"version {payload['version']!r}")
        if payload["boundary"] != "epoch":
            out.append(f"boundary {payload['boundary']!r}")
        out += [k for k in ("epoch", "update") if not isinstance(payload[k], int) or payload[k] < 0]
    return out


def save_checkpoint(model: DataFrame, root: str, name: str, manifest: dict) -> None:
    """The model's table and its manifest, visible only when both are complete.

    Every column of type double must be finite.
    """
    manifest = {"version": CHECKPOINT_VERSION, "boundary": "epoch"} | manifest
    if problems := checkpoint_problems(manifest):
        raise ValueError(", ".join(problems))
    doubles = [c for c, t in model.dtypes if t in ("double", "float")]
    bad = model.agg(*(F.count_if(~is_finite(F.col(c)) | F.col(c).isNull()).alias(c) for c in doubles)).first() if doubles else ()
    if any(bad):
        raise FloatingPointError("non-finite parameters")
    folder, stage = Folder(model.sparkSession, root), f"{name}.stage"
    if folder.exists(name):
        raise FileExistsError(os.path.join(root, name))
    folder.delete(stage)
    model.write.parquet(f"{folder.root}/{stage}/model")
    Folder(model.sparkSession, f"{folder.root}/{stage}").write_json("manifest.json", manifest)
    folder.rename(stage, name)


def load_checkpoint(spark: SparkSession, root: str, name: str, expected: dict) -> tuple[DataFrame, dict]:
    """(model, manifest); raises with the list of keys of ``training_config`` and
    ``data_signature`` that differ from ``expected``."""
    folder = Folder(spark, root)
    manifest = folder.read_json(f"{name}/manifest.json")
    if manifest is None:
        raise FileNotFoundError(os.path.join(root, name))
    problems = checkpoint_problems(manifest)
    for part in ("training_config", "data_signature"):
        if part in expected and part in manifest:
            told = json.loads(json.dumps(expected[part]))  # as a manifest keeps it
            problems += [f"{part}.{k}" for k in differences(manifest[part], told)]
    if problems:
        raise ValueError("checkpoint does not fit: " + ", ".join(problems))
    return spark.read.parquet(f"{folder.root}/{name}/model"), manifest
