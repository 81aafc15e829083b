"""Forecast verification by lead and channel.

Stage 1 sums per (model, sample, lead, channel): the anomaly correlation is taken
per initialisation, never pooled.  Stage 2 adds samples.  Both stages combine
map-side; nothing but metric rows leaves the executors.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from isobar.functions.scalars import guarded_divide, lead_hours

SAMPLE_KEYS = ["model", "sample_idx", "lead", "channel_idx"]


def sample_sums(pairs: DataFrame, lat: DataFrame, clim: DataFrame) -> DataFrame:
    """Additive area-weighted sums of every sample, lead and channel.

    Values are normalised (order 1), so the one-pass variance identity is safe.
    """
    p, y, w = F.col("prediction"), F.col("target"), F.col("area_w")
    a, b, e = p - F.col("clim"), y - F.col("clim"), p - y
    rows = pairs.join(F.broadcast(lat.select("lat_idx", "area_w")), "lat_idx").join(clim, ["channel_idx", "lat_idx", "lon_idx"])
    s = rows.groupBy(*SAMPLE_KEYS).agg(
        F.sum(w).alias("sw"),
        F.sum(w * e * e).alias("se2"),
        F.sum(w * F.abs(e)).alias("sae"),
        F.sum(w * e).alias("se"),
        F.sum(w * a * b).alias("sab"),
        F.sum(w * a * a).alias("saa"),
        F.sum(w * b * b).alias("sbb"),
        (F.sum(w * p * p) - F.sum(w * p) * F.sum(w * p) / F.sum(w)).alias("svp"),
        (F.sum(w * y * y) - F.sum(w * y) * F.sum(w * y) / F.sum(w)).alias("svy"),
    )
    return s.withColumn("acc", guarded_divide(F.col("sab"), F.sqrt(F.col("saa") * F.col("sbb")))).drop("sab", "saa", "sbb")


def channel_sums(samples: DataFrame) -> DataFrame:
    """The nine sums per model, lead and channel; n_acc counts valid correlations."""
    total = [F.sum(c).alias(c) for c in ("sw", "se2", "sae", "se", "svp", "svy")]
    return samples.groupBy("model", "lead", "channel_idx").agg(*total, F.coalesce(F.sum("acc"), F.lit(0.0)).alias("sacc"), F.count("acc").alias("n_acc"), F.count("*").alias("n_samples"))


def channel_results(sums: DataFrame, stats: DataFrame, step: int = 1, cadence_hours: float = 6.0) -> DataFrame:
    """Physical RMSE and bias, ACC over valid initialisations, spatial variance ratio (null if undefined)."""
    return sums.join(F.broadcast(stats.select("channel_idx", "std")), "channel_idx").select(
        "model",
        "lead",
        lead_hours(F.col("lead"), step, cadence_hours).alias("lead_hours"),
        "channel_idx",
        (F.sqrt(F.col("se2") / F.col("sw")) * F.col("std")).alias("physical_rmse"),
        F.try_divide("sacc", "n_acc").alias("normalized_acc"),
        F.col("n_acc").alias("acc_valid_initializations"),
        (F.col("se") / F.col("sw") * F.col("std")).alias("physical_bias"),
        guarded_divide(F.col("svp"), F.col("svy"), 0.0).alias("spatial_variance_ratio"),
    )


def lead_results(sums: DataFrame, step: int = 1, cadence_hours: float = 6.0) -> DataFrame:
    """RMSE and MAE pooled over channels; ACC the plain mean of the channels that have one."""
    per = sums.withColumn("acc", F.try_divide("sacc", "n_acc"))
    out = per.groupBy("model", "lead").agg(
        F.sqrt(F.sum("se2") / F.sum("sw")).alias("rmse"),
        (F.sum("sae") / F.sum("sw")).alias("mae"),
        F.avg("acc").alias("acc"),
        F.count("acc").alias("valid_channels"),
        F.count("*").alias("channels"),
        F.max("n_samples").alias("samples"),
    )
    return out.withColumn("lead_hours", lead_hours(F.col("lead"), step, cadence_hours))


def rmse_growth(leads: DataFrame) -> DataFrame:
    first = F.first_value("rmse").over(Window.partitionBy("model").orderBy("lead"))
    return leads.withColumn("rmse_growth_from_lead1", F.col("rmse") - first)


def milestones(leads: DataFrame, channels: DataFrame, every_days: int) -> DataFrame:
    """Leads at whole multiples of every_days, numbered, with their channel rows nested.

    A lead counts when its hours modulo the interval are within 1e-6 above 0.
    """
    if every_days < 1:
        raise ValueError("report interval must be positive")
    due = leads.where(F.abs(F.col("lead_hours") % (24.0 * every_days)) <= 1e-6)
    level = F.row_number().over(Window.partitionBy("model").orderBy("lead"))
    name = F.format_string("day_%02d", F.round(F.col("lead_hours") / 24).cast("int"))
    kept = [c for c in channels.columns if c not in ("model", "lead")]
    nested = channels.groupBy("model", "lead").agg(F.array_sort(F.collect_list(F.struct(*kept))).alias("channel_rows"))
    return due.withColumn("level", level).withColumn("name", name).join(nested, ["model", "lead"], "left")


def objective(losses: DataFrame, discount: float) -> DataFrame:
    """Per model the discounted mean of ``losses(model, lead, loss, n)``: samples first, then leads."""
    per = losses.groupBy("model", "lead").agg((F.sum(F.col("loss") * F.col("n")) / F.sum("n")).alias("loss"))
    g = F.pow(F.lit(discount), F.col("lead") - 1)
    return per.groupBy("model").agg((F.sum(g * F.col("loss")) / F.greatest(F.sum(g), F.lit(1e-8))).alias("objective"))


def best_epoch(history: DataFrame) -> DataFrame:
    """The epoch of least loss, the earliest on ties."""
    return history.agg(F.min_by("epoch", F.struct("loss", "epoch")).alias("epoch"), F.min("loss").alias("loss"))


def early_stopping(history: DataFrame, min_delta: float, patience: int) -> DataFrame:
    """epoch, loss, improved, stale, stopped: an ordered fold over the epochs of one run.

    An epoch improves when its loss is below the best so far minus min_delta; it
    stops once ``patience`` epochs in a row did not (patience 0: never).
    """
    start = F.struct(F.lit(float("inf")).alias("best"), F.lit(0).alias("stale"), F.array().cast("array<struct<epoch:bigint,loss:double,improved:boolean,stale:int>>").alias("out"))

    def step(acc, x):
        better = x["loss"] < acc["best"] - min_delta
        stale = F.when(better, 0).otherwise(acc["stale"] + 1)
        row = F.struct(x["epoch"].alias("epoch"), x["loss"].alias("loss"), better.alias("improved"), stale.alias("stale"))
        return F.struct(F.when(better, x["loss"]).otherwise(acc["best"]).alias("best"), stale.alias("stale"), F.array_append(acc["out"], row).alias("out"))

    rows = history.agg(F.array_sort(F.collect_list(F.struct(F.col("epoch").cast("long").alias("epoch"), F.col("loss").cast("double").alias("loss")))).alias("h"))
    fold = rows.select(F.explode(F.aggregate("h", start, step, lambda a: a["out"])).alias("r")).select("r.*")
    return fold.withColumn("stopped", (F.lit(patience) > 0) & (F.col("stale") >= patience))


# --- mergeable sums -------------------------------------------------------------

_SUMMED = ("sw", "se2", "sae", "se", "svp", "svy")
_EXACT = "decimal(38,18)"


def sum_parts(samples: DataFrame, width: int) -> DataFrame:
    """Per stretch of ``width`` samples, model, lead and channel: the sums of ``sample_sums``, in fixed point.

    Each sample's numbers are rounded to 1e-18 and added as integers, so the result does
    not depend on how rows are partitioned or in which order parts are merged, to the
    last bit.  Normalised sums are of order one; above 1e20 in all is an error.  A
    NaN makes its sum NaN.
    """
    keys = [F.floor(F.col("sample_idx") / width).cast("long").alias("stretch"), "model", "lead", "channel_idx"]
    exact = lambda c: F.sum(F.when(~F.isnan(c), F.col(c)).cast(_EXACT)).alias(c)
    bad = lambda c: F.coalesce(F.bool_or(F.isnan(c)), F.lit(False)).alias(f"{c}_nan")
    columns = [*_SUMMED, "acc"]
    return samples.groupBy(*keys).agg(*map(exact, columns), *map(bad, columns), F.count("acc").alias("n_acc"), F.count("*").alias("n_samples"))


def merged_sums(parts: DataFrame) -> DataFrame:
    """The parts of any stretches as ``channel_sums`` gives them (sacc: the sum of correlations)."""
    value = lambda c: F.when(F.bool_or(f"{c}_nan"), F.lit(float("nan"))).otherwise(F.sum(c).cast("double"))
    out = parts.groupBy("model", "lead", "channel_idx").agg(*(value(c).alias(c) for c in _SUMMED), F.coalesce(value("acc"), F.lit(0.0)).alias("sacc"), F.sum("n_acc").alias("n_acc"), F.sum("n_samples").alias("n_samples"))
    return out


def evaluate_stretches(spark, samples, n_samples: int, width: int, path: str) -> DataFrame:
    """Sums over all samples, stretch by stretch; those that ``path`` already holds are not made again.

    ``samples(first, end)``: the ``sample_sums`` of these samples.  Each missing run of
    stretches is one write, of whole partitions that a rerun replaces; a run that was
    broken off goes on from the stretches it has written.
    """
    wanted = range(-(-n_samples // width))
    try:
        held = {r[0] for r in spark.read.parquet(path).select("stretch").distinct().collect()}
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        held = set()
    for k in (k for k in wanted if k not in held):
        rows = sum_parts(samples(k * width, min(n_samples, (k + 1) * width)), width)
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("stretch").parquet(path)
    return merged_sums(spark.read.parquet(path).where(F.col("stretch") < len(wanted)))
