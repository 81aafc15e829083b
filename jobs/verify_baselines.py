"""Scores of baseline forecasts over an archive of states, by lead and channel.

Before a model is trained, its rivals must be known: how well persistence, the linear
tendency and the climatology forecast the test period, in physical units.

Input: vectors (vec_id, embedding, label); vector k of a label is time k of a channel.
Output, all Parquet:

- ``state/part=/channel_idx=``: the archive of fields, in files by stretches of time;
- ``pass/kind=``: partial results of one ordered pass over the training times;
- ``statistics``: per channel mean, std and those of the time difference;
- ``scores/model=``: per model, lead and channel RMSE, bias, ACC and variance ratio.

A rerun replaces every table with the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from isobar.functions import grid
from isobar.operators import fields as fl
from isobar.operators import metrics
from isobar.sources import state
from jobs.common import command_line, log

STEPS = {"persistence": fl.persistence, "linear_tendency": fl.linear_tendency, "climatology": fl.climatology}


def archive(vectors: DataFrame, path: str, times_per_part: int) -> DataFrame:
    """The fields written by stretch of time and channel, each file in the order of time, and read back."""
    told = state.fields_of(vectors).withColumn("part", F.floor(F.col("t_idx") / times_per_part))
    dealt = told.repartition("part", "channel_idx").sortWithinPartitions("part", "channel_idx", "t_idx")
    dealt.write.mode("overwrite").partitionBy("part", "channel_idx").parquet(path)
    return vectors.sparkSession.read.schema(told.schema).parquet(path)


def run(spark: SparkSession, source: str, output: str, config: dict) -> DataFrame:
    """Score baseline forecasts over an archive of states, by lead and channel."""
    unknown = set(config["models"]) - set(STEPS)
    if unknown:
        raise ValueError(f"unknown models: {', '.join(sorted(unknown))}")
    h, w = config["grid"]
    vectors = spark.read.parquet(source)
    log.info("read %s", source)
    fields = archive(vectors, f"{output}/state", config["times_per_part"])
    size = fields.agg(F.count("*").alias("fields"), F.coalesce(F.max("t_idx") + 1, F.lit(0)).alias("times"), F.count_distinct("channel_idx").alias("channels")).first()
    log.info("wrote %s/state: %d fields, %d times, %d channels", output, size["fields"], size["times"], size["channels"])

    n = size["times"]
    train_end, test_start = int(n * config["train_share"] + 1e-9), int(n * (1 - config["test_share"]) + 1e-9)
    weights = fl.cell_weights([r["area_w"] for r in grid.area_weights(state.dim_lat(spark, h)).orderBy("lat_idx").collect()], w)
    parts = fl.write_pass(fl.ordered_pass(fields.where(F.col("t_idx") < train_end), weights), f"{output}/pass")
    own, change = fl.pass_moments(parts, weights, 1)
    std = F.sqrt(F.col("m2") / F.col("w"))
    told = own.select("channel_idx", F.col("n").alias("n_times"), "mean", std.alias("std"))
    told = told.join(change.select("channel_idx", F.col("mean").alias("diff_mean"), std.alias("diff_std")), "channel_idx", "left")
    told.write.mode("overwrite").parquet(f"{output}/statistics")
    statistics = spark.read.schema(told.schema).parquet(f"{output}/statistics")
    log.info("wrote %s/statistics: %d channels over times before %d", output, statistics.count(), train_end)

    z, clim = fl.standardised(fields, statistics), fl.standardised(fl.pass_climatology(parts), statistics)
    steps = {m: STEPS[m] for m in config["models"]}
    sums = fl.verify_fields(z, clim, steps, config["leads"], weights, test_start, n - config["leads"], part_times=config["times_per_part"])
    scores = metrics.channel_results(metrics.merged_sums(metrics.sum_parts(sums, 1024)), statistics)
    scores.write.mode("overwrite").partitionBy("model").parquet(f"{output}/scores")
    out = spark.read.schema(scores.schema).parquet(f"{output}/scores").select(scores.columns)
    log.info("wrote %s/scores: %d rows, starts from %d, %d leads", output, out.count(), test_start, config["leads"])
    return out


if __name__ == "__main__":
    command_line("verify_baselines", run)
