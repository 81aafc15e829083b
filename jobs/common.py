"""What the jobs share: their command line, configuration and log."""

from __future__ import annotations

import argparse
import json
import logging
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

log = logging.getLogger("jobs")


def settings(job: str, spark: SparkSession | None = None, path: str | None = None) -> dict:
    """The job's own configuration, with the values of the file ``path`` (read by Spark) over it."""
    held = json.loads(Path(__file__).with_name(f"{job}.json").read_text())
    if path is not None:
        told = json.loads("\n".join(r[0] for r in spark.read.text(path, wholetext=True).collect()))
        if unknown := set(told) - set(held):
            raise ValueError(f"unknown settings: {', '.join(sorted(unknown))}")
        held |= told
    return held


def command_line(job: str, run: Callable[[SparkSession, str, str, dict], DataFrame]) -> None:
    ask = argparse.ArgumentParser(prog=f"python -m jobs.{job}", description=run.__doc__)
    ask.add_argument("--input", required=True, help="path of the table to read")
    ask.add_argument("--output", required=True, help="folder of the job's tables")
    ask.add_argument("--config", help="JSON file whose values replace those beside the job")
    told = ask.parse_args()
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    spark = SparkSession.builder.appName(job).config("spark.sql.session.timeZone", "UTC").getOrCreate()
    try:
        run(spark, told.input.rstrip("/"), told.output.rstrip("/"), settings(job, spark, told.config))
    finally:
        spark.stop()
