"""Identity of stored data: files by content, data sets, statistics bundles, split tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from isobar.functions.scalars import differences
from isobar.operators.select import date_slice, split_of, split_range
from isobar.sources.publish import Folder, check_bundle

#: Groups that the files of a folder are digested in, so no task holds all names.
GROUPS = 1024
#: The version a statistics bundle must have.
BUNDLE_VERSION = 4


def _files(spark: SparkSession, path: str) -> DataFrame:
    """name (relative to path), length, mtime, content of every file below; unread columns are not loaded."""
    folder = Folder(spark, path)
    root = folder._path(folder.root).makeQualified(folder._fs.getUri(), folder._fs.getWorkingDirectory()).toString()
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return f.select(F.substr("path", F.lit(len(root) + 2)).alias("name"), "length", F.unix_micros("modificationTime").alias("mtime"), "content")


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """name, length, sha256 of each file (a file is one row: for artefacts, not for payloads of many GB)."""
    return _files(spark, path).select("name", "length", F.sha2("content", 256).alias("sha256"))


def inventory(spark: SparkSession, path: str) -> DataFrame:
    """n_files, bytes, digest over (name, size, time of change): tells edits without reading payloads."""
    told = _files(spark, path).select("length", F.pmod(F.xxhash64("name"), F.lit(GROUPS)).alias("g"), F.concat_ws(":", "name", "length", "mtime").alias("x"))
    line = lambda c: F.sha2(F.array_join(F.array_sort(F.collect_list(c)), "\n").cast("binary"), 256)
    groups = told.groupBy("g").agg(F.count("*").alias("n"), F.sum("length").alias("b"), line("x").alias("x"))
    return groups.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_files"), F.coalesce(F.sum("b"), F.lit(0)).alias("bytes"), line(F.concat_ws(":", "g", "x")).alias("digest"))


def dataset_identity(spark: SparkSession, path: str, lat: DataFrame, lon: DataFrame, channels: DataFrame, samples: DataFrame) -> dict:
    """What must be the same when a run is resumed exactly: files, interval, cadence, grid, channels, samples.

    The table at ``path`` holds t_idx and ts; ``samples(sample_idx, t_idx)`` are the windows
    taken from it.  The driver gets the axes, the channels and single rows.
    """
    files = inventory(spark, path).first()
    times = spark.read.parquet(path).select("t_idx", "ts").distinct()
    axis = times.agg(F.count("*").alias("n"), F.min("ts").alias("a"), F.max("ts").alias("b")).first()
    gap = F.timestamp_diff("SECOND", F.min("ts"), F.max("ts")) / 3600 / F.greatest(F.count("*") - 1, F.lit(1))
    taken = samples.agg(F.count("*").alias("n"), F.sum(F.xxhash64("sample_idx", "t_idx").cast("decimal(38,0)")).cast("string").alias("x")).first()
    column = lambda df, order, name: [r[0] for r in df.orderBy(order).select(name).collect()]
    return {
        "path": path,
        "files": files["n_files"],
        "bytes": files["bytes"],
        "inventory_sha256": files["digest"],
        "timesteps": axis["n"],
        "first_time": str(axis["a"]),
        "last_time": str(axis["b"]),
        "cadence_hours": times.agg(gap).first()[0],
        "channels": column(channels, "channel_idx", "channel"),
        "channel_units": column(channels, "channel_idx", "units"),
        "latitude": column(lat, "lat_idx", "latitude"),
        "longitude": column(lon, "lon_idx", "longitude"),
        "samples": taken["n"],
        "sample_digest": taken["x"],
    }


def statistics_contract(identity: dict, step: int) -> dict:
    """The nine fields of a statistics bundle that must be those of the training data."""
    same = ("first_time", "last_time", "channels", "channel_units", "cadence_hours", "latitude", "longitude")
    return {k: identity[k] for k in same} | {"spatial_weighting": "spherical_latitude_cell_area", "time_difference_step": step}


def validate_bundle(spark: SparkSession, root: str, contract: dict) -> dict:
    """The manifest of a bundle that fits ``contract`` and its own tables, else an error."""
    saved = Folder(spark, root).read_json("manifest.json")
    if saved is None:
        raise ValueError(f"{root} holds no manifest")
    if saved.get("version") != BUNDLE_VERSION:
        raise ValueError(f"statistics of version {saved.get('version')}, not {BUNDLE_VERSION}")
    wrong = check_bundle(spark, root, contract)
    if wrong:
        raise ValueError("the statistics do not fit the training data: " + ", ".join(wrong))
    return saved


def guard_statistics(saved: dict[str, str], current: dict[str, str], override: bool = False) -> bool:
    """Are the results only diagnostic?  Digests that differ from the model's are an error without ``override``."""
    wrong = differences(saved, current)
    if wrong and not override:
        raise ValueError("statistics differ from those of training: " + ", ".join(wrong))
    return bool(wrong)


def write_splits(cells: DataFrame, path: str, train_end: str, valid_end: str) -> None:
    """One table partitioned by ``split``, cut by instants; each split needs two times.

    An existing table is never overwritten.  The first pass reads times only.
    """
    if train_end >= valid_end:
        raise ValueError("the training split must end before the validation split")
    if Folder(cells.sparkSession, path).exists():
        raise FileExistsError(path)
    marked = cells.withColumn("split", split_of(F.col("ts"), train_end, valid_end))
    n = {r["split"]: r["n"] for r in marked.groupBy("split").agg(F.count_distinct("ts").alias("n")).collect()}  # three rows
    short = [s for s in ("train", "valid", "test") if n.get(s, 0) < 2]
    if short:
        raise ValueError("fewer than two times in " + ", ".join(short))
    marked.write.mode("errorifexists").partitionBy("split").parquet(path)


def write_sample(cells: DataFrame, path: str, day: str, overwrite: bool = False) -> None:
    """The cells of one day; a table that is there is an error unless it may be overwritten."""
    date_slice(cells, day, day).write.mode("overwrite" if overwrite else "errorifexists").parquet(path)


@dataclass(frozen=True)
class Layout:
    """Where the tables of a data set lie: one store for all splits, statistics by stride."""

    root: str

    @property
    def store(self) -> str:
        return f"{self.root.rstrip('/')}/state"

    def statistics(self, step: int = 1) -> str:
        if step < 1:
            raise ValueError("the stride must be positive")
        return f"{self.root.rstrip('/')}/statistics_dt{step}"

    def table(self, split: str, override: str | None = None) -> str:
        """The table of a split; an ``override`` wins, an unknown split is an error either way."""
        split_range(split)
        return override or self.store


def write_summary(lead_rows: DataFrame, channel_rows: DataFrame | None, root: str, about: dict) -> None:
    """``metrics.json``: ``about`` and a row per model and lead; ``milestones.json`` beside it where asked for.

    Milestones of an earlier evaluation are removed when none are asked for.  Rows per lead
    and channel: some hundreds.
    """
    folder = Folder(lead_rows.sparkSession, root)
    rows = lambda df, *keys: [r.asDict() for r in df.orderBy(*keys).collect()]
    folder.write_json("metrics.json", about | {"leads": rows(lead_rows, "model", "lead")})
    if channel_rows is not None:
        folder.write_json("milestones.json", {"rows": rows(channel_rows, *channel_rows.columns[:3])})
    else:
        folder.delete("milestones.json")
        folder.delete("milestones.json.old")
