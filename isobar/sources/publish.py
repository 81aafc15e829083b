"""Sinks: resumable batches with a contract, atomic publication, bundles, reports."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from isobar.functions.scalars import differences, fingerprint


class Folder:
    """File-system operations on Hadoop paths (any store that Spark can reach)."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def exists(self, name: str = "") -> bool:
        return self._fs.exists(self._path(f"{self.root}/{name}" if name else self.root))

    def rename(self, name: str, to: str) -> None:
        if not self._fs.rename(self._path(f"{self.root}/{name}"), self._path(f"{self.root}/{to}")):
            raise OSError(f"cannot rename {name} to {to}")

    def delete(self, name: str) -> None:
        self._fs.delete(self._path(f"{self.root}/{name}"), True)

    def list(self, name: str) -> list[str]:
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self._path(f"{self.root}/{name}")))

    def read_json(self, name: str) -> dict | None:
        if not self.exists(name):  # a writer may have died between its two renames
            if not self.exists(f"{name}.old"):
                return None
            name = f"{name}.old"
        rows = self.spark.read.text(f"{self.root}/{name}", wholetext=True).collect()
        return json.loads(rows[0][0]) if rows else None

    def write_json(self, name: str, value: dict) -> None:
        """Written aside, then renamed, so a reader never sees half of it.

        The former file stays as ``.old`` until the new one is in place: at every
        moment one of them is whole.
        """
        self._fs.mkdirs(self._path(self.root))
        tmp = f".{name}.{uuid.uuid4().hex}"
        out = self._fs.create(self._path(f"{self.root}/{tmp}"), True)
        out.write(bytearray(json.dumps(value, indent=2, sort_keys=True, default=str).encode()))
        out.close()
        if self.exists(name):
            self.delete(f"{name}.old")
            self.rename(name, f"{name}.old")
        self.rename(tmp, name)
        self.delete(f"{name}.old")


def download_contract(source: str, channels: list[str], start: str, end: str, stride_hours: int, resolution: float) -> dict:
    """The semantic identity that must stay fixed when a build is resumed."""
    if stride_hours < 6 or stride_hours % 6:
        raise ValueError("the stride must be a multiple of 6 hours")
    if start > end:
        raise ValueError("the range ends before it starts")
    return {"schema_version": 2, "source": source, "channel_names": channels, "start_date": start, "end_date": end, "time_stride_hours": stride_hours, "target_resolution_degrees": resolution}


class BatchStore:
    """A state table built in batches: append, journal, resume, publish.

    Batches go to ``<name>.partial`` partitioned by batch, one by one (``append``) or all
    that a table holds (``extend``); the journal names the last committed one.  A restart drops whatever lies past the journal, refuses a
    changed contract, and sets an uncommitted first batch aside.  ``publish``
    renames the table to its final name after validation; an existing table is
    never overwritten.
    """

    def __init__(self, spark: SparkSession, root: str, name: str, contract: dict):
        self.folder, self.name, self.contract = Folder(spark, root), name, contract
        self.digest = fingerprint(contract)
        self.partial, self.journal = f"{name}.partial", f"{name}.progress.json"

    def resume(self) -> int:
        """Batches already committed."""
        if self.folder.exists(self.name):
            raise FileExistsError(f"{self.name} exists")
        saved = self.folder.read_json(self.journal)
        if saved is None:
            if self.folder.exists(self.partial):
                self.folder.rename(self.partial, f"{self.partial}.interrupted-{uuid.uuid4().hex[:8]}")
            return 0
        if saved["fingerprint"] != self.digest:
            raise ValueError(f"the contract changed: {differences(saved['contract'], self.contract)}")
        for b in self._written():
            if b >= saved["committed"]:
                self.folder.delete(f"{self.partial}/batch={b}")
        return saved["committed"]

    def _written(self) -> list[int]:
        return sorted(int(p[6:]) for p in self.folder.list(self.partial) if p.startswith("batch="))

    def _commit(self, batches: int) -> None:
        self.folder.write_json(self.journal, {"committed": batches, "contract": self.contract, "fingerprint": self.digest})

    def append(self, batch: int, rows: DataFrame) -> None:
        """Idempotent: a batch written twice is there once.  A batch that leaves a gap is refused."""
        saved = self.folder.read_json(self.journal)
        done = saved["committed"] if saved else 0
        if batch > done:
            raise ValueError(f"batch {batch} does not follow the {done} committed ones")
        rows.write.mode("overwrite").parquet(f"{self.folder.root}/{self.partial}/batch={batch}")
        self._commit(max(done, batch + 1))

    def extend(self, rows: DataFrame, end: int, *by: str) -> int:
        """All batches from the committed ones up to ``end`` of ``rows(batch, ...)`` in one job, journalled together.

        ``rows`` is evaluated once, however many batches there are.  Rows of committed
        batches are left out, and batches that an interrupted call left are replaced; a
        batch without rows is a gap and refused.  Rows are dealt by batch and ``by``: a
        large batch needs further columns to go to more than one task.
        """
        done = self.resume()
        if end <= done:
            return done
        mine = rows.where((F.col("batch") >= done) & (F.col("batch") < end)).repartition("batch", *by)
        mine.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(f"{self.folder.root}/{self.partial}")
        gaps = sorted(set(range(done, end)) - set(self._written()))
        if gaps:
            raise ValueError(f"{len(gaps)} batches have no rows, the first is {gaps[0]}")
        self._commit(end)
        return end

    def table(self) -> DataFrame:
        at = self.partial if self.folder.exists(self.partial) else self.name
        return self.folder.spark.read.parquet(f"{self.folder.root}/{at}")

    def publish(self, problems: Callable[[DataFrame], DataFrame]) -> None:
        bad = problems(self.table())
        if not bad.isEmpty():
            raise ValueError(f"not published: {bad.first()}")
        self.folder.write_json(f"{self.name}.contract.json", {"contract": self.contract, "fingerprint": self.digest})
        self.folder.rename(self.partial, self.name)
        self.folder.delete(self.journal)
        self.folder.delete(f"{self.journal}.old")


def write_bundle(stats: DataFrame, clim: DataFrame, root: str, manifest: dict) -> None:
    """An immutable statistics bundle: two tables and a manifest with their digests."""
    folder = Folder(stats.sparkSession, root)
    if folder.exists():
        raise FileExistsError(root)
    stage = Folder(stats.sparkSession, f"{root}.stage-{uuid.uuid4().hex[:8]}")
    stats.write.parquet(f"{stage.root}/stats_channel")
    clim.write.parquet(f"{stage.root}/stats_cell")
    digest = lambda df: df.agg(F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)")).cast("string")).first()[0]
    stage.write_json("manifest.json", manifest | {"version": 4, "stats_channel": digest(stats), "stats_cell": digest(clim)})
    parent, name = root.rstrip("/").rsplit("/", 1)
    Folder(stats.sparkSession, parent).rename(stage.root.rsplit("/", 1)[1], name)


def check_bundle(spark: SparkSession, root: str, expected: dict) -> list[str]:
    """Differences between the manifest, the tables and what is expected."""
    saved = Folder(spark, root).read_json("manifest.json")
    if saved is None:
        return ["manifest.json"]
    out = [k for k in differences({k: saved.get(k) for k in expected}, expected)]
    for t in ("stats_channel", "stats_cell"):
        df = spark.read.parquet(f"{root}/{t}")
        if df.agg(F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)")).cast("string")).first()[0] != saved[t]:
            out.append(t)
    return out


def write_report(rows: DataFrame, path: str) -> None:
    """A metric table as one CSV with a header (hundreds of rows)."""
    rows.coalesce(1).write.mode("errorifexists").csv(path, header=True)


def append_history(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").parquet(path)


def rewind_history(spark: SparkSession, root: str, name: str, epoch: int) -> None:
    """Keep epochs up to ``epoch``; the old ledger stays beside it."""
    folder = Folder(spark, root)
    backup = f"{name}.before-resume-{uuid.uuid4().hex[:8]}"
    folder.rename(name, backup)
    spark.read.parquet(f"{root}/{backup}").where(F.col("epoch") <= epoch).write.parquet(f"{root}/{name}")


def forecast_rows(forecast: DataFrame, truth: DataFrame | None, step_hours: int, origin: str) -> DataFrame:
    """The forecast sink's rows: initial and valid time in nanoseconds, target null without truth."""
    from isobar.functions.scalars import epoch_ns
    from isobar.sources.state import time_of

    out = forecast.withColumn("valid_t", F.col("base_t") + F.col("lead"))
    if truth is None:
        out = out.withColumn("target", F.lit(None).cast("double"))
    else:
        t = truth.select(F.col("t_idx").alias("valid_t"), "channel_idx", "lat_idx", "lon_idx", F.col("value").alias("target"))
        out = out.join(t, ["valid_t", "channel_idx", "lat_idx", "lon_idx"], "left")
    ns = lambda c: epoch_ns(time_of(F.col(c), step_hours, origin))
    return out.select("model", "sample_idx", "lead", "channel_idx", "lat_idx", "lon_idx", "prediction", "target", ns("base_t").alias("initial_time_unix_ns"), ns("valid_t").alias("valid_time_unix_ns"))


def write_forecast(rows: DataFrame, path: str) -> None:
    rows.write.mode("errorifexists").partitionBy("sample_idx", "lead").parquet(path)


def file_inventory(spark: SparkSession, path: str) -> DataFrame:
    """n_files, bytes, digest over (name, size) in order."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select(F.regexp_extract("path", "([^/]+)$", 1).alias("name"), "length")
    return f.agg(F.count("*").alias("n_files"), F.sum("length").alias("bytes"), F.sha2(F.to_json(F.array_sort(F.collect_list(F.struct("name", "length")))).cast("binary"), 256).alias("digest"))


