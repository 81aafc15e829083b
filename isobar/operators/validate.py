"""Contract checks; each returns a DataFrame of violations or findings."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from isobar.functions.scalars import is_finite


def cadence(times: DataFrame, column: str = "ts") -> DataFrame:
    """n, gap range in seconds, and whether ``times`` ascend with one constant gap."""
    d = F.timestamp_diff("SECOND", F.lag(column).over(Window.orderBy("t_idx")), F.col(column))  # a time axis
    return times.select(d.alias("gap")).agg(
        F.count("*").alias("n_times"),
        F.min("gap").alias("min_gap"),
        F.max("gap").alias("max_gap"),
        ((F.count("*") >= 2) & (F.min("gap") > 0) & (F.min("gap") == F.max("gap"))).alias("regular"),
    )


def calendar(times: DataFrame, start: str, end: str, hours: int, column: str = "ts") -> DataFrame:
    """ts, problem: missing, unexpected or repeated instants against the generated calendar."""
    spark = times.sparkSession
    step = F.make_dt_interval(hours=F.lit(hours))
    want = spark.range(1).select(F.explode(F.sequence(F.lit(start).cast("timestamp_ntz"), F.lit(end).cast("timestamp_ntz"), step)).alias("ts"))
    have = times.groupBy(F.col(column).alias("ts")).count()
    both = want.withColumn("wanted", F.lit(True)).join(have, "ts", "full_outer")
    problem = F.when(F.col("count").isNull(), "missing").when(F.col("wanted").isNull(), "unexpected").when(F.col("count") > 1, "repeated")
    return both.select("ts", problem.alias("problem")).where("problem IS NOT NULL")


def non_finite(cells: DataFrame) -> DataFrame:
    """channel_idx, n_cells, n_bad."""
    return cells.groupBy("channel_idx").agg(F.count("*").alias("n_cells"), F.count_if(~is_finite(F.col("value"))).alias("n_bad"))


def global_grid(lat: DataFrame, lon: DataFrame) -> DataFrame:
    """One row: is the grid pole to pole, regular and 360 degrees around?"""
    n = lat.agg(F.count("*").alias("h"))
    off = lat.crossJoin(F.broadcast(n)).agg(F.max("h").alias("n_lat"), F.max(F.abs(F.col("latitude") - (90 - F.col("lat_idx") * 180.0 / (F.col("h") - 1)))).alias("lat_error"))  # one row
    step = F.col("longitude") - F.lag("longitude").over(Window.orderBy("lon_idx"))  # an axis
    around = lon.select(step.alias("d")).agg(F.count("*").alias("n_lon"), F.avg("d").alias("d"), (F.max("d") - F.min("d")).alias("lon_jitter"))
    return off.crossJoin(around).select(  # 1 x 1 row
        "n_lat",
        "n_lon",
        ((F.col("lat_error") <= 1e-4) & (F.abs(F.col("d") * F.col("n_lon") - 360) <= 1e-4 + 1e-5 * 360) & (F.col("lon_jitter") <= 1e-6 + 1e-5 * F.abs("d"))).alias("global_grid"),
    )


def monotonic(lat: DataFrame) -> DataFrame:
    """One row: finite, within the poles, strictly monotonic either way."""
    d = F.col("latitude") - F.lag("latitude").over(Window.orderBy("lat_idx"))
    return lat.select("latitude", F.signum(d).alias("s")).agg(
        (F.bool_and(is_finite(F.col("latitude")) & (F.abs("latitude") <= 90)) & F.coalesce((F.min("s") == F.max("s")) & (F.min("s") != 0), F.count("*") == 1)).alias("ok")
    )


def missing(required: DataFrame, available: DataFrame, key: str) -> DataFrame:
    return required.join(available, key, "left_anti")


def splits_in_order(splits: DataFrame) -> DataFrame:
    """``splits(ord, split, first_t, last_t)`` that do not end before the next begins."""
    nxt = F.lead("first_t").over(Window.orderBy("ord"))
    return splits.withColumn("next_first", nxt).where(F.col("next_first").isNotNull() & (F.col("last_t") >= F.col("next_first"))).drop("next_first")


def overlaps(a: DataFrame, b: DataFrame) -> DataFrame:
    """Pairs of closed intervals (name, first_t, last_t) of a and b that meet (a few rows each)."""
    x = a.select(F.col("name").alias("a_name"), F.col("first_t").alias("a_first"), F.col("last_t").alias("a_last"))
    y = b.select(F.col("name").alias("b_name"), F.col("first_t").alias("b_first"), F.col("last_t").alias("b_last"))
    return x.join(y, (F.col("a_first") <= F.col("b_last")) & (F.col("a_last") >= F.col("b_first"))).select("a_name", "b_name")


def schema_problems(df: DataFrame, schema) -> list[str]:
    """Missing, unexpected and mistyped columns."""
    have, want = dict(df.dtypes), {f.name: f.dataType.simpleString() for f in schema}
    out = [f"missing column {c}" for c in want if c not in have] + [f"unexpected column {c}" for c in have if c not in want]
    return out + [f"column {c} is {have[c]}, not {t}" for c, t in want.items() if c in have and have[c] != t]


def slice_digests(cells: DataFrame) -> DataFrame:
    """t_idx, digest: SHA-256 over the channels' SHA-256 of their little-endian float32 payload in (lat, lon) order."""
    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            told = [hashlib.sha256(f.values.to_numpy(zero_copy_only=False).astype("<f4").tobytes()).hexdigest() for f in batch.column("field")]
            yield pa.RecordBatch.from_arrays([batch.column("t_idx"), batch.column("channel_idx"), pa.array(told, pa.string())], ["t_idx", "channel_idx", "x"])

    cell = F.struct("lat_idx", "lon_idx", F.col("value").cast("float").alias("value"))
    fields = cells.groupBy("t_idx", "channel_idx").agg(F.transform(F.array_sort(F.collect_list(cell)), lambda c: c["value"]).alias("field"))
    told = fields.mapInArrow(digest, "t_idx long, channel_idx int, x string")
    return told.groupBy("t_idx").agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("channel_idx", "x"))), lambda c: c["x"]), "").cast("binary"), 256).alias("digest"))


def merkle_digest(cells: DataFrame) -> DataFrame:
    """One row: a digest of the slices' digests (version merkle-1; not the sequential one)."""
    d = slice_digests(cells)
    return d.agg(F.count("*").alias("n_slices"), F.concat(F.lit("merkle-1:"), F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("t_idx", "digest"))), lambda s: s["digest"]), "").cast("binary"), 256)).alias("digest"))


def payload_digest(cells: DataFrame) -> str:
    """SHA-256 over the little-endian float32 payload in (t, channel, lat, lon) order.

    Order-dependent by definition: rows stream to the driver one partition at a time.
    """
    import struct

    h = hashlib.sha256()
    for r in cells.orderBy("t_idx", "channel_idx", "lat_idx", "lon_idx").select("value").toLocalIterator():
        h.update(struct.pack("<f", r["value"]))
    return h.hexdigest()
