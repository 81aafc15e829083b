"""State tables: the view over the driver's tables, layouts, and scans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

LATS, LONS, STEP_HOURS, ORIGIN = 7, 8, 6, "2024-01-01 00:00:00"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def driver_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dense state_cells on a 7 x 8 pole-to-pole grid from the embeddings table.

    The k-th vector of a label is time k of that channel; times that not every
    channel has are left out; the first 56 components are the row-major grid.
    """
    e = read_table(spark, sf_dir, "embeddings")
    ranked = e.select("label", "embedding", (F.row_number().over(Window.partitionBy("label").orderBy("vec_id")) - 1).cast("long").alias("t_idx"))
    least = e.groupBy("label").count().agg(F.min("count").alias("n"))
    return (
        ranked.join(F.broadcast(least), F.col("t_idx") < F.col("n"))  # one row
        .select("t_idx", "label", F.posexplode(F.slice("embedding", 1, LATS * LONS)).alias("p", "v"))
        .select(
            "t_idx",
            time_of(F.col("t_idx")).alias("ts"),
            F.col("label").cast("int").alias("channel_idx"),
            F.floor(F.col("p") / LONS).cast("int").alias("lat_idx"),
            (F.col("p") % LONS).cast("int").alias("lon_idx"),
            F.col("v").cast("double").alias("value"),
        )
    )


def time_of(t_idx, step_hours: int = STEP_HOURS, origin: str = ORIGIN):
    return F.expr(f"timestamp_ntz '{origin}'") + F.make_dt_interval(hours=t_idx.cast("int") * step_hours)


def dim_lat(spark: SparkSession, n: int = LATS) -> DataFrame:
    """lat_idx, latitude from pole to pole, north first."""
    return spark.range(n).select(F.col("id").cast("int").alias("lat_idx"), (F.lit(90.0) - F.lit(180.0) / (n - 1) * F.col("id")).alias("latitude"))


def dim_lon(spark: SparkSession, n: int = LONS) -> DataFrame:
    return spark.range(n).select(F.col("id").cast("int").alias("lon_idx"), (F.lit(360.0) / n * F.col("id")).alias("longitude"))


def read_state(spark: SparkSession, path: str, start: str | None = None, end: str | None = None) -> DataFrame:
    """Scan of a written state table; the time range prunes its year/month partitions."""
    from isobar.operators.select import date_slice

    return date_slice(spark.read.parquet(path), start, end)


def point_read(state: DataFrame, t_idx: int, h: int, w: int) -> DataFrame:
    """One time, the leading h x w rectangle, payload as float."""
    return state.where((F.col("t_idx") == t_idx) & (F.col("lat_idx") < h) & (F.col("lon_idx") < w)).withColumn("value", F.col("value").cast("float"))


def to_fields(cells: DataFrame) -> DataFrame:
    """Field layout: one row-major float array per time and channel."""
    cell = F.struct("lat_idx", "lon_idx", F.col("value").cast("float").alias("value"))
    return cells.groupBy("t_idx", "ts", "channel_idx").agg(F.transform(F.array_sort(F.collect_list(cell)), lambda c: c["value"]).alias("field"))


def to_cells(fields: DataFrame, n_lon: int) -> DataFrame:
    """Cell layout of a field table (narrow: one explode)."""
    return fields.select("t_idx", "ts", "channel_idx", F.posexplode("field").alias("p", "v")).select(
        "t_idx", "ts", "channel_idx", F.floor(F.col("p") / n_lon).cast("int").alias("lat_idx"), (F.col("p") % n_lon).cast("int").alias("lon_idx"), F.col("v").cast("double").alias("value")
    )


def flatten_variables(wide: DataFrame, keys: list[str], variables: list[str]) -> DataFrame:
    """Wide variables to (channel, value) rows: one unpivot, no join."""
    return wide.unpivot(keys, variables, "channel", "value")


def read_csv(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """All columns as doubles; an empty file is an error."""
    out = spark.read.schema(", ".join(f"`{c}` double" for c in columns)).csv(path, header=True, mode="FAILFAST")
    if out.isEmpty():
        raise ValueError(f"{path} has no rows")
    return out


def string_coordinate(channels: DataFrame, name: str, fallback: str) -> DataFrame:
    """A channel-aligned string column; the fallback where it is absent or null."""
    value = F.coalesce(F.col(name).cast("string"), F.lit(fallback)) if name in channels.columns else F.lit(fallback)
    return channels.select("channel_idx", value.alias(name))


#: The whole of the driver's vectors: an 8 x 8 grid from pole to pole.
WHOLE = (8, 8)
#: Vectors of a label that are numbered together.
_NUMBERED = 1 << 16


def whole_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fields of the driver's table ``embeddings``, on a grid of 8 x 8."""
    return fields_of(read_table(spark, sf_dir, "embeddings"))


def fields_of(vectors: DataFrame) -> DataFrame:
    """t_idx, ts, channel_idx, field: every vector of ``vectors(vec_id, embedding, label)``, whole, as a field.

    The k-th vector of a label, by vec_id, is time k of that channel; channels may have
    different numbers of times.  Numbers within a stretch of ids are offset by the
    sizes of the stretches before it, so no task orders all vectors of a label.
    """
    stretch = F.floor(F.col("vec_id") / _NUMBERED)
    e = vectors.select(F.col("label").cast("int").alias("channel_idx"), stretch.alias("stretch"), "vec_id", "embedding")
    sizes = e.groupBy("channel_idx", "stretch").agg(F.count("*").alias("n"))
    before = Window.partitionBy("channel_idx").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("channel_idx", "stretch", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    own = F.row_number().over(Window.partitionBy("channel_idx", "stretch").orderBy("vec_id")) - 1
    numbered = e.withColumn("k", own).join(offsets, ["channel_idx", "stretch"]).withColumn("t_idx", F.col("offset") + F.col("k"))
    return numbered.select("t_idx", time_of(F.col("t_idx")).alias("ts"), "channel_idx", F.col("embedding").alias("field"))
