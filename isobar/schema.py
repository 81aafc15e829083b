"""Schemas and the channel catalogue of gridded state tables.

``state_cells`` holds one row per cell (tests, small grids); ``state_fields`` one
row per time and channel with the field as a row-major array (production).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

STATE_CELLS = T.StructType(
    [
        T.StructField("t_idx", T.LongType()),
        T.StructField("ts", T.TimestampNTZType()),
        T.StructField("channel_idx", T.IntegerType()),
        T.StructField("lat_idx", T.IntegerType()),
        T.StructField("lon_idx", T.IntegerType()),
        T.StructField("value", T.DoubleType()),
    ]
)
STATE_FIELDS = "t_idx long, ts timestamp_ntz, channel_idx int, field array<float>"

# The versioned channel contract.
SURFACE_VARIABLES = (
    "10m_u_component_of_wind",
    "10m_v_component_of_wind",
    "2m_temperature",
    "surface_pressure",
    "mean_sea_level_pressure",
    "total_column_water_vapour",
)
PRESSURE_VARIABLES = ("u_component_of_wind", "v_component_of_wind", "geopotential", "temperature", "specific_humidity")
PRESSURE_LEVELS = (50, 100, 150, 200, 250, 300, 400, 500, 600, 700, 850, 925, 1000)
SURFACE_WEIGHTS = {
    "10m_u_component_of_wind": 0.1,
    "10m_v_component_of_wind": 0.1,
    "2m_temperature": 1.0,
    "surface_pressure": 0.1,
    "mean_sea_level_pressure": 0.1,
    "total_column_water_vapour": 0.1,
}

#: The channels of the driver's state view (labels 0 to 9 of its embeddings).
DRIVER_CHANNELS = (
    "10m_u_component_of_wind",
    "10m_v_component_of_wind",
    "2m_temperature",
    "surface_pressure",
    "total_column_water_vapour",
    "temperature@500hPa",
    "temperature@850hPa",
    "temperature@1000hPa",
    "geopotential@500hPa",
    "geopotential@1000hPa",
)


def channel_catalogue(spark: SparkSession) -> DataFrame:
    """channel_idx, channel, variable, pressure_hpa (null at the surface), in contract order.

    Surface variables first, then variable by variable, level by level.
    """
    surface = spark.createDataFrame([(i, v) for i, v in enumerate(SURFACE_VARIABLES)], "i int, variable string").select(
        "i", F.col("variable").alias("channel"), "variable", F.lit(None).cast("double").alias("pressure_hpa")
    )
    variables = spark.createDataFrame([(i, v) for i, v in enumerate(PRESSURE_VARIABLES)], "v int, variable string")
    levels = spark.createDataFrame([(i, float(p)) for i, p in enumerate(PRESSURE_LEVELS)], "l int, pressure_hpa double")
    upper = variables.crossJoin(levels).select(  # 5 x 13 rows
        (F.lit(len(SURFACE_VARIABLES)) + F.col("v") * len(PRESSURE_LEVELS) + F.col("l")).alias("i"),
        F.concat("variable", F.lit("@"), F.col("pressure_hpa").cast("int").cast("string"), F.lit("hPa")).alias("channel"),
        "variable",
        "pressure_hpa",
    )
    return surface.unionByName(upper).withColumnRenamed("i", "channel_idx")


def parse_channels(names: DataFrame) -> DataFrame:
    """Adds variable and pressure_hpa to ``names(channel_idx, channel)``."""
    level = F.regexp_extract("channel", "^(.*)@([0-9.]+)hPa$", 2)
    return names.select(
        "channel_idx",
        "channel",
        F.when(level != "", F.regexp_extract("channel", "^(.*)@([0-9.]+)hPa$", 1)).otherwise(F.col("channel")).alias("variable"),
        F.when(level != "", level).cast("double").alias("pressure_hpa"),
    )


def driver_channels(spark: SparkSession) -> DataFrame:
    return parse_channels(spark.createDataFrame(list(enumerate(DRIVER_CHANNELS)), "channel_idx int, channel string"))
