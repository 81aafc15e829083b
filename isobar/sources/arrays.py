"""Arrays kept in files of their own: statistics vectors saved as ``.npy``."""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_ROWS = 1 << 16


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
            x = np.load(io.BytesIO(content), allow_pickle=False)
            if x.dtype.kind not in "biuf":
                raise ValueError(f"{path} holds {x.dtype}, not numbers")
            flat, shape = x.ravel().astype(float), pa.array([list(x.shape)], pa.list_(pa.int64()))
            for at in range(0, len(flat), _ROWS):
                part = flat[at : at + _ROWS]
                first = pa.array(np.zeros(len(part), np.int64))
                yield pa.RecordBatch.from_arrays([pa.array([path]).take(first), shape.take(first), pa.array(np.arange(at, at + len(part))), pa.array(part)], ["path", "shape", "position", "value"])


def read_npy(spark: SparkSession, path: str) -> DataFrame:
    """path, shape, position, value: the numbers of ``.npy`` files in row-major order, as doubles.

    Read with Spark, so ``path`` may be remote, a folder or a pattern.  A file is one row
    of bytes (2 GB at most).  Objects and strings are an error; an empty array has no rows.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.npy").load(path)
    return files.select("path", "content").mapInArrow(_read, "path string, shape array<long>, position long, value double")


def channel_vector(numbers: DataFrame, channels: DataFrame, name: str) -> DataFrame:
    """channel_idx, name of one file's numbers, one per channel: a shape of n, (n, 1, 1) or (1, n, 1, 1).

    ``numbers``: as ``read_npy`` gives them.  Any other number of values is an error.
    """
    told = numbers.agg(F.count("*"), F.count_distinct("path"), F.count_distinct("position"), F.max(F.size(F.filter("shape", lambda n: n > 1)))).first()
    n = channels.count()
    if told[0] != n or told[1] != 1 or told[2] != n or (told[3] or 0) > 1:
        raise ValueError(f"{told[0]} numbers of {told[1]} files for {n} channels")
    return channels.select("channel_idx").join(numbers.select(F.col("position").cast("int").alias("channel_idx"), F.col("value").alias(name)), "channel_idx")


def describe_fields(fields: DataFrame) -> DataFrame:
    """channel_idx, n_fields, first_t, last_t, missing, repeated, least_cells, most_cells of a field table.

    missing: instants between the first and the last without a field; repeated: rows
    beyond one per instant.  Fields themselves are not read where the format keeps array
    sizes apart.
    """
    n, times = F.count("*"), F.count_distinct("t_idx")
    return fields.groupBy("channel_idx").agg(
        n.alias("n_fields"),
        F.min("t_idx").alias("first_t"),
        F.max("t_idx").alias("last_t"),
        (F.max("t_idx") - F.min("t_idx") + 1 - times).alias("missing"),
        (n - times).alias("repeated"),
        F.min(F.size("field")).alias("least_cells"),
        F.max(F.size("field")).alias("most_cells"),
    )
