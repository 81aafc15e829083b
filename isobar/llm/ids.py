"""Finding rows by a set of ids without shuffling the rest of a wide table.

A bitmap of ``BITS`` hash positions, a table of 64-bit words, is broadcast: its size
is fixed, whatever the input.  Rows whose position is not set pass (or fail) at once;
only the others, the wanted ones and some by chance, are shuffled and joined.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Positions of the bitmap; as words it has at most BITS / 64 rows (131072).
BITS = 1 << 23


def _spot(column: str) -> Column:
    return F.pmod(F.xxhash64(F.col(column).cast("long")), F.lit(BITS))


def _marked(docs: DataFrame, key: str, ids: DataFrame) -> DataFrame:
    """docs as a struct ``_row``, its id, and ``_hit``: may ids (one column) hold it?"""
    spot = _spot(ids.columns[0])
    words = ids.select(spot.alias("spot")).groupBy(F.shiftright("spot", 6).alias("_word")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(spot & 63 AS INT))")).alias("_bits"))
    packed = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("_row"), docs[key].cast("long").alias("_id"))
    at = packed.withColumn("_spot", _spot("_id")).withColumn("_word", F.shiftright("_spot", 6))
    hit = F.expr("coalesce(shiftrightunsigned(_bits, CAST(_spot & 63 AS INT)) & 1, 0) = 1")
    return at.join(F.broadcast(words), "_word", "left").select("_row", "_id", (F.col("_id").isNotNull() & hit).alias("_hit"))


def maybe(docs: DataFrame, key: str, ids: DataFrame) -> DataFrame:
    """Rows of ``docs`` whose ``key`` is in ``ids`` (one column), and a few others."""
    return _marked(docs, key, ids).where("_hit").select("_row.*")


def drop_ids(docs: DataFrame, key: str, touched: DataFrame) -> DataFrame:
    """``docs`` without the rows of ``touched(id, goes)`` that go; same columns.

    Of rows that repeat a touched id that stays, one is kept.  Null ids stay.
    """
    name = touched.columns[0]
    marked = _marked(docs, key, touched.select(name))
    told = touched.select(F.col(name).alias("_id"), "goes")
    met = marked.where("_hit").join(told, "_id", "left").where("goes IS NULL OR NOT goes")
    once = met.where("goes IS NOT NULL").dropDuplicates(["_id"]).select("_row.*")
    return marked.where("NOT _hit").select("_row.*").unionByName(met.where("goes IS NULL").select("_row.*")).unionByName(once)
