"""Grid geometry: cell edges, area weights, interval overlap, stencils."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _sine(edge: Column) -> Column:
    return F.sin(F.radians(edge))


def area_weights(lat: DataFrame) -> DataFrame:
    """lat_idx, latitude, area_w (unit mean) of ``lat(lat_idx, latitude)``.

    Edges are midpoints; outer edges are half a cell further out, clipped at the
    poles.  A single latitude weighs 1.  Either orientation is fine.
    """
    o = Window.orderBy("lat_idx")  # a dimension table: hundreds of rows
    prev, nxt, x = F.lag("latitude").over(o), F.lead("latitude").over(o), F.col("latitude")
    up = F.coalesce((x + prev) / 2, x + (x - nxt) / 2)
    down = F.coalesce((x + nxt) / 2, x - (prev - x) / 2)
    clip = lambda e: F.greatest(F.lit(-90.0), F.least(F.lit(90.0), e))
    w = F.coalesce(F.abs(_sine(clip(up)) - _sine(clip(down))), F.lit(1.0))
    return lat.select("lat_idx", "latitude", w.alias("w")).select("lat_idx", "latitude", (F.col("w") / F.avg("w").over(Window.partitionBy())).alias("area_w"))


def cell_bounds(lat: DataFrame) -> DataFrame:
    """lat_idx, latitude, lo, hi for regridding: midpoints, outer edges at the poles."""
    o = Window.orderBy("latitude")
    x = F.col("latitude")
    return lat.select(
        "lat_idx",
        "latitude",
        F.coalesce((x + F.lag("latitude").over(o)) / 2, F.lit(-90.0)).alias("lo"),
        F.coalesce((x + F.lead("latitude").over(o)) / 2, F.lit(90.0)).alias("hi"),
    )


def overlap_weights(source: DataFrame, target: DataFrame) -> DataFrame:
    """(tgt, src, w): share of each target band's area that a source band covers.

    An interval-overlap join of two dimension tables (at most hundreds of rows).
    """
    s = cell_bounds(source).select(F.col("lat_idx").alias("src"), F.col("lo").alias("s_lo"), F.col("hi").alias("s_hi"))
    t = cell_bounds(target).select(F.col("lat_idx").alias("tgt"), F.col("lo").alias("t_lo"), F.col("hi").alias("t_hi"))
    lo, hi = F.greatest("s_lo", "t_lo"), F.least("s_hi", "t_hi")
    met = t.join(F.broadcast(s), hi > lo).select("tgt", "src", (_sine(hi) - _sine(lo)).alias("a"))
    return met.select("tgt", "src", (F.col("a") / F.sum("a").over(Window.partitionBy("tgt"))).alias("w"))


def periodic_stencil(lon: DataFrame, n_lon: int, factor: int = 2) -> DataFrame:
    """(tgt, src, w): 1/4, 1/2, 1/4 around every factor-th longitude, across the seam."""
    tap = F.explode(F.array(*(F.struct(F.lit(o).alias("o"), F.lit(w).alias("w")) for o, w in ((-1, 0.25), (0, 0.5), (1, 0.25)))))
    rows = lon.where(F.col("lon_idx") % factor == 0).select(F.floor(F.col("lon_idx") / factor).cast("int").alias("tgt"), "lon_idx", tap.alias("p"))
    return rows.select("tgt", F.pmod(F.col("lon_idx") + F.col("p.o"), F.lit(n_lon)).cast("int").alias("src"), F.col("p.w").alias("w"))


def regrid(cells: DataFrame, lat_w: DataFrame, lon_w: DataFrame) -> DataFrame:
    """Area-conservative regridding: longitude stencil, then latitude overlap.

    The kernel is separable: two broadcast joins of small weight tables, each
    followed by a sum that is combined map-side.
    """
    keys = ["t_idx", "channel_idx"]
    along = (
        cells.join(F.broadcast(lon_w.select(F.col("src").alias("lon_idx"), F.col("tgt").alias("j"), "w")), "lon_idx")
        .groupBy(*keys, "lat_idx", "j")
        .agg(F.sum(F.col("value") * F.col("w")).alias("value"))
    )
    return (
        along.join(F.broadcast(lat_w.select(F.col("src").alias("lat_idx"), F.col("tgt").alias("i"), "w")), "lat_idx")
        .groupBy(*keys, F.col("i").alias("lat_idx"), F.col("j").alias("lon_idx"))
        .agg(F.sum(F.col("value") * F.col("w")).alias("value"))
    )
