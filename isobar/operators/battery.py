"""The validation battery of a data set: statistics, grid, and every split, as one report."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from isobar.functions.scalars import is_finite
from isobar.operators import stats as st
from isobar.operators import validate
from isobar.schema import PRESSURE_LEVELS, PRESSURE_VARIABLES, SURFACE_VARIABLES

REPORT = "check string, split string, passed boolean, detail string"


def _spans(cells: DataFrame, full_scan: bool):
    """One row of a split: its time axis, cells per time, and cells that are not finite."""
    bad = F.count_if(~is_finite(F.col("value"))) if full_scan else F.lit(None).cast("long")
    times = cells.groupBy("t_idx", "ts").agg(F.count("*").alias("n"), bad.alias("bad"))
    axis = validate.cadence(times)
    seen = times.agg(F.min("ts").alias("first"), F.max("ts").alias("last"), F.min("n").alias("least"), F.max("n").alias("most"), F.sum("bad").alias("bad"))
    return axis.crossJoin(seen).first()  # 1 x 1 row


def _first_bad(cells: DataFrame) -> int:
    first = cells.agg(F.min("t_idx")).first()[0]
    return cells.where((F.col("t_idx") == first) & ~is_finite(F.col("value"))).count()


def validation_report(
    splits: dict[str, DataFrame],
    lat: DataFrame,
    lon: DataFrame,
    channels: DataFrame,
    stats: DataFrame,
    clim: DataFrame,
    tendency: DataFrame | None = None,
    full_scan: bool = False,
    digests: dict[str, str] | None = None,
) -> DataFrame:
    """check, split, passed, detail: a row per check of a data set.

    ``splits`` are state cells by name, in the order of their times;
    ``channels(channel_idx, units)``, ``stats(channel_idx, mean, std)``,
    ``clim(channel_idx, lat_idx, lon_idx, clim)``, ``tendency(channel_idx, mean, std)``.
    Without ``full_scan`` only the first time of a split is looked at for values that
    are not finite; with it all are, and each split's ``merkle_digest`` must be the
    one in ``digests``.  Every table is aggregated where it lies: the driver gets a
    row per split and check.  An empty split fails its checks.
    """
    out: list[tuple] = []

    def told(check: str, passed, detail="", split: str | None = None) -> None:
        out.append((check, split, bool(passed), str(detail)))

    c, h, w = channels.count(), lat.count(), lon.count()
    for name, table in (("statistics", stats), ("tendency", tendency)):
        if table is None:
            continue
        bad = st.check_stats(table).count()
        told(f"{name}_values", not bad, f"{bad} channels without finite mean and positive deviation")
        odd = table.select("channel_idx", F.lit(1).alias("a")).join(channels.select("channel_idx", F.lit(1).alias("b")), "channel_idx", "full").where("a IS NULL OR b IS NULL").count()
        told(f"{name}_channels", not odd and table.count() == c, f"{odd} channels on one side only")
    cell = clim.agg(F.count("*").alias("n"), F.count_if(~is_finite(F.col("clim"))).alias("bad"), F.count_distinct("channel_idx", "lat_idx", "lon_idx").alias("cells")).first()
    told("climatology_shape", cell["n"] == cell["cells"] == c * h * w, f"{cell['cells']} of {c * h * w} cells in {cell['n']} rows")
    told("climatology_values", not cell["bad"], f"{cell['bad']} cells not finite")
    blank = channels.where("units IS NULL OR trim(units) = ''").count()
    told("units", not blank, f"{blank} channels without a unit")
    grid = validate.global_grid(lat, lon).first()
    told("global_grid", grid["global_grid"], f"{grid['n_lat']} x {grid['n_lon']}")
    seen = {name: _spans(cells, full_scan) for name, cells in splits.items()}
    for name, s in seen.items():
        told("cells", s["n_times"] > 0 and s["least"] == s["most"] == c * h * w, f"{s['least']} to {s['most']} of {c * h * w} a time", name)
        told("cadence", s["regular"], f"{s['n_times']} times, gaps {s['min_gap']} to {s['max_gap']} s", name)
        bad = s["bad"] if full_scan else _first_bad(splits[name])
        told("finite", s["n_times"] > 0 and not bad, f"{bad} cells not finite" + " at the first time" * (not full_scan), name)
        if full_scan and digests and name in digests:
            found = validate.merkle_digest(splits[name]).first()["digest"]
            told("payload", found == digests[name], found, name)
    gaps = {(s["min_gap"], s["max_gap"]) for s in seen.values()}
    told("same_cadence", len(gaps) == 1, f"{len(gaps)} cadences")
    for (a, x), (b, y) in zip(list(seen.items()), list(seen.items())[1:]):
        told("order", x["last"] is not None and y["first"] is not None and x["last"] < y["first"], f"{a} to {x['last']}, {b} from {y['first']}", b)
    return stats.sparkSession.createDataFrame(out, REPORT)


def source_problems(variables: DataFrame, levels: DataFrame | None) -> DataFrame:
    """problem, name: what a source of the full state lacks, from its metadata only.

    ``variables(variable, dims array<string>)`` in any order of dimensions;
    ``levels(level)``, None where the source has no such coordinate.  Variables and levels
    beyond the contract are allowed.
    """
    spark = variables.sparkSession
    flat = ["latitude", "longitude", "time"]
    want = spark.createDataFrame([(v, flat) for v in SURFACE_VARIABLES] + [(v, sorted([*flat, "level"])) for v in PRESSURE_VARIABLES], "name string, want array<string>")
    met = want.join(variables.select(F.col("variable").alias("name"), F.sort_array("dims").alias("dims")), "name", "left")
    problem = F.when(F.col("dims").isNull(), "missing variable").when(F.col("dims") != F.col("want"), "unexpected dimensions")
    out = met.select(problem.alias("problem"), "name").where("problem IS NOT NULL")
    if levels is None:
        return out.unionByName(spark.createDataFrame([("missing coordinate", "level")], "problem string, name string"))
    need = spark.createDataFrame([(float(p),) for p in PRESSURE_LEVELS], "level double")
    lacking = need.join(levels.select(F.col("level").cast("double").alias("level")), "level", "left_anti")
    return out.unionByName(lacking.select(F.lit("missing level").alias("problem"), F.col("level").cast("int").cast("string").alias("name")))


def channel_statistics(stats: DataFrame, n_channels: int) -> DataFrame:
    """``stats`` if it has one row for each channel 0 to n_channels - 1, else an error."""
    n = stats.agg(F.count("*").alias("n"), F.count_distinct("channel_idx").alias("c"), F.min("channel_idx").alias("a"), F.max("channel_idx").alias("b")).first()
    if n["n"] == 0 or (n["n"], n["c"], n["a"], n["b"]) != (n_channels, n_channels, 0, n_channels - 1):
        raise ValueError(f"expected {n_channels} channels, the statistics hold {n['c']} in {n['n']} rows")
    return stats


def run_summary(runs: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys, n_runs, mean, std (of the population): repeated runs of a benchmark by profile."""
    return runs.groupBy(*keys).agg(F.count(value).alias("n_runs"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"))
