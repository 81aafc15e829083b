"""Registered queries of the engine and their ANSI-SQL equivalents.

Each query is thin: operators from ``isobar.operators`` over the driver's tables.
Doubles are rounded to six places on both sides.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from isobar import schema
from isobar.functions import grid, harmonics, scalars
from isobar.operators import forecast as fc
from isobar.operators import battery, contracts, losses, metrics, normalize, select, stats, training, validate, windows
from isobar.plans import sql as S
from isobar.sources import identity, publish, state
from isobar.streaming import ingest

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

CELL = ["t_idx", "channel_idx", "lat_idx", "lon_idx"]


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle is not None:
            ORACLES[f.__name__] = oracle
        return f

    return add


def rounded(df: DataFrame, *exact: str) -> DataFrame:
    return df.select(*(F.round(c, 6).alias(c) if t == "double" and c not in exact else F.col(c) for c, t in df.dtypes))


class Ctx:
    """The tables that most queries start from; every member is a lazy DataFrame."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir
        self.state = state.driver_state(spark, sf_dir)
        self.lat = grid.area_weights(state.dim_lat(spark))
        self.lon = state.dim_lon(spark)
        self.channels = schema.driver_channels(spark)
        e = state.read_table(spark, sf_dir, "embeddings")
        self.n_times = e.groupBy("label").count().agg(F.min("count").alias("n")).first()["n"] or 0

    @property
    def cut(self) -> tuple[int, int, int]:
        n = self.n_times
        return n * 6 // 10, n * 8 // 10, n

    @property
    def train(self) -> DataFrame:
        return self.state.where(F.col("t_idx") < self.cut[0])

    @property
    def stats(self) -> DataFrame:
        return stats.area_moments(self.train, self.lat, ["channel_idx"])

    @property
    def z(self) -> DataFrame:
        return normalize.normalize(self.state, self.stats)

    @property
    def zclim(self) -> DataFrame:
        return normalize.normalized_climatology(stats.climatology(self.train), self.stats)

    @property
    def initial(self) -> DataFrame:
        _, b, n = self.cut
        starts = self.spark.range(max(0, n - S.LEADS - b)).select(F.col("id").alias("sample_idx"), (F.col("id") + b).alias("base_t"))
        return fc.initial_state(starts, self.z)

    def forecasts(self, *models: str) -> DataFrame:
        out = None
        for m in models:
            f = fc.rollout(self.initial, m, S.LEADS, self.zclim)
            out = f if out is None else out.unionByName(f)
        return out

    def sums(self) -> DataFrame:
        pairs = fc.paired(self.forecasts("persistence", "linear_tendency", "climatology"), self.z)
        return metrics.channel_sums(metrics.sample_sums(pairs, self.lat, self.zclim))

    def pairs(self, model: str = "persistence") -> DataFrame:
        return fc.paired(self.forecasts(model), self.z)


# --- state, channels, grid -------------------------------------------------


@query(f"WITH {S.STATE} SELECT t_idx, TIMESTAMP '2024-01-01 00:00:00' + to_hours(CAST(6 * t_idx AS INTEGER)) AS ts, channel_idx, lat_idx, lon_idx, round(value, 6) AS value FROM state")
def q_state_view(spark, d):
    return rounded(state.driver_state(spark, d))


@query(
    f"WITH {S.STATE} SELECT channel_idx, lat_idx, lon_idx, CAST(round(value, 6) AS DOUBLE) AS value FROM state WHERE t_idx = 5 AND lat_idx < 3 AND lon_idx < 4"
)
def q_point_read(spark, d):
    return rounded(state.point_read(state.driver_state(spark, d), 5, 3, 4).select("channel_idx", "lat_idx", "lon_idx", F.col("value").cast("double").alias("value")))


@query(f"WITH {S.STATE} SELECT t_idx, channel_idx, lat_idx, lon_idx, round(value, 6) AS value FROM state")
def q_field_layout_roundtrip(spark, d):
    return rounded(state.to_cells(state.to_fields(state.driver_state(spark, d)), state.LONS).select(*CELL, "value"))


@query(
    """WITH s AS (SELECT * FROM (VALUES (0, '10m_u_component_of_wind'), (1, '10m_v_component_of_wind'), (2, '2m_temperature'), (3, 'surface_pressure'), (4, 'mean_sea_level_pressure'), (5, 'total_column_water_vapour')) v(channel_idx, variable)),
v AS (SELECT * FROM (VALUES (0, 'u_component_of_wind'), (1, 'v_component_of_wind'), (2, 'geopotential'), (3, 'temperature'), (4, 'specific_humidity')) t(v, variable)),
l AS (SELECT unnest(range(13)) AS l, unnest([50, 100, 150, 200, 250, 300, 400, 500, 600, 700, 850, 925, 1000]) AS p)
SELECT channel_idx, variable AS channel, variable, CAST(NULL AS DOUBLE) AS pressure_hpa FROM s
UNION ALL SELECT CAST(6 + 13 * v + l AS INTEGER), variable || '@' || p || 'hPa', variable, CAST(p AS DOUBLE) FROM v, l"""
)
def q_channel_catalogue(spark, d):
    return schema.channel_catalogue(spark)


@query(f"WITH {S.CHANNELS} SELECT channel_idx, round(weight, 6) AS weight FROM balw")
def q_channel_weights_balanced(spark, d):
    return rounded(normalize.balanced_weights(schema.driver_channels(spark)))


_LEGACY = "leg AS (SELECT channel_idx, coalesce(CAST(sw AS DOUBLE), 0.001 * p, 0.01) AS w FROM chp LEFT JOIN surf USING (channel)), legw AS (SELECT channel_idx, w / sum(w) OVER () AS weight FROM leg)"


@query(f"WITH {S.CHANNELS}, {_LEGACY} SELECT channel_idx, round(weight, 6) AS weight FROM legw")
def q_channel_weights_legacy(spark, d):
    return rounded(normalize.legacy_weights(schema.driver_channels(spark)))


@query(f"WITH {S.BASE}, {S.diff(1)}, {S.CHANNELS}, {_LEGACY} SELECT channel_idx, round(weight * st.sd / greatest(ds1.sd, 1e-6), 6) AS weight FROM legw JOIN st USING (channel_idx) JOIN ds1 USING (channel_idx)")
def q_channel_weights_legacy_scaled(spark, d):
    c = Ctx(spark, d)
    return rounded(normalize.legacy_weights(c.channels, stats.channel_stats(c.train, c.lat).select("channel_idx", "std", "diff_std")))


@query("SELECT CAST(i AS INTEGER) AS channel_idx, CAST(0.1 AS DOUBLE) AS weight FROM range(10) r(i)")
def q_channel_weights_constant(spark, d):
    return rounded(normalize.constant_weights(schema.driver_channels(spark)))


@query(f"WITH {S.LAT} SELECT lat_idx, round(latitude, 6) AS latitude, round(aw, 6) AS area_w FROM dlat")
def q_lat_area_weights(spark, d):
    return rounded(grid.area_weights(state.dim_lat(spark)))


@query(f"WITH {S.CHANNELS} SELECT channel_idx, 'K' AS unit FROM ch")
def q_string_coordinate(spark, d):
    return state.string_coordinate(schema.driver_channels(spark), "unit", "K")


# --- statistics -----------------------------------------------------------


@query(f"WITH {S.BASE} SELECT channel_idx, round(m, 6) AS mean, round(sd, 6) AS std FROM st")
def q_area_mean_std(spark, d):
    return rounded(Ctx(spark, d).stats)


@query(f"WITH {S.BASE} SELECT channel_idx, round(m, 6) AS mean, round(sd, 6) AS std FROM st")
def q_two_stage_moments(spark, d):
    c = Ctx(spark, d)
    return rounded(stats.two_stage_moments(c.train, c.lat))


@query(ORACLES["q_area_mean_std"])
def q_field_moments(spark, d):
    """The same from the field layout: a narrow map per field, then one merge per channel."""
    c = Ctx(spark, d)
    weights = [r["area_w"] for r in c.lat.orderBy("lat_idx").collect()]
    parts = stats.field_moments(state.to_fields(c.train), weights, state.LONS)
    return rounded(stats.mean_std(stats.merge_moments(parts.drop("t_idx"), ["channel_idx"]), ["channel_idx"]))


@query(
    f"WITH {S.STATE} SELECT channel_idx, round(min(value), 6) AS min_value, round(max(value), 6) AS max_value, round(avg(value), 6) AS mean_value, round(stddev_pop(value), 6) AS std_value, count(*) FILTER (WHERE isnan(value)) AS n_nan FROM state GROUP BY 1"
)
def q_unweighted_profile(spark, d):
    return rounded(stats.profile(state.driver_state(spark, d)))


@query(f"WITH {S.STATE}, {S.SPLIT} SELECT channel_idx, round(avg(value), 6) AS mean, round(greatest(stddev_samp(value), 1e-6), 6) AS std FROM train GROUP BY 1")
def q_benchmark_norms(spark, d):
    return rounded(stats.benchmark_norms(Ctx(spark, d).train))


@query(f"WITH {S.BASE}, {S.diff(1)} SELECT t_idx, channel_idx, lat_idx, lon_idx, round(value, 6) AS value FROM d1")
def q_time_diff(spark, d):
    return rounded(stats.time_difference(Ctx(spark, d).train, 1))


@query(f"WITH {S.BASE}, {S.diff(1)} SELECT channel_idx, round(m, 6) AS mean, round(sd, 6) AS std FROM ds1")
def q_time_diff_stats_s1(spark, d):
    c = Ctx(spark, d)
    return rounded(stats.area_moments(stats.time_difference(c.train, 1), c.lat, ["channel_idx"]))


@query(f"WITH {S.BASE}, {S.diff(2)} SELECT channel_idx, round(m, 6) AS mean, round(sd, 6) AS std FROM ds2")
def q_time_diff_stats_s2(spark, d):
    c = Ctx(spark, d)
    return rounded(stats.area_moments(stats.time_difference(c.train, 2), c.lat, ["channel_idx"]))


@query(f"WITH {S.BASE}, {S.NORM} SELECT channel_idx, lat_idx, lon_idx, round(clim, 6) AS clim FROM clim")
def q_climatology(spark, d):
    return rounded(stats.climatology(Ctx(spark, d).train))


@query(f"WITH {S.BASE}, {S.NORM} SELECT channel_idx, lat_idx, lon_idx, round(clim, 6) AS clim FROM zclim")
def q_normalized_climatology(spark, d):
    return rounded(Ctx(spark, d).zclim)


@query(f"WITH {S.BASE} SELECT channel_idx, m AS mean, sd AS std FROM st WHERE NOT isfinite(m) OR NOT isfinite(sd) OR sd <= 0")
def q_stats_guard(spark, d):
    return stats.check_stats(Ctx(spark, d).stats)


@query(f"WITH {S.BASE}, {S.NORM} SELECT t_idx, channel_idx, lat_idx, lon_idx, round(value, 6) AS value FROM z")
def q_normalize(spark, d):
    return rounded(Ctx(spark, d).z.select(*CELL, "value"))


@query(f"WITH {S.STATE} SELECT t_idx, channel_idx, lat_idx, lon_idx, round(value, 6) AS value FROM state")
def q_denormalize_roundtrip(spark, d):
    c = Ctx(spark, d)
    return rounded(normalize.denormalize(c.z, c.stats).select(*CELL, "value"))


@query(f"WITH {S.BASE}, {S.diff(1)} SELECT channel_idx, round(ds1.sd / st.sd, 6) AS scale FROM st JOIN ds1 USING (channel_idx)")
def q_tendency_scale(spark, d):
    c = Ctx(spark, d)
    return rounded(normalize.tendency_scale(stats.channel_stats(c.train, c.lat)))


# --- selection -------------------------------------------------------------


@query(
    f"WITH {S.STATE}, {S.SPLIT} SELECT CASE WHEN t_idx < a THEN 'train' WHEN t_idx < b THEN 'valid' ELSE 'test' END AS split, count(DISTINCT t_idx) AS n_times, count(*) AS n_cells, min(t_idx) AS first_t, max(t_idx) AS last_t FROM state, cut GROUP BY 1"
)
def q_split_train_valid_test(spark, d):
    c = Ctx(spark, d)
    split = select.split_by_fraction(F.col("t_idx"), F.lit(c.n_times))
    return c.state.groupBy(split.alias("split")).agg(F.count_distinct("t_idx").alias("n_times"), F.count("*").alias("n_cells"), F.min("t_idx").alias("first_t"), F.max("t_idx").alias("last_t"))


@query(
    "SELECT CASE WHEN ts <= TIMESTAMP '2024-01-18 23:59:59' THEN 'train' WHEN ts <= TIMESTAMP '2024-01-24 23:59:59' THEN 'valid' ELSE 'test' END AS split, count(*) AS n, min(event_id) AS first_id, max(event_id) AS last_id FROM events GROUP BY 1"
)
def q_split_by_dates(spark, d):
    e = state.read_table(spark, d, "events")
    return e.groupBy(select.split_of(F.col("ts"), "2024-01-18", "2024-01-24").alias("split")).agg(F.count("*").alias("n"), F.min("event_id").alias("first_id"), F.max("event_id").alias("last_id"))


@query("SELECT event_type, count(*) AS n, round(sum(value), 6) AS total FROM events WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-11' GROUP BY 1")
def q_date_slice(spark, d):
    e = select.date_slice(state.read_table(spark, d, "events"), "2024-01-05", "2024-01-10")
    return rounded(e.groupBy("event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")))


@query("SELECT 'test' AS a_name, 'train' AS b_name WHERE FALSE UNION ALL SELECT 'late', 'train'")
def q_split_overlap_guard(spark, d):
    a, b, n = Ctx(spark, d).cut
    ask = spark.createDataFrame([("test", b, n - 1), ("late", a - 1, n - 1)], "name string, first_t long, last_t long")
    return validate.overlaps(ask, spark.createDataFrame([("train", 0, a - 1)], "name string, first_t long, last_t long"))


@query(f"WITH {S.STATE}, {S.SPLIT} SELECT CAST(2 AS INTEGER) AS ord, 'valid' AS split, CAST(a AS BIGINT) AS first_t, CAST(b AS BIGINT) AS last_t FROM cut")
def q_adjacent_splits(spark, d):
    a, b, n = Ctx(spark, d).cut
    rows = spark.createDataFrame([(1, "train", 0, a - 1), (2, "valid", a, b), (3, "test", b, n - 1)], "ord int, split string, first_t long, last_t long")
    return validate.splits_in_order(rows)  # the valid split runs one step into test


@query(f"WITH {S.STATE} SELECT t_idx, channel_idx, lat_idx, lon_idx, round(value, 6) AS value FROM state WHERE t_idx % 4 = 0")
def q_time_stride(spark, d):
    return rounded(select.time_stride(state.driver_state(spark, d), 4).select(*CELL, "value"))


@query(f"WITH {S.CHANNELS} SELECT CASE p WHEN 1000 THEN 0 ELSE 1 END AS ordinal, channel_idx, channel, p AS pressure_hpa FROM chp WHERE p IN (500, 1000)")
def q_level_select(spark, d):
    levels = spark.createDataFrame([(0, 1000.0), (1, 500.0)], "ordinal int, pressure_hpa double")
    return select.pick_levels(schema.driver_channels(spark), levels).select("ordinal", "channel_idx", "channel", "pressure_hpa")


@query(f"WITH {S.STATE} SELECT t_idx, channel_idx, lat_idx, lon_idx, round(value, 6) AS value FROM state WHERE lat_idx < 4 AND lon_idx < 5")
def q_spatial_crop(spark, d):
    return rounded(select.crop(state.driver_state(spark, d), 4, 5).select(*CELL, "value"))


@query(f"WITH {S.STATE} SELECT t_idx, channel_idx, CAST(lat_idx // 2 AS INTEGER) AS lat_idx, CAST(lon_idx // 2 AS INTEGER) AS lon_idx, round(value, 6) AS value FROM state WHERE lat_idx % 2 = 0 AND lon_idx % 2 = 0")
def q_subsample_grid(spark, d):
    return rounded(select.subsample(state.driver_state(spark, d), 2, 2).select(*CELL, "value"))


@query(
    "SELECT l_linenumber AS line, kind, round(sum(v), 2) AS total FROM (SELECT l_linenumber, 'l_quantity' AS kind, l_quantity AS v FROM lineitem UNION ALL SELECT l_linenumber, 'l_discount', l_discount FROM lineitem UNION ALL SELECT l_linenumber, 'l_tax', l_tax FROM lineitem) GROUP BY 1, 2"
)
def q_flatten_variables(spark, d):
    wide = state.read_table(spark, d, "lineitem").select("l_linenumber", "l_quantity", "l_discount", "l_tax")
    rows = state.flatten_variables(wide, ["l_linenumber"], ["l_quantity", "l_discount", "l_tax"])
    return rows.groupBy(F.col("l_linenumber").alias("line"), F.col("channel").alias("kind")).agg(F.round(F.sum("value"), 2).alias("total"))


@query(f"WITH {S.STATE} SELECT CAST(i AS BIGINT) AS sample_idx, CAST(i + 2 AS BIGINT) AS base_t FROM nt, range(0, 100000) r(i) WHERE i < least(7, n - 4)")
def q_samples_first(spark, d):
    n = select.valid_windows(Ctx(spark, d).n_times, 2, 2, 1)
    return select.first_samples(windows.starts(spark, n, 2, 1), 7)


@query(f"WITH {S.STATE} SELECT CAST(i AS BIGINT) AS ordinal, CAST(CASE WHEN i = 10 THEN n - 5 ELSE floor(i * ((n - 5) / 10.0::DOUBLE)) END AS BIGINT) AS sample_idx FROM nt, range(11) r(i)")
def q_samples_evenly_spaced(spark, d):
    return select.evenly_spaced(spark, select.valid_windows(Ctx(spark, d).n_times, 2, 2, 1), 11)


@query(
    f"WITH {S.STATE}, w AS (SELECT i AS sample_idx, i + 2 AS base_t, k, i + 2 + k AS t FROM nt, range(0, 100000) r(i), range(-2, 3) q(k) WHERE i < n - 4) SELECT CAST(sample_idx AS BIGINT) AS sample_idx, CAST(base_t AS BIGINT) AS base_t, CASE WHEN k <= 0 THEN 'input' ELSE 'target' END AS role, CAST(k AS INTEGER) AS k, CAST(t AS BIGINT) AS t_idx, round(sum(value), 6) AS total FROM w JOIN state ON state.t_idx = w.t GROUP BY 1, 2, 3, 4, 5"
)
def q_windows_history2_targets2(spark, d):
    c = Ctx(spark, d)
    index = windows.window_index(windows.starts(spark, select.valid_windows(c.n_times, 2, 2, 1), 2, 1), 2, 2, 1)
    per = c.state.groupBy("t_idx").agg(F.sum("value").alias("total"))
    return rounded(index.join(per, "t_idx").select("sample_idx", "base_t", "role", "k", "t_idx", "total"))


@query(f"WITH {S.STATE} SELECT CAST(i AS BIGINT) AS sample_idx, CAST((k + 1) * 10 + channel_idx AS INTEGER) AS channel_idx, lat_idx, lon_idx, round(value, 6) AS value FROM nt, range(0, 100000) r(i), range(-1, 1) q(k) JOIN state ON t_idx = i + 1 + k WHERE i < n - 2")
def q_stacked_history(spark, d):
    c = Ctx(spark, d)
    index = windows.window_index(windows.starts(spark, select.valid_windows(c.n_times, 1, 1, 1), 1, 1), 1, 1, 1)
    return rounded(windows.stacked_inputs(index, c.state, 1, 10))


@query(f"WITH {S.STATE} SELECT CAST(i AS BIGINT) AS sample_idx, 2 AS lead, channel_idx, lat_idx, lon_idx, round(value, 6) AS value FROM nt, range(0, 100000) r(i) JOIN state ON t_idx = i + 2 WHERE i < n - 2")
def q_lazy_truth(spark, d):
    c = Ctx(spark, d)
    index = windows.window_index(windows.starts(spark, select.valid_windows(c.n_times, 0, 2, 1), 0, 1), 0, 2, 1)
    return rounded(windows.targets(index, c.state, lead=2))


# --- regridding -----------------------------------------------------------

_OVER = """tl AS (SELECT CAST(i AS INTEGER) AS lat_idx, CAST(90.0 - 60.0 * i AS DOUBLE) AS latitude FROM range(4) r(i)),
sb AS (SELECT lat_idx, coalesce((latitude + lag(latitude) OVER o) / 2, -90) AS lo, coalesce((latitude + lead(latitude) OVER o) / 2, 90) AS hi FROM lat WINDOW o AS (ORDER BY latitude)),
tb AS (SELECT lat_idx, coalesce((latitude + lag(latitude) OVER o) / 2, -90) AS lo, coalesce((latitude + lead(latitude) OVER o) / 2, 90) AS hi FROM tl WINDOW o AS (ORDER BY latitude)),
ov AS (SELECT t.lat_idx AS tgt, s.lat_idx AS src, sin(radians(least(s.hi, t.hi))) - sin(radians(greatest(s.lo, t.lo))) AS a FROM tb t JOIN sb s ON least(s.hi, t.hi) > greatest(s.lo, t.lo)),
ow AS (SELECT tgt, src, a / sum(a) OVER (PARTITION BY tgt) AS w FROM ov),
lw AS (SELECT CAST(j AS INTEGER) AS tgt, CAST((2 * j + o + 8) % 8 AS INTEGER) AS src, CASE o WHEN 0 THEN 0.5 ELSE 0.25 END AS w FROM range(4) a(j), range(-1, 2) b(o)),
rg AS (SELECT t_idx, channel_idx, ow.tgt AS lat_idx, lw.tgt AS lon_idx, sum(value * ow.w * lw.w) AS value FROM state JOIN ow ON ow.src = lat_idx JOIN lw ON lw.src = lon_idx GROUP BY 1, 2, 3, 4)"""


@query(f"WITH {S.LAT}, {_OVER[: _OVER.index(",\nlw AS")]} SELECT tgt, src, round(w, 6) AS w FROM ow")
def q_regrid_lat_overlap(spark, d):
    return rounded(grid.overlap_weights(state.dim_lat(spark), state.dim_lat(spark, 4)))


def _regridded(c: Ctx) -> DataFrame:
    return grid.regrid(c.state, grid.overlap_weights(state.dim_lat(c.spark), state.dim_lat(c.spark, 4)), grid.periodic_stencil(c.lon, state.LONS))


@query(f"WITH {S.STATE}, {S.LAT}, {_OVER} SELECT t_idx, channel_idx, lat_idx, lon_idx, round(value, 6) AS value FROM rg")
def q_regrid_4x4(spark, d):
    return rounded(_regridded(Ctx(spark, d)))


@query(f"WITH {S.STATE}, {S.LAT}, s AS (SELECT t_idx, channel_idx, sum(value * w) / sum(w) AS m FROM state JOIN area USING (lat_idx) GROUP BY 1, 2) SELECT t_idx, channel_idx, round(m, 6) AS source_mean, round(m, 6) AS target_mean FROM s")
def q_regrid_integral_preserved(spark, d):
    c = Ctx(spark, d)
    mean = lambda cells, lat, name: cells.join(F.broadcast(lat), "lat_idx").groupBy("t_idx", "channel_idx").agg((F.sum(F.col("value") * F.col("area_w")) / F.sum("area_w")).alias(name))
    target = grid.area_weights(state.dim_lat(spark, 4))
    return rounded(mean(c.state, c.lat, "source_mean").join(mean(_regridded(c), target, "target_mean"), ["t_idx", "channel_idx"]))


# --- forecasts --------------------------------------------------------------


def _fc_sql(model: str) -> str:
    return f"WITH {S.BASE}, {S.NORM}, {S.FORECAST} SELECT sample_idx, base_t, CAST(lead AS INTEGER) AS lead, channel_idx, lat_idx, lon_idx, round(prediction, 6) AS prediction FROM fc WHERE model = '{model}'"


@query(_fc_sql("persistence"))
def q_rollout_persistence(spark, d):
    return rounded(Ctx(spark, d).forecasts("persistence").drop("model"))


@query(_fc_sql("climatology"))
def q_rollout_climatology(spark, d):
    return rounded(Ctx(spark, d).forecasts("climatology").drop("model"))


@query(_fc_sql("linear_tendency"))
def q_rollout_linear_tendency(spark, d):
    return rounded(Ctx(spark, d).forecasts("linear_tendency").drop("model"))


@query(_fc_sql("linear_tendency"))
def q_rollout_autoregressive(spark, d):
    out = fc.rollout_steps(Ctx(spark, d).initial, fc.linear_step, S.LEADS)
    return rounded(out.select("sample_idx", "base_t", "lead", "channel_idx", "lat_idx", "lon_idx", "prediction"))


@query(f"WITH {S.FULL} SELECT model, CAST(lead AS INTEGER) AS lead, lead_hours, round(rmse, 6) AS rmse, round(mae, 6) AS mae, round(acc, 6) AS acc, valid_channels, channels, samples FROM leads")
def q_lead_metrics(spark, d):
    return rounded(metrics.lead_results(Ctx(spark, d).sums()))


@query(
    f"WITH {S.FULL} SELECT model, CAST(lead AS INTEGER) AS lead, lead_hours, channel_idx, round(physical_rmse, 6) AS physical_rmse, round(normalized_acc, 6) AS normalized_acc, acc_valid_initializations, round(physical_bias, 6) AS physical_bias, CASE WHEN model <> 'climatology' THEN round(spatial_variance_ratio, 4) END AS spatial_variance_ratio FROM chan"
)
def q_channel_metrics(spark, d):
    c = Ctx(spark, d)
    raw = metrics.channel_results(c.sums(), c.stats)
    out = rounded(raw, "spatial_variance_ratio")
    return out.withColumn("spatial_variance_ratio", F.when(F.col("model") != "climatology", F.round("spatial_variance_ratio", 4)))


@query(f"WITH {S.FULL} SELECT sample_idx, CAST(lead AS INTEGER) AS lead, channel_idx, round(acc, 6) AS acc FROM s1a WHERE model = 'persistence'")
def q_acc_by_init(spark, d):
    c = Ctx(spark, d)
    return rounded(metrics.sample_sums(c.pairs(), c.lat, c.zclim).select("sample_idx", "lead", "channel_idx", "acc"))


@query(
    f"WITH {S.FULL} SELECT CAST(lead AS INTEGER) AS lead, round(max(rmse) FILTER (WHERE model = 'linear_tendency'), 6) AS linear_tendency, round(max(rmse) FILTER (WHERE model = 'persistence'), 6) AS persistence, round(max(rmse) FILTER (WHERE model = 'climatology'), 6) AS climatology FROM leads GROUP BY 1"
)
def q_baseline_compare(spark, d):
    leads = metrics.lead_results(Ctx(spark, d).sums())
    return rounded(leads.groupBy("lead").pivot("model", ["linear_tendency", "persistence", "climatology"]).agg(F.max("rmse")))


@query(f"WITH {S.FULL} SELECT model, CAST(lead AS INTEGER) AS lead, round(rmse - first_value(rmse) OVER (PARTITION BY model ORDER BY lead), 6) AS rmse_growth_from_lead1 FROM leads")
def q_rmse_growth(spark, d):
    return rounded(metrics.rmse_growth(metrics.lead_results(Ctx(spark, d).sums())).select("model", "lead", "rmse_growth_from_lead1"))


@query(
    "SELECT CAST(lead AS INTEGER) AS lead, CAST(row_number() OVER (ORDER BY lead) AS INTEGER) AS level, printf('day_%02d', CAST(round(lead * 6 / 24.0) AS INTEGER)) AS name, CAST(2 AS INTEGER) AS n_channels FROM range(1, 61) r(lead) WHERE (lead * 6) % 72 = 0"
)
def q_milestones(spark, d):
    leads = spark.range(1, 61).select(F.lit("m").alias("model"), F.col("id").cast("int").alias("lead"), scalars.lead_hours(F.col("id")).alias("lead_hours"))
    channels = leads.select("model", "lead", F.explode(F.array(F.lit(0), F.lit(1))).alias("channel_idx"))
    out = metrics.milestones(leads, channels, 3)
    return out.select("lead", "level", "name", F.size("channel_rows").alias("n_channels"))


@query(
    f"WITH {S.FULL}, p AS (SELECT lead, sum(se2) / sum(sw) AS loss FROM s2 WHERE model = 'persistence' GROUP BY 1) SELECT 'persistence' AS model, round(sum(0.5 ** (lead - 1) * loss) / sum(0.5 ** (lead - 1)), 6) AS objective FROM p"
)
def q_objective_discounted(spark, d):
    c = Ctx(spark, d)
    per = losses.area_mse(c.pairs(), c.lat, ["model", "sample_idx", "lead"]).withColumn("n", F.lit(1))
    return rounded(metrics.objective(per, 0.5))


@query(f"WITH {S.BASE}, {S.diff(1)}, {S.NORM}, {S.FORECAST} SELECT sample_idx, 1 AS lead, init.channel_idx, lat_idx, lon_idx, round(now + 0.5 * (now - before) * ds1.sd / st.sd, 6) AS prediction FROM init JOIN st USING (channel_idx) JOIN ds1 USING (channel_idx)")
def q_residual_update(spark, d):
    c = Ctx(spark, d)
    step = fc.residual_step(lambda s: s.withColumn("tendency", 0.5 * (F.col("now") - F.col("before"))), normalize.tendency_scale(stats.channel_stats(c.train, c.lat)))
    out = fc.rollout_steps(c.initial, step, 1)
    return rounded(out.select("sample_idx", "lead", "channel_idx", "lat_idx", "lon_idx", "prediction"))


# --- losses -----------------------------------------------------------------

_PERS = f"WITH {S.BASE}, {S.NORM}, {S.FORECAST}, pp AS (SELECT * FROM pair JOIN dlat USING (lat_idx) WHERE model = 'persistence')"
_MSE = "per AS (SELECT lead, channel_idx, avg(aw * (prediction - target) ** 2) AS x FROM pp GROUP BY 1, 2)"


@query(f"{_PERS}, {_MSE} SELECT CAST(lead AS INTEGER) AS lead, round(avg(x), 6) AS loss FROM per GROUP BY 1")
def q_loss_area_mse(spark, d):
    c = Ctx(spark, d)
    return rounded(losses.area_mse(c.pairs(), c.lat, ["lead"]))


@query(f"{_PERS}, {_MSE}, {S.CHANNELS} SELECT CAST(lead AS INTEGER) AS lead, round(sum(weight * x), 6) AS loss FROM per JOIN balw USING (channel_idx) GROUP BY 1")
def q_loss_area_mse_weighted(spark, d):
    c = Ctx(spark, d)
    return rounded(losses.area_mse(c.pairs(), c.lat, ["lead"], normalize.balanced_weights(c.channels)))


@query(f"{_PERS} SELECT CAST(lead AS INTEGER) AS lead, round(avg(aw * abs(prediction - target)), 6) AS loss FROM pp GROUP BY 1")
def q_loss_area_l1(spark, d):
    c = Ctx(spark, d)
    return rounded(losses.area_l1(c.pairs(), c.lat, ["lead"]))


@query(
    f"{_PERS}, o AS (SELECT lead, sample_idx, channel_idx, sqrt(sum(aw * (prediction - target) ** 2)) / greatest(sqrt(sum(aw * target * target)), 1e-8) AS x FROM pp GROUP BY 1, 2, 3) SELECT CAST(lead AS INTEGER) AS lead, channel_idx, round(avg(x), 6) AS loss FROM o GROUP BY 1, 2"
)
def q_loss_relative_l2(spark, d):
    c = Ctx(spark, d)
    return rounded(losses.relative_l2(c.pairs(), c.lat, ["lead"]))


@query(
    f"{_PERS}, {S.diff(1)}, {S.CHANNELS}, per AS (SELECT lead, pp.channel_idx, avg(aw * ((prediction - target) / (ds1.sd / st.sd)) ** 2) AS x FROM pp JOIN st USING (channel_idx) JOIN ds1 USING (channel_idx) GROUP BY 1, 2) SELECT CAST(lead AS INTEGER) AS lead, round(sum(weight * x), 6) AS loss FROM per JOIN balw USING (channel_idx) GROUP BY 1"
)
def q_loss_tendency(spark, d):
    c = Ctx(spark, d)
    return rounded(losses.tendency_mse(c.pairs(), c.lat, normalize.tendency_scale(stats.channel_stats(c.train, c.lat)), normalize.balanced_weights(c.channels), ["lead"]))


@query(f"{_PERS}, {_MSE}, l AS (SELECT lead, avg(x) AS loss FROM per GROUP BY 1) SELECT round(sum(0.9 ** (lead - 1) * loss) / sum(0.9 ** (lead - 1)), 6) AS loss FROM l")
def q_loss_discounted(spark, d):
    c = Ctx(spark, d)
    return rounded(losses.discounted(losses.area_mse(c.pairs(), c.lat, ["lead"]), 0.9))


@query(f"{_PERS} SELECT CAST(lead AS INTEGER) AS lead, round(avg((prediction - target) ** 2), 6) AS loss FROM pp GROUP BY 1")
def q_loss_spectral_l2(spark, d):
    return rounded(losses.spectral(Ctx(spark, d).pairs(), ["lead"], (state.LATS, state.LONS), 2))


@query(f"{_PERS}, {S.SPECTRUM} SELECT CAST(lead AS INTEGER) AS lead, round(s, 6) AS loss FROM l1")
def q_loss_spectral_l1(spark, d):
    return rounded(losses.spectral(Ctx(spark, d).pairs(), ["lead"], (state.LATS, state.LONS), 1))


@query(f"{_PERS}, {_MSE}, {S.SPECTRUM}, mse AS (SELECT lead, avg(x) AS x FROM per GROUP BY 1) SELECT CAST(lead AS INTEGER) AS lead, round(x + 0.1 * s, 6) AS loss FROM mse JOIN l1 USING (lead)")
def q_loss_combined(spark, d):
    c = Ctx(spark, d)
    return rounded(losses.combined(c.pairs(), c.lat, ["lead"], (state.LATS, state.LONS), 0.1))


@query(
    f"WITH {S.STATE}, n AS (SELECT i AS lat_idx, pi() * i / 6 AS theta, CASE WHEN i IN (0, 6) THEN 1 ELSE 2 END / 6.0 * (1 - 2.0 / 3 * cos(pi() * i / 3) - 2.0 / 15 * cos(2 * pi() * i / 3) - 1.0 / 35 * cos(pi() * i)) AS w FROM range(7) r(i)), "
    "b AS (SELECT lat_idx, 0 AS l, 0 AS m, w * sqrt(1 / (4 * pi())) AS p FROM n UNION ALL SELECT lat_idx, 1, 0, w * sqrt(3 / (4 * pi())) * cos(theta) FROM n UNION ALL SELECT lat_idx, 1, 1, -w * sqrt(3 / (8 * pi())) * sin(theta) FROM n) "
    "SELECT t_idx, channel_idx, CAST(l AS INTEGER) AS l, CAST(m AS INTEGER) AS m, round(sum(value * p * cos(m * lon_idx * pi() / 4)) * pi() / 4, 6) + 0.0 AS re, round(sum(value * p * -sin(m * lon_idx * pi() / 4)) * pi() / 4, 6) + 0.0 AS im FROM state JOIN b USING (lat_idx) GROUP BY ALL"
)
def q_spherical_coefficients(spark, d):
    fields = state.to_fields(state.driver_state(spark, d))
    out = rounded(harmonics.analyse(fields, (state.LATS, state.LONS), 2))
    return out.withColumns({c: F.col(c) + 0.0 for c in ("re", "im")})  # no negative zeros


@query(
    f"WITH RECURSIVE {S.STATE}, {S.LEGENDRE} SELECT t_idx, channel_idx, CAST(l AS INTEGER) AS l, CAST(m AS INTEGER) AS m, round(sum(value * w * p * cos(m * lon_idx * pi() / 4)) * pi() / 4, 6) + 0.0 AS re, round(sum(value * w * p * -sin(m * lon_idx * pi() / 4)) * pi() / 4, 6) + 0.0 AS im FROM state JOIN leg USING (lat_idx) GROUP BY ALL"
)
def q_spherical_coefficients_all(spark, d):
    """All degrees the latitudes hold; the query above is their part with l <= 1."""
    fields = state.to_fields(state.driver_state(spark, d))
    out = rounded(harmonics.analyse(fields, (state.LATS, state.LONS)))
    return out.withColumns({c: F.col(c) + 0.0 for c in ("re", "im")})


# --- training ---------------------------------------------------------------


@query(
    f"WITH {S.STATE}, g AS (SELECT t_idx, channel_idx, 1 / greatest(sqrt(sum(value * value)), 1e-5) AS inv FROM state GROUP BY 1, 2), f AS (SELECT t_idx, channel_idx, count(*) OVER o * inv / greatest(sum(inv) OVER o, 1e-5) AS factor FROM g WINDOW o AS (PARTITION BY t_idx)) SELECT t_idx AS sample_idx, channel_idx, lat_idx, lon_idx, round(value * factor, 6) AS value FROM state JOIN f USING (t_idx, channel_idx)"
)
def q_balanced_gradients(spark, d):
    gradients = state.driver_state(spark, d).select(F.col("t_idx").alias("sample_idx"), *CELL[1:], "value")
    return rounded(training.balanced_gradients(gradients).select("sample_idx", *CELL[1:], "value"))


@query(f"WITH {S.STATE} SELECT round(sqrt(sum(value * value)), 6) AS norm FROM state")
def q_global_norm(spark, d):
    return rounded(training.global_norm(state.driver_state(spark, d)))


@query(
    f"WITH {S.STATE}, u AS (SELECT t_idx, sqrt(sum(value * value)) AS norm FROM state GROUP BY 1) SELECT t_idx // 10 AS epoch, count(*) AS measured, round(avg(norm), 6) AS mean_norm, round(max(norm), 6) AS max_norm, round(count(*) FILTER (WHERE norm > 2.95) / count(*), 6) AS clip_fraction, CAST(0 AS BIGINT) AS non_finite FROM u GROUP BY 1"
)
def q_clip_statistics(spark, d):
    norms = state.driver_state(spark, d).groupBy("t_idx").agg(F.sqrt(F.sum(F.col("value") * F.col("value"))).alias("norm"))
    return rounded(training.clip_statistics(norms.withColumn("epoch", F.floor(F.col("t_idx") / 10)), 2.95))


_FIT = """xy AS (SELECT b.channel_idx, b.lat_idx, b.value - a.value AS x, c.value - b.value AS y FROM z b, z a, z c, cut WHERE a.t_idx = b.t_idx - 1 AND c.t_idx = b.t_idx + 1 AND c.t_idx < cut.a
  AND a.channel_idx = b.channel_idx AND a.lat_idx = b.lat_idx AND a.lon_idx = b.lon_idx AND c.channel_idx = b.channel_idx AND c.lat_idx = b.lat_idx AND c.lon_idx = b.lon_idx),
fit AS (SELECT channel_idx, sum(aw * x * y) / sum(aw * x * x) AS slope, count(*) AS n FROM xy JOIN dlat USING (lat_idx) GROUP BY 1)"""


@query(f"WITH {S.BASE}, {S.NORM}, {_FIT} SELECT channel_idx, round(slope, 6) AS slope, n FROM fit")
def q_fit_tendency(spark, d):
    c = Ctx(spark, d)
    return rounded(training.fit_tendency(c.z.where(F.col("t_idx") < c.cut[0]), c.lat))


@query(
    f"WITH {S.BASE}, {S.NORM}, {S.FORECAST}, {_FIT} SELECT sample_idx, CAST(k AS INTEGER) AS lead, channel_idx, lat_idx, lon_idx, round(now + (now - before) * (slope + CASE WHEN k > 1 THEN slope ** 2 ELSE 0 END + CASE WHEN k > 2 THEN slope ** 3 ELSE 0 END), 6) AS prediction FROM init JOIN fit USING (channel_idx), range(1, 4) l(k)"
)
def q_rollout_fitted(spark, d):
    c = Ctx(spark, d)
    model = training.fit_tendency(c.z.where(F.col("t_idx") < c.cut[0]), c.lat)
    return rounded(fc.rollout_steps(c.initial, training.tendency_step(model), S.LEADS).select("sample_idx", "lead", *CELL[1:], "prediction"))


@query(
    f"WITH {S.CHANNELS}, b AS (SELECT channel_idx, replace(channel, 'surface', 'mean_sea_level') AS channel, p FROM chp WHERE channel_idx < 9) SELECT channel_idx, CASE WHEN b.channel IS NULL THEN 'row' ELSE 'channel' END AS field FROM chp FULL JOIN b USING (channel_idx) WHERE b.channel IS NULL OR b.channel <> chp.channel"
)
def q_split_compatibility(spark, d):
    a = schema.driver_channels(spark)
    b = a.where("channel_idx < 9").withColumn("channel", F.replace("channel", F.lit("surface"), F.lit("mean_sea_level")))
    return contracts.incompatible(a, b, ["channel_idx"], ["channel", "pressure_hpa"])


# --- validation -------------------------------------------------------------


@query(f"WITH {S.STATE} SELECT CAST(n AS BIGINT) AS n_times, CAST(21600 AS BIGINT) AS min_gap, CAST(21600 AS BIGINT) AS max_gap, TRUE AS regular FROM nt")
def q_validate_cadence(spark, d):
    return validate.cadence(state.driver_state(spark, d).select("t_idx", "ts").distinct())


@query(
    "WITH h AS (SELECT date_trunc('hour', ts) AS ts, count(*) AS c FROM events GROUP BY 1), w AS (SELECT unnest(generate_series(TIMESTAMP '2024-01-03', TIMESTAMP '2024-02-03', INTERVAL 1 HOUR)) AS ts) SELECT ts, CASE WHEN c IS NULL THEN 'missing' WHEN wts IS NULL THEN 'unexpected' ELSE 'repeated' END AS problem FROM (SELECT ts, ts AS wts FROM w) w FULL JOIN h USING (ts) WHERE c IS NULL OR wts IS NULL OR c > 1"
)
def q_validate_calendar(spark, d):
    e = state.read_table(spark, d, "events").select(F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("ts"))
    return validate.calendar(e, "2024-01-03 00:00:00", "2024-02-03 00:00:00", 1)


@query(f"WITH {S.STATE} SELECT channel_idx, count(*) AS n_cells, count(*) FILTER (WHERE NOT isfinite(value)) AS n_bad FROM state GROUP BY 1")
def q_validate_finite(spark, d):
    return validate.non_finite(state.driver_state(spark, d))


@query("SELECT CAST(7 AS BIGINT) AS n_lat, CAST(8 AS BIGINT) AS n_lon, TRUE AS global_grid")
def q_validate_grid(spark, d):
    return validate.global_grid(state.dim_lat(spark), state.dim_lon(spark))


@query("SELECT TRUE AS ok")
def q_validate_latitudes(spark, d):
    return validate.monotonic(state.dim_lat(spark))


@query(f"WITH {S.CHANNELS} SELECT CAST(v AS DOUBLE) AS pressure_hpa FROM (SELECT unnest([50, 500, 850, 925, 1000]) AS v) WHERE v NOT IN (SELECT p FROM chp WHERE p IS NOT NULL)")
def q_missing_levels(spark, d):
    want = spark.createDataFrame([(float(p),) for p in (50, 500, 850, 925, 1000)], "pressure_hpa double")
    return validate.missing(want, schema.driver_channels(spark).where("pressure_hpa IS NOT NULL"), "pressure_hpa")


@query(
    f"WITH {S.STATE}, {S.DIGESTS}, times AS (SELECT t_idx, sha256(string_agg(x, '' ORDER BY channel_idx)) AS d FROM slice GROUP BY 1) SELECT count(*) AS n_slices, 'merkle-1:' || sha256(string_agg(d, '' ORDER BY t_idx)) AS digest FROM times"
)
def q_payload_digest(spark, d):
    return validate.merkle_digest(state.driver_state(spark, d))


_CONTRACT = {"cadence_hours": 6.0, "channels": list(schema.DRIVER_CHANNELS), "forecast_step_hours": 6.0, "latitude": [90 - 30 * i for i in range(7)], "longitude": [45 * i for i in range(8)], "version": 1}


@query(f"SELECT sha256('{scalars.canonical_json(_CONTRACT)}') AS digest")
def q_contract_digest(spark, d):
    return spark.range(1).select(F.sha2(F.lit(scalars.canonical_json(_CONTRACT)).cast("binary"), 256).alias("digest"))


# --- schedules and projections ------------------------------------------------


@query(
    "SELECT u AS update, round(CASE WHEN u < 2 THEN 0.1 + 0.9 * u / 2.0 ELSE 0.01 + 0.99 * 0.5 * (1 + cos(pi() * (u - 2) / 8.0)) END, 6) AS factor FROM range(11) r(u)"
)
def q_lr_schedule(spark, d):
    return rounded(spark.range(11).select(F.col("id").alias("update"), scalars.warmup_cosine(F.col("id"), 10, 2, 0.1, 0.01).alias("factor")))


@query("SELECT i AS batch, CAST(least(least((i // 2) * 2 + 2, 5) * 4, 19) - (i // 2) * 8 AS BIGINT) AS samples FROM range(5) r(i)")
def q_bucket_counts(spark, d):
    return spark.range(5).select(F.col("id").alias("batch"), scalars.bucket_samples(F.col("id"), 5, 19, 4, 2).alias("samples"))


@query(
    "WITH y AS (SELECT unnest([1, 5, 10, 24]) AS years), s AS (SELECT years, CAST(ceil(date_diff('day', DATE '1995-01-01', least(CAST(DATE '1995-01-01' + to_years(years) AS DATE), DATE '2021-01-01')) * 24 / 6.0) AS BIGINT) AS steps FROM y), w AS (SELECT *, greatest(0, steps - 8) AS windows FROM s) SELECT CAST(years AS INTEGER) AS years, steps, windows, CAST(ceil(ceil(windows / 4.0) / 2.0) AS BIGINT) AS updates, steps * 71 * 361 * 720 * 4 AS raw_bytes FROM w"
)
def q_capacity_projection(spark, d):
    years = spark.createDataFrame([(y,) for y in (1, 5, 10, 24)], "years int")
    start = F.lit("1995-01-01").cast("date")
    end = F.least(scalars.add_years(start, F.col("years")), F.lit("2021-01-01").cast("date"))
    steps = years.withColumn("steps", scalars.count_timesteps(start, F.date_sub(end, 1), 6))
    w = steps.withColumn("windows", F.greatest(F.lit(0).cast("long"), F.col("steps") - 8))
    return w.select("years", "steps", "windows", F.ceil(F.ceil(F.col("windows") / 4) / 2).cast("long").alias("updates"), (F.col("steps") * F.lit(71 * 361 * 720 * 4).cast("long")).alias("raw_bytes"))


_HISTORY = [5.0, 4.0, 3.999, 3.5, 3.6, 3.495, 3.7, 3.2, 3.2, 3.1]


@query(
    """WITH RECURSIVE h AS (SELECT unnest(range(1, 11)) AS epoch, unnest([5.0, 4.0, 3.999, 3.5, 3.6, 3.495, 3.7, 3.2, 3.2, 3.1]::DOUBLE[]) AS loss),
f AS (SELECT epoch, loss, TRUE AS improved, 0 AS stale, loss AS best FROM h WHERE epoch = 1
UNION ALL SELECT h.epoch, h.loss, h.loss < best - 0.01, CASE WHEN h.loss < best - 0.01 THEN 0 ELSE stale + 1 END, CASE WHEN h.loss < best - 0.01 THEN h.loss ELSE best END FROM f JOIN h ON h.epoch = f.epoch + 1)
SELECT CAST(epoch AS BIGINT) AS epoch, loss, improved, stale, stale >= 3 AS stopped FROM f"""
)
def q_early_stopping(spark, d):
    return metrics.early_stopping(spark.createDataFrame(list(enumerate(_HISTORY, 1)), "epoch long, loss double"), 0.01, 3)


@query("SELECT CAST(10 AS BIGINT) AS epoch, CAST(3.1 AS DOUBLE) AS loss")
def q_best_epoch(spark, d):
    return metrics.best_epoch(spark.createDataFrame(list(enumerate(_HISTORY, 1)), "epoch long, loss double"))


@query("SELECT o_orderkey, CAST(CASE WHEN month(o_orderdate) = 2 AND day(o_orderdate) = 29 THEN make_date(year(o_orderdate) + 1, 2, 28) ELSE CAST(o_orderdate + INTERVAL 1 YEAR AS DATE) END AS VARCHAR) AS next_year FROM orders")
def q_add_years(spark, d):
    o = state.read_table(spark, d, "orders")
    return o.select("o_orderkey", scalars.add_years(F.col("o_orderdate").cast("date"), 1).cast("string").alias("next_year"))


# --- sinks and streams --------------------------------------------------------


@query(
    f"WITH {S.FULL} SELECT model, sample_idx, CAST(lead AS INTEGER) AS lead, channel_idx, lat_idx, lon_idx, round(prediction, 6) AS prediction, round(target, 6) AS target, CAST((1704067200 + base_t * 21600) * 1000000000 AS BIGINT) AS initial_time_unix_ns, CAST((1704067200 + (base_t + lead) * 21600) * 1000000000 AS BIGINT) AS valid_time_unix_ns FROM pair WHERE model = 'persistence'"
)
def q_forecast_sink(spark, d):
    c = Ctx(spark, d)
    return rounded(publish.forecast_rows(c.forecasts("persistence"), c.z, state.STEP_HOURS, state.ORIGIN))


@query("SELECT CAST(i AS BIGINT) AS t_idx, CAST((1704067200 + i * 21600) * 1000000000 AS BIGINT) AS unix_ns FROM range(40) r(i)")
def q_valid_times(spark, d):
    return spark.range(40).select(F.col("id").alias("t_idx"), scalars.epoch_ns(state.time_of(F.col("id"))).alias("unix_ns"))


@query("SELECT time_bucket(INTERVAL 6 HOUR, ts) AS bucket, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY 1, 2")
def q_event_series(spark, d):
    out = ingest.event_series(state.read_table(spark, d, "events"), 6)
    return rounded(out.withColumn("bucket", F.col("bucket").cast("timestamp_ntz")))


def _scratch(spark: SparkSession, label: str) -> str:
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if root is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = "/tmp/checkpoints"
    return f"{root.rstrip('/')}/isobar-{label}-{uuid.uuid4().hex[:12]}"


@query(f"WITH {S.STATE} SELECT channel_idx, count(*) AS n, round(sum(value), 6) AS total FROM state GROUP BY 1")
def q_stream_ingest_resume(spark, d):
    """State written in files, streamed into a table in two runs of one checkpoint."""
    root = _scratch(spark, "ingest")
    cells = state.driver_state(spark, d)
    half = Ctx(spark, d).n_times // 2
    for part in (F.col("t_idx") < half, F.col("t_idx") >= half):
        cells.where(part).write.mode("append").parquet(f"{root}/in")
        ingest.ingest(ingest.stream_table(spark, f"{root}/in", 2), f"{root}/out", f"{root}/checkpoint")
    out = spark.read.parquet(f"{root}/out")
    return rounded(out.groupBy("channel_idx").agg(F.count("*").alias("n"), F.sum("value").alias("total")))


@query(ORACLES["q_area_mean_std"].replace("FROM train JOIN", "FROM state JOIN"))
def q_stream_moments(spark, d):
    root = _scratch(spark, "moments")
    c = Ctx(spark, d)
    c.state.write.parquet(f"{root}/in")
    return rounded(ingest.streaming_moments(ingest.stream_table(spark, f"{root}/in", 4), c.lat, f"{root}/moments", f"{root}/checkpoint"))


@query(f"WITH {S.STATE} SELECT CAST(t_idx // 16 AS INTEGER) AS batch, count(*) AS n, round(sum(value), 6) AS total FROM state GROUP BY 1")
def q_batch_store(spark, d):
    """Batches of 16 times, an interruption after the first, resume, publish."""
    root = _scratch(spark, "store")
    c = Ctx(spark, d)
    contract = publish.download_contract("driver", list(schema.DRIVER_CHANNELS), "2024-01-01", "2024-01-11", 6, 30.0)
    publish.BatchStore(spark, root, "state", contract).append(0, c.state.where("t_idx < 16"))
    store = publish.BatchStore(spark, root, "state", contract)
    store.extend(c.state.withColumn("batch", F.expr("CAST(t_idx DIV 16 AS INT)")), -(-c.n_times // 16))
    store.publish(lambda t: validate.cadence(t.select("t_idx", "ts").distinct()).where("NOT regular"))
    return rounded(spark.read.parquet(f"{root}/state").groupBy("batch").agg(F.count("*").alias("n"), F.sum("value").alias("total")))


# --- validation battery, identities, split tables ----------------------------


def _spans(c: Ctx) -> dict[str, DataFrame]:
    a, b, n = c.cut
    return {s: c.state.where((F.col("t_idx") >= x) & (F.col("t_idx") < y)) for s, x, y in (("train", 0, a), ("valid", a, b), ("test", b, n))}


def _report(units: str, x: str, y: str, z: str) -> str:
    """The battery's rows for splits x, y, z in this order."""
    return f"""WITH {S.BASE}, {S.NORM}, part AS (SELECT *, CASE WHEN t_idx < a THEN 'train' WHEN t_idx < b THEN 'valid' ELSE 'test' END AS split FROM state, cut),
per AS (SELECT split, t_idx, count(*) AS n, count(*) FILTER (WHERE NOT isfinite(value)) AS bad FROM part GROUP BY 1, 2),
span AS (SELECT split, count(*) AS n_times, min(t_idx) AS lo, max(t_idx) AS hi, min(n) AS least, max(n) AS most, sum(bad) AS bad FROM per GROUP BY 1),
ch AS (SELECT count(DISTINCT channel_idx) AS c FROM state)
SELECT 'statistics_values' AS "check", NULL AS split, (SELECT bool_and(isfinite(m) AND isfinite(sd) AND sd > 0) FROM st) AS passed
UNION ALL SELECT 'statistics_channels', NULL, (SELECT count(*) FROM st) = c FROM ch
UNION ALL SELECT 'climatology_shape', NULL, (SELECT count(*) FROM clim) = c * 56 FROM ch
UNION ALL SELECT 'climatology_values', NULL, (SELECT bool_and(isfinite(clim)) FROM clim)
UNION ALL SELECT 'units', NULL, {units}
UNION ALL SELECT 'global_grid', NULL, (SELECT max(latitude) = 90 AND min(latitude) = -90 FROM dlat)
UNION ALL SELECT 'cells', split, least = c * 56 AND most = c * 56 FROM span, ch
UNION ALL SELECT 'cadence', split, n_times >= 2 AND hi - lo + 1 = n_times FROM span
UNION ALL SELECT 'finite', split, bad = 0 FROM span
UNION ALL SELECT 'same_cadence', NULL, (SELECT min(n_times) >= 2 FROM span)
UNION ALL SELECT 'order', '{y}', (SELECT hi FROM span WHERE split = '{x}') < (SELECT lo FROM span WHERE split = '{y}')
UNION ALL SELECT 'order', '{z}', (SELECT hi FROM span WHERE split = '{y}') < (SELECT lo FROM span WHERE split = '{z}')"""


def _battery(c: Ctx, splits: dict[str, DataFrame], units: str) -> DataFrame:
    channels = c.channels.select("channel_idx", "channel", F.lit(units).alias("units"))
    report = battery.validation_report(splits, c.lat, c.lon, channels, c.stats, stats.climatology(c.train), full_scan=True)
    return report.select("check", "split", "passed")


@query(_report("TRUE", "train", "valid", "test"))
def q_validation_report(spark, d):
    c = Ctx(spark, d)
    return _battery(c, _spans(c), "1")


@query(_report("FALSE", "test", "train", "valid"))
def q_validation_report_failing(spark, d):
    """Splits in a wrong order and channels without units."""
    c = Ctx(spark, d)
    parts = _spans(c)
    return _battery(c, {s: parts[s] for s in ("test", "train", "valid")}, "")


@query(
    f"WITH {S.STATE}, part AS (SELECT *, CASE WHEN t_idx < 4 THEN 'train' WHEN t_idx < 8 THEN 'valid' ELSE 'test' END AS split FROM state) SELECT split, count(DISTINCT t_idx) AS n_times, count(*) AS n_cells, round(sum(value), 6) AS total FROM part GROUP BY 1"
)
def q_split_tables(spark, d):
    """Three splits in one table, cut at the ends of days, read back."""
    root = _scratch(spark, "splits")
    identity.write_splits(state.driver_state(spark, d), f"{root}/state", "2024-01-01", "2024-01-02")
    back = spark.read.parquet(f"{root}/state")
    return rounded(back.groupBy("split").agg(F.count_distinct("t_idx").alias("n_times"), F.count("*").alias("n_cells"), F.sum("value").alias("total")))


@query(f"WITH {S.STATE} SELECT channel_idx, count(*) AS n, round(sum(value), 6) AS total FROM state WHERE t_idx BETWEEN 4 AND 7 GROUP BY 1")
def q_day_sample(spark, d):
    """One day, written over another one, read back."""
    root, cells = _scratch(spark, "sample"), state.driver_state(spark, d)
    identity.write_sample(cells, f"{root}/day", "2024-01-01")
    identity.write_sample(cells, f"{root}/day", "2024-01-02", overwrite=True)
    return rounded(spark.read.parquet(f"{root}/day").groupBy("channel_idx").agg(F.count("*").alias("n"), F.sum("value").alias("total")))


@query("SELECT event_type, count(value) AS n_runs, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std FROM events GROUP BY 1")
def q_run_summary(spark, d):
    return rounded(battery.run_summary(state.read_table(spark, d, "events"), ["event_type"], "value"))


_SOURCE = ["time", "latitude", "longitude"]


@query("SELECT 'missing variable' AS problem, '2m_temperature' AS name UNION ALL SELECT 'unexpected dimensions', 'geopotential' UNION ALL SELECT 'missing level', '850'")
def q_source_contract(spark, d):
    """A source that lacks a variable, a level, and the level dimension of another variable."""
    flat = [(v, _SOURCE) for v in schema.SURFACE_VARIABLES if v != "2m_temperature"]
    deep = [(v, _SOURCE if v == "geopotential" else [*_SOURCE, "level"]) for v in schema.PRESSURE_VARIABLES]
    levels = spark.createDataFrame([(p,) for p in schema.PRESSURE_LEVELS if p != 850], "level int")
    return battery.source_problems(spark.createDataFrame(flat + deep, "variable string, dims array<string>"), levels)
