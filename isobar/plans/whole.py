"""Queries over the whole state view (8 x 8 cells, every time), on the field layout.

They stand beside the older queries on the cell view, which keep their own SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from isobar.functions import grid, harmonics
from isobar.operators import fields as fl
from isobar.operators import gradient, metrics
from isobar.plans import sql as S
from isobar.plans.catalogue import _OVER, CELL, _scratch, query, rounded
from isobar.sources import arrays, state
from isobar.streaming import changes


class Whole:
    """Whole fields, their split, and the written pass over the training times."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.fields = state.whole_fields(spark, sf_dir)
        self.lat = grid.area_weights(state.dim_lat(spark, state.WHOLE[0]))
        self.weights = fl.cell_weights([r["area_w"] for r in self.lat.orderBy("lat_idx").collect()], state.WHOLE[1])
        self.n = state.read_table(spark, sf_dir, "embeddings").groupBy("label").count().agg(F.max("count")).first()[0] or 0

    @property
    def train(self) -> DataFrame:
        return self.fields.where(F.col("t_idx") < self.n * 6 // 10)

    def passed(self, source: DataFrame, stride: int, **more) -> DataFrame:
        return fl.write_pass(fl.ordered_pass(source, self.weights, stride, **more), _scratch(self.spark, "pass"))


def cells(fields: DataFrame, n_lon: int = state.WHOLE[1], value: str = "field") -> DataFrame:
    """A row per number of a field: the view that the SQL states."""
    keys = [c for c in fields.columns if c not in (value, "ts")]
    told = fields.select(*keys, F.posexplode(value).alias("p", "v"))
    return told.select(*keys, F.floor(F.col("p") / n_lon).cast("int").alias("lat_idx"), (F.col("p") % n_lon).cast("int").alias("lon_idx"), F.round(F.col("v").cast("double"), 6).alias("value"))


@query(f"WITH {S.WHOLE} SELECT t_idx, channel_idx, lat_idx, lon_idx, round(value, 6) AS value FROM state")
def q_whole_state(spark, d):
    return cells(state.whole_fields(spark, d)).select(*CELL, "value")


def _mean_std(moments: DataFrame) -> DataFrame:
    return rounded(moments.select("channel_idx", "mean", F.sqrt(F.col("m2") / F.col("w")).alias("std")))


@query(f"WITH {S.WHOLE_BASE} SELECT channel_idx, round(m, 6) AS mean, round(sd, 6) AS std FROM st")
def q_whole_moments(spark, d):
    c = Whole(spark, d)
    return _mean_std(fl.pass_moments(c.passed(c.train, 1), c.weights, 1)[0])


def _diff_stats(stride: int):
    def q(spark, d):
        c = Whole(spark, d)
        return _mean_std(fl.pass_moments(c.passed(c.train, stride), c.weights, stride)[1])

    q.__name__ = f"q_whole_time_diff_stats_s{stride}"
    return query(f"WITH {S.WHOLE_BASE}, {S.diff(stride)} SELECT channel_idx, round(m, 6) AS mean, round(sd, 6) AS std FROM ds{stride}")(q)


for _stride in (1, 2, 3):
    _diff_stats(_stride)


@query(f"WITH {S.WHOLE_BASE}, {S.diff(2)} SELECT t_idx, channel_idx, lat_idx, lon_idx, round(value, 6) AS value FROM d2")
def q_whole_time_diff_s2(spark, d):
    c = Whole(spark, d)
    return cells(fl.pass_changes(c.passed(c.train, 2, differences=True), 2)).select(*CELL, "value")


@query(f"WITH {S.WHOLE_BASE}, {S.NORM} SELECT channel_idx, lat_idx, lon_idx, round(clim, 6) AS clim FROM clim")
def q_whole_climatology(spark, d):
    c = Whole(spark, d)
    return cells(fl.pass_climatology(c.passed(c.train, 1))).withColumnRenamed("value", "clim")


@query(f"WITH {S.WHOLE}, {S.DIGESTS} SELECT channel_idx, count(*) AS n_times, sha256(string_agg(x, '' ORDER BY t_idx)) AS digest FROM slice GROUP BY 1")
def q_whole_slice_digests(spark, d):
    """Per channel the digest of its fields' digests, over every number of every field."""
    c = Whole(spark, d)
    return fl.pass_digest(c.passed(c.fields, 1))


@query(f"WITH {S.WHOLE}, {S.WHOLE_LAT}, {_OVER} SELECT t_idx, channel_idx, lat_idx, lon_idx, round(value, 6) AS value FROM rg")
def q_whole_regrid_4x4(spark, d):
    h, w = state.WHOLE
    lat = grid.overlap_weights(state.dim_lat(spark, h), state.dim_lat(spark, 4))
    out = fl.regrid_fields(state.whole_fields(spark, d).drop("ts"), lat, grid.periodic_stencil(state.dim_lon(spark, w), w), (h, w))
    return cells(out, 4).select(*CELL, "value")


def _rollout_sql(leads: int) -> str:
    return f"WITH {S.WHOLE_BASE}, a AS (SELECT x.t_idx - b AS sample_idx, x.channel_idx, x.lat_idx, x.lon_idx, x.value AS now, y.value AS before FROM state x JOIN cut ON x.t_idx >= b AND x.t_idx < n LEFT JOIN state y ON y.t_idx = x.t_idx - 1 AND y.channel_idx = x.channel_idx AND y.lat_idx = x.lat_idx AND y.lon_idx = x.lon_idx) SELECT CAST(sample_idx AS BIGINT) AS sample_idx, CAST(k AS INTEGER) AS lead, channel_idx, lat_idx, lon_idx, round(now + k * (now - before), 6) AS value FROM a, range(1, {leads + 1}) l(k)"


def _rolled(spark, d, leads: int, joint: bool) -> DataFrame:
    c = Whole(spark, d)
    initial = fl.initial_fields(c.fields, c.n * 8 // 10, c.n)
    out = fl.rollout_fields(initial, fl.linear_tendency, leads, joint=joint)
    return cells(out.select("sample_idx", "lead", "channel_idx", "field"))


@query(_rollout_sql(3))
def q_whole_rollout_3(spark, d):
    return _rolled(spark, d, 3, False)


@query(_rollout_sql(12))
def q_whole_rollout_12_joint(spark, d):
    """Twelve leads, all channels of a sample in one step: the same number of scans."""
    return _rolled(spark, d, 12, True)


_HARMONICS = """nodes AS (SELECT CAST(i AS INTEGER) AS lat_idx, pi() * i / 7 AS theta, CASE WHEN i IN (0, 7) THEN 1 ELSE 2 END / 7.0 * (1 - 2.0 / 3 * cos(2 * pi() * i / 7) - 2.0 / 15 * cos(4 * pi() * i / 7) - 2.0 / 35 * cos(6 * pi() * i / 7)) AS w FROM range(8) r(i)),
basis AS (SELECT lat_idx, w, 0 AS l, 0 AS m, sqrt(1 / (4 * pi())) AS p FROM nodes UNION ALL SELECT lat_idx, w, 1, 0, sqrt(3 / (4 * pi())) * cos(theta) FROM nodes UNION ALL SELECT lat_idx, w, 1, 1, -sqrt(3 / (8 * pi())) * sin(theta) FROM nodes),
coef AS (SELECT t_idx, channel_idx, l, m, sum(value * w * p * cos(m * lon_idx * pi() / 4)) * pi() / 4 AS re, sum(value * w * p * -sin(m * lon_idx * pi() / 4)) * pi() / 4 AS im FROM state JOIN basis USING (lat_idx) GROUP BY ALL)"""


@query(
    f"WITH {S.WHOLE}, {_HARMONICS} SELECT t_idx, channel_idx, basis.lat_idx, CAST(j AS INTEGER) AS lon_idx, round(sum(p * (CASE m WHEN 0 THEN 1 ELSE 2 END) * (re * cos(m * j * pi() / 4) - im * sin(m * j * pi() / 4))), 6) + 0.0 AS value FROM coef JOIN basis USING (l, m), range(8) x(j) GROUP BY ALL"
)
def q_whole_spectral_smooth(spark, d):
    """Every field reduced to its degrees 0 and 1."""
    out = cells(harmonics.filtered(state.whole_fields(spark, d).drop("ts"), state.WHOLE, [1.0, 1.0]))
    return out.select(*CELL, (F.col("value") + 0.0).alias("value"))


@query(
    f"WITH {S.WHOLE_FULL} SELECT model, CAST(lead AS INTEGER) AS lead, lead_hours, round(rmse, 6) AS rmse, round(mae, 6) AS mae, round(acc, 6) AS acc, valid_channels, channels, samples FROM leads"
)
def q_whole_lead_metrics(spark, d):
    """Three models scored where their truth is, in stretches of samples whose sums are merged exactly."""
    c = Whole(spark, d)
    parts = c.passed(c.train, 1, digests=False)
    own = fl.pass_moments(parts, c.weights, 1)[0]
    told = own.select("channel_idx", "mean", F.sqrt(F.col("m2") / F.col("w")).alias("std"))
    z, clim = fl.standardised(c.fields, told), fl.standardised(fl.pass_climatology(parts), told)
    steps = {"persistence": fl.persistence, "linear_tendency": fl.linear_tendency, "climatology": fl.climatology}
    sums = fl.verify_fields(z, clim, steps, S.LEADS, c.weights, c.n * 8 // 10, c.n - S.LEADS)
    return rounded(metrics.lead_results(metrics.merged_sums(metrics.sum_parts(sums, 64))))


@query(f"WITH {S.WHOLE}, {S.diff(2, 'state').split(',' + chr(10) + 'dm2')[0]} SELECT t_idx, channel_idx, lat_idx, lon_idx, round(value, 6) AS value FROM d2")
def q_whole_stream_changes(spark, d):
    """Differences as the fields arrive, in two runs of one checkpoint."""
    root, c = _scratch(spark, "changes"), Whole(spark, d)
    for part in (F.col("t_idx") < c.n // 2, F.col("t_idx") >= c.n // 2):
        c.fields.where(part).select("t_idx", "channel_idx", "field").write.mode("append").parquet(f"{root}/in")
        schema = spark.read.parquet(f"{root}/in").schema
        changes.write_changes(spark.readStream.schema(schema).parquet(f"{root}/in"), 2, f"{root}/out", f"{root}/checkpoint")
    out = spark.read.parquet(f"{root}/out").where("kind = 'change'")
    return cells(out.select("t_idx", "channel_idx", "field")).select(*CELL, "value")


@query(
    f"WITH {S.WHOLE} SELECT CAST(label AS INTEGER) AS channel_idx, count(*) AS n_fields, CAST(min(t_idx) AS BIGINT) AS first_t, CAST(max(t_idx) AS BIGINT) AS last_t, CAST(max(t_idx) - min(t_idx) + 1 - count(DISTINCT t_idx) AS BIGINT) AS missing, CAST(count(*) - count(DISTINCT t_idx) AS BIGINT) AS repeated, CAST(min(len(embedding)) AS INTEGER) AS least_cells, CAST(max(len(embedding)) AS INTEGER) AS most_cells FROM ranked GROUP BY 1"
)
def q_whole_archive(spark, d):
    """What a field table holds, channel by channel."""
    return arrays.describe_fields(state.whole_fields(spark, d))


#: Settings of the registered training run.
TRAINING = gradient.Training(epochs=3, batch=16, rate=0.3, warmup=1)
TRAINED_DEGREES = 4


@query()
def q_whole_trained_tendency(spark, d):
    """Factors per channel and degree after the best of three epochs; tested against the loop in plain numpy."""
    root, c = _scratch(spark, "training"), Whole(spark, d)
    seen = c.fields.where(F.col("t_idx") < c.n * 8 // 10)
    pairs = gradient.tendency_pairs(fl.pass_changes(c.passed(seen, 1, differences=True, digests=False), 1))
    gradient.spectral_samples(pairs, state.WHOLE, c.weights, TRAINED_DEGREES).write.parquet(f"{root}/samples")
    channels = sorted(r[0] for r in seen.select("channel_idx").distinct().collect())
    run = gradient.train(spark.read.parquet(f"{root}/samples"), (1, c.n * 6 // 10), (c.n * 6 // 10, c.n * 8 // 10), channels, TRAINED_DEGREES, f"{root}/run", TRAINING)
    return rounded(gradient.best_factors(run))
