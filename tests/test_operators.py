"""Identities, exact values and negative cases of the gridded operators."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from isobar import schema
from isobar.functions import grid, harmonics, scalars
from isobar.operators import contracts, forecast, losses, metrics, normalize, select, stats, training, validate
from isobar.sources import publish, state


def cells(spark, values, first_t=0):
    """values[t][channel][lat][lon] as state cells."""
    rows = [(first_t + t, c, i, j, float(v)) for (t, c, i, j), v in np.ndenumerate(np.asarray(values, dtype=float))]
    return spark.createDataFrame(rows, "t_idx long, channel_idx int, lat_idx int, lon_idx int, value double")


def lat_table(spark, n):
    return grid.area_weights(state.dim_lat(spark, n))


def test_moments_match_numpy_under_a_large_offset(spark):
    x = 1e5 + np.random.default_rng(4).normal(size=(16, 2, 5, 8))
    lat = lat_table(spark, 5)
    w = np.array([r.area_w for r in lat.orderBy("lat_idx").collect()])[None, :, None] * np.ones((16, 5, 8))
    for f in (lambda c: stats.area_moments(c, lat, ["channel_idx"]), lambda c: stats.two_stage_moments(c, lat)):
        for r in f(cells(spark, x)).collect():
            v = x[:, r.channel_idx]
            m = (v * w).sum() / w.sum()
            assert r["mean"] == pytest.approx(m, rel=1e-12)
            assert r["std"] == pytest.approx(math.sqrt((((v - m) ** 2) * w).sum() / w.sum()), rel=1e-8)


def test_regrid_keeps_constants_and_wraps(spark):
    lw = grid.overlap_weights(state.dim_lat(spark, 7), state.dim_lat(spark, 4))
    ow = grid.periodic_stencil(state.dim_lon(spark, 8), 8)
    got = [r["value"] for r in grid.regrid(cells(spark, np.full((1, 1, 7, 8), 7.0)), lw, ow).collect()]
    assert len(got) == 16 and got == pytest.approx([7.0] * 16)
    seam = np.zeros((1, 1, 7, 8))
    seam[..., -1] = 1.0
    rows = {(r.lat_idx, r.lon_idx): r["value"] for r in grid.regrid(cells(spark, seam), lw, ow).collect()}
    assert rows[(0, 0)] == pytest.approx(0.25) and rows[(0, 3)] == pytest.approx(0.25) and rows[(0, 1)] == pytest.approx(0)


def test_physical_rmse_exact(spark):
    pairs = cells(spark, np.ones((1, 2, 5, 8))).select(F.lit("m").alias("model"), F.lit(0).alias("sample_idx"), F.lit(1).alias("lead"), "channel_idx", "lat_idx", "lon_idx", F.col("value").alias("prediction"), F.lit(0.0).alias("target"))
    clim = pairs.select("channel_idx", "lat_idx", "lon_idx", F.lit(0.0).alias("clim"))
    sums = metrics.channel_sums(metrics.sample_sums(pairs, lat_table(spark, 5), clim))
    std = spark.createDataFrame([(0, 2.0), (1, 4.0)], "channel_idx int, std double")
    got = {r.channel_idx: r for r in metrics.channel_results(sums, std).collect()}
    assert got[0].physical_rmse == pytest.approx(2) and got[1].physical_rmse == pytest.approx(4)
    assert got[0].normalized_acc is None and got[0].spatial_variance_ratio is None
    assert metrics.lead_results(sums).first().rmse == pytest.approx(1)


def test_acc_is_a_mean_per_initialisation(spark):
    truth = np.random.default_rng(1).normal(size=(1, 3, 3, 2))
    pred = np.concatenate([100 * truth, -truth])
    p = cells(spark, pred).withColumnRenamed("value", "prediction").withColumnRenamed("t_idx", "sample_idx")
    y = cells(spark, np.concatenate([truth, truth])).withColumnRenamed("value", "target").withColumnRenamed("t_idx", "sample_idx")
    pairs = p.join(y, ["sample_idx", "channel_idx", "lat_idx", "lon_idx"]).withColumn("model", F.lit("m")).withColumn("lead", F.lit(1))
    clim = pairs.select("channel_idx", "lat_idx", "lon_idx", F.lit(0.0).alias("clim")).distinct()
    lat = lat_table(spark, 3)
    one = metrics.lead_results(metrics.channel_sums(metrics.sample_sums(pairs, lat, clim))).first()
    other = metrics.lead_results(metrics.channel_sums(metrics.sample_sums(pairs.repartition(7), lat, clim))).first()
    assert one.acc == pytest.approx(0, abs=1e-12) and other.rmse == pytest.approx(one.rmse, rel=1e-12)


def test_discounted_loss_exact(spark):
    rows = spark.createDataFrame([(1, 1.0), (2, 9.0)], "lead int, loss double")
    assert losses.discounted(rows, 0.5).first().loss == pytest.approx((1 + 0.5 * 9) / 1.5)


def test_spectral_l2_is_mse(spark):
    r = np.random.default_rng(3)
    p, y = r.normal(size=(2, 2, 4, 6)), r.normal(size=(2, 2, 4, 6))
    pairs = cells(spark, p).withColumnRenamed("value", "prediction").join(cells(spark, y).withColumnRenamed("value", "target"), ["t_idx", "channel_idx", "lat_idx", "lon_idx"]).withColumn("lead", F.lit(1)).withColumnRenamed("t_idx", "sample_idx")
    assert losses.spectral(pairs, ["lead"], (4, 6), 2).first().loss == pytest.approx(((p - y) ** 2).mean())


def test_rollout_loop_equals_closed_form(spark):
    x = cells(spark, np.random.default_rng(5).normal(size=(6, 1, 2, 2)))
    init = forecast.initial_state(spark.createDataFrame([(0, 2), (1, 3)], "sample_idx long, base_t long"), x)
    key = ["sample_idx", "lead", "channel_idx", "lat_idx", "lon_idx"]
    a = {tuple(r[k] for k in key): r.prediction for r in forecast.rollout(init, "linear_tendency", 3).collect()}
    b = {tuple(r[k] for k in key): r.prediction for r in forecast.rollout_steps(init, forecast.linear_step, 3).collect()}
    assert a.keys() == b.keys() and all(a[k] == pytest.approx(b[k]) for k in a)


def test_arrow_forecaster(spark):
    import pyarrow as pa
    import pyarrow.compute as pc

    def double(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pc.multiply(b.column("now"), 2.0)], [*b.schema.names, "next"])

    init = forecast.initial_state(spark.createDataFrame([(0, 1)], "sample_idx long, base_t long"), cells(spark, np.ones((2, 1, 1, 1))))
    got = [r.prediction for r in forecast.rollout_steps(init, forecast.arrow_step(double), 3).orderBy("lead").collect()]
    assert got == [2.0, 4.0, 8.0]


def test_milestones_and_schedule(spark):
    leads = spark.range(1, 61).select(F.lit("m").alias("model"), F.col("id").cast("int").alias("lead"), (F.col("id") * 6.0).alias("lead_hours"))
    got = metrics.milestones(leads, leads.select("model", "lead", F.lit(0).alias("channel_idx")), 3).orderBy("lead").collect()
    assert [r.lead for r in got] == [12, 24, 36, 48, 60] and got[0].name == "day_03"
    with pytest.raises(ValueError):
        scalars.warmup_cosine(F.lit(1), 10, 10, 0.1, 0.01)


def test_balanced_weights(spark):
    w = {r.channel_idx: r.weight for r in normalize.balanced_weights(schema.driver_channels(spark)).collect()}
    assert sum(w.values()) == pytest.approx(1) and w[9] == pytest.approx(2 * w[8])
    bad = schema.parse_channels(spark.createDataFrame([(0, "nonsense")], "channel_idx int, channel string"))
    with pytest.raises(Exception, match="no weight for channel"):
        normalize.balanced_weights(bad).collect()


def test_samples(spark):
    assert [r.sample_idx for r in select.evenly_spaced(spark, 23, 3).orderBy("ordinal").collect()] == [0, 11, 22]
    with pytest.raises(ValueError):
        select.valid_windows(4, 2, 2, 1)
    with pytest.raises(ValueError):
        select.split_range("later")


def test_date_slice_takes_the_whole_end_day(spark):
    t = spark.createDataFrame([("2018-12-31 18:00:00",), ("2019-01-01 00:00:00",)], "s string").select(F.col("s").cast("timestamp_ntz").alias("ts"))
    assert select.date_slice(t, None, "2018-12-31").count() == 1
    assert select.date_slice(t, "2018-12-31 18:00:00", "2019-01-01 00:00:00").count() == 2


@pytest.mark.parametrize("index", [[0, 1, 3], [0, 1, 1, 2], [0, 2, 1]])
def test_broken_calendars_are_found(spark, index):
    t = spark.createDataFrame([(i, k) for i, k in enumerate(index)], "t_idx long, k long").select("t_idx", state.time_of(F.col("k")).alias("ts"))
    assert not validate.cadence(t).first().regular


def test_empty_and_non_finite(spark):
    assert stats.climatology(cells(spark, np.zeros((0, 1, 1, 1)))).count() == 0
    bad = cells(spark, [[[[float("nan")], [1.0]]]])
    assert validate.non_finite(bad).first().n_bad == 1
    p = stats.profile(bad).first()
    assert (p.n_nan, p.min_value) == (1, 1.0)


def test_batch_store_recovers(spark, tmp_path):
    root, c = str(tmp_path), {"v": 1}
    rows = lambda b: cells(spark, np.full((1, 1, 2, 2), b), first_t=b)
    rows(9).write.parquet(f"{root}/s.partial/batch=0")  # interrupted before any commit
    store = publish.BatchStore(spark, root, "s", c)
    assert store.resume() == 0
    store.append(0, rows(0))
    rows(5).write.parquet(f"{root}/s.partial/batch=1")  # not committed
    store = publish.BatchStore(spark, root, "s", c)
    assert store.resume() == 1
    store.append(1, rows(1))
    with pytest.raises(ValueError, match="contract changed"):
        publish.BatchStore(spark, root, "s", {"v": 2}).resume()
    with pytest.raises(ValueError, match="not published"):
        store.publish(lambda t: t)
    store.publish(lambda t: t.where("false"))
    assert sorted(r["value"] for r in spark.read.parquet(f"{root}/s").select("value").distinct().collect()) == [0.0, 1.0]
    with pytest.raises(FileExistsError):
        store.resume()


def test_batch_store_extends_by_many_batches(spark, tmp_path):
    root, c = str(tmp_path), {"v": 1}
    rows = cells(spark, np.arange(40.0).reshape(10, 1, 2, 2)).withColumn("batch", F.expr("CAST(t_idx DIV 2 AS INT)"))
    told = lambda store: sorted((r["batch"], r["value"]) for r in store.table().collect())
    want = [(k // 8, float(k)) for k in range(40)]
    publish.BatchStore(spark, root, "s", c).append(0, rows.where("batch = 0").drop("batch"))
    rows.where("batch = 3").drop("batch").withColumn("value", F.lit(-1.0)).write.parquet(f"{root}/s.partial/batch=3")  # left by an interrupted call
    store = publish.BatchStore(spark, root, "s", c)
    with pytest.raises(ValueError, match="1 batches have no rows, the first is 3"):
        store.extend(rows.where("batch <> 3"), 5)
    assert store.resume() == 1
    changed = rows.withColumn("value", F.when(F.col("batch") == 0, -1.0).otherwise(F.col("value")))
    assert store.extend(changed, 4, "t_idx") == 4  # committed batches stay as they are
    assert told(store) == want[:32]
    assert store.extend(rows, 5) == store.extend(rows, 5) == 5
    assert told(store) == want
    with pytest.raises(ValueError, match="contract changed"):
        publish.BatchStore(spark, root, "s", {"v": 2}).extend(rows, 6)


def test_batch_store_query_runs_as_many_jobs_over_more_batches(spark, tmp_path):
    from isobar.plans import catalogue

    jobs = []
    for n in (40, 200):  # 3 and 13 batches
        path = f"{tmp_path}/{n}"
        spark.range(2 * n).selectExpr("id AS vec_id", "transform(sequence(1, 64), x -> CAST(x + id AS FLOAT)) AS embedding", "CAST(id % 2 AS INT) AS label").write.parquet(f"{path}/embeddings.parquet")
        spark.sparkContext.setJobGroup(path, "batch store")
        assert catalogue.q_batch_store(spark, path).count() == -(-n // 16)
        jobs.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(path)))
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert jobs[1] <= jobs[0] + 3


def test_statistics_bundle(spark, tmp_path):
    root = f"{tmp_path}/bundle"
    a = spark.createDataFrame([(0, 1.0)], "channel_idx int, mean double")
    publish.write_bundle(a, a, root, {"step": 1})
    assert publish.check_bundle(spark, root, {"step": 1}) == []
    assert publish.check_bundle(spark, root, {"step": 2}) == ["step"]
    with pytest.raises(FileExistsError):
        publish.write_bundle(a, a, root, {})


def test_ledger_and_csv(spark, tmp_path):
    for e in (1, 2, 3):
        publish.append_history(spark.createDataFrame([(e, 0.5)], "epoch int, loss double"), f"{tmp_path}/h")
    publish.rewind_history(spark, str(tmp_path), "h", 2)
    assert spark.read.parquet(f"{tmp_path}/h").count() == 2
    publish.write_report(spark.read.parquet(f"{tmp_path}/h"), f"{tmp_path}/csv")
    assert state.read_csv(spark, f"{tmp_path}/csv", ["epoch", "loss"]).count() == 2


def test_digests_and_versions(spark):
    x = cells(spark, np.arange(8.0).reshape(2, 1, 2, 2))
    import hashlib

    assert validate.payload_digest(x) == hashlib.sha256(np.arange(8, dtype="<f4").tobytes()).hexdigest()
    assert validate.merkle_digest(x.repartition(3)).first() == validate.merkle_digest(x).first()
    assert scalars.split_version("2.10.1rc1") == (2, 10, 1)
    assert scalars.differences({"a": 1, "b": 2}, {"a": 1, "c": 3}) == ["b", "c"]
    assert scalars.canonical_json({"b": 1, "a": [1]}) == '{"a":[1],"b":1}'


def test_balanced_gradients_and_clipping(spark):
    x = cells(spark, [[[[3.0, 4.0]], [[0.0, 0.0]], [[6.0, 8.0]]]]).withColumnRenamed("t_idx", "sample_idx")
    got = {(r.channel_idx, r.lon_idx): r.value for r in training.balanced_gradients(x, 1e-5).collect()}
    inverse = np.array([1 / 5, 1 / 1e-5, 1 / 10])
    factor = 3 * inverse / inverse.sum()
    assert got[0, 0] == pytest.approx(3 * factor[0]) and got[2, 1] == pytest.approx(8 * factor[2]) and got[1, 0] == 0
    assert training.global_norm(x).first().norm == pytest.approx(math.sqrt(125)) and training.global_norm(x.where("false")).first().norm == 0
    u = spark.createDataFrame([(1, 0.5), (1, 1.5), (1, float("inf")), (2, float("nan"))], "epoch int, norm double")
    a, b = training.clip_statistics(u, 1.0).orderBy("epoch").collect()
    assert tuple(a)[1:] == (2, 1.0, 1.5, 0.5, 1) and tuple(b)[1:] == (0, 0.0, 0.0, 0.0, 1)


def test_fitted_tendency_recovers_the_slope_and_skips_gaps(spark):
    v = [0.0, 1.0, 1.5, 1.75, 1.875]
    x = cells(spark, [[[[t * s for s in (1, -2)]] * 3, [[7.0, 7.0]] * 3] for t in v])
    fit = {r.channel_idx: r for r in training.fit_tendency(x, lat_table(spark, 3)).collect()}
    assert fit[0].slope == pytest.approx(0.5) and fit[0].n == 18 and fit[1].slope == 0
    assert training.tendencies(x.where("t_idx <> 2")).count() == 0
    init = forecast.initial_state(spark.createDataFrame([(0, 4)], "sample_idx long, base_t long"), x)
    out = forecast.rollout_steps(init, training.tendency_step(training.fit_tendency(x, lat_table(spark, 3))), 2).where("channel_idx = 0 AND lat_idx = 0 AND lon_idx = 0")
    assert [r.prediction for r in out.orderBy("lead").collect()] == pytest.approx([1.9375, 1.96875])


def test_precision(spark):
    r = training.precision_rmse(spark.createDataFrame([(1.0, 1.0), (2.0, 5.0), (None, 1.0)], "a double, b double"), "a", "b").first()
    assert (r.rmse, r.max_error, r.n) == (pytest.approx(math.sqrt(4.5)), 3.0, 2)


def test_checkpoints(spark, tmp_path):
    model = spark.createDataFrame([(0, 0.5)], "channel_idx int, slope double")
    manifest = {"epoch": 3, "update": 12, "training_config": {"step": 1, "range": (1, 2)}, "data_signature": {"digest": "a"}}
    training.save_checkpoint(model, str(tmp_path), "last", manifest)
    expected = {"training_config": manifest["training_config"], "data_signature": {"digest": "a"}}
    again, told = training.load_checkpoint(spark, str(tmp_path), "last", expected)
    assert again.collect() == model.collect() and told["epoch"] == 3
    with pytest.raises(ValueError, match="training_config.step, data_signature.digest"):
        training.load_checkpoint(spark, str(tmp_path), "last", {"training_config": {"step": 2, "range": [1, 2]}, "data_signature": {"digest": "b"}})
    with pytest.raises(FileExistsError):
        training.save_checkpoint(model, str(tmp_path), "last", manifest)
    with pytest.raises(FloatingPointError):
        training.save_checkpoint(model.withColumn("slope", F.lit(float("nan"))), str(tmp_path), "bad", manifest)
    with pytest.raises(ValueError, match="missing epoch"):
        training.save_checkpoint(model, str(tmp_path), "bad", {})
    with pytest.raises(FileNotFoundError):
        training.load_checkpoint(spark, str(tmp_path), "none", {})


@pytest.mark.parametrize("bad", [{"start_date": "2021-01-01"}, {"stride_hours": 5}, {"stride_hours": 0}, {"batch_days": 0}, {"batch_days": 1, "stride_hours": 18}, {"resolution": 0.25}])
def test_ingest_config(bad):
    assert contracts.IngestConfig().batch_days == 7
    with pytest.raises(ValueError, match="invalid"):
        contracts.IngestConfig(**bad)


@pytest.mark.parametrize("bad", [{"history": -1}, {"rollout": 0}, {"step": 0}, {"max_samples": 0}, {"selection": "last"}, {"start": "2020", "end": "2019"}, {"noise_std": 0.0}])
def test_window_config(bad):
    assert contracts.WindowConfig(selection="evenly_spaced").step == 1
    with pytest.raises(ValueError, match="invalid"):
        contracts.WindowConfig(**bad)


def test_saved_step_and_splits(spark):
    assert contracts.saved_step(2, None) == contracts.saved_step(2, 2) == 2
    for saved, asked in ((0, None), (None, 1), (2, 3)):
        with pytest.raises(ValueError):
            contracts.saved_step(saved, asked)
    days = spark.sql("SELECT explode(sequence(timestamp_ntz'2018-12-30', timestamp_ntz'2020-01-02 18:00:00', interval 6 hours)) AS ts")
    assert contracts.select_split(days, "valid", True).count() == 1460
    assert contracts.select_split(days, "valid", False).count() == days.count()
    with pytest.raises(ValueError, match="2020-01-01..2020-12-31"):
        contracts.select_split(days, "test", True)


def test_grid_contract_and_differences(spark):
    channels = spark.createDataFrame([(1, "b", "m"), (0, "a", "K")], "channel_idx int, channel string, units string")
    c = contracts.grid_contract(channels, state.dim_lat(spark, 3), state.dim_lon(spark, 4), 6.0, 2)
    assert c["channels"] == ["a", "b"] and c["channel_units"] == ["K", "m"] and c["latitude"] == [90, 0, -90] and c["forecast_step_hours"] == 12
    other = spark.createDataFrame([(1, "b", None), (2, "c", "m")], channels.schema)
    got = sorted(map(tuple, contracts.incompatible(channels, other, ["channel_idx"], ["channel", "units"]).collect()))
    assert got == [(0, "row"), (1, "units"), (2, "row")]
    assert contracts.incompatible(channels, channels, ["channel_idx"], ["channel", "units"]).count() == 0


def test_spherical_harmonics(spark):
    h, w = 9, 16
    theta, phi = np.meshgrid(np.pi * np.arange(h) / (h - 1), 2 * np.pi * np.arange(w) / w, indexing="ij")
    assert harmonics.quadrature(h).sum() == pytest.approx(2) and harmonics.quadrature(8).sum() == pytest.approx(2)
    y21 = -math.sqrt(15 / (8 * math.pi)) * np.sin(theta) * np.cos(theta)
    y32 = math.sqrt(105 / (32 * math.pi)) * np.sin(theta) ** 2 * np.cos(theta)
    rows = [(0, 0, np.full((h, w), 1e6 + 0.1)), (1, 0, y21 * np.cos(phi)), (2, 0, y32 * np.sin(2 * phi) + 5)]
    fields = spark.createDataFrame([(t, c, f.ravel().tolist()) for t, c, f in rows], "t_idx long, channel_idx int, field array<double>")
    out = harmonics.analyse(fields, (h, w)).collect()
    got = {(r.t_idx, r.l, r.m): complex(r.re, r.im) for r in out}
    assert len(out) == 3 * h * (h + 1) // 2
    assert got.pop((0, 0, 0)) == pytest.approx((1e6 + 0.1) * math.sqrt(4 * math.pi)) and all(v == 0 for k, v in got.items() if k[0] == 0)
    assert got.pop((1, 2, 1)) == pytest.approx(0.5) and got.pop((2, 3, 2)) == pytest.approx(-0.5j) and got.pop((2, 0, 0)) == pytest.approx(5 * math.sqrt(4 * math.pi))
    low = {k: v for k, v in got.items() if k[1] < 5}  # degrees that the quadrature holds exactly
    assert max(map(abs, low.values())) < 1e-12
    with pytest.raises(ValueError):
        harmonics.analyse(fields, (h, w), h + 1)


def test_spherical_query_returns_all_degrees(spark):
    from isobar.plans import catalogue

    d = "/root/testdata/sf0.001"
    h, w = state.LATS, state.LONS
    x = np.cos(np.pi * np.arange(h) / (h - 1))
    # weights that integrate every polynomial the nodes hold
    rhs = [0.0 if j % 2 else 2 / (1 - j * j) for j in range(h)]
    weights = np.linalg.solve(np.polynomial.chebyshev.chebvander(x, h - 1).T, rhs)
    basis = {}
    for l in range(h):  # noqa: E741
        for m in range(min(l, w // 2) + 1):
            p = np.polynomial.Legendre.basis(l).deriv(m)(x) * (1 - x * x) ** (m / 2) * (-1) ** m
            norm = math.sqrt((2 * l + 1) / (4 * math.pi) * math.factorial(l - m) / math.factorial(l + m))
            basis[l, m] = np.outer(weights * norm * p, np.exp(-2j * np.pi * m * np.arange(w) / w)) * 2 * np.pi / w
    cells = state.driver_state(spark, d).toPandas()
    fields = {}
    for r in cells.itertuples():
        fields.setdefault((r.t_idx, r.channel_idx), np.zeros((h, w)))[r.lat_idx, r.lon_idx] = r.value
    got = {(r.t_idx, r.channel_idx, r.l, r.m): (r.re, r.im) for r in catalogue.QUERIES["q_spherical_coefficients_all"](spark, d).collect()}
    assert len(basis) == 25 and len(got) == 25 * len(fields)
    for (t, c), f in fields.items():
        for (l, m), b in basis.items():  # noqa: E741
            z = (f * b).sum()
            assert got[t, c, l, m] == pytest.approx((z.real, z.imag), abs=2e-6)
    first = {(r.t_idx, r.channel_idx, r.l, r.m): (r.re, r.im) for r in catalogue.QUERIES["q_spherical_coefficients"](spark, d).collect()}
    assert first == {k: v for k, v in got.items() if k[2] < 2}


def _offset_cells(spark, n_t=6):
    """A state around 1e8 that varies by about 1, with the plain weighted answer."""
    import numpy as np

    r = np.random.default_rng(3)
    x = 1e8 + r.normal(size=(n_t, 2, 5, 8))
    rows = [(t, c, i, j, float(x[t, c, i, j])) for t in range(n_t) for c in range(2) for i in range(5) for j in range(8)]
    cells = spark.createDataFrame(rows, "t_idx long, channel_idx int, lat_idx int, lon_idx int, value double")
    w = np.array([0.1, 0.5, 1.0, 0.5, 0.1])
    lat = spark.createDataFrame([(i, float(v)) for i, v in enumerate(w)], "lat_idx int, area_w double")
    return x, w, cells, lat


def _spread(x, w):
    import numpy as np

    full = np.broadcast_to(w[None, None, :, None], x.shape)
    mean = (x * full).sum(axis=(0, 2, 3)) / full.sum(axis=(0, 2, 3))
    return mean, np.sqrt((full * (x - mean[None, :, None, None]) ** 2).sum(axis=(0, 2, 3)) / full.sum(axis=(0, 2, 3)))


def test_moments_of_large_offsets(spark, tmp_path):
    from isobar.operators import stats
    from isobar.streaming import ingest

    x, w, cells, lat = _offset_cells(spark)
    mean, std = _spread(x, w)
    for t in range(3):
        cells.where(f"t_idx % 3 = {t}").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    arrays = cells.groupBy("t_idx", "channel_idx").agg(F.transform(F.array_sort(F.collect_list(F.struct("lat_idx", "lon_idx", "value"))), lambda c: c["value"]).alias("field"))
    fields = stats.merge_moments(stats.field_moments(arrays, w.tolist(), 8), ["channel_idx"])
    for out in (
        stats.area_moments(cells, lat, ["channel_idx"]),
        stats.two_stage_moments(cells, lat),
        stats.mean_std(fields, ["channel_idx"]),
        ingest.streaming_moments(ingest.stream_table(spark, f"{tmp_path}/in"), lat, f"{tmp_path}/out", f"{tmp_path}/checkpoint"),
    ):
        got = {r.channel_idx: r for r in out.collect()}
        for c in range(2):
            assert abs(got[c]["mean"] - mean[c]) < 1e-6 and abs(got[c]["std"] - std[c]) < 1e-6
    step = {(r.t_idx, r.channel_idx, r.lat_idx, r.lon_idx): r.value for r in stats.time_difference(cells.where("t_idx <> 3"), 2).collect()}
    assert {k[0] for k in step} == {0, 2} and abs(step[2, 1, 4, 7] - (x[4, 1, 4, 7] - x[2, 1, 4, 7])) < 1e-6


def test_journal_survives_a_crash_between_its_renames(spark, tmp_path):
    from isobar.sources import publish

    contract = publish.download_contract("s", ["a"], "2024-01-01", "2024-01-02", 6, 1.0)
    store = lambda: publish.BatchStore(spark, str(tmp_path), "state", contract)
    rows = spark.range(3)
    store().append(0, rows)
    real = publish.Folder.rename

    def dies(self, name, to):
        if to.endswith("progress.json"):
            raise KeyboardInterrupt
        real(self, name, to)

    publish.Folder.rename = dies
    try:
        with pytest.raises(KeyboardInterrupt):
            store().append(1, rows)
    finally:
        publish.Folder.rename = real
    assert store().resume() == 1  # batch 0 is still committed
    store().append(1, rows)
    with pytest.raises(ValueError, match="does not follow"):
        store().append(4, rows)
    assert store().resume() == 2 and store().table().count() == 6


def test_noise_does_not_depend_on_partitions(spark):
    from isobar.operators import normalize

    _, _, cells, _ = _offset_cells(spark)
    a, b = (sorted(normalize.add_noise(cells.repartition(n), 1.0, 5).collect()) for n in (2, 7))
    assert a == b
    noise = [r.value for r in normalize.add_noise(cells.withColumn("value", F.lit(0.0)), 1.0, 5).collect()]
    assert abs(sum(noise) / len(noise)) < 0.2 and 0.85 < (sum(v * v for v in noise) / len(noise)) ** 0.5 < 1.15


def test_versions_stop_at_the_first_word(spark):
    cases = {"2.rc.1": (2,), "2.10.1rc1": (2, 10, 1), "rc.1": (), "3": (3,), "1rc2.4": (1, 4)}
    rows = spark.createDataFrame([(v,) for v in cases], "v string").select("v", scalars.version_numbers(F.col("v")).alias("n")).collect()
    assert {r.v: tuple(r.n) for r in rows} == cases and all(scalars.split_version(v) == n for v, n in cases.items())


def test_guarded_division_of_nan(spark):
    rows = spark.createDataFrame([(1.0, 2.0), (1.0, float("nan")), (1.0, 0.0), (1.0, None)], "a double, b double")
    assert [r.x for r in rows.select(scalars.guarded_divide(F.col("a"), F.col("b")).alias("x")).collect()] == [0.5, None, None, None]


def test_payload_digest_tells_small_edits(spark):
    from isobar.operators import validate

    _, _, cells, _ = _offset_cells(spark)
    edited = cells.withColumn("value", F.when((F.col("t_idx") == 2) & (F.col("lat_idx") == 1) & (F.col("lon_idx") == 1), F.col("value") + 16).otherwise(F.col("value")))
    a, b = ({r.t_idx: r.digest for r in validate.slice_digests(x).collect()} for x in (cells, edited))
    assert [t for t in a if a[t] != b[t]] == [2]
    assert validate.merkle_digest(cells).first() == validate.merkle_digest(cells.repartition(5)).first() != validate.merkle_digest(edited).first()
