"""Field-layout operators against plain numpy."""

import hashlib
import random

import numpy as np
import pytest

from isobar.functions import grid, harmonics
from isobar.operators import fields as fl
from isobar.operators import metrics
from isobar.sources import state

H, W = 5, 8
AREA = [0.1, 0.5, 1.0, 0.5, 0.1]
WEIGHTS = fl.cell_weights(AREA, W)


def table(spark, data, times, parts=7, shuffled=True):
    """data[channel][k] at time times[k]; rows dealt over partitions at random or in the order of time."""
    rows = [(int(t), c, [float(x) for x in data[c][k]]) for c in range(len(data)) for k, t in enumerate(times)]
    if shuffled:
        random.Random(1).shuffle(rows)
    return spark.createDataFrame(rows, "t_idx long, channel_idx int, field array<double>").repartition(parts) if shuffled else spark.createDataFrame(spark.sparkContext.parallelize(rows, parts), "t_idx long, channel_idx int, field array<double>")


def weighted(x):
    w = np.broadcast_to(WEIGHTS, x.shape)
    mean = (x * w).sum() / w.sum()
    return mean, np.sqrt((w * (x - mean) ** 2).sum() / w.sum())


@pytest.mark.parametrize("stride", [1, 3, 40])
@pytest.mark.parametrize("shuffled", [True, False])
def test_pass_over_borders_with_large_offsets(spark, tmp_path, stride, shuffled):
    data = 1e5 + np.random.default_rng(4).normal(size=(2, 64, H * W))
    times = np.arange(100, 164)
    parts = fl.write_pass(fl.ordered_pass(table(spark, data, times, shuffled=shuffled), WEIGHTS, stride, differences=True), str(tmp_path / "pass"))
    state_m, diff_m = fl.pass_moments(parts, WEIGHTS, stride)
    for r in state_m.collect():
        assert (r["mean"], np.sqrt(r["m2"] / r["w"])) == pytest.approx(weighted(data[r["channel_idx"]]), rel=1e-12) and r["n"] == 64
    for r in diff_m.collect():
        x = data[r["channel_idx"]]
        want = weighted(x[stride:] - x[:-stride])
        assert r["mean"] == pytest.approx(want[0], abs=1e-9) and np.sqrt(r["m2"] / r["w"]) == pytest.approx(want[1], rel=1e-9) and r["n"] == 64 - stride
    for r in fl.pass_climatology(parts).collect():
        assert np.allclose(r["field"], data[r["channel_idx"]].mean(axis=0), rtol=1e-13)
    got = {(r["channel_idx"], r["t_idx"]): r["field"] for r in fl.pass_changes(parts, stride).collect()}
    assert len(got) == 2 * (64 - stride)
    assert all(np.allclose(x, data[c][t - 100 + stride] - data[c][t - 100]) for (c, t), x in got.items())
    for r in fl.pass_digest(parts).collect():
        own = [hashlib.sha256(x.astype("<f4").tobytes()).hexdigest() for x in data[r["channel_idx"]]]
        assert r["digest"] == hashlib.sha256("".join(own).encode()).hexdigest() and r["n_times"] == 64


def test_pass_in_order_of_time_sends_only_the_ends(spark, tmp_path):
    data = np.random.default_rng(5).normal(size=(1, 60, H * W))
    parts = fl.write_pass(fl.ordered_pass(table(spark, data, range(60), 3, False), WEIGHTS, 2), str(tmp_path / "pass"))
    n = {r["kind"]: r["count"] for r in parts.groupBy("kind").count().collect()}
    assert n == {"head": 6, "tail": 6, "state": 3, "difference": 3, "climatology": 3, "digest": 60}


def test_pass_gaps_repeats_nans_and_nothing(spark, tmp_path):
    data = np.random.default_rng(6).normal(size=(1, 9, H * W))
    times = [0, 1, 2, 4, 5, 9, 10, 11, 12]
    parts = fl.write_pass(fl.ordered_pass(table(spark, data, times), WEIGHTS, 2, differences=True), str(tmp_path / "a"))
    got = {r["t_idx"]: r["field"] for r in fl.pass_changes(parts, 2).collect()}
    want = {t: data[0][times.index(t + 2)] - data[0][k] for k, t in enumerate(times) if t + 2 in times}
    assert set(got) == set(want) and all(np.allclose(got[t], want[t]) for t in want)
    assert fl.pass_moments(parts, WEIGHTS, 2)[1].first()["n"] == len(want)
    hole = data.copy()
    hole[0, 4, 3] = np.nan
    parts = fl.write_pass(fl.ordered_pass(table(spark, hole, times), WEIGHTS, 1), str(tmp_path / "b"))
    assert np.isnan(fl.pass_moments(parts, WEIGHTS, 1)[0].first()["mean"])
    empty = table(spark, data, times).where("t_idx < 0")
    parts = fl.write_pass(fl.ordered_pass(empty, WEIGHTS, 1), str(tmp_path / "c"))
    assert parts.count() == 0 and fl.pass_moments(parts, WEIGHTS, 1)[1].count() == 0 and fl.pass_climatology(parts).count() == 0
    twice = table(spark, data, times, 1).unionByName(table(spark, data, times, 1)).coalesce(1)
    with pytest.raises(Exception, match="repeated"):
        fl.ordered_pass(twice, WEIGHTS, 1).count()
    with pytest.raises(ValueError):
        fl.ordered_pass(empty, WEIGHTS, 0)


def test_regrid_seam_constant_and_no_exchange(spark):
    h, w = 7, 8
    lat = grid.overlap_weights(state.dim_lat(spark, h), state.dim_lat(spark, 4))
    lon = grid.periodic_stencil(state.dim_lon(spark, w), w)
    impulse = np.zeros((h, w))
    impulse[:, -1] = 1
    noise = np.random.default_rng(4).normal(size=(h, w))
    rows = [(k, "x", x.ravel().tolist()) for k, x in enumerate((np.full((h, w), 7.0), impulse, noise))]
    out = fl.regrid_fields(spark.createDataFrame(rows, "t_idx int, note string, field array<float>"), lat, lon, (h, w))
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
    got = {r["t_idx"]: np.array(r["field"]).reshape(4, 4) for r in out.collect()}
    assert np.allclose(got[0], 7.0, rtol=1e-15) and np.allclose(got[1], [[0.25, 0, 0, 0.25]] * 4)  # both neighbours of the seam
    cells = spark.createDataFrame([(2, 0, i, j, float(np.float32(noise[i, j]))) for i in range(h) for j in range(w)], "t_idx int, channel_idx int, lat_idx int, lon_idx int, value double")
    assert all(got[2][r["lat_idx"], r["lon_idx"]] == pytest.approx(r["value"], abs=1e-12) for r in grid.regrid(cells, lat, lon).collect())


@pytest.mark.parametrize("joint", [False, True])
@pytest.mark.parametrize("leads", [1, 3, 120])
def test_rollout_is_the_closed_form_with_constant_scans(spark, tmp_path, joint, leads):
    data = np.random.default_rng(7).normal(size=(3, 6, H * W))
    table(spark, data, range(6)).write.parquet(str(tmp_path / "fields"))
    initial = fl.initial_fields(spark.read.parquet(str(tmp_path / "fields")), 0, 4)
    out = fl.rollout_fields(initial, fl.linear_tendency, leads, joint=joint)
    assert out._jdf.queryExecution().optimizedPlan().toString().count("parquet") == 2
    rows = out.collect()
    assert len(rows) == 4 * 3 * leads
    for r in rows:
        now = data[r["channel_idx"]][r["base_t"]]
        before = data[r["channel_idx"]][r["base_t"] - 1] if r["base_t"] else np.full(H * W, np.nan)
        assert np.allclose(r["field"], now + r["lead"] * (now - before), equal_nan=True)


def test_joint_step_sees_all_channels_and_what_stands_aside(spark):
    data = np.random.default_rng(8).normal(size=(3, 4, H * W))
    aside = spark.createDataFrame([(c, 10.0 * c) for c in range(3)], "channel_idx int, bias double")
    initial = fl.initial_fields(table(spark, data, range(4)), 1, 4, aside=aside)
    step = lambda now, before, beside: now.mean(axis=0) + beside["bias"][:, None]
    got = {(r["base_t"], r["lead"], r["channel_idx"]): r["field"] for r in fl.rollout_fields(initial, step, 2, ["bias"], joint=True).collect()}
    for t in (1, 2, 3):
        first = [data[:, t].mean(axis=0) + 10.0 * c for c in range(3)]
        assert all(np.allclose(got[t, 1, c], first[c]) for c in range(3))
        assert all(np.allclose(got[t, 2, c], np.mean(first, axis=0) + 10.0 * c) for c in range(3))


def test_field_sums_equal_the_cell_form(spark):
    r = np.random.default_rng(9)
    p, y, c = (r.normal(size=(4, H * W)) for _ in range(3))
    keys = ["m", 0, 1]
    rows = [(keys[0], k, 1, 0, p[k].tolist(), y[k].tolist(), c[0].tolist()) for k in range(4)]
    wide = spark.createDataFrame(rows, "model string, sample_idx int, lead int, channel_idx int, prediction array<double>, target array<double>, clim array<double>")
    lat = spark.createDataFrame(list(enumerate(AREA)), "lat_idx int, area_w double")
    at = [(k, i, j) for k in range(4) for i in range(H) for j in range(W)]
    cells = spark.createDataFrame([("m", k, 1, 0, i, j, float(p[k][i * W + j]), float(y[k][i * W + j])) for k, i, j in at], "model string, sample_idx int, lead int, channel_idx int, lat_idx int, lon_idx int, prediction double, target double")
    clim = spark.createDataFrame([(0, i, j, float(c[0][i * W + j])) for i in range(H) for j in range(W)], "channel_idx int, lat_idx int, lon_idx int, clim double")
    want = {x["sample_idx"]: x.asDict() for x in metrics.sample_sums(cells, lat, clim).collect()}
    for x in fl.field_sums(wide, WEIGHTS).collect():
        assert all(v == pytest.approx(want[x["sample_idx"]][k], rel=1e-9) for k, v in x.asDict().items() if k != "model")


def test_whole_fields_number_times_over_stretches(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(state, "_NUMBERED", 7)
    r = random.Random(2)
    ids = r.sample(range(200), 90)
    rows = [(i, [float(i)] * 64, r.choice([0, 1, 1, 1])) for i in ids]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    got = {(x["channel_idx"], x["t_idx"]): x["field"][0] for x in state.whole_fields(spark, str(tmp_path)).collect()}
    want = {(c, k): float(i) for c in (0, 1) for k, i in enumerate(sorted(i for i, _, label in rows if label == c))}
    assert got == want


def test_synthesis_inverts_analysis_and_filters_act_by_degree(spark):
    h, w = 9, 16
    r = np.random.default_rng(3)
    c = {(k, l, m): complex(r.normal(), r.normal() if m else 0.0) for k in range(3) for l in range(5) for m in range(l + 1)}
    rows = [(k, 0, l, m, z.real, z.imag) for (k, l, m), z in c.items()]
    table = spark.createDataFrame(rows, "t_idx long, channel_idx int, l int, m int, re double, im double")
    fields = harmonics.synthesise(table, (h, w))
    back = {(x.t_idx, x.l, x.m): complex(x.re, x.im) for x in harmonics.analyse(fields, (h, w), 5).collect()}
    assert max(abs(back[k] - c[k]) for k in c) < 1e-12 and len(back) == len(c)
    x = {q.t_idx: np.array(q.field).reshape(h, w) for q in fields.collect()}
    area = 2 * np.pi / w * harmonics.quadrature(h)[:, None]
    for k in range(3):  # Parseval
        assert (area * x[k] ** 2).sum() == pytest.approx(sum(abs(z) ** 2 * (2 if m else 1) for (t, _, m), z in c.items() if t == k), rel=1e-10)
    again = {q.t_idx: np.array(q.field).reshape(h, w) for q in harmonics.filtered(fields, (h, w), [1.0] * 5).collect()}
    assert max(abs(again[k] - x[k]).max() for k in x) < 1e-10
    laplace = harmonics.filtered(fields, (h, w), [-l * (l + 1.0) for l in range(5)])
    assert "Exchange" not in harmonics.filtered(fields.select("*"), (h, w), [1.0])._jdf.queryExecution().optimizedPlan().toString()
    for q in harmonics.analyse(laplace, (h, w), 5).collect():
        assert complex(q.re, q.im) == pytest.approx(-q.l * (q.l + 1) * c[q.t_idx, q.l, q.m], abs=1e-10)
    flat = spark.createDataFrame([(0, 0, [1e6 + 0.1] * (h * w))], "t_idx long, channel_idx int, field array<double>")
    assert np.allclose(harmonics.filtered(flat, (h, w), [1.0] * h).first().field, 1e6 + 0.1, rtol=1e-15)
    assert harmonics.filtered(flat.where("t_idx > 0"), (h, w), [1.0]).count() == 0
