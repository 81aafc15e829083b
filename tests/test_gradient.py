"""The training loop against plain numpy, its resumption, and what it is better than."""

from dataclasses import replace
from itertools import islice

import numpy as np
import pytest

from isobar.functions import harmonics
from isobar.operators import fields as fl
from isobar.operators import gradient as gr
from isobar.operators.epochs import permuted, position_of

H, W, DEGREES = 9, 16, 4
WEIGHTS = fl.cell_weights(harmonics.quadrature(H), W)
SETTINGS = gr.Training(epochs=5, batch=24, rate=0.4, patience=9)
TRUE = np.array([[0.9, 0.5, -0.3, 0.0], [0.1, 0.8, 0.4, -0.6]])


@pytest.fixture(scope="module")
def world(spark, tmp_path_factory):
    """States whose tendencies of each degree are passed on by a factor, with noise."""
    r = np.random.default_rng(12)
    table = list(islice(harmonics.legendre(H, DEGREES), W // 2 + 1))
    smooth = lambda x: gr.degree_parts(x.reshape(1, H, W), table, DEGREES)[0].sum(axis=0)
    rows, z = [], np.zeros((2, 70, H * W))
    for c in range(2):
        d = smooth(r.normal(size=H * W))
        for t in range(1, 70):
            parts = gr.degree_parts(d.reshape(1, H, W), table, DEGREES)[0]
            d = TRUE[c] @ parts + smooth(r.normal(size=H * W))
            z[c, t] = z[c, t - 1] + d
        rows += [(t, c, z[c, t].tolist()) for t in range(70)]
    path = str(tmp_path_factory.mktemp("gradient"))
    fields = spark.createDataFrame(rows, "t_idx long, channel_idx int, field array<double>").repartition(5)
    parts = fl.write_pass(fl.ordered_pass(fields, WEIGHTS, 1, differences=True), f"{path}/pass")
    gr.spectral_samples(gr.tendency_pairs(fl.pass_changes(parts, 1)), (H, W), WEIGHTS, DEGREES).write.parquet(f"{path}/samples")
    return z, spark.read.parquet(f"{path}/samples")


def plain(z, settings, first=1, end=49, held=(49, 69), shape=(H, W), weights=WEIGHTS, degrees=DEGREES):
    """(factors by epoch, losses by epoch) of the same loop, on whole fields z[channel][time]."""
    table = list(islice(harmonics.legendre(shape[0], degrees), shape[1] // 2 + 1))
    w = weights / weights.sum()
    at = [(c, t) for c in range(len(z)) for t in range(1, len(z[c]) - 1)]
    x = {(c, t): gr.degree_parts((z[c][t] - z[c][t - 1]).reshape(1, *shape), table, degrees)[0] for c, t in at}
    y = {(c, t): z[c][t + 1] - z[c][t] for c, t in at}
    f, told, losses, n = np.zeros((len(z), degrees)), [], [], end - first
    updates = -(-n // settings.batch)
    for epoch in range(settings.epochs):
        order = permuted(np.arange(n), n, settings.seed, epoch) + first
        for k in range(updates):
            g, m = np.zeros_like(f), 0
            for t in order[k * settings.batch : (k + 1) * settings.batch].tolist():
                for c in range(len(z)):
                    if (c, t) in x:
                        g[c] += -2 * (x[c, t] * w) @ (y[c, t] - f[c] @ x[c, t])
                        m += 1
            g /= max(1, m)
            norm = np.sqrt((g * g).sum())
            f = f - gr._rate(settings, epoch * updates + k, settings.epochs * updates) * min(1, settings.clip / norm) * g
        told.append(f)
        losses.append(np.mean([w @ (y[c, t] - f[c] @ x[c, t]) ** 2 for c, t in at if held[0] <= t < held[1]]))
    return told, losses


def rows_of(run):
    return sorted((r.epoch, r.channel_idx, r.degree, r.factor, r.loss, r.best, r.stale, r.norm) for r in run.collect())


def go(samples, path, settings=SETTINGS):
    return gr.train(samples, (1, 49), (49, 69), [0, 1], DEGREES, path, settings)


def test_loop_resume_and_gain(spark, world, tmp_path, monkeypatch):
    z, samples = world
    run = rows_of(go(samples, str(tmp_path / "a")))
    told, losses = plain(z, SETTINGS)
    f = told[-1]
    assert [r[3] for r in run if r[0] == 4] == pytest.approx(f.ravel().tolist(), rel=1e-9, abs=1e-12)
    assert sorted({(r[0], r[4]) for r in run}) == [(k, pytest.approx(x, rel=1e-9)) for k, x in enumerate(losses)]
    # broken off in the third epoch and resumed, over other partitions: the same bits
    own, calls = gr._sums, []

    def breaks(*args):
        calls.append(1)
        if len(calls) == 8:
            raise RuntimeError("lost")
        return own(*args)

    monkeypatch.setattr(gr, "_sums", breaks)
    with pytest.raises(RuntimeError):
        go(samples.repartition(7), str(tmp_path / "b"))
    assert max(r[0] for r in rows_of(spark.read.parquet(str(tmp_path / "b")))) == 1
    assert rows_of(go(samples.repartition(3), str(tmp_path / "b"))) == run
    with pytest.raises(ValueError, match="other settings"):
        go(samples, str(tmp_path / "b"), replace(SETTINGS, rate=0.1))
    # better on held-out times than one slope a channel, fitted exactly
    one = []
    w = WEIGHTS / WEIGHTS.sum()
    for c in range(2):
        d = np.diff(z[c], axis=0)
        slope = sum(w @ (d[t] * d[t - 1]) for t in range(1, 49)) / sum(w @ d[t - 1] ** 2 for t in range(1, 49))
        one += [w @ (d[t] - slope * d[t - 1]) ** 2 for t in range(49, 69)]
    assert losses[-1] < np.mean(one)
    # the model as a forecast step
    step, aside = gr.spectral_tendency(gr.best_factors(spark.read.parquet(str(tmp_path / "a"))), (H, W), DEGREES)
    fields = spark.createDataFrame([(t, c, z[c, t].tolist()) for c in range(2) for t in (48, 49)], "t_idx long, channel_idx int, field array<double>")
    out = {r.channel_idx: np.array(r.field) for r in fl.rollout_fields(fl.initial_fields(fields, 49, 50, aside=aside), step, 1, ["factors"], joint=True).collect()}
    table = list(islice(harmonics.legendre(H, DEGREES), W // 2 + 1))
    for c in range(2):
        assert np.allclose(out[c], z[c, 49] + f[c] @ gr.degree_parts((z[c, 49] - z[c, 48]).reshape(1, H, W), table, DEGREES)[0])


def test_registered_run_by_brute_force(spark):
    from isobar.functions import grid
    from isobar.plans import whole
    from isobar.sources import state

    where = "/root/testdata/sf0.001"
    weights = fl.cell_weights([r.area_w for r in grid.area_weights(state.dim_lat(spark, 8)).orderBy("lat_idx").collect()], 8)
    series = {}
    for r in state.whole_fields(spark, where).orderBy("channel_idx", "t_idx").collect():
        series.setdefault(r.channel_idx, []).append(np.array(r.field, float))
    n = max(map(len, series.values()))
    z = [np.array(series[c][: n * 8 // 10]) for c in sorted(series)]
    told, losses = plain(z, whole.TRAINING, 1, n * 6 // 10, (n * 6 // 10, n * 8 // 10), state.WHOLE, weights, whole.TRAINED_DEGREES)
    got = {(r.channel_idx, r.degree): r.factor for r in whole.q_whole_trained_tendency(spark, where).collect()}
    best = told[int(np.argmin(losses))]
    assert got == {(c, d): pytest.approx(best[k, d], abs=2e-6) for k, c in enumerate(sorted(series)) for d in range(whole.TRAINED_DEGREES)}


def test_early_stop_and_bad_gradients(spark, world, tmp_path):
    _, samples = world
    run = rows_of(go(samples, str(tmp_path / "a"), replace(SETTINGS, patience=1, least=10.0)))
    assert max(r[0] for r in run) == 1  # the second epoch did not gain enough
    assert rows_of(go(samples, str(tmp_path / "a"), replace(SETTINGS, patience=1, least=10.0))) == run
    bad = samples.selectExpr("sample_idx", "channel_idx", "gram", "transform(cross, x -> x * 1e300 * 1e300) AS cross", "power")
    with pytest.raises(Exception):
        go(bad, str(tmp_path / "b"))


def test_an_epoch_is_one_pass_whatever_its_updates(spark, world, tmp_path):
    z, samples = world
    jobs = []
    for batch in (48, 2):  # one update, 24 updates
        spark.sparkContext.setJobGroup(f"epoch-{batch}", "training")
        run = rows_of(go(samples, str(tmp_path / str(batch)), replace(SETTINGS, epochs=1, batch=batch)))
        jobs.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"epoch-{batch}")))
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        told, losses = plain(z, replace(SETTINGS, epochs=1, batch=batch))
        assert [r[3] for r in run] == pytest.approx(told[0].ravel().tolist(), rel=1e-9, abs=1e-12)
        assert run[0][4] == pytest.approx(losses[0], rel=1e-9)
    assert jobs[1] <= jobs[0] + 4


def test_numbers_that_are_not_finite_end_a_run(spark, world, tmp_path):
    _, samples = world
    bad = samples.selectExpr("sample_idx", "channel_idx", "gram", "transform(cross, x -> IF(sample_idx = 7, CAST('NaN' AS DOUBLE), x)) AS cross", "power")
    with pytest.raises(FloatingPointError, match="epoch 0"):
        go(bad, str(tmp_path / "a"))


def test_position_of_inverts_the_order():
    for n in (1, 2, 5, 64, 1000):
        assert (position_of(permuted(np.arange(n), n, 17, 3), n, 17, 3) == np.arange(n)).all()
