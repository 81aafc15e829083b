"""Epoch order, mergeable sums and streamed differences."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from isobar.operators import epochs, metrics
from isobar.streaming import changes


def test_order_is_a_permutation_for_every_size():
    for n in range(1, 1001):
        assert sorted(epochs.permuted(np.arange(n), n, 7, n % 5).tolist()) == list(range(n))
    a, b, c = (epochs.permuted(np.arange(1000), 1000, s, e) for s, e in ((1, 0), (1, 1), (2, 0)))
    assert sum(a == b) < 20 and sum(a == c) < 20 and np.corrcoef(a, np.arange(1000))[0, 1] < 0.15
    big = epochs.permuted(np.arange(10**12, 10**12 + 1000), 3 * 10**12, 1, 2)
    assert len(set(big.tolist())) == 1000 and big.min() >= 0 and big.max() < 3 * 10**12
    with pytest.raises(ValueError):
        epochs.permuted(np.arange(1), 0, 1, 1)


def test_ranks_share_an_epoch_and_resume_inside_it(spark):
    whole = {r.position: r.sample_idx for r in epochs.epoch_order(spark, 103, 5, 2).collect()}
    assert sorted(whole.values()) == list(range(103))
    shares = [epochs.epoch_order(spark, 103, 5, 2, rank, 4) for rank in range(4)]
    assert "Exchange" not in shares[0]._jdf.queryExecution().executedPlan().toString()
    rows = [[(r.position, r.sample_idx) for r in s.collect()] for s in shares]
    assert sorted(x for s in rows for x in s) == sorted(whole.items())
    assert [(r.position, r.sample_idx) for r in epochs.epoch_order(spark, 103, 5, 2, 1, 4, done=10).collect()] == rows[1][10:]
    assert epochs.epoch_order(spark, 103, 5, 2, 1, 4, done=99).count() == 0
    with pytest.raises(ValueError):
        epochs.epoch_order(spark, 103, 5, 2, 4, 4)


def sample_rows(n):
    r = np.random.default_rng(11)
    return [("m", k, lead, c, *map(float, 10 ** r.uniform(-6, 3, 6)), float(r.uniform(-1, 1)) if k % 7 else None) for k in range(n) for lead in (1, 2) for c in (0, 1)]


SCHEMA = "model string, sample_idx long, lead int, channel_idx int, sw double, se2 double, sae double, se double, svp double, svy double, acc double"


def test_sums_are_the_same_bits_however_they_are_dealt(spark):
    rows = sample_rows(300)
    table = spark.createDataFrame(rows, SCHEMA)
    told = lambda parts: sorted(map(tuple, metrics.merged_sums(parts).collect()))
    want = told(metrics.sum_parts(table, 1000))
    for n in (1, 4, 200):
        assert told(metrics.sum_parts(spark.createDataFrame(random.Random(n).sample(rows, len(rows)), SCHEMA).repartition(n), 1000)) == want
    assert told(metrics.sum_parts(table, 7)) == want
    two, three = (metrics.sum_parts(table.where(c), 1000) for c in ("sample_idx < 120", "sample_idx >= 120"))
    assert told(two.unionByName(three)) == want
    plain = {(r.model, r.lead, r.channel_idx): r for r in metrics.channel_sums(table).collect()}
    for r in metrics.merged_sums(metrics.sum_parts(table, 7)).collect():
        p = plain[r.model, r.lead, r.channel_idx]
        assert (r.n_acc, r.n_samples) == (p.n_acc, p.n_samples)
        assert all(r[c] == pytest.approx(p[c], rel=1e-12) for c in ("sw", "se2", "sae", "se", "svp", "svy", "sacc"))
    broken = [(*rows[0][:4], float("nan"), *rows[0][5:]), *rows[1:]]
    bad = {(r.lead, r.channel_idx): r for r in metrics.merged_sums(metrics.sum_parts(spark.createDataFrame(broken, SCHEMA), 7)).collect()}
    assert np.isnan(bad[1, 0]["sw"]) and not np.isnan(bad[1, 0]["se2"]) and not np.isnan(bad[1, 1]["sw"])


def test_an_evaluation_goes_on_from_what_is_written(spark, tmp_path):
    table = spark.createDataFrame(sample_rows(50), SCHEMA)
    made, path = [], str(tmp_path / "sums")

    def samples(first, end):
        if len(made) == 3 and not made.count("again"):
            made.append("again")
            raise RuntimeError("broken off")
        made.append(first)
        return table.where((F.col("sample_idx") >= first) & (F.col("sample_idx") < end))

    with pytest.raises(RuntimeError):
        metrics.evaluate_stretches(spark, samples, 50, 12, path)
    out = metrics.evaluate_stretches(spark, samples, 50, 12, path)
    assert made == [0, 12, 24, "again", 36, 48]
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, metrics.merged_sums(metrics.sum_parts(table, 12)).collect()))


def feed(spark, where, batches):
    """One file per batch, streamed one by one."""
    for rows in batches:
        spark.createDataFrame([(t, 0, [float(t * t), 1.0]) for t in rows], "t_idx long, channel_idx int, field array<double>").coalesce(1).write.mode("append").parquet(f"{where}/in")
        schema = spark.read.parquet(f"{where}/in").schema
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{where}/in")
        changes.write_changes(stream, 2, f"{where}/out", f"{where}/checkpoint")
    rows = [(r.kind, r.t_idx, r.upto, None if r.field is None else r.field[0]) for r in spark.read.parquet(f"{where}/out").collect()]
    return sorted(rows, key=str)


def change(t):
    return ("change", t, t + 2, float((t + 2) ** 2 - t * t))


@pytest.mark.parametrize(
    ("batches", "others"),
    [
        ([[0, 1, 2], [3], [5, 4, 6]], []),
        ([[0, 1, 2], [2, 3], [3, 4]], [("repeated", 2, 2, None), ("repeated", 3, 3, None)]),
        ([[0, 1, 2, 3, 4], [1, 5]], [("late", 1, 1, None)]),
        ([[0, 1], [4, 5], [6, 7]], [("missing", 2, 3, None)]),
    ],
)
def test_streamed_differences(spark, tmp_path, batches, others):
    seen = {t for b in batches for t in b}
    assert feed(spark, str(tmp_path), batches) == sorted([change(t) for t in seen if t + 2 in seen] + others, key=str)
