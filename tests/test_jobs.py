"""The jobs: what they write, on growing input, run again, and from the command line."""

import json
import math
import subprocess
import sys

import numpy as np
import pytest

from conftest import ROOT
from isobar.operators import fields as fl
from jobs import common, queries, text_statistics, verify_baselines

DATA = "/root/testdata/sf0.001"


def plain_statistics(rows):
    """{(lang, source, measure): values} of (doc_id, text, lang, source)."""
    out = {}
    for _, text, lang, source in rows:
        if not text:
            continue
        lines = text.split("\n")
        words = [w for w in "".join(" " if c in " \t\n\x0b\x0c\r" else c for c in text).split(" ") if w]
        told = {"characters": len(text), "bytes": len(text.encode()), "words": len(words), "lines": len(lines), "upper_case": sum("A" <= c <= "Z" for c in text), "digits": sum("0" <= c <= "9" for c in text), "line_repeats": len(lines) - len(set(lines))}
        for m, v in told.items():
            out.setdefault((lang, source, m), []).append(v)
    return out


def holds(out, rows):
    want = plain_statistics(rows)
    got = {(r.lang, r.source, r.measure): r for r in out.collect()}
    assert set(got) == set(want) and out.count() == len(want)
    for k, v in want.items():
        r = got[k]
        assert (r.n, r.least, r.most) == (len(v), min(v), max(v))
        assert r["mean"] == pytest.approx(np.mean(v), rel=1e-12) and r["std"] == pytest.approx(np.std(v), rel=1e-9, abs=1e-9)


def test_text_statistics_on_growing_input(spark, tmp_path):
    source, output = str(tmp_path / "in"), str(tmp_path / "out")
    table = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text", "lang", "source")
    rows = [tuple(r) for r in table.collect()]
    odd = [(-1, None, "en", "a"), (-2, "", "en", None), (-3, "one two\n\none two\n", None, None), (-4, "é 漢字 🎈 ABC 12\x0b3", "", "a"), (-5, "x" * 2_000_000, "en", "a"), (-5, "x", "en", "a")]
    put = lambda some: spark.createDataFrame(some, "doc_id long, text string, lang string, source string").coalesce(1).write.mode("append").parquet(source)
    config = common.settings("text_statistics")
    put(rows[:80])
    holds(text_statistics.run(spark, source, output, config), rows[:80])
    batches = lambda: sorted(r[0] for r in spark.read.parquet(f"{output}/parts").select("batch").distinct().collect())
    assert batches() == [0]
    first = sorted(map(str, text_statistics.run(spark, source, output, config).collect()))
    assert batches() == [0]  # nothing was new
    assert first == sorted(map(str, spark.read.parquet(f"{output}/statistics").select("lang", "source", "measure", "n", "mean", "std", "least", "most").collect()))
    put(rows[80:])
    put(odd)
    holds(text_statistics.run(spark, source, output, config | {"files_per_batch": 1}), rows + odd)
    assert batches() == [0, 1, 2]
    assert {(r.doc_id, r.reason) for r in spark.read.parquet(f"{output}/rejected").where("doc_id < 0").collect()} == {(-1, "null text"), (-2, "empty text")}
    with pytest.raises(ValueError, match="begun with other columns"):
        text_statistics.run(spark, source, output, config | {"by": ["lang"]})


def test_text_statistics_of_an_empty_table_and_odd_settings(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string").coalesce(1).write.parquet(str(tmp_path / "in"))
    config = common.settings("text_statistics")
    assert text_statistics.run(spark, str(tmp_path / "in"), str(tmp_path / "out"), config).count() == 0
    with pytest.raises(ValueError, match="unknown measures"):
        text_statistics.run(spark, str(tmp_path / "in"), str(tmp_path / "x"), config | {"measures": ["beauty"]})
    (tmp_path / "c.json").write_text(json.dumps({"by": ["lang"]}))
    assert common.settings("text_statistics", spark, str(tmp_path / "c.json"))["by"] == ["lang"]
    (tmp_path / "d.json").write_text(json.dumps({"buy": ["lang"]}))
    with pytest.raises(ValueError, match="unknown settings: buy"):
        common.settings("text_statistics", spark, str(tmp_path / "d.json"))


def plain_scores(x, w, leads, first, end, train_end):
    """Per model, lead and channel (rmse, bias, acc) of fields x[channel][time][cell]."""
    out = {}
    for c, series in enumerate(x):
        ww = np.broadcast_to(w, series[:train_end].shape)
        mean = (series[:train_end] * ww).sum() / ww.sum()
        std = math.sqrt((ww * (series[:train_end] - mean) ** 2).sum() / ww.sum())
        z, clim = (series - mean) / std, (series[:train_end].mean(axis=0) - mean) / std
        for lead in range(1, leads + 1):
            for model, make in (("persistence", lambda t: z[t]), ("linear_tendency", lambda t: z[t] + lead * (z[t] - z[t - 1])), ("climatology", lambda t: clim)):
                se2, se, acc, n = 0.0, 0.0, [], 0
                for t in range(first, min(end, len(z) - lead)):
                    p, y = make(t), z[t + lead]
                    se2 += w @ (p - y) ** 2
                    se += w @ (p - y)
                    n += 1
                    a, b = p - clim, y - clim
                    d = math.sqrt((w @ a**2) * (w @ b**2))
                    if d > 1e-12:
                        acc.append((w @ (a * b)) / d)
                if n:
                    out[model, lead, c] = (math.sqrt(se2 / (n * w.sum())) * std, se / (n * w.sum()) * std, np.mean(acc) if acc else None)
    return out


@pytest.mark.parametrize(("leads", "per_part"), [(3, 64), (5, 4), (9, 2)])
def test_verify_baselines_by_brute_force(spark, tmp_path, leads, per_part):
    r = np.random.default_rng(5)
    lengths = [60, 60, 51]
    x = [np.float32(r.normal(size=(n, 64)).cumsum(axis=0)).astype(float) for n in lengths]
    rows = [(int(3 * k + c), v.tolist(), c) for c in range(3) for k, v in enumerate(x[c])]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(3).write.parquet(str(tmp_path / "in"))
    config = common.settings("verify_baselines") | {"leads": leads, "times_per_part": per_part}
    out = [sorted(map(str, verify_baselines.run(spark, str(tmp_path / "in"), str(tmp_path / "out"), config).collect())) for _ in range(2)]
    assert out[0] == out[1]  # a rerun replaces the tables with the same rows
    scores = spark.read.parquet(str(tmp_path / "out/scores")).collect()
    from isobar.functions import grid
    from isobar.sources import state

    w = fl.cell_weights([q.area_w for q in grid.area_weights(state.dim_lat(spark, 8)).orderBy("lat_idx").collect()], 8)
    want = plain_scores(x, w, leads, 48, 60 - leads, 36)
    assert {(q.model, q.lead, q.channel_idx) for q in scores} == set(want)
    for q in scores:
        rmse, bias, acc = want[q.model, q.lead, q.channel_idx]
        assert q.physical_rmse == pytest.approx(rmse, rel=1e-9) and q.physical_bias == pytest.approx(bias, rel=1e-7, abs=1e-9)
        assert (q.normalized_acc is None) == (acc is None) and (acc is None or q.normalized_acc == pytest.approx(acc, rel=1e-8))
    assert spark.read.parquet(str(tmp_path / "out/state")).where("part = 1 AND channel_idx = 0").count() == min(per_part, 60 - per_part if per_part < 60 else 0)


def test_verify_baselines_of_nothing_and_unknown_models(spark, tmp_path):
    spark.createDataFrame([], "vec_id long, embedding array<float>, label int").coalesce(1).write.parquet(str(tmp_path / "in"))
    config = common.settings("verify_baselines")
    assert verify_baselines.run(spark, str(tmp_path / "in"), str(tmp_path / "out"), config).count() == 0
    with pytest.raises(ValueError, match="unknown models"):
        verify_baselines.run(spark, str(tmp_path / "in"), str(tmp_path / "x"), config | {"models": ["oracle"]})


def test_registered_jobs_leave_a_new_folder_each(spark):
    before = dict(spark.conf.getAll)
    a, b = (queries.QUERIES["job2_text_statistics"](spark, DATA) for _ in range(2))
    assert a.inputFiles() and not set(a.inputFiles()) & set(b.inputFiles())
    assert sorted(map(str, a.collect())) == sorted(map(str, b.collect()))
    assert dict(spark.conf.getAll) == before


def test_command_line(tmp_path):
    told = subprocess.run(
        [sys.executable, "-m", "jobs.text_statistics", "--input", f"{DATA}/documents.parquet", "--output", str(tmp_path / "out")], cwd=ROOT, capture_output=True, text=True, timeout=300, check=True
    )
    assert (tmp_path / "out/statistics/measure=words").is_dir() and "wrote" in told.stderr and "read" in told.stderr
