"""Validation battery, identities and split tables, each with an input that must fail."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from isobar import schema
from isobar.functions import grid
from isobar.operators import battery, stats, validate
from isobar.sources import identity, publish, state


@pytest.fixture(scope="module")
def data(spark):
    rows = [(t, c, i, j, float(v)) for (t, c, i, j), v in np.ndenumerate(np.random.default_rng(17).normal(size=(12, 2, 5, 8)))]
    cells = spark.createDataFrame(rows, "t_idx long, channel_idx int, lat_idx int, lon_idx int, value double")
    cells = cells.withColumn("ts", state.time_of(F.col("t_idx"))).cache()
    lat, lon = state.dim_lat(spark, 5), state.dim_lon(spark, 8)
    part = lambda a, b: cells.where((F.col("t_idx") >= a) & (F.col("t_idx") < b))
    return {
        "splits": {"train": part(0, 6), "valid": part(6, 9), "test": part(9, 12)},
        "lat": lat,
        "lon": lon,
        "channels": spark.createDataFrame([(0, "a", "K"), (1, "b", "Pa")], "channel_idx int, channel string, units string"),
        "stats": stats.area_moments(part(0, 6), grid.area_weights(lat), ["channel_idx"]).cache(),
        "clim": stats.climatology(part(0, 6)).cache(),
    }


def failed(report):
    return {(r.check, r.split) for r in report.where("NOT passed").collect()}


def test_report_passes_and_names_what_fails(spark, data):
    digest = validate.merkle_digest(data["splits"]["train"]).first().digest
    whole = battery.validation_report(**data, tendency=data["stats"], full_scan=True, digests={"train": digest})
    assert not failed(whole) and whole.where("check = 'payload'").count() == 1
    late = F.when((F.col("t_idx") == 5) & (F.col("lat_idx") == 2), float("nan")).otherwise(F.col("value"))
    bad = data["splits"] | {"train": data["splits"]["train"].withColumn("value", late)}
    assert failed(battery.validation_report(**data | {"splits": bad}, full_scan=True, digests={"train": digest})) == {("finite", "train"), ("payload", "train")}
    assert not failed(battery.validation_report(**data | {"splits": bad}))  # the first time is whole
    swapped = {k: data["splits"][k] for k in ("valid", "train", "test")}
    gap = swapped | {"test": data["splits"]["test"].where("t_idx <> 10 OR lat_idx > 0")}
    assert failed(battery.validation_report(**data | {"splits": gap})) == {("order", "train"), ("cells", "test")}
    other = {
        "channels": data["channels"].withColumn("units", F.lit(" ")),
        "stats": data["stats"].where("channel_idx = 0").withColumn("std", F.lit(0.0)),
        "clim": data["clim"].where("lat_idx > 1"),
        "lat": state.dim_lat(spark, 5).where("lat_idx > 0"),
    }
    names = {c for c, _ in failed(battery.validation_report(**data | other))}
    assert names == {"units", "statistics_values", "statistics_channels", "climatology_shape", "global_grid", "cells"}


def test_report_of_an_empty_split(data):
    none = data["splits"] | {"test": data["splits"]["test"].limit(0)}
    got = failed(battery.validation_report(**data | {"splits": none}, full_scan=True))
    assert {("cells", "test"), ("finite", "test"), ("cadence", "test"), ("order", "test")} <= got


def test_source_problems(spark):
    flat = ["time", "latitude", "longitude"]
    rows = [(v, flat) for v in schema.SURFACE_VARIABLES] + [(v, ["level", *flat]) for v in schema.PRESSURE_VARIABLES] + [("extra", ["time"])]
    table = lambda r: spark.createDataFrame(r, "variable string, dims array<string>")
    levels = spark.createDataFrame([(p,) for p in (*schema.PRESSURE_LEVELS, 70)], "level int")
    assert battery.source_problems(table(rows), levels).isEmpty()
    broken = [r for r in rows if r[0] != "2m_temperature"]
    broken[-2] = (broken[-2][0], flat)
    got = {tuple(r) for r in battery.source_problems(table(broken), levels.where("level <> 850")).collect()}
    assert got == {("missing variable", "2m_temperature"), ("unexpected dimensions", "specific_humidity"), ("missing level", "850")}
    assert [tuple(r) for r in battery.source_problems(table(rows), None).collect()] == [("missing coordinate", "level")]


def test_channel_statistics(spark, data):
    assert battery.channel_statistics(data["stats"], 2).count() == 2
    for s, n in ((data["stats"], 3), (data["stats"].limit(0), 0), (data["stats"].unionByName(data["stats"]), 2)):
        with pytest.raises(ValueError, match="channels"):
            battery.channel_statistics(s, n)


def test_identity_sees_payload_edits(spark, data, tmp_path):
    root = str(tmp_path / "state")
    data["splits"]["train"].coalesce(1).write.parquet(root)
    samples = spark.createDataFrame([(0, 0), (1, 1)], "sample_idx long, t_idx long")
    ask = lambda: identity.dataset_identity(spark, root, data["lat"], data["lon"], data["channels"], samples)
    one = ask()
    assert one == ask() and one["cadence_hours"] == 6.0 and one["timesteps"] == 6 and one["samples"] == 2
    names = {r.name: r for r in identity.file_digests(spark, root).collect()}
    part = next(n for n in names if n.endswith(".parquet"))
    import hashlib
    import os

    with open(f"{root}/{part}", "rb") as f:
        assert hashlib.sha256(f.read()).hexdigest() == names[part].sha256
    os.utime(f"{root}/{part}", (1, 1))
    assert publish.differences(one, ask()) == ["inventory_sha256"]


def test_bundle_contract(spark, data, tmp_path):
    about = {"first_time": "a", "last_time": "b", "channels": ["a"], "channel_units": ["K"], "cadence_hours": 6.0, "latitude": [90.0], "longitude": [0.0]}
    want = identity.statistics_contract(about, 1)
    assert len(want) == 9
    root = str(tmp_path / "bundle")
    with pytest.raises(ValueError, match="manifest"):
        identity.validate_bundle(spark, root, want)
    publish.write_bundle(data["stats"], data["clim"], root, want)
    assert identity.validate_bundle(spark, root, want)["version"] == 4
    with pytest.raises(ValueError, match="time_difference_step"):
        identity.validate_bundle(spark, root, want | {"time_difference_step": 2})
    data["stats"].withColumn("std", F.col("std") * 2).write.mode("overwrite").parquet(f"{root}/stats_channel")
    with pytest.raises(ValueError, match="stats_channel"):
        identity.validate_bundle(spark, root, want)
    assert not identity.guard_statistics({"x": "1"}, {"x": "1"})
    assert identity.guard_statistics({"x": "1"}, {"x": "2"}, override=True)
    with pytest.raises(ValueError, match="x"):
        identity.guard_statistics({"x": "1"}, {"x": "2"})


def test_split_and_sample_tables(spark, data, tmp_path):
    cells = data["splits"]["train"].unionByName(data["splits"]["valid"]).unionByName(data["splits"]["test"])
    root = str(tmp_path / "splits")
    with pytest.raises(ValueError, match="test"):
        identity.write_splits(cells, root, "2024-01-01", "2024-01-03")
    identity.write_splits(cells, root, "2024-01-01", "2024-01-02")
    got = {r.split: r.n for r in spark.read.parquet(root).groupBy("split").agg(F.count_distinct("t_idx").alias("n")).collect()}
    assert got == {"train": 4, "valid": 4, "test": 4}
    with pytest.raises(FileExistsError):
        identity.write_splits(cells, root, "2024-01-01", "2024-01-02")
    day = str(tmp_path / "day")
    identity.write_sample(cells, day, "2024-01-02")
    assert spark.read.parquet(day).select("t_idx").distinct().count() == 4
    with pytest.raises(Exception, match="(?i)exists"):
        identity.write_sample(cells, day, "2024-01-02")
    identity.write_sample(cells, day, "2024-01-03", overwrite=True)
    assert spark.read.parquet(day).agg(F.min("t_idx")).first()[0] == 8


def test_layout_and_summary(spark, tmp_path):
    at = identity.Layout("/data/")
    assert (at.store, at.statistics(4), at.table("test", "/x")) == ("/data/state", "/data/statistics_dt4", "/x")
    for wrong in (lambda: at.table("future"), lambda: at.statistics(0)):
        with pytest.raises(ValueError):
            wrong()
    leads = spark.createDataFrame([("m", 2, 0.5), ("m", 1, 0.25)], "model string, lead int, rmse double")
    root = str(tmp_path / "out")
    identity.write_summary(leads, leads.select("model", "lead", "rmse"), root, {"hash": "h"})
    identity.write_summary(leads, None, root, {"hash": "h"})
    told = json.loads((tmp_path / "out" / "metrics.json").read_text())
    assert told["hash"] == "h" and [r["lead"] for r in told["leads"]] == [1, 2]
    assert not (tmp_path / "out" / "milestones.json").exists()
