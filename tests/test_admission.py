"""The guard before a model is scored: everything that forbids it, at once."""

import pytest

from isobar.operators import contracts
from isobar.sources import state


@pytest.fixture(scope="module")
def tables(spark):
    channels = spark.createDataFrame([(0, "t2m", "K"), (1, "sp", "Pa")], "channel_idx int, channel string, units string")
    return channels, state.dim_lat(spark, 5), state.dim_lon(spark, 8)


def times(spark, first, last):
    return spark.sql(f"SELECT explode(sequence(timestamp_ntz '{first}', timestamp_ntz '{last}', interval 6 hours)) AS ts")


def saved(tables, **more):
    return {"forecast_contract": contracts.grid_contract(*tables, 6.0, 1), "data_signature": {"train": {"first_time": "2024-01-01T00:00:00", "last_time": "2024-01-10T18:00:00"}}} | more


def problems(spark, tables, manifest, first="2024-01-11 00:00:00", last="2024-01-12 18:00:00", split="valid", **more):
    return contracts.evaluation_problems(manifest, times(spark, first, last), *tables, 6.0, 1, split, **more)


def test_a_fitting_evaluation_is_admitted(spark, tables):
    assert problems(spark, tables, saved(tables)) == []
    contracts.admit_evaluation(saved(tables), times(spark, "2024-02-01", "2024-02-02"), *tables, cadence_hours=6.0, step=1, split="test")
    assert problems(spark, tables, {"forecast_contract": saved(tables)["forecast_contract"]}, split="train") == []


def test_leakage_contract_and_diagnostic_runs_are_told_together(spark, tables):
    manifest = saved(tables, diagnostic_run=True)
    manifest["forecast_contract"] = manifest["forecast_contract"] | {"cadence_hours": 12.0, "channels": ["t2m"]}
    found = problems(spark, tables, manifest, first="2024-01-10 18:00:00")
    assert len(found) == 4 and "valid overlaps the times of train" in found
    assert {"cadence_hours differs from the forecast contract", "channels differs from the forecast contract"} < set(found)
    assert len(problems(spark, tables, manifest, first="2024-01-10 18:00:00", diagnostic=True)) == 3
    with pytest.raises(ValueError, match="overlaps.*|differs"):
        contracts.admit_evaluation(manifest, times(spark, "2024-01-10 18:00:00", "2024-01-12"), *tables, cadence_hours=6.0, step=1, split="valid")


def test_spans_of_the_splits_before(spark, tables):
    both = saved(tables)
    both["data_signature"]["valid"] = {"first_time": "2024-01-11T00:00:00", "last_time": "2024-01-12T18:00:00"}
    assert problems(spark, tables, both, split="test") == ["test overlaps the times of valid"]
    assert problems(spark, tables, both, split="valid") == []
    assert problems(spark, tables, saved(tables, data_signature={}), split="test") == ["the times of the training data are not known"]
    assert problems(spark, tables, {"data_signature": both["data_signature"]}) == ["the manifest has no forecast contract"]


def test_grid_units_and_empty_tables(spark, tables):
    channels, lat, lon = tables
    blank = spark.createDataFrame([(0, "t2m", " "), (1, "sp", None)], "channel_idx int, channel string, units string")
    found = problems(spark, (blank, lat.where("lat_idx < 4"), lon), saved((blank, lat.where("lat_idx < 4"), lon)))
    assert found == ["the grid is not global", "channel t2m has no unit", "channel sp has no unit"]
    empty = times(spark, "2024-01-01", "2024-01-02").where("ts IS NULL")
    assert contracts.evaluation_problems(saved(tables), empty, channels, lat, lon, 6.0, 1, "test") == []
