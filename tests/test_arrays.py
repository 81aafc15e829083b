"""Statistics vectors in .npy files, and what a field table holds."""

import numpy as np
import pytest

from isobar.sources import arrays


@pytest.fixture(scope="module")
def channels(spark):
    return spark.createDataFrame([(c, f"c{c}") for c in range(3)], "channel_idx int, channel string")


def test_npy_files_of_any_number_kind_and_order(spark, tmp_path):
    kinds = {"a": np.arange(6, dtype=">f4").reshape(2, 3), "b": np.asfortranarray(np.arange(6.0).reshape(2, 3)), "c": np.array([1, 2], np.int16), "d": np.array(7.5), "e": np.zeros((0, 4)), "f": np.array([True, False]), "g": np.array([np.nan, np.inf])}
    for name, x in kinds.items():
        np.save(tmp_path / f"{name}.npy", x)
    (tmp_path / "notes.txt").write_text("not an array")
    got = {}
    for r in arrays.read_npy(spark, str(tmp_path)).collect():
        got.setdefault(r.path[-5], []).append((r.position, r.value, tuple(r.shape)))
    for name, x in kinds.items():
        rows = sorted(got.get(name, []))
        assert np.array_equal([v for _, v, _ in rows], x.ravel().astype(float), equal_nan=True)
        assert all(s == x.shape for _, _, s in rows)
    np.save(tmp_path / "s.npy", np.array(["x"]))
    with pytest.raises(Exception, match="not numbers"):
        arrays.read_npy(spark, str(tmp_path / "s.npy")).collect()


@pytest.mark.parametrize("shape", [(3,), (3, 1, 1), (1, 3, 1, 1)])
def test_channel_vectors(spark, tmp_path, channels, shape):
    np.save(tmp_path / "means.npy", np.array([4.0, 5.0, 6.0]).reshape(shape))
    out = arrays.channel_vector(arrays.read_npy(spark, str(tmp_path / "means.npy")), channels, "mean")
    assert sorted(map(tuple, out.collect())) == [(0, 4.0), (1, 5.0), (2, 6.0)]


def test_channel_vectors_that_do_not_fit(spark, tmp_path, channels):
    np.save(tmp_path / "x.npy", np.zeros(4))
    np.save(tmp_path / "y.npy", np.zeros(3))
    with pytest.raises(ValueError, match="4 numbers of 1 files for 3 channels"):
        arrays.channel_vector(arrays.read_npy(spark, str(tmp_path / "x.npy")), channels, "mean")
    with pytest.raises(ValueError, match="7 numbers of 2 files"):
        arrays.channel_vector(arrays.read_npy(spark, str(tmp_path)), channels, "mean")


def test_field_tables_are_described(spark):
    rows = [(0, 0, [1.0] * 4), (1, 0, [1.0] * 4), (4, 0, [1.0] * 3), (4, 0, [1.0] * 4), (7, 1, [1.0])]
    out = arrays.describe_fields(spark.createDataFrame(rows, "t_idx long, channel_idx int, field array<double>"))
    assert sorted(map(tuple, out.collect())) == [(0, 4, 0, 4, 2, 1, 3, 4), (1, 1, 7, 7, 0, 0, 1, 1)]
