"""Nearest neighbours where norms differ: recall, and how many candidates are compared."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from isobar.llm import ann


def clustered(n, norms, seed=1, dim=32):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(60, dim))
    x = centres[r.integers(0, 60, n)] + 0.35 * r.normal(size=(n, dim))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    return x * norms(r, n)[:, None]


def lognormal(r, n):
    return np.exp(r.normal(size=n))


def one_outlier(r, n):
    return np.append(np.ones(n - 1), 50.0)


def table(spark, x):
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(8)


def compared(spark, x, every):
    """Candidates that a query meets in the buckets it visits, on average."""
    one = table(spark, x).select("vec_id", F.col("embedding").alias("e"), F.lit(0).cast("long").alias("h1"), F.lit(0).cast("long").alias("h2"))
    plan = ann._plans(one, ann.NEIGHBOURS)
    reps = one.mapInArrow(ann._pack, "rep long, dim int, v binary, h1 long, h2 long").select("rep", "dim", "v")
    size = {}
    for r in reps.mapInArrow(ann._index(plan), "t int, dim int, grp long, bucket long, rep long, v binary").groupBy("t", "bucket").count().collect():
        size[r["t"], r["bucket"]] = r["count"]
    met = 0
    asked = reps.where(F.col("rep") % every == 0)
    for r in asked.mapInArrow(ann._probe(plan), "t int, dim int, grp long, buckets binary, query long, v binary").select("t", "buckets").collect():
        met += sum(size.get((r["t"], b), 0) for b in np.frombuffer(r["buckets"], np.int64).tolist())
    return met / len(range(0, len(x), every)), plan


@pytest.mark.parametrize("norms", [lognormal, one_outlier])
def test_op8_recall_on_uneven_norms(spark, norms):
    x = clustered(12000, norms)
    out = ann.nearest(table(spark, x), F.col("vec_id") % 100 == 0).toPandas()
    hit = 0
    for q in range(0, len(x), 100):
        s = x @ x[q]
        s[q] = -np.inf
        best = set(np.argsort(-s, kind="stable")[:20].tolist())
        mine = out[out.query_id == q]
        assert len(mine) == 20
        hit += len(best & set(mine.vec_id))
    assert hit >= 0.9 * 20 * len(range(0, len(x), 100))


def test_op8_compares_a_shrinking_share(spark):
    small, _ = compared(spark, clustered(8000, lognormal), 80)
    large, plan = compared(spark, clustered(32000, lognormal), 320)
    assert len(plan[32].bands) > 3
    assert large < 3 * small and large < 0.5 * 32000
    plain, _ = compared(spark, clustered(12000, lambda r, n: np.ones(n)), 120)
    outlier, plan = compared(spark, clustered(12000, one_outlier), 120)
    assert len(plan[32].bands) == 2 and outlier < 1.2 * plain + 2  # one long vector costs one comparison


def test_op8_bands_hold_every_halving():
    counts = {0: (1, 8.0), 3: (9000, 0.9), 4: (2000, 0.5), 5: (100, 0.2), 9: (5000, 0.01), 60: (1, 1e-18)}
    of, bands = ann._bands(counts, 16)
    assert [b.k > 0 for b in bands] == [False, True, False, True, False]
    assert of.tolist()[:10] == [0, 0, 0, 1, 2, 2, 2, 2, 2, 3] and of[60] == 4
    assert [b.bound for b in bands] == pytest.approx([8.0, 0.9, 0.5, 0.01, 1e-18])
