"""Training by gradient steps: a linear tendency model with a factor per channel and degree.

The model says that the part of degree l of the next tendency is a multiple of that
part of the last one.  Its loss is quadratic, so one narrow pass over the fields turns
every sample into a small matrix and vector, and the gradient of an update needs only
their sums.  One job an epoch sums all its updates, in fixed point: the same bits however
the rows are dealt, so a run that was broken off and resumed equals an unbroken one.
Updates follow each other by nature: the driver takes their sums in order, a partition at
a time, and holds the parameters (channels x degrees).
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import asdict, dataclass
from itertools import groupby, islice

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from isobar.functions import harmonics
from isobar.operators.epochs import position_of
from isobar.operators.fields import _fields

_EXACT = "decimal(38,18)"


def tendency_pairs(changes: DataFrame, step: int = 1) -> DataFrame:
    """sample_idx, channel_idx, x, y of ``changes(t_idx, channel_idx, field)``: a tendency and the one after it."""
    x = changes.select("channel_idx", (F.col("t_idx") + step).alias("sample_idx"), F.col("field").alias("x"))
    y = changes.select("channel_idx", F.col("t_idx").alias("sample_idx"), F.col("field").alias("y"))
    return x.join(y, ["channel_idx", "sample_idx"]).select("sample_idx", "channel_idx", "x", "y")


def degree_parts(x: np.ndarray, table: list[np.ndarray], degrees: int) -> np.ndarray:
    """Fields x degrees x cells: the part of each degree of ``x`` (fields x latitudes x longitudes)."""
    told = harmonics._transform(x, table)
    out = []
    for degree in range(degrees):
        only = [np.where(np.arange(m, m + c.shape[1]) == degree, c, 0) for m, c in enumerate(told)]
        out.append(harmonics._inverse(only, table, x.shape[2]).reshape(len(x), -1))
    return np.stack(out, axis=1)


def spectral_samples(pairs: DataFrame, shape: tuple[int, int], weights: Sequence[float], degrees: int) -> DataFrame:
    """sample_idx, channel_idx, gram, cross, power of ``pairs(sample_idx, channel_idx, x, y)``: a narrow map.

    With X the parts of x by degree and <> the weighted mean over cells: gram = <X X>
    (row by row), cross = <X y>, power = <y y>.  The loss of factors f on a sample is
    power - 2 f cross + f gram f.
    """
    w = np.asarray(weights, float) / float(np.sum(weights))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = list(islice(harmonics.legendre(shape[0], degrees), shape[1] // 2 + 1))
        for batch in batches:
            rows: list[list] = [[], [], []]
            for x, y in zip(_fields(batch, "x"), _fields(batch, "y"), strict=True):
                parts = degree_parts(x.reshape(1, *shape), table, degrees)[0]
                for held, value in zip(rows, (((parts * w) @ parts.T).ravel().tolist(), ((parts * w) @ y).tolist(), float(w @ (y * y))), strict=True):
                    held.append(value)
            yield pa.RecordBatch.from_arrays(
                [batch.column("sample_idx"), batch.column("channel_idx"), pa.array(rows[0], pa.list_(pa.float64())), pa.array(rows[1], pa.list_(pa.float64())), pa.array(rows[2], pa.float64())],
                ["sample_idx", "channel_idx", "gram", "cross", "power"],
            )

    return pairs.select("sample_idx", "channel_idx", "x", "y").mapInArrow(run, "sample_idx long, channel_idx int, gram array<double>, cross array<double>, power double")


def _totals(samples: DataFrame, first: int, n: int, update_of: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """update, channel_idx, n, sums: the samples of each update, and their gram, cross and power summed, in this order.

    Windows are numbered from ``first``; ``update_of`` gives the update of the windows
    0 <= w < n.  A number that is not finite, or beyond fixed point, makes its sum NaN.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("sample_idx").to_numpy(zero_copy_only=False) - first
            own = np.flatnonzero((ids >= 0) & (ids < n))
            if not len(own):
                continue
            taken = batch.take(pa.array(own))
            told = [taken.column(c).flatten().to_numpy(zero_copy_only=False).reshape(len(own), -1) for c in ("gram", "cross")]
            x = np.hstack([*told, taken.column("power").to_numpy(zero_copy_only=False)[:, None]])
            width = x.shape[1]
            update = np.repeat(update_of(ids[own]), width)
            channel = np.repeat(taken.column("channel_idx").to_numpy(zero_copy_only=False), width)
            part = np.tile(np.arange(width, dtype=np.int32), len(own))
            yield pa.RecordBatch.from_arrays([pa.array(update), pa.array(channel), pa.array(part), pa.array(x.ravel())], ["update", "channel_idx", "part", "x"])

    x = F.expr(f"try_cast(x AS {_EXACT})")
    told = samples.select("sample_idx", "channel_idx", "gram", "cross", "power").mapInArrow(run, "update long, channel_idx int, part int, x double")
    told = told.groupBy("update", "channel_idx", "part").agg(F.count("*").alias("n"), F.when(F.count(x) == F.count("*"), F.sum(x).cast("double")).otherwise(F.lit(math.nan)).alias("x"))
    rows = F.array_sort(F.collect_list(F.struct("part", "x")))
    return told.groupBy("update", "channel_idx").agg(F.max("n").alias("n"), F.transform(rows, lambda r: r["x"]).alias("sums"))


def _sums(totals: Iterable[Row], factors: dict[int, np.ndarray]) -> dict[int, tuple[int, float, np.ndarray]]:
    """{channel: (samples, loss, gradient), summed} from the rows of one update (see ``_totals``)."""
    out = {}
    for r in totals:
        f, x = factors[r["channel_idx"]], np.array(r["sums"])
        d = len(f)
        cross = x[d * d : -1]
        moved = (x[: d * d].reshape(d, d) * f).sum(axis=1)  # additions in a fixed order
        loss = float(x[-1]) - 2 * math.fsum(f * cross) + math.fsum(f * moved)
        out[r["channel_idx"]] = (r["n"], loss, 2 * (moved - cross))
    return out


@dataclass
class Training:
    """Settings of a run; ``rate`` is reached after ``warmup`` updates and falls by half a cosine to ``floor`` of it."""

    epochs: int = 8
    batch: int = 64
    rate: float = 0.3
    warmup: int = 2
    floor: float = 0.05
    clip: float = 1.0
    patience: int = 3
    least: float = 0.0
    seed: int = 17


def _rate(s: Training, update: int, total: int) -> float:
    if update < s.warmup:
        return s.rate * (update + 1) / s.warmup
    return s.rate * (s.floor + (1 - s.floor) * 0.5 * (1 + math.cos(math.pi * (update - s.warmup) / max(1, total - s.warmup))))


def train(samples: DataFrame, train_range: tuple[int, int], held_out: tuple[int, int], channels: Sequence[int], degrees: int, path: str, settings: Training | None = None) -> DataFrame:
    """channel_idx, degree, factor, epoch, loss, stale, norm of every epoch so far, a partition of ``path`` each.

    Windows first <= sample_idx < end of ``train_range`` are taken once an epoch, ``batch``
    at a time; ``loss`` is that of ``held_out`` after the epoch.  Training ends after
    ``epochs``, or when the loss has not fallen by ``least`` for ``patience`` epochs.  A
    run goes on after the last epoch that ``path`` holds.  An epoch is one job over
    ``samples``, however many updates it has.  A gradient that is not finite
    is an error; one longer than ``clip`` is shortened to it.
    """
    s, spark = settings or Training(), samples.sparkSession
    first, n = train_range[0], train_range[1] - train_range[0]
    updates = -(-n // s.batch)
    if held_out[1] <= held_out[0]:
        raise ValueError("no windows are held out")
    factors, begin, best, stale = {c: np.zeros(degrees) for c in channels}, 0, math.inf, 0
    schema = "channel_idx int, degree int, factor double, loss double, best double, stale int, norm double, settings string, epoch int"
    try:
        rows = spark.read.schema(schema).parquet(path).collect()  # epochs x parameters
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        rows = []
    told = repr(asdict(s) | {"train": train_range, "held_out": held_out})
    if rows:
        last = max(r["epoch"] for r in rows)
        for r in (r for r in rows if r["epoch"] == last):
            if r["settings"] != told:
                raise ValueError("the run in this folder has other settings")
            factors[r["channel_idx"]][r["degree"]] = r["factor"]
            begin, best, stale = last + 1, r["best"], r["stale"]
    judged = None
    for epoch in range(begin, s.epochs):
        if stale >= s.patience:
            break
        if judged is None:  # the same rows after every epoch: one a channel
            judged = _totals(samples, held_out[0], held_out[1] - held_out[0], np.zeros_like).collect()
        norm = 0.0
        order = lambda w, epoch=epoch: position_of(w, n, s.seed, epoch) // s.batch
        ordered = groupby(_totals(samples, first, n, order).orderBy("update", "channel_idx").toLocalIterator(), lambda r: r["update"])
        at, rows = next(ordered, (None, ()))
        for k in range(updates):
            sums = _sums(rows if at == k else (), factors)
            if at == k:
                at, rows = next(ordered, (None, ()))
            total = max(1, sum(m for m, _, _ in sums.values()))
            gradient = {c: g / total for c, (_, _, g) in sums.items()}
            norm = math.sqrt(math.fsum(x * x for c in sorted(gradient) for x in gradient[c].tolist()))
            if not math.isfinite(norm):
                raise FloatingPointError(f"gradient of epoch {epoch}, update {k}")
            scale = _rate(s, epoch * updates + k, s.epochs * updates) * (min(1.0, s.clip / norm) if norm else 1.0)
            factors = {c: f - scale * gradient[c] if c in gradient else f for c, f in factors.items()}
        lost = _sums(judged, factors)
        loss = math.fsum(x for _, x, _ in lost.values()) / max(1, sum(m for m, _, _ in lost.values()))
        best, stale = (loss, 0) if loss < best - s.least else (best, stale + 1)
        out = [(c, d, float(x), loss, best, stale, norm, told, epoch) for c in channels for d, x in enumerate(factors[c])]
        spark.createDataFrame(out, schema).coalesce(1).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("epoch").parquet(path)
    return spark.read.schema(schema).parquet(path)


def best_factors(run: DataFrame) -> DataFrame:
    """channel_idx, degree, factor of the epoch with the least held-out loss (the first of equal ones)."""
    best = run.select("epoch", "loss").distinct().agg(F.min_by("epoch", F.struct("loss", "epoch")).alias("epoch"))
    return run.join(F.broadcast(best), "epoch").select("channel_idx", "degree", "factor")  # one row


def spectral_tendency(factors: DataFrame, shape: tuple[int, int], degrees: int):
    """The trained model as a step of ``rollout_fields`` (aside: ``factors``, an array per channel)."""

    def step(now: np.ndarray, before: np.ndarray, aside: dict[str, np.ndarray]) -> np.ndarray:
        table = list(islice(harmonics.legendre(shape[0], degrees), shape[1] // 2 + 1))
        parts = degree_parts((now - before).reshape(len(now), *shape), table, degrees)
        return now + np.einsum("cl,clx->cx", aside["factors"][:, :degrees], parts)

    own = factors.groupBy("channel_idx").agg(F.transform(F.array_sort(F.collect_list(F.struct("degree", "factor"))), lambda x: x["factor"]).alias("factors"))
    return step, own
