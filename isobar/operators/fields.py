"""Operators on the field layout: one row-major array per time and channel.

Everything here is a narrow map over whole fields in Arrow batches, followed by sums
of a few numbers or fields per partition; the cells of a field are never rows.  What
must cross partitions, the fields at the ends of a stretch of times, is sent alone.
"""

from __future__ import annotations

import hashlib
from collections import deque
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of fields that a task sends at once.
_SENT = 1 << 22
_PARTS = "kind string, channel_idx int, t_idx long, n long, w double, mean double, m2 double, field array<double>, digest string"
_PARTS_ARROW = pa.schema(
    [("kind", pa.string()), ("channel_idx", pa.int32()), ("t_idx", pa.int64()), ("n", pa.int64()), ("w", pa.float64()), ("mean", pa.float64()), ("m2", pa.float64()), ("field", pa.list_(pa.float64())), ("digest", pa.string())]
)


def _array(values: pa.Array) -> np.ndarray:
    """A list column's numbers as one float array; missing ones become NaN."""
    flat = values.flatten().cast(pa.float64())
    return flat.to_numpy(zero_copy_only=False).astype(float)


def _fields(batch: pa.RecordBatch, column: str) -> list[np.ndarray]:
    values = batch.column(column)
    if values.null_count:
        raise ValueError(f"{column} holds null fields")
    ends = np.cumsum(values.value_lengths().to_numpy(zero_copy_only=False))
    return np.split(_array(values), ends[:-1]) if len(ends) else []


def cell_weights(area_w: Sequence[float], n_lon: int) -> np.ndarray:
    """Area weights of a row-major field from those of its latitudes."""
    return np.repeat(np.asarray(area_w, float), n_lon)


class _Moments:
    """Weight, mean and centred squares of everything added; large offsets do not cancel."""

    def __init__(self, weights: np.ndarray):
        self.weights, self.total = weights, float(weights.sum())
        self.n, self.w, self.mean, self.m2 = 0, 0.0, 0.0, 0.0

    def add(self, x: np.ndarray) -> None:
        mean = float(self.weights @ x) / self.total
        m2 = float(self.weights @ (x - mean) ** 2)
        w = self.w + self.total
        apart = mean - self.mean if self.n else 0.0
        self.mean = self.mean + apart * self.total / w if self.n else mean
        self.m2 += m2 + apart * apart * self.w * self.total / w
        self.w, self.n = w, self.n + 1


class _Sent:
    """Rows of a pass, sent in record batches of about _SENT bytes."""

    def __init__(self):
        self.rows: list[dict] = []
        self.size = 0

    def put(self, kind: str, channel: int, t: int | None = None, moments: _Moments | None = None, field: np.ndarray | None = None, n: int | None = None, digest: str | None = None) -> None:
        row = {"kind": kind, "channel_idx": channel, "t_idx": t, "n": n, "field": field, "digest": digest}
        if moments is not None:
            row |= {"n": moments.n, "w": moments.w, "mean": moments.mean, "m2": moments.m2}
        self.rows.append(row)
        self.size += 200 + (field.nbytes if field is not None else 0)

    def full(self, least: int = _SENT) -> Iterator[pa.RecordBatch]:
        if self.rows and self.size >= least:
            yield pa.RecordBatch.from_pylist(self.rows, _PARTS_ARROW)
            self.rows, self.size = [], 0


def _pass(weights: np.ndarray, stride: int, differences: bool, digests: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = _Sent()
        channel, last = None, None
        ring: deque[np.ndarray] = deque(maxlen=stride)  # the newest fields of a stretch
        length = 0

        def stretch_ends() -> None:
            for back, x in zip(range(len(ring) - 1, -1, -1), ring, strict=True):
                out.put("tail", channel, last - back, field=x)
            ring.clear()

        def channel_ends() -> None:
            if moments.n:
                out.put("state", channel, moments=moments)
                out.put("climatology", channel, n=moments.n, field=mean)
            if changes.n:
                out.put("difference", channel, moments=changes)

        moments, changes, mean = _Moments(weights), _Moments(weights), None
        for batch in batches:
            for c, t, x in zip(batch.column("channel_idx").to_pylist(), batch.column("t_idx").to_pylist(), _fields(batch, "field"), strict=True):
                if c != channel:
                    if channel is not None:
                        stretch_ends()
                        channel_ends()
                    moments, changes, mean, length = _Moments(weights), _Moments(weights), np.zeros(len(weights)), 0
                    channel = c
                elif t == last:
                    raise ValueError(f"time {t} of channel {c} is repeated")
                elif t != last + 1:
                    stretch_ends()
                    length = 0
                moments.add(x)
                mean += (x - mean) / moments.n
                if digests:
                    out.put("digest", c, t, digest=hashlib.sha256(x.astype("<f4").tobytes()).hexdigest())
                if length < stride:
                    out.put("head", c, t, field=x)
                else:
                    changes.add(x - ring[0])
                    if differences:
                        out.put("change", c, t - stride, field=x - ring[0])
                ring.append(x)
                last, length = t, length + 1
                yield from out.full()
        if channel is not None:
            stretch_ends()
            channel_ends()
        yield from out.full(0)

    return run


def ordered_pass(fields: DataFrame, weights: Sequence[float], stride: int = 1, differences: bool = False, digests: bool = True) -> DataFrame:
    """One pass over ``fields(t_idx, channel_idx, field)`` in the order of time: its partial results.

    A partition's fields are sorted where they are (no exchange) and read once, with the
    newest ``stride`` of them in memory.  Per partition and channel it gives moments of
    the state, moments of ``x[t + stride] - x[t]`` and a mean field (kinds ``state``,
    ``difference``, ``climatology``); per field a digest of its float32 bits; and of
    every stretch of consecutive times the first and last ``stride`` fields
    (``head``, ``tail``), which alone meet across partitions.  A table in files by
    time has few stretches; any other order gives the same results, with more heads.
    differences: also the fields ``x[t + stride] - x[t]`` (kind ``change``).

    Write the result once (``write_pass``) and take statistics from there.  Gaps end a
    stretch; a (time, channel) that a partition repeats and a null field are errors;
    missing numbers in a field count as NaN.
    """
    if stride < 1:
        raise ValueError("stride must be at least 1")
    told = fields.select("channel_idx", F.col("t_idx").cast("long").alias("t_idx"), "field").sortWithinPartitions("channel_idx", "t_idx")
    return told.mapInArrow(_pass(np.asarray(weights, float), stride, differences, digests), _PARTS)


def write_pass(parts: DataFrame, path: str) -> DataFrame:
    """The parts as a table by kind, read back: a reader of one kind opens that kind only."""
    parts.write.mode("overwrite").partitionBy("kind").parquet(path)
    return parts.sparkSession.read.schema(_PARTS).parquet(path)


def _field_moments(weights: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for c, x in zip(batch.column("channel_idx").to_pylist(), _fields(batch, "field"), strict=True):
                m = _Moments(weights)
                m.add(x)
                out.append({"channel_idx": c, "n": m.n, "w": m.w, "mean": m.mean, "m2": m.m2})
            yield pa.RecordBatch.from_pylist(out, pa.schema([_PARTS_ARROW.field(k) for k in ("channel_idx", "n", "w", "mean", "m2")]))

    return run


def border_changes(parts: DataFrame, stride: int) -> DataFrame:
    """channel_idx, t_idx, field: differences over the ends of stretches; only heads and tails are shuffled."""
    tails = parts.where("kind = 'tail'").select("channel_idx", "t_idx", (F.col("t_idx") + stride).alias("later"), F.col("field").alias("x"))
    heads = parts.where("kind = 'head'").select("channel_idx", F.col("t_idx").alias("later"), F.col("field").alias("y"))
    return tails.join(heads, ["channel_idx", "later"]).select("channel_idx", "t_idx", F.zip_with("y", "x", lambda a, b: a - b).alias("field"))


def pass_moments(parts: DataFrame, weights: Sequence[float], stride: int) -> tuple[DataFrame, DataFrame]:
    """(state, difference): (channel_idx, n, w, mean, m2) of a written pass, merged."""
    keys = ["channel_idx", "n", "w", "mean", "m2"]
    border = border_changes(parts, stride).select("channel_idx", "field").mapInArrow(_field_moments(np.asarray(weights, float)), "channel_idx int, n long, w double, mean double, m2 double")
    of = lambda kind: parts.where(F.col("kind") == kind).select(keys)
    return merged(of("state")), merged(of("difference").unionByName(border))


def merged(parts: DataFrame) -> DataFrame:
    """channel_idx, n, w, mean, m2 of disjoint parts, a few numbers per partition.

    They are added in ascending order, so the order in which parts arrive does not tell.
    """
    p = F.array_sort(F.collect_list(F.struct("mean", "m2", "w")))
    told = parts.groupBy("channel_idx").agg(F.sum("n").alias("n"), p.alias("p"))
    total = lambda value: F.aggregate("p", F.lit(0.0), lambda s, x: s + value(x))
    told = told.withColumn("w", total(lambda x: x["w"])).withColumn("mean", total(lambda x: x["w"] * x["mean"]) / F.col("w"))
    apart = lambda x: x["mean"] - F.col("mean")
    return told.select("channel_idx", "n", "w", "mean", total(lambda x: x["m2"] + x["w"] * apart(x) * apart(x)).alias("m2"))


def pass_climatology(parts: DataFrame) -> DataFrame:
    """channel_idx, field: the mean field of every channel, of a written pass.

    A partition gave one mean field a channel; their cells are summed by place, in
    fixed point (1e-18), so the result does not depend on the order.
    """
    own = parts.where("kind = 'climatology'").select("channel_idx", "n", F.posexplode("field").alias("p", "x"))
    total = F.sum(F.when(~F.isnan("x"), F.col("x") * F.col("n")).cast("decimal(38,18)")).cast("double")
    value = F.when(F.bool_or(F.isnan("x")), F.lit(float("nan"))).otherwise(total / F.sum("n"))
    cells = own.groupBy("channel_idx", "p").agg(value.alias("x"))
    return cells.groupBy("channel_idx").agg(F.transform(F.array_sort(F.collect_list(F.struct("p", "x"))), lambda s: s["x"]).alias("field"))


def pass_changes(parts: DataFrame, stride: int) -> DataFrame:
    """channel_idx, t_idx, field: all differences of a written pass made with ``differences``."""
    return parts.where("kind = 'change'").select("channel_idx", "t_idx", "field").unionByName(border_changes(parts, stride))


def pass_digest(parts: DataFrame) -> DataFrame:
    """channel_idx, n_times, digest: SHA-256 of the digests of a channel's fields, in the order of time."""
    rows = parts.where("kind = 'digest'").groupBy("channel_idx")
    told = rows.agg(F.count("*").alias("n_times"), F.array_sort(F.collect_list(F.struct("t_idx", "digest"))).alias("d"))
    return told.select("channel_idx", "n_times", F.sha2(F.array_join(F.transform("d", lambda s: s["digest"]), "").cast("binary"), 256).alias("digest"))


# --- regridding ---------------------------------------------------------------


def _sparse(rows: list, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first entry of each target row, source, weight) of (tgt, src, w) rows."""
    rows = sorted(rows)
    target = np.array([r[0] for r in rows])
    start = np.searchsorted(target, np.arange(n))
    if len(rows) == 0 or (np.diff(np.append(start, len(rows))) == 0).any():
        raise ValueError("every target needs a source")
    return start, np.array([r[1] for r in rows]), np.array([r[2] for r in rows], float)


def regrid_fields(fields: DataFrame, lat_w: DataFrame, lon_w: DataFrame, shape: tuple[int, int]) -> DataFrame:
    """``fields(..., field)`` on a coarser grid; the other columns stay.

    The kernel is separable: sparse weights (tgt, src, w) of longitudes, then of
    latitudes, applied to whole fields.  No exchange.  Only the weights, of the size of
    the axes, come to the driver.
    """
    h, w = shape
    take = lambda df: [(r["tgt"], r["src"], r["w"]) for r in df.select("tgt", "src", "w").collect()]
    rows, columns = take(lat_w), take(lon_w)
    lat, lon = _sparse(rows, 1 + max(r[0] for r in rows)), _sparse(columns, 1 + max(r[0] for r in columns))
    others = [c for c in fields.columns if c != "field"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _array(batch.column("field")).reshape(-1, h, w)
            x = np.add.reduceat(x[:, :, lon[1]] * lon[2], lon[0], axis=2)
            x = np.add.reduceat(x[:, lat[1], :] * lat[2][:, None], lat[0], axis=1)
            size = x.shape[1] * x.shape[2]
            out = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * size), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in others), out], [*others, "field"])

    told = fields.select(*others, "field")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in told.schema.fields if f.name != "field")
    return told.mapInArrow(run, f"{kinds}, field array<double>")


# --- forecasts ------------------------------------------------------------------

#: (now, before, aside) -> the next state, all arrays channels x cells.
Step = Callable[[np.ndarray, np.ndarray, dict[str, np.ndarray]], np.ndarray]


def persistence(now: np.ndarray, before: np.ndarray, aside: dict[str, np.ndarray]) -> np.ndarray:
    return now


def linear_tendency(now: np.ndarray, before: np.ndarray, aside: dict[str, np.ndarray]) -> np.ndarray:
    return 2 * now - before


def climatology(now: np.ndarray, before: np.ndarray, aside: dict[str, np.ndarray]) -> np.ndarray:
    return aside["clim"]


def initial_fields(fields: DataFrame, first: int, end: int, step: int = 1, aside: DataFrame | None = None) -> DataFrame:
    """sample_idx, base_t, channel_idx, now, before (null without one): states at first <= t < end.

    Two reads of the fields meet by (time, channel); ``aside`` adds per-channel columns.
    """
    now = fields.where((F.col("t_idx") >= first) & (F.col("t_idx") < end)).select((F.col("t_idx") - first).alias("sample_idx"), F.col("t_idx").alias("base_t"), "channel_idx", F.col("field").alias("now"))
    back = fields.where((F.col("t_idx") >= first - step) & (F.col("t_idx") < end - step)).select((F.col("t_idx") + step).alias("base_t"), "channel_idx", F.col("field").alias("before"))
    out = now.join(back, ["base_t", "channel_idx"], "left")
    return out if aside is None else out.join(aside, "channel_idx")


def rollout_fields(initial: DataFrame, step: Step | dict[str, Step], leads: int, aside: Sequence[str] = (), joint: bool = False, model: str = "custom") -> DataFrame:
    """model, sample_idx, base_t, lead, channel_idx, field of ``initial`` (see ``initial_fields``).

    A task holds the newest two states of a sample and carries them through all leads,
    so the plan has one scan however many leads there are.  ``step`` (or steps by the name
    of their model, run side by side) gets a sample's
    channels together when ``joint`` (one exchange of the initial states), else one
    by one.  Columns named in ``aside`` are arrays (or numbers) per channel; the step
    gets them stacked.  A null ``before`` is NaN.
    """
    steps = step if isinstance(step, dict) else {model: step}
    columns = ["sample_idx", "base_t", "channel_idx", "now", "before", *aside]
    schema = "model string, sample_idx long, base_t long, lead int, channel_idx int, field array<double>"
    arrow = pa.schema([("model", pa.string()), ("sample_idx", pa.int64()), ("base_t", pa.int64()), ("lead", pa.int32()), ("channel_idx", pa.int32()), ("field", pa.list_(pa.float64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def forecast(rows: list[dict]) -> Iterator[pa.RecordBatch]:
            stack = lambda c: np.array([np.full(len(rows[0]["now"]), np.nan) if r[c] is None else np.asarray(r[c], float) for r in rows])
            first, beside = (stack("now"), stack("before")), {c: stack(c) for c in aside}
            out, size = [], 0
            for name, one in steps.items():
                now, before = first
                for lead in range(1, leads + 1):
                    now, before = np.asarray(one(now, before, beside), float), now
                    out += [{"model": name, "sample_idx": r["sample_idx"], "base_t": r["base_t"], "lead": lead, "channel_idx": r["channel_idx"], "field": x} for r, x in zip(rows, now, strict=True)]
                    size += now.nbytes
                    if size >= _SENT:
                        yield pa.RecordBatch.from_pylist(out, arrow)
                        out, size = [], 0
            if out:
                yield pa.RecordBatch.from_pylist(out, arrow)

        held: list[dict] = []
        for batch in batches:
            for row in batch.to_pylist():
                if held and not (joint and row["sample_idx"] == held[0]["sample_idx"]):
                    yield from forecast(held)
                    held = []
                held.append(row)
        if held:
            yield from forecast(held)

    rows = initial.select(*columns)
    if joint:
        rows = rows.repartition("sample_idx").sortWithinPartitions("sample_idx", "channel_idx")
    return rows.mapInArrow(run, schema)


# --- verification ------------------------------------------------------------------

_SUMS = ("sw", "se2", "sae", "se", "sab", "saa", "sbb", "svp", "svy")


def _sums(w: np.ndarray, p: np.ndarray, y: np.ndarray, c: np.ndarray) -> tuple[float, ...]:
    e, a, b = p - y, p - c, y - c
    spread = lambda x: w @ (x - w @ x / w.sum()) ** 2
    return tuple(map(float, (w.sum(), w @ (e * e), w @ abs(e), w @ e, w @ (a * b), w @ (a * a), w @ (b * b), spread(p), spread(y))))


def _with_acc(sums: DataFrame) -> DataFrame:
    from isobar.functions.scalars import guarded_divide

    return sums.withColumn("acc", guarded_divide(F.col("sab"), F.sqrt(F.col("saa") * F.col("sbb")))).drop("sab", "saa", "sbb")


def field_sums(pairs: DataFrame, weights: Sequence[float], keys: Sequence[str] = ("model", "sample_idx", "lead", "channel_idx")) -> DataFrame:
    """keys and the area-weighted sums of ``pairs(keys, prediction, target, clim)``, all fields: a narrow map.

    Same columns as ``metrics.sample_sums`` makes from cells (acc: null where undefined).
    """
    w = np.asarray(weights, float)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [_sums(w, *x) for x in zip(*(_fields(batch, c) for c in ("prediction", "target", "clim")), strict=True)]
            columns = zip(*rows, strict=True) if rows else ((),) * len(_SUMS)
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keys), *(pa.array(c, pa.float64()) for c in columns)], [*keys, *_SUMS])

    told = pairs.select(*keys, "prediction", "target", "clim")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in told.schema.fields[: len(keys)])
    return _with_acc(told.mapInArrow(run, kinds + "".join(f", {s} double" for s in _SUMS)))


_SCORES = [pa.string(), pa.int64(), pa.int32(), pa.int32(), *[pa.float64()] * len(_SUMS)]
#: Times of a channel whose forecasts one task starts.
PART_TIMES = 64


def verify_fields(fields: DataFrame, clim: DataFrame, steps: dict[str, Step], leads: int, weights: Sequence[float], first: int, end: int, step: int = 1, part_times: int = PART_TIMES) -> DataFrame:
    """model, sample_idx, lead, channel_idx and sums (as ``field_sums``) of forecasts started at first <= t < end.

    ``fields(t_idx, channel_idx, field)``, ``clim(channel_idx, field)``.  Forecasts are
    not written and not joined with the truth: a task takes a part of one channel's times in
    order, steps all open forecasts once a time and scores them there.  The fields a part
    needs beyond its own times, ``leads * step`` after and ``step`` before, are sent to it
    too, so one exchange moves each field ``1 + (leads + 1) * step / part_times`` times.
    A task holds ``leads`` forecasts a model.  A time without a field gets no score, a
    start without the state before it no forecast by a step that needs one (NaN).
    """
    w, late = np.asarray(weights, float), leads * step
    low, high = first // part_times, (end - 1) // part_times
    bound = lambda x, edge, least: least(x, F.lit(edge)).cast("long")
    from_, to = bound(F.floor((F.col("t_idx") - late) / part_times), low, F.greatest), bound(F.floor((F.col("t_idx") + step) / part_times), high, F.least)
    needed = fields.where((F.col("t_idx") >= first - step) & (F.col("t_idx") < end + late) & F.lit(first < end))
    rows = needed.select("channel_idx", F.explode(F.sequence(from_, to)).alias("part"), F.col("t_idx").cast("long").alias("t_idx"), F.col("field").cast("array<double>").alias("field"))
    beside = clim.select("channel_idx", F.explode(F.sequence(F.lit(low).cast("long"), F.lit(max(low, high)).cast("long"))).alias("part"), F.lit(None).cast("long").alias("t_idx"), F.col("field").cast("array<double>").alias("field"))
    dealt = rows.unionByName(beside).repartition("part", "channel_idx").sortWithinPartitions("part", "channel_idx", "t_idx")  # the climatology's row comes first

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, normal, open_, seen = None, None, [], {}
        for batch in batches:
            out = []
            for c, k, t, x in zip(*(batch.column(n).to_pylist() for n in ("channel_idx", "part", "t_idx")), _fields(batch, "field"), strict=True):
                if (k, c) != place:
                    place, normal, open_, seen = (k, c), None, [], {}
                if t is None:
                    normal = x
                    continue
                if normal is None:
                    raise ValueError(f"channel {c} has no climatology")
                for f in open_:
                    while f["at"] < t:
                        f["at"] += step
                        f["now"], f["before"] = f["one"](f["now"], f["before"], f["beside"]), f["now"]
                    if f["at"] == t:
                        out.append((f["model"], f["base"] - first, (t - f["base"]) // step, c, *_sums(w, f["now"][0], x, normal)))
                open_ = [f for f in open_ if f["at"] < f["base"] + late]
                if first <= t < end and t // part_times == k:
                    for name, one in steps.items():
                        before = seen.get(t - step)
                        open_.append({"model": name, "one": one, "base": t, "at": t, "now": x[None], "before": np.full((1, len(x)), np.nan) if before is None else before[None], "beside": {"clim": normal[None]}})
                seen = {u: v for u, v in seen.items() if u > t - step} | {t: x}
            columns = list(zip(*out, strict=True)) if out else [()] * (4 + len(_SUMS))
            yield pa.RecordBatch.from_arrays([pa.array(v, kind) for v, kind in zip(columns, _SCORES, strict=True)], ["model", "sample_idx", "lead", "channel_idx", *_SUMS])

    return _with_acc(dealt.mapInArrow(run, "model string, sample_idx long, lead int, channel_idx int" + "".join(f", {s} double" for s in _SUMS)))


def standardised(fields: DataFrame, statistics: DataFrame) -> DataFrame:
    """field becomes (field - mean) / std of its channel: a map, with the channels' numbers (a row each) broadcast."""
    rows = fields.join(F.broadcast(statistics.select("channel_idx", "mean", "std")), "channel_idx")
    return rows.withColumn("field", F.transform("field", lambda x: (x.cast("double") - F.col("mean")) / F.col("std"))).drop("mean", "std")
