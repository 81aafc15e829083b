"""Scalar expressions: schedules, calendars, counts, digests."""

from __future__ import annotations

import hashlib
import json
import re
from itertools import takewhile

from pyspark.sql import Column
from pyspark.sql import functions as F


def is_finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))


def guarded_divide(num: Column, den: Column, least: float = 1e-12) -> Column:
    """num / den where den exceeds ``least``, else null (also for a den that is NaN)."""
    return F.when((den > least) & ~F.isnan(den.cast("double")), num / den)


def warmup_cosine(update: Column, total: int, warmup: int, start: float, floor: float) -> Column:
    """Learning-rate factor: linear from ``start`` to 1, then half a cosine to ``floor``."""
    if total < 1 or not 0 <= warmup < total or not 0 < start <= 1 or not 0 <= floor <= 1:
        raise ValueError("schedule parameters out of range")
    u = F.least(F.greatest(update.cast("double"), F.lit(0.0)), F.lit(float(total)))
    cosine = floor + (1.0 - floor) * 0.5 * (1.0 + F.cos(F.pi() * (u - warmup) / (total - warmup)))
    return F.when(u < warmup, start + (1.0 - start) * u / warmup).otherwise(cosine) if warmup else cosine


def bucket_samples(batch: Column, batches: int, samples: int, batch_size: int, accumulate: int) -> Column:
    """Samples behind the accumulation bucket of a batch, the short last one included."""
    if min(batches, samples, batch_size, accumulate) < 1:
        raise ValueError("counts must be positive")
    first = F.floor(batch / accumulate) * accumulate
    last = F.least(first + accumulate, F.lit(batches))
    return (F.least(last * batch_size, F.lit(samples)) - first * batch_size).cast("long")


def count_timesteps(start: Column, end: Column, stride_hours: Column | int) -> Column:
    """Steps over an inclusive range of dates."""
    return F.ceil((F.datediff(end, start) + 1) * 24 / stride_hours).cast("long")


def add_years(day: Column, years: Column | int) -> Column:
    """Whole years later; 29 February becomes the 28th."""
    return F.add_months(day, years * 12)


def lead_hours(lead: Column, step: int = 1, cadence_hours: float = 6.0) -> Column:
    return lead * float(step * cadence_hours)


def epoch_ns(ts: Column) -> Column:
    """Nanoseconds since 1970 of a timestamp_ntz (microsecond precision)."""
    return F.unix_micros(ts.cast("timestamp")) * 1000


def version_numbers(version: Column) -> Column:
    """Leading integers of the dotted pieces before the first that has none."""
    known = F.regexp_extract(version, "^[0-9]+[^.]*(?:\\.[0-9]+[^.]*)*", 0)
    parts = F.transform(F.split(known, "\\."), lambda p: F.regexp_extract(p, "^([0-9]+)", 1))
    return F.transform(F.filter(parts, lambda p: p != ""), lambda p: p.cast("int"))


def canonical_json(contract: dict) -> str:
    """Sorted keys, no spaces."""
    return json.dumps(contract, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def fingerprint(contract: dict) -> str:
    return hashlib.sha256(canonical_json(contract).encode()).hexdigest()


def differences(saved: dict, current: dict) -> list[str]:
    """Keys whose values differ, or that one side lacks."""
    return sorted(k for k in saved.keys() | current.keys() if saved.get(k) != current.get(k))


def split_version(version: str) -> tuple[int, ...]:
    leads = (re.match(r"[0-9]+", piece) for piece in version.split("."))
    return tuple(int(m[0]) for m in takewhile(bool, leads))
