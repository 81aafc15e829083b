"""Contracts: guarded configurations, forecast identity, compatibility of splits."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from isobar.operators import validate
from isobar.operators.select import SPLITS, date_slice, split_range


def _require(**rules: bool) -> None:
    broken = [name for name, holds in rules.items() if not holds]
    if broken:
        raise ValueError("invalid " + ", ".join(broken))


@dataclass(frozen=True)
class IngestConfig:
    """What an ingest reads.  Batches keep the phase of the stride; one resolution."""

    start_date: str = SPLITS["train"][0]
    end_date: str = SPLITS["test"][1]
    stride_hours: int = 6
    batch_days: int = 7
    resolution: float = 0.5

    def __post_init__(self) -> None:
        _require(
            start_date=self.start_date <= self.end_date,
            stride_hours=self.stride_hours >= 6 and self.stride_hours % 6 == 0,
            batch_days=self.batch_days >= 1,
            resolution=self.resolution == 0.5,
        )
        _require(batch_days=self.batch_days * 24 % self.stride_hours == 0)


@dataclass(frozen=True)
class WindowConfig:
    """How samples are cut from a state table."""

    history: int = 0
    rollout: int = 1
    step: int = 1
    max_samples: int | None = None
    selection: str = "first"
    start: str | None = None
    end: str | None = None
    noise_std: float | None = None

    def __post_init__(self) -> None:
        _require(
            history=self.history >= 0,
            rollout=self.rollout >= 1,
            step=self.step >= 1,
            max_samples=self.max_samples is None or self.max_samples >= 1,
            selection=self.selection in ("first", "evenly_spaced"),
            start=not (self.start and self.end) or self.start <= self.end,
            noise_std=self.noise_std is None or self.noise_std > 0,
        )


def saved_step(saved: int | None, requested: int | None) -> int:
    """The stride a model was trained with; a request must equal it."""
    if not isinstance(saved, int) or saved < 1:
        raise ValueError("the model holds no valid stride")
    if requested not in (None, saved):
        raise ValueError(f"stride {requested} requested, trained with {saved}")
    return saved


def select_split(state: DataFrame, name: str, canonical: bool, column: str = "ts") -> DataFrame:
    """A split of a state table.

    Of the canonical store the split's days are taken, and the first and last day
    found must be those declared; any other table is taken whole.
    """
    first, last = split_range(name)
    if not canonical:
        return state
    part = date_slice(state, first, last, column)
    day = lambda f: F.date_format(f(column), "yyyy-MM-dd")
    found = tuple(part.agg(day(F.min), day(F.max)).first())
    if found != (first, last):
        raise ValueError(f"split {name} needs {first}..{last}, found {found[0]}..{found[1]}")
    return part


def grid_contract(channels: DataFrame, lat: DataFrame, lon: DataFrame, cadence_hours: float, step: int) -> dict:
    """The identity of a forecast.  The tables hold a row per coordinate."""
    column = lambda df, order, name: [r[0] for r in df.orderBy(order).select(name).collect()]
    return {
        "version": 1,
        "channels": column(channels, "channel_idx", "channel"),
        "channel_units": column(channels, "channel_idx", "units"),
        "latitude": column(lat, "lat_idx", "latitude"),
        "longitude": column(lon, "lon_idx", "longitude"),
        "cadence_hours": cadence_hours,
        "forecast_step_hours": step * cadence_hours,
    }


def incompatible(a: DataFrame, b: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Rows of two coordinate tables that differ, null-safe: keys and which ``field`` differs."""
    side = lambda df, s: df.select(*keys, F.lit(True).alias(f"_{s}"), *(F.col(v).alias(f"{v}_{s}") for v in values))
    both = side(a, "a").join(side(b, "b"), keys, "full")
    one_side = F.when(F.col("_a").isNull() | F.col("_b").isNull(), F.lit("row"))
    fields = [F.when(~F.col(f"{v}_a").eqNullSafe(F.col(f"{v}_b")), F.lit(v)) for v in values]
    found = F.when(one_side.isNotNull(), F.array(one_side)).otherwise(F.array_compact(F.array(*fields)) if values else F.array().cast("array<string>"))
    return both.select(*keys, F.explode(found).alias("field"))


#: Splits that a model has seen before it may be scored on this one.
_SEEN = {"valid": ("train",), "test": ("train", "valid")}


def _span(told: dict | None) -> tuple[datetime, datetime] | None:
    ends = [(told or {}).get(k) for k in ("first_time", "last_time")]
    return tuple(map(datetime.fromisoformat, ends)) if all(ends) else None


def evaluation_problems(saved: dict, state: DataFrame, channels: DataFrame, lat: DataFrame, lon: DataFrame, cadence_hours: float, step: int, split: str, diagnostic: bool = False) -> list[str]:
    """All that forbids to score the model of the manifest ``saved`` on ``state(ts, ...)``; empty if nothing.

    The grid must be global and every channel have a unit; the manifest's
    ``forecast_contract`` must equal that of the tables, key by key; a diagnostic run is
    scored only where asked; and the times of ``state`` must lie outside those of the
    splits (``data_signature``) that the model has seen.  The training times must be
    known, the validation times may be missing.  One scan, of the times.
    """
    out = [] if validate.global_grid(lat, lon).first()["global_grid"] else ["the grid is not global"]
    out += [f"channel {r['channel']} has no unit" for r in channels.where("units IS NULL OR trim(units) = ''").orderBy("channel_idx").collect()]
    held = saved.get("forecast_contract")
    own = grid_contract(channels, lat, lon, cadence_hours, step)
    out += ["the manifest has no forecast contract"] if held is None else [f"{k} differs from the forecast contract" for k in own if own[k] != held.get(k)]
    if saved.get("diagnostic_run") and not diagnostic:
        out.append("a diagnostic run is scored only where that is asked for")
    first, last = state.agg(F.min("ts"), F.max("ts")).first()
    for name in _SEEN.get(split, ()):
        seen = _span(saved.get("data_signature", {}).get(name))
        if seen is None and name == "train":
            out.append("the times of the training data are not known")
        elif seen is not None and first is not None and first <= seen[1] and seen[0] <= last:
            out.append(f"{split} overlaps the times of {name}")
    return out


def admit_evaluation(saved: dict, *tables, **how) -> None:
    """Raise with all of ``evaluation_problems``, if there are any."""
    if problems := evaluation_problems(saved, *tables, **how):
        raise ValueError("; ".join(problems))
