"""Scalers: fitted on training rows as one-row tables, applied as arithmetic, kept as JSON."""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import zscore


def standardise(df: DataFrame, train: Column, columns: Sequence[str], suffix: str = "_z", guard: str = "floor") -> DataFrame:
    """Population z-scores by the training rows' statistics (one broadcast row, no collect)."""
    stats = df.where(train).agg(*(f(c).alias(f"_{n}_{c}") for c in columns for n, f in (("m", F.avg), ("s", F.stddev_pop))))
    out = df.join(F.broadcast(stats))  # one row
    return out.withColumns({f"{c}{suffix}": zscore(c, f"_m_{c}", f"_s_{c}", guard) for c in columns}).drop(*(f"_{n}_{c}" for c in columns for n in "ms"))


@dataclass(frozen=True)
class Scaler:
    """identity, capacity (x / scale) or standard ((x - mean) / scale)."""

    name: str = "identity"
    mean: float = 0.0
    scale: float = 1.0

    def apply(self, x: Column) -> Column:
        return x if self.name == "identity" else (x - self.mean) / self.scale

    def inverse(self, x: Column) -> Column:
        return x if self.name == "identity" else x * self.scale + self.mean

    def save(self, path: str) -> None:
        with open(path, "w") as f:
            json.dump(asdict(self), f)

    @classmethod
    def load(cls, path: str) -> Scaler:
        with open(path) as f:
            return rebuilt(json.load(f))


def fit_capacity(capacity: float) -> Scaler:
    return Scaler("capacity", 0.0, capacity)


def fit_standard(windows: DataFrame, group: str = "grp", history_rows: str = "history_rows", history: str = "history", target_row: str = "target_row", target: str = "target") -> Scaler:
    """Mean and population deviation + 1e-8 over the different rows that training windows touch."""
    m, s = touched(windows, group, history_rows, history, target_row, target).agg(F.avg("v"), F.stddev_pop("v")).first()
    return Scaler("standard", m, s + 1e-8)


def touched(windows: DataFrame, group: str = "grp", history_rows: str = "history_rows", history: str = "history", target_row: str = "target_row", target: str = "target") -> DataFrame:
    """The different (g, r, v) of the windows' rows: a row number belongs to its group."""
    both = F.concat(F.arrays_zip(F.col(history_rows).alias("r"), F.col(history).alias("v")), F.array(F.struct(F.col(target_row).alias("r"), F.col(target).alias("v"))))
    return windows.select(F.col(group).alias("g"), F.explode(both).alias("x")).select("g", "x.r", "x.v").distinct()


def rebuilt(saved: dict) -> Scaler:
    """The scaler that a mapping with its name describes."""
    if saved.get("name") not in SCALERS:
        raise ValueError(f"unknown scaler {saved.get('name')}; there are {sorted(SCALERS)}")
    return Scaler(**saved)


SCALERS = {"identity": lambda **_: Scaler(), "capacity": lambda capacity, **_: fit_capacity(capacity), "standard": lambda windows, **_: fit_standard(windows)}
