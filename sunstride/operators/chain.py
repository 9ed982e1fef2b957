"""Named feature steps that say what they need, applied in an order that satisfies them."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from graphlib import TopologicalSorter

from pyspark.sql import DataFrame, functions as F

from ..functions import cyclic, local_time


@dataclass(frozen=True)
class Step:
    """A transformation and the steps whose columns it reads."""

    name: str
    apply: Callable[[DataFrame], DataFrame]
    after: tuple[str, ...] = ()


def local_calendar(ts: str = "ts", hours: int = 10, irradiance: str = "VAR169_dea") -> Step:
    """ts_local, hour, dayofyear, month and is_daytime."""
    here = local_time(ts, hours)
    made = {"ts_local": here, "hour": F.hour(here), "dayofyear": F.dayofyear(here), "month": F.month(here), "is_daytime": F.coalesce(F.col(irradiance) > 0, F.lit(False))}
    return Step("local", lambda df: df.withColumns(made))


def cyclic_time() -> Step:
    return Step("cyclic", lambda df: df.withColumns(cyclic("hour", 24, "hour") | cyclic("dayofyear", 366, "doy")), ("local",))


def wind(u: str = "VAR165", v: str = "VAR166") -> Step:
    return Step("wind", lambda df: df.withColumn("wind_speed", F.hypot(u, v)))


def chained(df: DataFrame, steps: Sequence[Step]) -> DataFrame:
    """All steps, each after those that it names; raises where one is missing or they go in a circle."""
    known = {s.name: s for s in steps}
    if missing := {a for s in steps for a in s.after} - set(known):
        raise ValueError(f"no step {sorted(missing)}")
    for name in TopologicalSorter({s.name: s.after for s in steps}).static_order():
        df = df.transform(known[name].apply)
    return df
