"""Structured Streaming forms: windowed readings, and stateful thinning and ramps in the order of event time.

Rows wait in their entity's state until the watermark has passed them, so order holds across micro-batches; later rows
are too late and go. State is what lies within the watermark's delay, so it does not grow with the stream.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def stream_readings(events: DataFrame, entity: str = "event_type", ts: str = "ts", value: str = "value", minutes: int = 15, late: str = "30 minutes") -> DataFrame:
    """Mean by entity and window; windows are final once the watermark has passed them."""
    e = events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    out = e.groupBy(F.window(ts, f"{minutes} minutes"), F.col(entity).alias("site")).agg(F.avg(value).alias("power"))
    return out.select("site", F.col("window.start").alias("ts"), "power")


def _in_order(events: DataFrame, entity: str, ts: str, value: str | None, late: str, schema: str, step: Callable[[np.ndarray, np.ndarray, tuple], tuple[dict, tuple]]) -> DataFrame:
    """``step`` gets an entity's next rows in order (microseconds, values) and what it last returned, and returns columns and what to remember, (microseconds, value)."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last_us, last_v, us, v = state.get if state.exists else (None, None, [], [])
        new = list(batches)
        us, v = np.concatenate([np.array(us, np.int64), *(b["us"].to_numpy(np.int64) for b in new)]), np.concatenate([np.array(v, float), *(b["v"].to_numpy(float) for b in new)])
        order = np.lexsort((v, us))
        us, v = us[order], v[order]
        passed = state.getCurrentWatermarkMs() * 1000
        n = int(np.searchsorted(us, passed, "right"))
        out, last = step(us[:n], v[:n], (last_us, last_v)) if n else (None, (last_us, last_v))
        state.update((*last, us[n:].tolist(), v[n:].tolist()))
        if n < len(us):
            state.setTimeoutTimestamp(max(int(us[n] // 1000) + 1, state.getCurrentWatermarkMs() + 1))
        if out is not None:
            yield pd.DataFrame({"site": key[0]} | out)

    e = events.select(F.col(entity).alias("site"), F.col(ts).cast("timestamp").alias("at"), F.unix_micros(F.col(ts).cast("timestamp")).alias("us"), (F.col(value).cast("double") if value else F.lit(0.0)).alias("v"))
    return e.withWatermark("at", late).groupBy("site").applyInPandasWithState(run, f"site string, us long{schema}", "last_us long, last_v double, us array<long>, v array<double>", "append", GroupStateTimeout.EventTimeTimeout)


def stream_thinned(events: DataFrame, entity: str, ts: str, stride_s: int, late: str = "30 minutes") -> DataFrame:
    """Rows at least a stride after the last accepted one of their entity."""
    stride = stride_s * 1_000_000

    def step(us: np.ndarray, v: np.ndarray, last: tuple) -> tuple[dict, tuple]:
        kept, at, before = [], 0, last[0]
        while (at := int(np.searchsorted(us, before + stride)) if before is not None else at) < len(us):  # a jump for each accepted row
            kept.append(before := int(us[at]))
        return {"us": kept}, (before, None)

    return _in_order(events, entity, ts, None, late, "", step)


def stream_ramps(events: DataFrame, entity: str, ts: str, value: str, late: str = "30 minutes") -> DataFrame:
    """Difference from the entity's row before."""

    def step(us: np.ndarray, v: np.ndarray, last: tuple) -> tuple[dict, tuple]:
        before = np.append(np.nan if last[1] is None else last[1], v[:-1])
        ramp = pd.Series(v - before, dtype=object).where(~np.isnan(before), None)
        return {"us": us, "ramp": ramp}, (int(us[-1]), float(v[-1]))

    return _in_order(events, entity, ts, value, late, ", ramp double", step)
