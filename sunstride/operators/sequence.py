"""Lags, rolling statistics, leads, differences and sliding windows.

Expressions of one call share one window specification, so Spark sorts each entity once whatever the frames.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec, functions as F

from ..functions import clip_low, cyclic, minute_of_day
from .grid import interval


def over(by: Sequence[str], ts: str) -> WindowSpec:
    return Window.partitionBy(*by).orderBy(ts)


def lags(columns: Sequence[str], steps: Sequence[int], w: WindowSpec) -> dict[str, Column]:
    return {f"{c}_lag{k}": F.lag(c, k).over(w) for c in columns for k in steps}


def rolling_mean(x: str, n: int, w: WindowSpec) -> Column:
    """Over the row and the n - 1 before it, of as many as there are."""
    return F.avg(x).over(w.rowsBetween(1 - n, 0))


def rolling_std(x: str, n: int, w: WindowSpec) -> Column:
    """Sample deviation; 0 where fewer than two values are there."""
    return F.coalesce(F.stddev_samp(x).over(w.rowsBetween(1 - n, 0)), F.lit(0.0))


def lead_target(target: str, ts: str, w: WindowSpec, horizon: int = 1, minutes: int = 15) -> dict[str, Column]:
    """target_ts and target_y ``horizon`` steps ahead; y is NULL where that row is not exactly so much later."""
    if horizon <= 0:
        raise ValueError("horizon must be a positive number of steps")
    later = F.lead(ts, horizon).over(w)
    return {"target_ts": later, "target_y": F.when(later - F.col(ts) == interval(minutes * horizon), F.lead(target, horizon).over(w))}


def tabular(df: DataFrame, entity: str, ts: str, target: str, source: str, extra: Sequence[str] = (), horizon: int = 1, steps: Sequence[int] = (1, 4, 8, 96), windows: Sequence[int] = (4, 16, 96), split: str = "split") -> DataFrame:
    """Origin-time features for a direct forecast: lags, rolling statistics, calendar of the target, split of the target.

    Rows whose target or any feature is missing go. Nothing later than the origin enters a feature.
    """
    w = over([entity], ts)
    made = lead_target(target, ts, w, horizon) | {split: F.lead(split, horizon).over(w)} | lags([source, *extra], steps, w)
    for n in windows:
        made |= {f"roll{n}_mean": rolling_mean(source, n, w), f"roll{n}_std": rolling_std(source, n, w)}
        made |= {f"{c}_roll{n}_mean": rolling_mean(c, n, w) for c in extra}
    out = df.withColumns(made)
    calendar = cyclic(minute_of_day("target_ts"), 1440, "target_tod") | cyclic(F.dayofyear("target_ts"), 365.25, "target_doy")
    out = out.withColumns(calendar | {"lead_steps": F.lit(int(horizon))})
    features = [source, *extra, *(c for c in made if c not in ("target_ts", "target_y", split)), *calendar]
    return out.na.drop(subset=["target_y", *features])


def deaccumulate(x: str, by: Sequence[str], ts: str) -> Column:
    """Increments of a sum that restarts with each forecast day (which ends with the following midnight); not below 0."""
    day = F.date_trunc("DAY", F.col(ts) - F.expr("INTERVAL 1 HOUR"))
    before = F.lag(x).over(Window.partitionBy(*by, day).orderBy(ts))
    return clip_low(F.coalesce(F.col(x) - before, F.col(x)))


def ramp(x: str, ts: str, w: WindowSpec, seconds: int = 60) -> Column:
    """First difference where the step is exactly ``seconds``, else NULL."""
    return F.when(F.col(ts) - F.lag(ts).over(w) == F.expr(f"make_dt_interval(0, 0, 0, {seconds})"), F.col(x) - F.lag(x).over(w))


def sliding(df: DataFrame, frame: Sequence[str], ts: str, inputs: Sequence[str], target: str, history: int, horizon: int, future: Sequence[str] = (), strict: bool = True) -> DataFrame:
    """Full windows of each contiguous frame: x (history rows before the origin), y (``horizon`` rows from it on).

    Inputs come as ``x_<name>`` arrays and ``future`` columns, known ahead, as ``f_<name>``. ``collect_list`` skips NULLs,
    so with ``strict`` a missing input raises, as a frame must not have any. A frame of n rows has n - history - horizon + 1 windows.
    """
    w = over(frame, ts)
    past, ahead = w.rowsBetween(-history, -1), w.rowsBetween(0, horizon - 1)
    if strict:
        bad = F.greatest(*(F.col(c).isNull().cast("int") for c in (*inputs, target, *future)), F.lit(0)) > 0
        df = df.withColumn(ts, F.when(bad, F.raise_error(F.lit("a frame has missing values"))).otherwise(F.col(ts)))
    out = df.withColumns(
        {f"x_{c}": F.collect_list(c).over(past) for c in inputs} | {"y": F.collect_list(target).over(ahead)} | {f"f_{c}": F.collect_list(c).over(ahead) for c in future}
        | {"target_ts": F.collect_list(ts).over(ahead), "origin": F.row_number().over(w) - 1}
    )
    return out.where((F.size("y") == horizon) & (F.col("origin") >= history) & (F.size(f"x_{inputs[0]}") == history))


def contiguous_frames(df: DataFrame, frame: Sequence[str], columns: Sequence[str], history: int, horizon: int) -> DataFrame:
    """The frames of at least history + horizon rows. Raises where a column is missing, at run time where a value is, and where no frame is left."""
    missing = {*frame, *columns} - set(df.columns)
    if missing:
        raise ValueError(f"missing columns: {sorted(missing)}")
    bad = F.greatest(*(F.col(c).isNull().cast("int") for c in columns), F.lit(0)) > 0
    sizes = df.groupBy(*frame).agg(F.count(F.lit(1)).alias("_n"), F.max(F.when(bad, F.raise_error(F.lit("a frame has missing values")).cast("int")).otherwise(0)).alias("_bad"))
    sizes = sizes.where((F.col("_n") >= history + horizon) & (F.col("_bad") == 0)).drop("_n", "_bad")
    if sizes.isEmpty():
        raise ValueError(f"no frame has {history + horizon} rows")
    return df.join(sizes, list(frame), "left_semi")


def seasonal_naive(target: str, period: int, horizon: int, w: WindowSpec) -> Column:
    """The values one period before the horizon; a period below the horizon would reach into it."""
    if period < horizon:
        raise ValueError("the period must not be shorter than the horizon")
    return F.collect_list(target).over(w.rowsBetween(-period, horizon - period - 1))


def flatten(windows: DataFrame, keep: Sequence[str], y_true: str = "y", y_pred: str = "y_pred", ts: str = "target_ts") -> DataFrame:
    """A row for each step of each window: horizon_step (from 1), target_ts, y_true, y_pred."""
    rows = windows.select(*keep, F.posexplode(F.arrays_zip(F.col(ts).alias("ts"), F.col(y_true).alias("t"), F.col(y_pred).alias("p"))).alias("_i", "_v"))
    return rows.select(*keep, (F.col("_i") + 1).alias("horizon_step"), F.col("_v.ts").alias("target_ts"), F.col("_v.t").alias("y_true"), F.col("_v.p").alias("y_pred"))


def array_mean(x: Column) -> Column:
    """Of the values that are there; NULL if there are none."""
    there = F.array_compact(x)
    return F.try_divide(F.aggregate(there, F.lit(0.0), lambda a, v: a + v.cast("double")), F.size(there))


def array_var(x: Column, mean: Column) -> Column:
    return array_mean(F.transform(x, lambda v: (v.cast("double") - mean) * (v.cast("double") - mean)))


def revin(df: DataFrame, x: str, eps: float = 1e-5, gain: float = 1.0, shift: float = 0.0) -> DataFrame:
    """Each window by its own mean and deviation (columns revin_mean, revin_std and ``x``_norm), then by the learned gain and shift of its channel."""
    out = df.withColumn("revin_mean", array_mean(F.col(x)))
    out = out.withColumn("revin_std", F.sqrt(array_var(F.col(x), F.col("revin_mean")) + eps))
    own = lambda v: (v.cast("double") - F.col("revin_mean")) / F.col("revin_std") * gain
    return out.withColumn(f"{x}_norm", F.transform(x, lambda v: own(v) + shift if shift else own(v)))  # -0.0 + 0.0 is 0.0


def revin_inverse(x: Column | str, gain: float = 1.0, shift: float = 0.0) -> Column:
    return F.transform(x, lambda v: (v - shift) / gain * F.col("revin_std") + F.col("revin_mean"))


def patchify(x: str, length: int, size: int, stride: int) -> Column:
    """(length - size) / stride + 1 patches."""
    return F.transform(F.sequence(F.lit(0), F.lit(length - size), F.lit(stride)), lambda i: F.slice(x, i + 1, size))


def positions(length: int, width: int) -> list[list[float]]:
    """The sinusoidal table of positions, for models that take it as a constant."""
    from math import cos, sin

    return [[(sin if k % 2 == 0 else cos)(t / 10000 ** (k // 2 * 2 / width)) for k in range(width)] for t in range(length)]
