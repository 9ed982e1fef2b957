"""Scalar expressions. NULL means missing throughout; scans turn NaN into NULL."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def r6(x: Column | str) -> Column:
    return F.round(_c(x), 6)


def r8(x: Column | str) -> Column:
    return F.round(_c(x), 8)


def rounded(x: Column | str, places: int) -> Column:
    """Half away from zero in doubles, as SQL engines do it, and a zero keeps the sign of what it was. Spark's own round goes through decimals, which have no negative zero."""
    d, unit = _c(x).cast("double"), 10.0**places
    return F.when(F.abs(d) < 1e300, F.signum(d) * F.round(F.abs(d) * unit) / unit).otherwise(d)  # NaN is above all numbers


def exact_mean(x: Column | str) -> Column:
    """Aggregate: the mean as a sum of decimals with twelve digits after the point, so the order of addition doesn't show."""
    return F.sum(_c(x).cast("decimal(38,12)")).cast("double") / F.count(_c(x))


def null_if_nan(x: Column | str) -> Column:
    return F.when(~F.isnan(_c(x)), _c(x))


def lenient_double(x: str) -> Column:
    """A number, or NULL for junk."""
    return F.expr(f"try_cast({x} AS DOUBLE)")


def is_junk(x: str) -> Column:
    """The raw value is there but is no number."""
    return F.expr(f"try_cast({x} AS DOUBLE) IS NULL AND {x} IS NOT NULL")


def lenient_timestamp(x: Column | str, pattern: str = "yyyyMMdd H:mm") -> Column:
    return F.try_to_timestamp(_c(x), F.lit(pattern)).cast("timestamp_ntz")


def clip_low(x: Column | str, low: float = 0.0) -> Column:
    """NULL stays NULL, which a bare ``greatest`` would not keep."""
    return F.when(_c(x).isNotNull(), F.greatest(_c(x), F.lit(low)))


def clip(x: Column | str, low: float | Column, high: float | Column) -> Column:
    low, high = (v if isinstance(v, Column) else F.lit(v) for v in (low, high))
    return F.when(_c(x).isNotNull(), F.least(F.greatest(_c(x), low), high))


def in_range(x: Column | str, low: float, high: float) -> Column:
    """The value within inclusive bounds, else NULL."""
    return F.when(_c(x).between(low, high), _c(x))


def valid_power(power: Column | str, capacity: Column | str) -> Column:
    """Small negative draw counts as zero; more than the capacity is invalid."""
    low = clip_low(power)
    return F.when(low <= _c(capacity), low)


def capacity_factor(power: Column | str, capacity: Column | str) -> Column:
    return valid_power(power, capacity) / _c(capacity)


def flag(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False)).cast("tinyint")


def one_hot(x: Column | str, levels: Sequence, prefix: str) -> dict[str, Column]:
    """``prefix_level`` columns, in the order of their names as text."""
    return {name: flag(_c(x) == level) for name, level in sorted((f"{prefix}_{v}", v) for v in levels)}


def cyclic(x: Column | str, period: float, name: str) -> dict[str, Column]:
    turn = 2 * F.pi() * _c(x) / F.lit(float(period))
    return {f"{name}_sin": F.sin(turn), f"{name}_cos": F.cos(turn)}


def minute_of_day(ts: Column | str) -> Column:
    return F.hour(_c(ts)) * 60 + F.minute(_c(ts))


def zoned_minute(ts: Column | str, zone: str) -> Column:
    """Minute of the local day of a UTC instant."""
    return minute_of_day(F.from_utc_timestamp(_c(ts).cast("timestamp"), zone))


def local_time(ts: Column | str, hours: int) -> Column:
    """A fixed offset from UTC, no daylight saving."""
    return _c(ts) + F.make_dt_interval(F.lit(0), F.lit(hours))


def split_by_cuts(ts: Column | str, train_end: str, val_end: str) -> Column:
    cut = lambda x: F.lit(x).cast("timestamp_ntz")
    return F.when(_c(ts) < cut(train_end), "train").when(_c(ts) < cut(val_end), "val").otherwise("test")


def zscore(x: Column | str, mean: Column | str, std: Column | str, guard: str = "floor", eps: float = 1e-8) -> Column:
    """``guard``: ``floor`` takes 1 for a tiny deviation, ``add`` adds eps to it, ``sqrt`` expects a variance and adds eps under the root."""
    s = _c(std)
    s = {"floor": F.when(s < eps, F.lit(1.0)).otherwise(s), "add": s + eps, "sqrt": F.sqrt(s + eps)}[guard]
    return (_c(x) - _c(mean)) / s


def clear_sky_index(power: Column | str, clear: Column | str, floor: float = 0.5) -> Column:
    return _c(power) / F.greatest(_c(clear), F.lit(floor))


def errors(y_true: Column | str = "y_true", y_pred: Column | str = "y_pred") -> dict[str, Column]:
    e = _c(y_pred) - _c(y_true)
    return {"absolute_error": F.abs(e), "squared_error": e * e}
