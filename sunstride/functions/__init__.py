"""Column expressions: all of them stay inside generated code."""

from .scalar import (
    capacity_factor, clip, clip_low, clear_sky_index, cyclic, errors, exact_mean, flag, in_range, is_junk, lenient_double, lenient_timestamp, local_time, minute_of_day,
    null_if_nan, one_hot, r6, r8, rounded, split_by_cuts, valid_power, zoned_minute, zscore,
)

__all__ = [
    "capacity_factor", "clip", "clip_low", "clear_sky_index", "cyclic", "errors", "exact_mean", "flag", "in_range", "is_junk", "lenient_double", "lenient_timestamp", "local_time",
    "minute_of_day", "null_if_nan", "one_hot", "r6", "r8", "rounded", "split_by_cuts", "valid_power", "zoned_minute", "zscore",
]
