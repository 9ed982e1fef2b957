"""Samples for training: order, and the shapes that each kind of model takes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def epoch(samples: DataFrame, seed: int, split: str = "split", train: str = "train", key: str = "sample_index") -> DataFrame:
    """Training samples in a seeded order that no partitioning changes; other splits in their own order. All samples are kept."""
    own = F.when(F.col(split) == train, F.xxhash64(F.lit(seed), key)).otherwise(F.col(key).cast("long"))
    return samples.orderBy(split, own, key)


def sample(windows: DataFrame, group: str = "grp") -> DataFrame:
    """The canonical record of a window: history and target, issue and target time in UTC nanoseconds, split, position."""
    nanos = lambda c: F.unix_micros(F.col(c).cast("timestamp")) * 1000
    return windows.select(group, F.col("history").alias("pv_history"), F.array("target").alias("target"), nanos("issue_time").alias("issue_time"), nanos("target_time").alias("target_time"), "split", "sample_index")


def stack_channels(images: str) -> Column:
    """[time, channel, ...] to [time * channel, ...]."""
    return F.flatten(images)


def sequence_input(history: str) -> Column:
    """[time] to [time, 1]."""
    return F.transform(history, lambda v: F.array(v))
