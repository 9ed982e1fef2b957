"""Rule forecasts: persistence, clear-sky persistence, climatology."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import clear_sky_index, clip
from .stats import quantiles


def minutes_table(spark: SparkSession, minutes: int = 1440) -> DataFrame:
    return spark.range(minutes).select(F.col("id").cast("int").alias("minute"))


def smooth_circle(curve: DataFrame, smooth: int, minutes: int = 1440) -> DataFrame:
    """Moving average around the day over k = ``smooth`` entries to each side, always by 2k + 1; up to 1 changes nothing."""
    k = smooth
    if k <= 1:
        return curve
    shifted = curve.select("minute", "clear", F.explode(F.sequence(F.lit(-k), F.lit(k))).alias("_o"))
    shifted = shifted.select(F.pmod(F.col("minute") + F.col("_o"), F.lit(minutes)).cast("int").alias("minute"), "clear")
    return shifted.groupBy("minute").agg((F.sum("clear") / (2 * k + 1)).alias("clear"))


def clear_sky_curve(df: DataFrame, minute: Column, power: str, quantile: float = 0.95, smooth: int = 15, minutes: int = 1440, grain: int = 1) -> DataFrame:
    """(minute, clear): exact quantile of power by local minute, 0 for minutes without data, smoothed around the day.

    ``grain`` is the number of minutes that one entry of the curve stands for.
    """
    found = quantiles(df.select(F.floor(minute / grain).cast("int").alias("minute"), power), power, ["minute"], [quantile]).select("minute", F.col("q")[0].alias("clear"))
    full = minutes_table(df.sparkSession, minutes // grain).join(F.broadcast(found), "minute", "left")  # both are at most a day long
    return smooth_circle(full.select("minute", F.coalesce("clear", F.lit(0.0)).alias("clear")), smooth, minutes // grain)


def save_curve(curve: DataFrame, path: str, **about: float) -> None:
    """The curve as one JSON object with what describes it; an entry for each minute at most, so the driver writes it."""
    rows = curve.select("minute", "clear").orderBy("minute").collect()
    with open(path, "w") as f:
        json.dump(about | {"curve": {str(r["minute"]): r["clear"] for r in rows}}, f)


def load_curve(spark: SparkSession, path: str) -> tuple[DataFrame, dict]:
    """The curve (minute, clear) and what describes it."""
    with open(path) as f:
        about = json.load(f)
    return spark.createDataFrame([(int(m), float(c)) for m, c in about.pop("curve").items()], "minute int, clear double"), about


def with_curve(df: DataFrame, curve: DataFrame, minute: Column, name: str, minutes: int = 1440) -> DataFrame:
    """The curve's value at a minute, taken around the day."""
    at = curve.select(F.col("minute").alias("_m"), F.col("clear").alias(name))
    return df.join(F.broadcast(at), F.pmod(minute, F.lit(minutes)).cast("int") == F.col("_m"), "left").drop("_m")  # a row a minute


def clear_sky_forecast(power: Column | str, now: Column | str, later: Column | str, capacity: float, floor: float = 0.5) -> Column:
    """The clear-sky index now times the clear sky at the target, within [0, capacity]."""
    later = F.col(later) if isinstance(later, str) else later
    return clip(clear_sky_index(power, now, floor) * later, 0.0, capacity)


def climatology(train: DataFrame, keys: Sequence[str], target: str) -> DataFrame:
    return train.groupBy(*keys).agg(F.avg(target).alias("climatology"))


def in_sample_climatology(df: DataFrame, keys: Sequence[str], target: str) -> DataFrame:
    """``y_true`` and ``y_pred``, the mean of the row's own keys; rows with a NULL key have none and go."""
    return df.join(climatology(df, keys, target).withColumnRenamed("climatology", "y_pred"), list(keys), "inner").withColumnRenamed(target, "y_true")


def with_climatology(df: DataFrame, table: DataFrame, keys: Sequence[str], fallback: float | Column, cap: float | None = None) -> DataFrame:
    """``y_pred`` from the table, else the training mean; optionally within [0, cap]."""
    out = df.join(table, list(keys), "left")
    value = F.coalesce("climatology", fallback if isinstance(fallback, Column) else F.lit(fallback))
    return out.withColumn("y_pred", clip(value, 0.0, cap) if cap is not None else value).drop("climatology")
