"""Regular calendars, first-row deduplication, contiguous blocks and physical cleaning."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import capacity_factor, clip_low, flag, in_range, valid_power


def interval(minutes: float) -> Column:
    return F.expr(f"make_dt_interval(0, 0, 0, {minutes * 60})")


def regularise(df: DataFrame, entity: str, ts: str, minutes: int = 15, keep: Sequence[str] = ()) -> DataFrame:
    """One row for each step of each entity's span; steps without a row have NULL measures, rows off the calendar go.

    ``keep`` are constants of an entity that are filled in again. The calendar is made next to the data: both sides are
    dealt by the entity and step, so a long entity does not sit in one task.
    """
    span = df.groupBy(entity).agg(F.min(ts).alias("_a"), F.max(ts).alias("_b"), *(F.first(c, ignorenulls=True).alias(f"_k_{c}") for c in keep))
    steps = span.withColumn(ts, F.explode(F.sequence("_a", "_b", interval(minutes)))).drop("_a", "_b")
    rest = [c for c in df.columns if c not in (entity, ts, *keep)]
    return steps.join(df.select(entity, ts, *rest), [entity, ts], "left").withColumnsRenamed({f"_k_{c}": c for c in keep})


def off_grid(df: DataFrame, entity: str, ts: str, minutes: int = 15) -> DataFrame:
    """How many rows ``regularise`` would drop, by entity."""
    span = df.groupBy(entity).agg(F.min(ts).alias("_a"))
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    off = F.pmod(micros(ts) - micros("_a"), F.lit(minutes * 60_000_000)) != 0
    return df.join(span, entity).groupBy(entity).agg(F.count_if(off).alias("off_grid"))


def first_rows(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """The first row of each key by ingest order; ``dropDuplicates`` would keep any."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")


def blocks(df: DataFrame, entity: str, ts: str, minutes: int = 15, min_length: int = 1) -> DataFrame:
    """Numbers each entity's contiguous runs (column ``block``, from 1) and keeps those of ``min_length`` rows."""
    w = Window.partitionBy(entity).orderBy(ts)
    new = F.coalesce(F.col(ts) - F.lag(ts).over(w) != interval(minutes), F.lit(True))
    out = df.withColumn("_new", new.cast("long"))
    out = out.withColumn("block", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")
    return out.withColumn("block_rows", F.count(F.lit(1)).over(Window.partitionBy(entity, "block"))).where(F.col("block_rows") >= min_length)


def clean(df: DataFrame, irradiance: Sequence[str] = (), ranges: Mapping[str, tuple[float, float]] | None = None, power: str = "power", capacity: str = "capacity", ceiling: float = 2000.0) -> DataFrame:
    """Physical limits, the capacity factor ``cf``, and a missing flag for each cleaned measure (after cleaning, before any fill)."""
    ranges = ranges or {}
    out = {c: F.when(clip_low(c) <= ceiling, clip_low(c)) for c in irradiance}
    out |= {c: in_range(c, *bounds) for c, bounds in ranges.items()}
    out |= {power: valid_power(power, capacity), "cf": capacity_factor(power, capacity)}
    df = df.withColumns(out)
    return df.withColumns({f"{c}_missing": flag(F.col(c).isNull()) for c in (*irradiance, *ranges, power)})
