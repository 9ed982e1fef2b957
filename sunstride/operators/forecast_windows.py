"""The index of forecast windows: which rows make a history and a target, and why others do not.

Row numbers belong to their group, so every key has the group. Exact-offset lookups are equi-joins on (group, timestamp).
Stride thinning is sequential, but a gap of a stride or more always accepts the next row, so each run without such a gap
is thinned on its own. Runs are found day by day: what a day needs from earlier ones is a row for each day.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window, functions as F

from .grid import interval

#: Why a candidate is no window, in the order of the tests.
REASONS = ("rejected_stride", "rejected_missing_history", "rejected_missing_target", "rejected_split_boundary", "valid")


def thinned(df: DataFrame, by: list[str], ts: str, stride: Column, row: str) -> DataFrame:
    """``accepted``: the row is at least a stride (minutes) after the last accepted one of its key. Of equal timestamps only the least ``row`` (unique in its key) can be."""
    out = df.withColumns({"_us": F.unix_micros(F.col(ts).cast("timestamp")), "_stride": (stride.cast("double") * 60_000_000).cast("long")}).withColumn("_day", F.floor(F.col("_us") / 86_400_000_000))
    own = Window.partitionBy(*by, "_day").orderBy("_us", row)
    out = out.withColumn("_gap", F.col("_us") - F.lag("_us").over(own)).withColumn("_start", F.when(F.col("_gap") >= F.col("_stride"), F.col("_us")))
    days = out.groupBy(*by, "_day").agg(F.min("_us").alias("_a"), F.max("_us").alias("_b"), F.max("_start").alias("_c"), F.max("_stride").alias("_s"))
    w = Window.partitionBy(*by).orderBy("_day")  # a row a day
    opened = F.when(F.coalesce(F.col("_a") - F.lag("_b").over(w) >= F.col("_s"), F.lit(True)), F.col("_a"))
    days = days.withColumn("_opened", opened).withColumn("_last", F.coalesce("_c", "_opened"))
    days = days.select(*by, "_day", F.coalesce("_opened", F.last("_last", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))).alias("_begin"))
    run = F.coalesce(F.last("_start", ignorenulls=True).over(own.rowsBetween(Window.unboundedPreceding, 0)), F.col("_begin"))
    runs = out.join(days, [*by, "_day"]).withColumn("_run", run).groupBy(*by, "_run").agg(F.array_sort(F.collect_list(F.struct("_us", row))).alias("_all"), F.first("_stride").alias("_s"))
    start = F.struct(F.lit(None).cast("long").alias("last"), F.array().cast(f"array<{df.schema[row].dataType.simpleString()}>").alias("kept"))
    fold = F.aggregate("_all", start, lambda a, x: F.when(F.coalesce(x["_us"] - a["last"] < F.col("_s"), F.lit(False)), a).otherwise(F.struct(x["_us"].alias("last"), F.array_append(a["kept"], x[row]).alias("kept"))))
    kept = runs.select(*by, F.explode(fold["kept"]).alias(row), F.lit(True).alias("accepted"))
    return df.join(kept, [*by, row], "left").withColumn("accepted", F.coalesce("accepted", F.lit(False)))


def window_index(rows: DataFrame, splits: DataFrame, history: int, step: int, horizon: int, strides: Mapping[str, int], group: str = "grp", ts: str = "ts", row: str = "row_id", value: str = "value") -> DataFrame:
    """A row for each candidate: reason, and for each its history rows and values, target row, time and value.

    ``rows`` has group, ts, row and value; ``splits`` has date and split, and rows of other days are no candidates but can
    be looked up. Times are in minutes; row numbers are unique in their group; of equal timestamps in a group the last row counts for lookups.
    """
    if history % step:
        raise ValueError("the history must be a whole number of steps, or its newest row would not be the issue row")
    count = history // step + 1
    own = rows.withColumn("date", F.to_date(ts))
    known = own.groupBy(group, ts).agg(F.max(F.struct(row, value, "date")).alias("k")).select(F.col(group).alias("_g"), F.col(ts).alias("_t"), f"k.{row}", f"k.{value}", F.col("k.date").alias("_d"))
    known = known.join(F.broadcast(splits.select(F.col("date").alias("_d"), F.col("split").alias("_split"))), "_d", "left").drop("_d")  # a row a day
    candidates = own.join(F.broadcast(splits), "date")
    stride = F.create_map(*(F.lit(x) for kv in strides.items() for x in kv))[F.col("split")]
    marked = thinned(candidates, [group, "split"], ts, stride, row)
    kept = marked.where("accepted")
    offsets = F.explode(F.array(*(F.lit(m) for m in (*range(-history, 1, step), horizon)))).alias("_m")
    wanted = kept.select(F.col(row).alias("_row"), F.col(group).alias("_g"), F.col("split").alias("_own"), offsets, F.col(ts).alias("_issue"))
    wanted = wanted.withColumn("_t", F.col("_issue") + F.expr("make_dt_interval(0, 0, cast(_m AS int), 0)"))
    met = wanted.join(known, ["_g", "_t"])
    past = F.col("_m") <= 0
    found = met.groupBy("_g", "_row").agg(
        F.count_if(past).alias("_past"), F.count_if(~past).alias("_ahead"), F.count_if(~F.col("_split").eqNullSafe(F.col("_own"))).alias("_other"),
        F.array_sort(F.collect_list(F.when(past, F.struct("_m", row, value)))).alias("_h"),
        F.max(F.when(~past, F.struct(row, "_t", value))).alias("_y"),
    )
    out = marked.join(found, (F.col(group) == F.col("_g")) & (F.col(row) == F.col("_row")), "left")
    none = F.coalesce("_past", F.lit(0)) < count
    reason = (
        F.when(~F.col("accepted"), REASONS[0]).when(none, REASONS[1]).when(F.coalesce("_ahead", F.lit(0)) == 0, REASONS[2]).when(F.col("_other") > 0, REASONS[3]).otherwise(REASONS[4])
    )
    return out.select(
        group, F.col(row).alias("issue_row"), F.col(ts).alias("issue_time"), "split", reason.alias("reason"),
        F.col(f"_h.{row}").alias("history_rows"), F.col(f"_h.{value}").alias("history"), F.col(f"_y.{row}").alias("target_row"), F.col("_y._t").alias("target_time"), F.col(f"_y.{value}").alias("target"),
    )


#: Row numbers that one task ranks.
_ROWS = 1 << 16


def valid_windows(index: DataFrame, group: str = "grp") -> DataFrame:
    """The windows with sample_index, their position in their split by group and issue row.

    Stretches of row numbers are ranked on their own; what lies before a stretch is a sum over stretches.
    """
    out = index.where("reason = 'valid'").withColumn("_at", F.floor(F.col("issue_row") / _ROWS))
    before = Window.partitionBy("split").orderBy(group, "_at").rowsBetween(Window.unboundedPreceding, -1)
    sizes = out.groupBy("split", group, "_at").agg(F.count(F.lit(1)).alias("_n")).withColumn("_off", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    place = F.row_number().over(Window.partitionBy("split", group, "_at").orderBy("issue_row")) - 1
    return out.join(sizes, ["split", group, "_at"]).withColumn("sample_index", (F.col("_off") + place).cast("long")).select(*index.columns, "sample_index")


def report(index: DataFrame) -> DataFrame:
    """Candidates by split (NULL: all of them) and reason; the reasons partition the candidates."""
    return index.groupingSets([["split", "reason"], ["reason"]], "split", "reason").agg(F.count(F.lit(1)).alias("n"))
