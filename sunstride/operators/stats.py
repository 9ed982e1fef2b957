"""Distribution summaries."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window, functions as F


def histogram(df: DataFrame, x: str, low: float, high: float, bins: int, by: Sequence[str] = ()) -> DataFrame:
    """Counts of equal bins 1..bins over [low, high]; the last one includes its upper edge."""
    at = F.least(F.expr(f"width_bucket({x}, {low}D, {high}D, {bins})"), F.lit(bins)).cast("int")
    return df.where(F.col(x).between(low, high)).groupBy(*by, at.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


#: Stretches of a group's values that are counted to find where a rank lies.
_STRETCHES = 1024


def quantiles(df: DataFrame, x: str, by: Sequence[str], wanted: Sequence[float]) -> DataFrame:
    """``by`` and ``q``, an array of the exact quantiles of the group's values, interpolated between neighbours; NULL and NaN are no values.

    No task holds a group: counts of equal stretches say where the wanted ranks lie, and only those stretches are sorted.
    """
    keys = [f"_k{i}" for i in range(len(by))]
    rows = df.select(*(F.col(c).alias(k) for c, k in zip(by, keys)), F.col(x).cast("double").alias("_x")).where("_x IS NOT NULL AND NOT isnan(_x)")
    same = lambda other: [F.col(k).eqNullSafe(F.col(f"{other}{k}")) for k in keys] or [F.lit(True)]
    named = lambda d, other: d.withColumnsRenamed({k: f"{other}{k}" for k in keys})
    span = rows.groupBy(*keys).agg(F.min("_x").alias("_low"), F.max("_x").alias("_high"), F.count(F.lit(1)).alias("_n"))
    # groups are few beside their rows, but of no known number: the join is left to the planner
    at = F.when(F.col("_high") > F.col("_low"), F.least(F.floor((F.col("_x") / 2 - F.col("_low") / 2) / (F.col("_high") / 2 - F.col("_low") / 2) * _STRETCHES), F.lit(_STRETCHES - 1))).otherwise(F.lit(0)).cast("int")
    placed = rows.join(named(span, "s"), same("s")).withColumn("_at", at)
    counts = placed.groupBy(*keys, "_at").agg(F.count(F.lit(1)).alias("_c"), F.first("_n").alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)  # _STRETCHES rows a group
    counts = counts.withColumn("_before", F.coalesce(F.sum("_c").over(before), F.lit(0)))
    ranks = F.array_distinct(F.array(*(f(F.lit(float(q)) * (F.col("_n") - 1)).cast("long") for q in wanted for f in (F.floor, F.ceil))))
    counts = counts.withColumn("_ranks", F.filter(ranks, lambda r: (r >= F.col("_before")) & (r < F.col("_before") + F.col("_c")))).where("size(_ranks) > 0")
    near = placed.join(named(counts.select(*keys, F.col("_at").alias("_where"), "_before", "_ranks"), "c"), [*same("c"), F.col("_at") == F.col("_where")])
    values = near.groupBy(*keys, "_at", "_x").agg(F.count(F.lit(1)).alias("_c"), F.first("_before").alias("_before"), F.first("_ranks").alias("_ranks"), F.first("_n").alias("_n"))
    end = F.col("_before") + F.sum("_c").over(Window.partitionBy(*keys, "_at").orderBy("_x").rowsBetween(Window.unboundedPreceding, 0))
    found = values.withColumn("_end", end).withColumn("_r", F.explode(F.filter("_ranks", lambda r: (r < F.col("_end")) & (r >= F.col("_end") - F.col("_c")))))
    one = found.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("_r", "_x"))).alias("_v"), F.first("_n").alias("_n"))

    def value(q: float) -> Column:
        place = F.lit(float(q)) * (F.col("_n") - 1)
        low, high = F.col("_v")[F.floor(place).cast("long")], F.col("_v")[F.ceil(place).cast("long")]
        return low + (high - low) * (place - F.floor(place))

    return one.select(*(F.col(k).alias(c) for c, k in zip(by, keys)), F.array(*map(value, wanted)).alias("q"))


def with_quantiles(df: DataFrame, aggregate: DataFrame, x: str, by: Sequence[str], wanted: Mapping[str, float]) -> DataFrame:
    """``aggregate`` (a row for each ``by``) with a column for each wanted quantile."""
    q = quantiles(df, x, by, list(wanted.values())).withColumnsRenamed({c: f"_q_{c}" for c in by})
    on = [F.col(c).eqNullSafe(F.col(f"_q_{c}")) for c in by] or [F.lit(True)]
    return aggregate.join(q, on, "left").withColumns({n: F.get("q", F.lit(i)) for i, n in enumerate(wanted)}).drop("q", *(f"_q_{c}" for c in by))


def quantile_band(df: DataFrame, x: str, by: Sequence[str], wanted: Sequence[float] = (0.1, 0.9)) -> DataFrame:
    return with_quantiles(df, df.groupBy(*by).agg(F.avg(x).alias("mean")), x, by, {f"q{round(v * 100):02d}": v for v in wanted})


def five_numbers(df: DataFrame, x: str, by: Sequence[str]) -> DataFrame:
    out = with_quantiles(df, df.groupBy(*by).agg(F.min(x).alias("low"), F.max(x).alias("high")), x, by, {"q1": 0.25, "mid": 0.5, "q3": 0.75})
    return out.select(*by, "low", "q1", "mid", "q3", "high")


def sample_stats(df: DataFrame, x: str, by: Sequence[str] = ()) -> DataFrame:
    one = df.groupBy(*by).agg(F.count(x).alias("n"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"), F.max(F.abs(x)).alias("max_abs"))
    return with_quantiles(df, one, x, by, {"p01": 0.01, "p99": 0.99}).select(*by, "n", "mean", "std", "p01", "p99", "max_abs")


def correlations(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """(a, b, corr) for each pair, over the rows that have both; one scan."""
    pairs = list(combinations(columns, 2))
    one = df.groupBy(*by).agg(*(F.corr(a, b).alias(f"_{i}") for i, (a, b) in enumerate(pairs)))
    rows = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"_{i}").alias("corr")) for i, (a, b) in enumerate(pairs)))
    return one.select(*by, F.explode(rows).alias("v")).select(*by, "v.*")


def pivot_mean(df: DataFrame, row: str | Column, column: str, values: Sequence, x: str) -> DataFrame:
    return df.groupBy(row).pivot(column, list(values)).agg(F.avg(x))


def even_picks(df: DataFrame, by: Sequence[str], order: str, k: int) -> DataFrame:
    """k evenly spaced rows of each key, first and last among them."""
    own = Window.partitionBy(*by)
    ranked = df.withColumns({"_k": F.row_number().over(own.orderBy(order)) - 1, "_n": F.count(F.lit(1)).over(own)})
    places = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.floor(i * (F.col("_n") - 1) / (k - 1)))
    return ranked.where(F.array_contains(places, F.col("_k").cast("long"))).drop("_k", "_n")


def hash_sample(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """n rows by the lowest seeded MD5 of the key: the same rows whatever the partitioning."""
    return df.orderBy(F.md5(F.concat(F.lit(f"{seed}/"), F.col(key).cast("string")).cast("binary")), key).limit(n)


def extremes(df: DataFrame, key: str, x: str) -> DataFrame:
    """Keys of the least and greatest value; of equals the first key."""
    return df.agg(F.min(F.struct(F.col(x), F.col(key))).getField(key).alias("least"), F.min(F.struct(-F.col(x), F.col(key))).getField(key).alias("greatest"))
