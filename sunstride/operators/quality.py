"""Data-quality reports in one pass over an entity's rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window, functions as F, types as T


def _seconds(c: str, w) -> F.Column:
    t = lambda x: F.unix_micros(x.cast("timestamp")) / 1e6
    return t(F.col(c)) - t(F.lag(c).over(w))


def store_report(df: DataFrame, group: str, ts: str, value: str, order: Sequence[str]) -> DataFrame:
    """By group, in stored order: rows, first and last time, negatives, duplicate times, steps back, gaps over a minute and over a day, largest gap.

    The gap counts overlap: a gap over a day is also over a minute.
    """
    w = Window.partitionBy(group).orderBy(*order)
    steps = df.withColumn("_dt", _seconds(ts, w))
    return steps.groupBy(group).agg(
        F.count(F.lit(1)).alias("n_rows"), F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"), F.count_if(F.col(value) < 0).alias("negatives"),
        (F.count(ts) - F.count_distinct(ts)).alias("duplicates"), F.count_if(F.col("_dt") < 0).alias("non_monotonic"),
        F.count_if(F.col("_dt") > 60).alias("gaps_over_minute"), F.count_if(F.col("_dt") > 86400).alias("gaps_over_day"), F.max("_dt").alias("largest_gap_s"),
    )


def overview(df: DataFrame, entity: str, ts: str, power: str, capacity: str, minutes: int = 15) -> DataFrame:
    """By entity: rows, span, share of the span's steps that are there, missing, negative, over capacity, duplicate times."""
    out = df.groupBy(entity).agg(
        F.count(F.lit(1)).alias("n_rows"), F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"), F.count_distinct(ts).alias("_d"), F.count_if(F.col(power).isNull()).alias("nulls"),
        F.count_if(F.col(power) < 0).alias("negatives"), F.count_if(F.col(power) > F.col(capacity)).alias("over_capacity"), (F.count(ts) - F.count_distinct(ts)).alias("duplicates"),
    )
    span = (F.unix_micros(F.col("last_ts").cast("timestamp")) - F.unix_micros(F.col("first_ts").cast("timestamp"))) / (minutes * 60e6) + 1
    return out.withColumn("completeness", F.col("_d") / span).drop("_d")


def cadence(df: DataFrame, group: str, ts: str, seconds: int = 60) -> DataFrame:
    """Share of steps of exactly ``seconds`` among those below an hour."""
    steps = df.withColumn("_dt", _seconds(ts, Window.partitionBy(group).orderBy(ts))).where("_dt > 0 AND _dt < 3600")
    return steps.groupBy(group).agg(F.count(F.lit(1)).alias("steps"), F.avg((F.col("_dt") == seconds).cast("double")).alias("exact_share"))


def consistency(df: DataFrame, entity: str, rules: Mapping[str, F.Column]) -> DataFrame:
    """How many rows break each rule, by entity."""
    return df.groupBy(entity).agg(*(F.count_if(rule).alias(name) for name, rule in rules.items()))


def schema_profile(df: DataFrame, target: str | None = None) -> DataFrame:
    """A row for each plain column: name, dtype, non_null, n_unique, least and greatest as text (numbers, dates and times), mean_value of numbers, role.

    One aggregate gives all but the different values, which are counted by column in one grouping. Means are sums of
    decimals with twelve digits after the point, so no order of addition shows; only columns too large for that are averaged as doubles.
    """
    plain = [(f.name, f.dataType) for f in df.schema.fields if not isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType, T.BinaryType, T.VariantType))]
    aggs, none = [], F.lit(None).cast("double")
    for name, kind in plain:
        c, number, ordered = F.col(f"`{name}`"), isinstance(kind, T.NumericType), isinstance(kind, (T.NumericType, T.DateType, T.TimestampType, T.TimestampNTZType))
        exact = F.expr(f"try_cast(`{name}` AS decimal(38, 12))")
        mean = F.coalesce(F.when(F.count(exact) == F.count(c), F.try_sum(exact).cast("double") / F.count(c)), F.avg(c.cast("double"))) if number else none
        end = lambda f: f(c).cast("string") if ordered else F.lit(None).cast("string")  # noqa: E731, B023
        aggs += [F.struct(
            F.lit(name).alias("name"), F.lit(kind.simpleString()).alias("dtype"), F.count(c).alias("non_null"), end(F.min).alias("least"), end(F.max).alias("greatest"),
            mean.alias("mean_value"), F.lit("target" if name == target else "feature").alias("role"),
        ).alias(f"_{len(aggs)}")]
    one = df.agg(*aggs)
    rows = one.select(F.explode(F.array(*one.columns)).alias("v")).select("v.*")
    values = df.select(F.explode(F.array(*(F.struct(F.lit(n).alias("name"), F.col(f"`{n}`").cast("string").alias("v")) for n, _ in plain))).alias("x")).select("x.*")
    unique = values.where("v IS NOT NULL").distinct().groupBy("name").agg(F.count(F.lit(1)).alias("n_unique"))
    out = rows.join(F.broadcast(unique), "name", "left")  # a row a column
    return out.select("name", "dtype", "non_null", F.coalesce("n_unique", F.lit(0)).cast("long").alias("n_unique"), "least", "greatest", "mean_value", "role")


def junk_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """How many values of each text column are there but no numbers."""
    one = df.agg(*(F.count_if(F.expr(f"try_cast(`{c}` AS DOUBLE) IS NULL AND `{c}` IS NOT NULL")).alias(c) for c in columns))
    return one.unpivot([], list(columns), "name", "junk")


def join_parity(a: DataFrame, b: DataFrame, keys: Sequence[str], column: str, tolerance: float = 1e-6) -> DataFrame:
    """One row: keys of either side that the other lacks, rows with a missing value, largest difference, and whether all agree."""
    left, right = a.select(*keys, F.col(column).alias("_a"), F.lit(1).alias("_la")), b.select(*keys, F.col(column).alias("_b"), F.lit(1).alias("_lb"))
    both = left.join(right, list(keys), "full")
    one = both.agg(
        F.count_if(F.col("_la").isNull()).alias("only_right"), F.count_if(F.col("_lb").isNull()).alias("only_left"),
        F.count_if(F.col("_a").isNull() | F.col("_b").isNull()).alias("missing"), F.max(F.abs(F.col("_a") - F.col("_b"))).alias("largest_difference"),
    )
    return one.withColumn("agrees", (F.col("only_left") + F.col("only_right") + F.col("missing") == 0) & (F.coalesce("largest_difference", F.lit(0.0)) < tolerance))
