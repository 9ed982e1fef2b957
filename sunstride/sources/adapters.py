"""The supplied tables seen as the series that the operators expect."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..operators.grid import blocks


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def slot_of(ts: str) -> F.Column:
    return F.window(ts, "15 minutes").getField("start").cast("timestamp_ntz")


def readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """site, ts (15 min), power, capacity from events."""
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("site"), "ts", "value")
    return e.groupBy("site", slot_of("ts").alias("ts")).agg(F.avg("value").alias("power")).withColumn("capacity", F.lit(500.0))


def meter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Power summed up within each forecast day."""
    r = readings(spark, sf_dir)
    day = F.date_trunc("DAY", F.col("ts") - F.expr("INTERVAL 1 HOUR"))
    w = Window.partitionBy("site", day).orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    return r.withColumn("total", F.sum("power").over(w))


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """site (one), ts, y (total price), orders by day."""
    o = table(spark, sf_dir, "orders")
    return o.groupBy(F.col("o_orderdate").alias("ts")).agg(F.sum("o_totalprice").alias("y"), F.count(F.lit(1)).alias("orders")).withColumn("site", F.lit("all"))


def daily_frames(spark: SparkSession, sf_dir: str, least: int) -> DataFrame:
    return blocks(daily(spark, sf_dir), "site", "ts", 1440, least)


def dispatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """site, ts, y_true, y_pred (a level forecast), capacity, price from lineitem."""
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        F.col("l_returnflag").alias("site"), F.col("l_shipdate").alias("ts"), F.col("l_quantity").alias("y_true"),
        (F.col("l_extendedprice") / 2000.0).alias("y_pred"), F.lit(50.0).alias("capacity"), F.col("l_discount").alias("discount"), F.col("l_tax").alias("tax"),
    )


def crowded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """grp (two), ts (15 min), row_id, value, place: the first two events of each group's slot, at the same time. Both groups number their rows from the same slot on."""
    e = table(spark, sf_dir, "events").select(F.when(F.col("event_type").isin("click", "error"), "a").otherwise("b").alias("grp"), "event_id", slot_of("ts").alias("ts"), "value")
    e = e.withColumn("place", F.row_number().over(Window.partitionBy("grp", "ts").orderBy("event_id"))).where("place <= 2")
    number = 2 * (F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 900_000_000) - 1_893_408) + F.col("place") - 1  # slots since 2024
    return e.select("grp", "ts", number.cast("long").alias("row_id"), "value", "place")


def slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """grp, ts, row_id, value: one row for each time of a group."""
    return crowded(spark, sf_dir).where("place = 1").drop("place")


def tensor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("x"))
