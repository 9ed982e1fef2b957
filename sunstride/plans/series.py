"""Grid, cleaning, imputation, features, calendar."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..functions import capacity_factor, clip_low, cyclic, flag, is_junk, lenient_double, lenient_timestamp, local_time, minute_of_day, one_hot, r6, r8, split_by_cuts, valid_power, zoned_minute
from ..operators import grid, impute, scale, sequence
from ..sources import adapters
from .registry import CLEAN, FILLED, GRID, LED, READINGS, SLOTS, query

TRAIN_END, VAL_END = "2024-01-16", "2024-01-23"


def cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The regular grid with power less a base load of 50, at most 400; cf and the missing flag."""
    g = grid.regularise(adapters.readings(spark, sf_dir), "site", "ts", 15, ["capacity"])
    base = g.withColumns({"power": F.col("power") - 50, "_cap": F.lit(400.0)})
    return base.withColumns({"power": valid_power("power", "_cap"), "cf": capacity_factor("power", "_cap")}).withColumn("power_missing", flag(F.col("power").isNull())).drop("_cap")


def prepared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """cf_input: filled forward four steps at most, then by training medians; and the split."""
    c = cleaned(spark, sf_dir).withColumns({"cf_input": impute.bounded_ffill("cf", ["site"], "ts", 4), "split": split_by_cuts("ts", TRAIN_END, VAL_END)})
    train = F.col("split") == "train"
    med = impute.medians(c.where(train), "site", ["cf"])
    own, over = med.where("site IS NOT NULL").select(F.col("site").alias("_s"), F.col("cf").alias("_m")), med.where("site IS NULL").select(F.col("cf").alias("_g"))
    out = c.join(own, F.col("site") == F.col("_s"), "left").join(F.broadcast(over))  # one row
    return out.withColumn("cf_input", F.coalesce("cf_input", "_m", "_g")).drop("_s", "_m", "_g")


@query(f"WITH {GRID} SELECT site, ts, capacity, round(power, 6) AS power FROM grid")
def q_grid_regularise(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = adapters.readings(spark, sf_dir)
    parts = [r.where(F.col("site") == s) for s in ("click", "error")] + [r.where(~F.col("site").isin("click", "error"))]
    joined = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)  # a union of stations, as files would be
    return grid.regularise(joined, "site", "ts", 15, ["capacity"]).select("site", "ts", "capacity", r6("power").alias("power"))


@query(f"WITH {CLEAN} SELECT site, ts, round(power, 6) AS power, round(cf, 8) AS cf, power_missing::INT AS power_missing FROM clean")
def q_clean_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaned(spark, sf_dir).select("site", "ts", r6("power").alias("power"), r8("cf").alias("cf"), F.col("power_missing").cast("int").alias("power_missing"))


@query("""WITH t AS (SELECT event_type AS site, ts, value FROM events), c AS (SELECT site, ts, CASE WHEN greatest(value, 0) <= 2000 THEN greatest(value, 0) END AS irr,
    CASE WHEN value BETWEEN 10 AND 300 THEN value END AS temp, CASE WHEN greatest(value, 0) <= 450 THEN greatest(value, 0) END AS power FROM t)
    SELECT site, count(*) AS n, sum((irr IS NULL)::INT)::BIGINT AS irr_missing, sum((temp IS NULL)::INT)::BIGINT AS temp_missing, sum((power IS NULL)::INT)::BIGINT AS power_missing, round(avg(power / 450), 6) AS cf
    FROM c GROUP BY site""")
def q_physical_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = adapters.table(spark, sf_dir, "events").select(F.col("event_type").alias("site"), F.col("value").alias("irr"), F.col("value").alias("temp"), F.col("value").alias("power"), F.lit(450.0).alias("capacity"))
    c = grid.clean(e, ["irr"], {"temp": (10, 300)})
    return c.groupBy("site").agg(F.count(F.lit(1)).alias("n"), *(F.sum(F.col(f"{m}_missing").cast("long")).alias(f"{m}_missing") for m in ("irr", "temp", "power")), r6(F.avg("cf")).alias("cf"))


@query(f"WITH {SLOTS} SELECT grp, ts, row_id, value FROM slots")
def q_dedup_keep_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.first_rows(adapters.crowded(spark, sf_dir), ["grp", "ts"], ["row_id"]).select("grp", "ts", "row_id", "value")


@query("""SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k, TRY_CAST(event_type AS DOUBLE) AS junk, (TRY_CAST(event_type AS DOUBLE) IS NULL AND event_type IS NOT NULL)::INT AS is_junk,
    try_strptime(strftime(ts, '%Y%m%d %H:%M'), '%Y%m%d %H:%M') AS ts, try_strptime(event_type, '%Y%m%d %H:%M') AS bad_ts FROM events""")
def q_lenient_cast(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = adapters.table(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k")).withColumn("text", F.date_format("ts", "yyyyMMdd H:mm"))
    return e.select("event_id", lenient_double("k").alias("k"), lenient_double("event_type").alias("junk"), is_junk("event_type").cast("int").alias("is_junk"), lenient_timestamp("text").alias("ts"), lenient_timestamp("event_type").alias("bad_ts"))


@query(f"""WITH {CLEAN}, t AS (SELECT * FROM clean WHERE ts < TIMESTAMP '{TRAIN_END}'), s AS (SELECT site, median(power) AS m FROM t GROUP BY site), g AS (SELECT median(power) AS m FROM t)
    SELECT c.site, c.ts, round(coalesce(c.power, s.m, g.m), 6) AS power FROM clean c LEFT JOIN s USING (site) CROSS JOIN g""")
def q_train_median_impute(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = impute.fill_from_train(cleaned(spark, sf_dir), F.col("ts") < F.lit(TRAIN_END).cast("timestamp_ntz"), "site", ["power"])
    return out.select("site", "ts", r6("power").alias("power"))


@query(f"WITH {FILLED} SELECT site, ts, round(cf_fill, 8) AS cf_fill FROM filled")
def q_bounded_ffill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaned(spark, sf_dir).select("site", "ts", r8(impute.bounded_ffill("cf", ["site"], "ts", 4)).alias("cf_fill"))


@query(f"WITH {FILLED} SELECT site, ts, round(cf_input, 8) AS cf_input, split FROM prepared")
def q_prepare_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prepared(spark, sf_dir).select("site", "ts", r8("cf_input").alias("cf_input"), "split")


@query(f"WITH {FILLED} SELECT site, ts, " + ", ".join(f"round(lag(cf_input, {k}) OVER w, 8) AS cf_input_lag{k}" for k in (1, 4, 8, 96)) + " FROM prepared WINDOW w AS (PARTITION BY site ORDER BY ts)")
def q_lag_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = sequence.lags(["cf_input"], (1, 4, 8, 96), sequence.over(["site"], "ts"))
    return prepared(spark, sf_dir).select("site", "ts", *(r8(c).alias(n) for n, c in made.items()))


@query(f"WITH {FILLED} SELECT site, ts, " + ", ".join(f"round(avg(cf_input) OVER (PARTITION BY site ORDER BY ts ROWS {n - 1} PRECEDING), 13) AS mean{n}, round(coalesce(stddev_samp(cf_input) OVER (PARTITION BY site ORDER BY ts ROWS {n - 1} PRECEDING), 0), 10) AS std{n}" for n in (4, 16, 96)) + " FROM prepared")
def q_rolling_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = sequence.over(["site"], "ts")
    made = {f"{k}{n}": f("cf_input", n, w) for n in (4, 16, 96) for k, f in (("mean", sequence.rolling_mean), ("std", sequence.rolling_std))}
    return prepared(spark, sf_dir).select("site", "ts", *(F.round(c, 13 if n.startswith("mean") else 10).alias(n) for n, c in made.items()))


@query(f"WITH {LED} SELECT site, ts, target_ts, round(target_y, 8) AS target_y, target_split AS split FROM led")
def q_lead_target_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = sequence.over(["site"], "ts")
    made = sequence.lead_target("cf", "ts", w) | {"split": F.lead("split").over(w)}
    return prepared(spark, sf_dir).withColumns(made).select("site", "ts", "target_ts", r8("target_y").alias("target_y"), "split")


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequence.tabular(prepared(spark, sf_dir), "site", "ts", "cf", "cf_input")


SITES = ("click", "error", "purchase", "signup", "view")


@query(f"""WITH {LED}, f AS (SELECT *, {", ".join(f"lag(cf_input, {k}) OVER w AS l{k}" for k in (1, 4, 8, 96))},
    {", ".join(f"avg(cf_input) OVER (PARTITION BY site ORDER BY ts ROWS {n - 1} PRECEDING) AS m{n}, coalesce(stddev_samp(cf_input) OVER (PARTITION BY site ORDER BY ts ROWS {n - 1} PRECEDING), 0) AS s{n}" for n in (4, 16, 96))}
    FROM led WINDOW w AS (PARTITION BY site ORDER BY ts))
    SELECT site, ts, target_split AS split, round(target_y, 8) AS target_y, round(cf_input, 8) AS cf_input, {", ".join(f"round(l{k}, 8) AS cf_input_lag{k}" for k in (1, 4, 8, 96))},
    {", ".join(f"round(m{n}, 13) AS roll{n}_mean, round(s{n}, 10) AS roll{n}_std" for n in (4, 16, 96))},
    round(sin(2 * pi() * (hour(target_ts) * 60 + minute(target_ts)) / 1440), 6) AS target_tod_sin, round(cos(2 * pi() * (hour(target_ts) * 60 + minute(target_ts)) / 1440), 6) AS target_tod_cos,
    round(sin(2 * pi() * dayofyear(target_ts) / 365.25), 6) AS target_doy_sin, round(cos(2 * pi() * dayofyear(target_ts) / 365.25), 6) AS target_doy_cos, 1 AS lead_steps,
    {", ".join(f"(site = '{s}')::INT AS site_{s}" for s in SITES)}
    FROM f WHERE target_y IS NOT NULL AND l96 IS NOT NULL AND cf_input IS NOT NULL""")
def q_tabular_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = features(spark, sf_dir)
    numbers = ["target_y", "cf_input", *(f"cf_input_lag{k}" for k in (1, 4, 8, 96)), *(f"roll{n}_{s}" for n in (4, 16, 96) for s in ("mean", "std")), *(f"target_{x}_{y}" for x in ("tod", "doy") for y in ("sin", "cos"))]
    return t.select("site", "ts", "split", "lead_steps", *(F.round(c, 13 if c.endswith("_mean") else 10 if c.endswith("_std") else 6 if c.startswith(("target_tod", "target_doy")) else 8).alias(c) for c in numbers), *(c.cast("int").alias(n) for n, c in one_hot("site", SITES, "site").items()))


@query(f"""WITH {READINGS}, meter AS (SELECT *, sum(power) OVER (PARTITION BY site, date_trunc('day', ts - INTERVAL '1 hour') ORDER BY ts) AS total FROM readings)
    SELECT site, ts, round(greatest(coalesce(total - lag(total) OVER (PARTITION BY site, date_trunc('day', ts - INTERVAL '1 hour') ORDER BY ts), total), 0), 4) AS increment, round(power, 4) AS power FROM meter""")
def q_deaccumulate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adapters.meter(spark, sf_dir).select("site", "ts", F.round(sequence.deaccumulate("total", ["site"], "ts"), 4).alias("increment"), F.round("power", 4).alias("power"))


@query("""SELECT event_id, round(sin(2 * pi() * (hour(ts) * 60 + minute(ts)) / 1440), 6) AS tod_sin, round(cos(2 * pi() * (hour(ts) * 60 + minute(ts)) / 1440), 6) AS tod_cos, round(sin(2 * pi() * dayofyear(ts) / 365.25), 6) AS doy_sin,
    round(cos(2 * pi() * dayofyear(ts) / 365.25), 6) AS doy_cos, round(sin(2 * pi() * hour(ts) / 24), 6) AS hour_sin, round(cos(2 * pi() * hour(ts) / 24), 6) AS hour_cos, round(sin(2 * pi() * dayofyear(ts) / 366), 6) AS year_sin FROM events""")
def q_cyclic_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = cyclic(minute_of_day("ts"), 1440, "tod") | cyclic(F.dayofyear("ts"), 365.25, "doy") | cyclic(F.hour("ts"), 24, "hour") | {"year_sin": cyclic(F.dayofyear("ts"), 366, "year")["year_sin"]}
    return adapters.table(spark, sf_dir, "events").select("event_id", *(r6(c).alias(n) for n, c in made.items()))


@query("""SELECT event_id, ts + INTERVAL '10 hours' AS ts_local, hour(ts + INTERVAL '10 hours')::INT AS hour, dayofyear(ts + INTERVAL '10 hours')::INT AS doy, month(ts + INTERVAL '10 hours')::INT AS month,
    coalesce(value > 100, false) AS is_daytime, (hour(timezone('US/Pacific', timezone('UTC', ts))) * 60 + minute(timezone('US/Pacific', timezone('UTC', ts))))::INT AS pacific_minute FROM events""")
def q_local_calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    e = adapters.table(spark, sf_dir, "events").withColumn("ts_local", local_time("ts", 10))
    return e.select("event_id", "ts_local", F.hour("ts_local").alias("hour"), F.dayofyear("ts_local").alias("doy"), F.month("ts_local").alias("month"), F.coalesce(F.col("value") > 100, F.lit(False)).alias("is_daytime"), zoned_minute("ts", "US/Pacific").alias("pacific_minute"))


@query("SELECT l_orderkey, l_linenumber, round(sqrt(l_quantity ** 2 + l_tax ** 2), 6) AS speed, round(least(greatest(l_quantity - 10, 0), 30), 6) AS clipped FROM lineitem")
def q_hypot(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = adapters.table(spark, sf_dir, "lineitem")
    return li.select("l_orderkey", "l_linenumber", r6(F.hypot("l_quantity", "l_tax")).alias("speed"), r6(F.least(clip_low(F.col("l_quantity") - 10), F.lit(30.0))).alias("clipped"))


@query(f"""WITH {READINGS}, m AS (SELECT *, sum(CASE WHEN d = INTERVAL '15 minutes' THEN 0 ELSE 1 END) OVER (PARTITION BY site ORDER BY ts) AS block FROM (SELECT *, ts - lag(ts) OVER (PARTITION BY site ORDER BY ts) AS d FROM readings)),
    n AS (SELECT *, count(*) OVER (PARTITION BY site, block) AS block_rows FROM m) SELECT site, block::BIGINT AS block, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts FROM n WHERE block_rows >= 2 GROUP BY 1, 2""")
def q_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = grid.blocks(adapters.readings(spark, sf_dir), "site", "ts", 15, 2)
    return b.groupBy("site", "block").agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


@query(f"""WITH {FILLED}, s AS (SELECT avg(cf_input) AS m, stddev_pop(cf_input) AS d FROM prepared WHERE split = 'train') SELECT site, ts, round((cf_input - m) / CASE WHEN d < 1e-8 THEN 1 ELSE d END, 5) AS z FROM prepared CROSS JOIN s""")
def q_standardise_train_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scale.standardise(prepared(spark, sf_dir), F.col("split") == "train", ["cf_input"]).select("site", "ts", F.round("cf_input_z", 5).alias("z"))


@query(f"WITH {SLOTS} SELECT grp, ts, round(CASE WHEN ts - lag(ts) OVER w = INTERVAL '15 minutes' THEN value - lag(value) OVER w END, 6) AS ramp FROM slots WINDOW w AS (PARTITION BY grp ORDER BY ts)")
def q_ramp(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("grp").orderBy("ts")
    return adapters.slots(spark, sf_dir).select("grp", "ts", r6(sequence.ramp("value", "ts", w, 900)).alias("ramp"))
