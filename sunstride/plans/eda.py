"""Quality reports, distributions, joins, sorts and samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import exact_mean, r6, r8
from ..operators import quality, stats
from ..sources import adapters
from .registry import DISPATCH, READINGS, SLOTS, query


@query("""WITH e AS (SELECT event_type AS grp, ts, value, epoch_us(ts) / 1e6 - lag(epoch_us(ts) / 1e6) OVER (PARTITION BY event_type ORDER BY event_id) AS dt FROM events)
    SELECT grp, count(*) AS n_rows, min(ts) AS first_ts, max(ts) AS last_ts, count(*) FILTER (value < 0) AS negatives, count(ts) - count(DISTINCT ts) AS duplicates, count(*) FILTER (dt < 0) AS non_monotonic,
    count(*) FILTER (dt > 60) AS gaps_over_minute, count(*) FILTER (dt > 86400) AS gaps_over_day, round(max(dt), 3) AS largest_gap_s FROM e GROUP BY grp""")
def q_quality_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = adapters.table(spark, sf_dir, "events").withColumn("grp", F.col("event_type"))
    return quality.store_report(e, "grp", "ts", "value", ["event_id"]).withColumn("largest_gap_s", F.round("largest_gap_s", 3))


@query(f"""WITH {READINGS} SELECT site, count(*) AS n_rows, min(ts) AS first_ts, max(ts) AS last_ts, count(*) FILTER (power IS NULL) AS nulls, count(*) FILTER (power < 0) AS negatives, count(*) FILTER (power > capacity) AS over_capacity,
    count(ts) - count(DISTINCT ts) AS duplicates, round(count(DISTINCT ts) / (epoch(max(ts) - min(ts)) / 900 + 1), 6) AS completeness FROM readings GROUP BY site""")
def q_station_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.overview(adapters.readings(spark, sf_dir), "site", "ts", "power", "capacity").withColumn("completeness", r6("completeness"))


@query(f"""WITH {SLOTS}, d AS (SELECT grp, epoch(ts - lag(ts) OVER (PARTITION BY grp ORDER BY ts)) AS dt FROM slots) SELECT grp, count(*) AS steps, round(avg((dt = 900)::INT), 6) AS exact_share FROM d WHERE dt > 0 AND dt < 3600 GROUP BY grp""")
def q_cadence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.cadence(adapters.slots(spark, sf_dir), "grp", "ts", 900).withColumn("exact_share", r6("exact_share"))


@query(f"WITH {DISPATCH} SELECT site, count(*) FILTER (y_pred > y_true + 1e-6) AS above, count(*) FILTER (discount <= 0 AND y_true > 0.005 * capacity) AS night_output, count(*) FILTER (y_true < 0) AS negative FROM dispatch GROUP BY site")
def q_consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    rules = {"above": c("y_pred") > c("y_true") + 1e-6, "night_output": (c("discount") <= 0) & (c("y_true") > 0.005 * c("capacity")), "negative": c("y_true") < 0}
    return quality.consistency(adapters.dispatch(spark, sf_dir), "site", rules)


_PROFILE = {
    "l_orderkey": "bigint", "l_partkey": "bigint", "l_suppkey": "bigint", "l_linenumber": "int", "l_quantity": "double", "l_extendedprice": "double", "l_discount": "double",
    "l_tax": "double", "l_returnflag": "string", "l_linestatus": "string", "l_shipdate": "timestamp_ntz",
}


def _profiled(c: str, kind: str) -> str:
    """Least and greatest are given as whole numbers, as the shortest doubles, or as times."""
    end = {"string": "NULL", "timestamp_ntz": f"strftime(%s({c}), '%%Y-%%m-%%d %%H:%%M:%%S')"}.get(kind, f"%s({c})::VARCHAR")
    ends = ", ".join(f"{end % f if '%s' in end else end}::VARCHAR AS {name}" for f, name in (("min", "least"), ("max", "greatest")))
    mean = "NULL::DOUBLE" if kind in ("string", "timestamp_ntz") else f"round(sum({c}::DECIMAL(38, 12))::DOUBLE / count({c}), 6)"
    return f"SELECT '{c}' AS name, '{kind}' AS dtype, count({c}) AS non_null, count(DISTINCT {c}) AS n_unique, {ends}, {mean} AS mean_value, '{'target' if c == 'l_quantity' else 'feature'}' AS role FROM lineitem"


@query(" UNION ALL ".join(_profiled(*x) for x in _PROFILE.items()))
def q_schema_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.schema_profile(adapters.table(spark, sf_dir, "lineitem"), "l_quantity").withColumn("mean_value", r6("mean_value"))


@query("SELECT 'event_type' AS name, count(*) FILTER (TRY_CAST(event_type AS DOUBLE) IS NULL AND event_type IS NOT NULL) AS junk FROM events UNION ALL SELECT 'props', count(*) FILTER (TRY_CAST(props AS DOUBLE) IS NULL AND props IS NOT NULL) FROM events")
def q_junk_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.junk_counts(adapters.table(spark, sf_dir, "events"), ["event_type", "props"])


@query(f"WITH {SLOTS} SELECT ts::DATE AS date, count(*) AS n, round(sum(value::DECIMAL(38, 12))::DOUBLE / count(value), 8) AS mean, min(dayofyear(ts))::INT AS doy FROM slots GROUP BY 1")
def q_daily_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adapters.slots(spark, sf_dir).groupBy(F.to_date("ts").alias("date")).agg(F.count(F.lit(1)).alias("n"), r8(exact_mean("value")).alias("mean"), F.min(F.dayofyear("ts")).alias("doy"))


@query(f"WITH {SLOTS}, d AS (SELECT ts::DATE AS date, stddev_samp(value) AS s FROM slots GROUP BY 1) SELECT arg_min(date, s) AS least, arg_max(date, s) AS greatest FROM d")
def q_extreme_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = adapters.slots(spark, sf_dir).groupBy(F.to_date("ts").alias("date")).agg(F.stddev_samp("value").alias("s")).where("s IS NOT NULL")
    return stats.extremes(d, "date", "s")


@query("SELECT hour(ts)::INT AS hour, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.1), 6) AS q10, round(quantile_cont(value, 0.9), 6) AS q90 FROM events GROUP BY 1")
def q_diurnal_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = stats.quantile_band(adapters.table(spark, sf_dir, "events").select(F.hour("ts").alias("hour"), "value"), "value", ["hour"])
    return b.select("hour", r6("mean").alias("mean"), r6("q10").alias("q10"), r6("q90").alias("q90"))


_TYPES = ("click", "error", "purchase", "signup", "view")


@query("SELECT hour(ts)::INT AS hour, " + ", ".join(f"round(avg(value) FILTER (event_type = '{s}'), 6) AS {s}" for s in _TYPES) + " FROM events GROUP BY 1")
def q_pivot_hour_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = stats.pivot_mean(adapters.table(spark, sf_dir, "events"), F.hour("ts").alias("hour"), "event_type", _TYPES, "value")
    return p.select("hour", *(r6(c).alias(c) for c in _TYPES))


@query("SELECT l_returnflag, " + ", ".join(f"round(avg(l_quantity) FILTER (month(l_shipdate) = {m}), 6) AS m{m:02d}" for m in range(1, 13)) + " FROM lineitem GROUP BY 1")
def q_pivot_hour_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = adapters.table(spark, sf_dir, "lineitem").withColumn("month", F.month("l_shipdate"))
    p = stats.pivot_mean(li, "l_returnflag", "month", list(range(1, 13)), "l_quantity")
    return p.select("l_returnflag", *(r6(str(m)).alias(f"m{m:02d}") for m in range(1, 13)))


_CORR = ("y_true", "y_pred", "discount", "tax")


@query(f"WITH {DISPATCH} " + " UNION ALL ".join(f"SELECT site, '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS corr FROM dispatch GROUP BY site" for i, a in enumerate(_CORR) for b in _CORR[i + 1 :]))
def q_corr_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.correlations(adapters.dispatch(spark, sf_dir), _CORR, ["site"]).withColumn("corr", r6("corr"))


@query(f"WITH {DISPATCH} SELECT site, least(floor(y_true / (50.0 / 60)) + 1, 60)::INT AS bin, count(*) AS n FROM dispatch WHERE y_true BETWEEN 0 AND 50 GROUP BY 1, 2")
def q_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.histogram(adapters.dispatch(spark, sf_dir), "y_true", 0.0, 50.0, 60, ["site"])


@query(f"WITH {DISPATCH} SELECT site, round(min(y_pred), 6) AS low, round(quantile_cont(y_pred, 0.25), 6) AS q1, round(quantile_cont(y_pred, 0.5), 6) AS mid, round(quantile_cont(y_pred, 0.75), 6) AS q3, round(max(y_pred), 6) AS high FROM dispatch GROUP BY site")
def q_boxplot(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = stats.five_numbers(adapters.dispatch(spark, sf_dir), "y_pred", ["site"])
    return b.select("site", *(r6(c).alias(c) for c in ("low", "q1", "mid", "q3", "high")))


@query("SELECT event_type AS site, count(value) AS n, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std, round(quantile_cont(value, 0.01), 6) AS p01, round(quantile_cont(value, 0.99), 6) AS p99, round(max(abs(value)), 6) AS max_abs FROM events GROUP BY 1")
def q_sample_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = stats.sample_stats(adapters.table(spark, sf_dir, "events").withColumnRenamed("event_type", "site"), "value", ["site"])
    return s.select("site", "n", *(r6(c).alias(c) for c in ("mean", "std", "p01", "p99", "max_abs")))


@query("SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users FROM events GROUP BY 1")
def q_group_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adapters.table(spark, sf_dir, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("user_id").alias("users"))


@query("SELECT l_orderkey, l_linenumber, l_extendedprice, l_partkey FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey LIMIT 240")
def q_topn(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = adapters.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice", "l_partkey")
    return li.orderBy(F.desc_nulls_last("l_extendedprice"), "l_orderkey", "l_linenumber", "l_partkey").limit(240)


@query("""WITH r AS (SELECT ts::DATE AS date, event_id, ts, row_number() OVER (PARTITION BY ts::DATE ORDER BY event_id) - 1 AS k, count(*) OVER (PARTITION BY ts::DATE) AS n FROM events)
    SELECT date, event_id, ts FROM r WHERE list_contains(list_transform(range(6), lambda i: floor(i * (n - 1) / 5)::BIGINT), k)""")
def q_even_picks(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = adapters.table(spark, sf_dir, "events").select(F.to_date("ts").alias("date"), "event_id", "ts")
    return stats.even_picks(e, ["date"], "event_id", 6)


@query("SELECT event_id, event_type, value FROM events ORDER BY md5('42/' || event_id), event_id LIMIT 500")
def q_hash_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.hash_sample(adapters.table(spark, sf_dir, "events").select("event_id", "event_type", "value"), "event_id", 500)


@query("""SELECT o.o_orderkey, o.o_custkey, c.c_name, n.n_name, o.o_totalprice FROM orders o LEFT JOIN customer c ON o.o_custkey = c.c_custkey LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey""")
def q_left_join_parity(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, c, n = (adapters.table(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    return o.join(c, o["o_custkey"] == c["c_custkey"], "left").join(n, c["c_nationkey"] == n["n_nationkey"], "left").select("o_orderkey", "o_custkey", "c_name", "n_name", "o_totalprice")


@query("""WITH l AS (SELECT l_orderkey AS k, sum(l_extendedprice) AS a FROM lineitem GROUP BY 1), r AS (SELECT o_orderkey AS k, o_totalprice AS b FROM orders), j AS (SELECT * FROM l FULL JOIN r USING (k))
    SELECT count(*) FILTER (b IS NULL) AS only_left, count(*) FILTER (a IS NULL) AS only_right, count(*) FILTER (a IS NULL OR b IS NULL) AS missing, round(max(abs(a - b)), 2) AS largest_difference,
    count(*) FILTER (a IS NULL OR b IS NULL) = 0 AND coalesce(max(abs(a - b)), 0) < 1e-6 AS agrees FROM j""")
def q_join_equality(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = adapters.table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.sum("l_extendedprice").alias("v"))
    b = adapters.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("v"))
    p = quality.join_parity(a, b, ["k"], "v")
    return p.select("only_left", "only_right", "missing", F.round("largest_difference", 2).alias("largest_difference"), "agrees")
