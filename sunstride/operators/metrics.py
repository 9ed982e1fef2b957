"""Capacity-normalised scores. A NULL among the scored values makes a score NULL unless rows with NULLs are dropped first."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F


def _whole(value: Column, *columns: str) -> Column:
    """The aggregate if no value is missing, else NULL."""
    ok = F.lit(True)
    for c in columns:
        ok = ok & (F.count(c) == F.count(F.lit(1)))
    return F.when(ok, value)


def mae(y: str = "y_true", p: str = "y_pred") -> Column:
    return _whole(F.avg(F.abs(F.col(p) - F.col(y))), y, p)


def rmse(y: str = "y_true", p: str = "y_pred") -> Column:
    return _whole(F.sqrt(F.avg((F.col(p) - F.col(y)) * (F.col(p) - F.col(y)))), y, p)


def mbe(y: str = "y_true", p: str = "y_pred") -> Column:
    return _whole(F.avg(F.col(p) - F.col(y)), y, p)


def accuracy(error: Column, capacity: float | Column = 1.0) -> Column:
    return 1 - error / capacity


def overall(df: DataFrame, capacity: float, y: str = "y_true", p: str = "y_pred", by: Sequence[str] = ()) -> DataFrame:
    """n, rmse, mae, mbe, acc_rmse, acc_mae."""
    r, m = rmse(y, p), mae(y, p)
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), r.alias("rmse"), m.alias("mae"), mbe(y, p).alias("mbe"), accuracy(r, capacity).alias("acc_rmse"), accuracy(m, capacity).alias("acc_mae"))


def monthly_daily(df: DataFrame, capacity: float = 1.0, ts: str = "ts", entity: str = "site", daytime: str = "is_daytime") -> DataFrame:
    """Scores of each day's daytime rows, then the mean over the days of a month."""
    rows = df.where(F.col(daytime) & F.col(entity).isNotNull()).withColumns({"month": F.date_format(ts, "yyyy-MM"), "_day": F.to_date(ts)})
    daily = rows.groupBy(entity, "month", "_day").agg(accuracy(rmse(), capacity).alias("r"), accuracy(mae(), capacity).alias("m"))
    return daily.groupBy(entity, "month").agg(F.avg("r").alias("acc_rmse"), F.avg("m").alias("acc_mae"))


def monthly_pooled(df: DataFrame, ts: str = "target_ts", entity: str = "site", capacity: str = "capacity") -> DataFrame:
    """Scores over all rows of an entity's month, by its capacity, which must be constant there; rows with a NULL go first."""
    missing = {ts, entity, capacity, "y_true", "y_pred"} - set(df.columns)
    if missing:
        raise ValueError(f"missing columns: {sorted(missing)}")
    rows = df.select(ts, entity, capacity, "y_true", "y_pred").na.drop().withColumn("month", F.date_format(ts, "yyyy-MM"))
    e = F.col("y_pred") - F.col("y_true")
    out = rows.groupBy(entity, "month").agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), F.min(capacity).alias("_lo"), F.max(capacity).alias("_hi")
    )
    cap = F.when(F.col("_lo") == F.col("_hi"), F.col("_lo")).otherwise(F.raise_error(F.lit("capacity must be constant within a month")).cast("double"))
    return out.withColumns({"acc_mae": accuracy(F.col("mae"), cap), "acc_rmse": accuracy(F.col("rmse"), cap)}).drop("_lo", "_hi")


def mean_monthly(monthly: DataFrame, entity: str = "site") -> DataFrame:
    """Mean of the monthly rows by entity, and of all rows (entity NULL), in one pass."""
    return monthly.groupingSets([[entity], []], entity).agg(F.avg("acc_mae").alias("mean_monthly_acc_mae"), F.avg("acc_rmse").alias("mean_monthly_acc_rmse"))


def by_step(flat: DataFrame, step: str = "horizon_step") -> DataFrame:
    return flat.groupBy(step).agg(rmse().alias("rmse"), mae().alias("mae"))


def walk_forward_summary(scored: DataFrame, fold: str = "fold") -> tuple[DataFrame, DataFrame]:
    """Scores by fold; and one row: their mean and sample deviation, and the scores over all rows."""
    per = scored.groupBy(fold).agg(F.count(F.lit(1)).alias("n"), rmse().alias("rmse"), mae().alias("mae"))
    pooled = scored.agg(rmse().alias("oof_rmse"), mae().alias("oof_mae"))
    spread = per.agg(F.avg("rmse").alias("mean_rmse"), F.stddev_samp("rmse").alias("std_rmse"), F.avg("mae").alias("mean_mae"), F.stddev_samp("mae").alias("std_mae"))
    return per, spread.join(F.broadcast(pooled))  # one row each


def improvement(error: Column | str, base: Column | str) -> Column:
    error, base = (F.col(x) if isinstance(x, str) else x for x in (error, base))
    return 1 - error / base


def common_targets(predictions: Sequence[DataFrame], keys: Sequence[str]) -> list[DataFrame]:
    """Each set of predictions reduced to the keys that all have."""
    shared = predictions[0].select(*keys).distinct()
    for p in predictions[1:]:
        shared = shared.join(p.select(*keys).distinct(), list(keys))
    return [p.join(shared, list(keys), "left_semi") for p in predictions]


def prediction_frame(df: DataFrame, model: str) -> DataFrame:
    """Long predictions with their errors."""
    e = F.col("y_pred") - F.col("y_true")
    return df.withColumns({"model_name": F.lit(model), "absolute_error": F.abs(e), "squared_error": e * e})


def night_diagnostic(df: DataFrame, ts: str = "target_ts", entity: str = "site", capacity: str = "capacity") -> DataFrame:
    """Mean monthly accuracy over all rows and over rows with output, and the difference; one row for each entity."""
    every = mean_monthly(monthly_pooled(df, ts, entity, capacity), entity).where(F.col(entity).isNotNull())
    day = mean_monthly(monthly_pooled(df.where("y_true > 0"), ts, entity, capacity), entity).where(F.col(entity).isNotNull())
    day = day.withColumnsRenamed({"mean_monthly_acc_mae": "day_acc_mae", "mean_monthly_acc_rmse": "day_acc_rmse"})
    return every.join(day, entity, "left").withColumn("drop_acc_rmse", F.col("mean_monthly_acc_rmse") - F.col("day_acc_rmse"))


def identity_check(ledger: DataFrame, tolerance: float = 5e-4) -> DataFrame:
    """Where a ledger has rmse, acc_rmse and a normaliser, whether acc_rmse is 1 - rmse / normaliser."""
    keys = ["dataset", "model", "normalized_by"]
    wide = ledger.groupBy(*keys).pivot("metric", ["rmse", "acc_rmse"]).agg(F.first("value")).where("rmse IS NOT NULL AND acc_rmse IS NOT NULL AND normalized_by IS NOT NULL")
    return wide.withColumn("expected", 1 - F.col("rmse") / F.col("normalized_by")).withColumn("holds", F.abs(F.col("expected") - F.col("acc_rmse")) <= tolerance)


def best_by_group(ledger: DataFrame, group: str = "task") -> DataFrame:
    """The best model of each group: highest acc_rmse where there is one, else lowest rmse; of equals the first by name."""
    wide = ledger.groupBy(group, "model").pivot("metric", ["acc_rmse", "rmse"]).agg(F.first("value"))
    ranked = wide.groupBy(group).agg(
        F.count("acc_rmse").alias("_n"),
        F.min_by("model", F.struct(F.col("rmse"), F.col("model"))).alias("_b"),
        F.min(F.when(F.col("acc_rmse").isNotNull(), F.struct(-F.col("acc_rmse"), F.col("model")))).alias("_first"),
    )
    return ranked.select(group, F.when(F.col("_n") > 0, F.col("_first.model")).otherwise(F.col("_b")).alias("best_model"), F.when(F.col("_n") > 0, "acc_rmse").otherwise("rmse").alias("by"))


def tag_tasks(ledger: DataFrame, tasks: dict[tuple[str, str], str]) -> DataFrame:
    """``task`` by (dataset, model), else the dataset's single task."""
    known = F.create_map(*(F.lit(x) for (d, m), t in tasks.items() for x in (f"{d}\n{m}", t))) if tasks else F.lit(None).cast("map<string,string>")
    return ledger.withColumn("task", F.coalesce(known[F.concat_ws("\n", "dataset", "model")], F.concat("dataset", F.lit(" / single task"))))


def leaderboard(scores: DataFrame, by: str = "acc_rmse") -> DataFrame:
    return scores.orderBy(F.desc_nulls_last(by), "model")
