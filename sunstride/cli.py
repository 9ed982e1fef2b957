"""Command line: inspect a store, build a window index, train, evaluate, run all of it; compare runs.

A store is a folder of Parquet with grp, ts, row_id and value; a run is configured by a JSON (or YAML) file.
"""

from __future__ import annotations

import argparse
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from .functions import minute_of_day
from .operators import baselines, forecast_windows, metrics, models, quality, scale, splits
from .session import session
from .sources import config as configs, sinks


def store(spark: SparkSession, config: dict) -> DataFrame:
    return spark.read.parquet(config["data"]["path"]).select("grp", F.col("ts").cast("timestamp_ntz").alias("ts"), "row_id", "value")


def inspect(spark: SparkSession, config: dict) -> DataFrame:
    return quality.store_report(store(spark, config), "grp", "ts", "value", ["row_id"])


def day_table(rows: DataFrame, config: dict) -> DataFrame:
    days = rows.select(F.to_date("ts").alias("date"), (F.col("grp") != "test").alias("own")).groupBy("date").agg(F.min("own").alias("own"))
    return splits.day_holdout(days, config["split"]["validation_fraction"], "date", F.col("own"))


def build_index(spark: SparkSession, config: dict) -> DataFrame:
    rows, d = store(spark, config), config["data"]
    return forecast_windows.window_index(rows, day_table(rows, config), d["history_minutes"], d["history_step_minutes"], d["horizon_minutes"], config["strides"])


def tabular(index: DataFrame) -> tuple[DataFrame, list[str]]:
    """Valid windows with a column for each value of the history."""
    valid = forecast_windows.valid_windows(index)
    n = valid.select(F.size("history")).first()
    names = [f"h{k}" for k in range(n[0] if n else 0)]
    return valid.select("grp", "split", "sample_index", "issue_time", "target_time", F.col("target").alias("target_y"), *(F.get("history", F.lit(k)).alias(c) for k, c in enumerate(names))), names


def predict(spark: SparkSession, config: dict, index: DataFrame, load: bool) -> DataFrame:
    """Predictions of the test split (validation where there is none). ``load`` takes the saved model and raises where there is none."""
    rows, names = tabular(index)
    name, capacity = config["model"]["name"], config["model"].get("capacity", 1.0)
    if name == "persistence":
        out = rows.withColumn("y_pred", F.col(names[-1]))
    elif name == "clear_sky":
        own = store(spark, config)
        train = own.withColumn("date", F.to_date("ts")).join(F.broadcast(day_table(own, config).where("split = 'train'")), "date")  # a row a day
        curve = baselines.clear_sky_curve(train, minute_of_day("ts"), "value")
        out = baselines.with_curve(baselines.with_curve(rows, curve, minute_of_day("issue_time"), "now"), curve, minute_of_day("target_time"), "later")
        out = out.withColumn("y_pred", baselines.clear_sky_forecast(names[-1], "now", "later", capacity))
    else:
        path = config["output"]["path"]
        scaler = scale.Scaler.load(f"{path}/scaler.json") if load else scale.SCALERS[config["scaler"]](capacity=capacity, windows=forecast_windows.valid_windows(index).where("split = 'train'"))
        scaled = rows.withColumns({c: scaler.apply(F.col(c)) for c in (*names, "target_y")})
        model = models.Forecaster(name, names, **models.preset(config["model"]["preset"], config["model"].get("presets")))
        if load:
            model.load(f"{path}/model")
        else:
            model.fit(scaled.where("split = 'train'")).save(f"{path}/model")
            scaler.save(f"{path}/scaler.json")
        out = model.predict(scaled, scaler.inverse).withColumn("target_y", scaler.inverse(F.col("target_y")))
    return out.where("split <> 'train'").withColumnRenamed("target_y", "y_true")


def evaluate(spark: SparkSession, config: dict, load: bool = True) -> DataFrame:
    found = predict(spark, config, build_index(spark, config), load)
    scores = metrics.overall(found, config["model"].get("capacity", 1.0), by=["split"])
    if config["output"]["path"]:
        sinks.evaluation(metrics.prediction_frame(found, config["model"]["name"]), scores, config["output"]["path"])
    return scores


def compare(spark: SparkSession, paths: list[str], out: str | None = None) -> DataFrame:
    """The metrics of several runs' outputs, best first; as a CSV too where ``out`` is given."""
    each = [spark.read.json(f"{p}/metrics.json").withColumn("model", F.lit(p.rstrip("/").rsplit("/", 1)[-1])) for p in paths]
    found = metrics.leaderboard(reduce(DataFrame.unionByName, each).select("model", "split", "n", "rmse", "mae", "mbe", "acc_rmse", "acc_mae"))
    if out:
        sinks.comparison(found, out)
    return found


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> DataFrame:
    parser = argparse.ArgumentParser(prog="sunstride", description=__doc__)
    parser.add_argument("command", choices=("inspect", "build-index", "train", "evaluate", "run", "compare"))
    parser.add_argument("config", nargs="+", help="a configuration; for compare, the output folders of runs")
    given = parser.parse_args(args)
    spark = spark or session()
    if given.command == "compare":
        out = compare(spark, given.config)
        out.show(100, truncate=False)
        return out
    config = configs.load(given.config[0])
    if given.command == "inspect":
        out = inspect(spark, config)
    elif given.command == "build-index":
        index = build_index(spark, config)
        sinks.window_index(forecast_windows.valid_windows(index), f"{config['output']['path']}/index")
        out = forecast_windows.report(index)
    else:
        out = evaluate(spark, config, load=given.command == "evaluate")
    out.show(100, truncate=False)
    return out


if __name__ == "__main__":
    main()
