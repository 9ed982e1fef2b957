"""Sinks; each has its scan or reads back with Spark's own."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, functions as F


def table(df: DataFrame, path: str, by: tuple[str, ...] = ()) -> None:
    """Parquet, a folder for each value of ``by``; rows are dealt by it first, so a folder has few files."""
    (df.repartition(*map(F.col, by)) if by else df).write.mode("overwrite").partitionBy(*by).parquet(path)


def comparison(df: DataFrame, path: str) -> None:
    """One CSV file with a header, for small summaries."""
    df.coalesce(1).write.mode("overwrite").csv(path, header=True)


def evaluation(predictions: DataFrame, metrics: DataFrame, path: str) -> None:
    """predictions as Parquet, metrics as JSON lines."""
    predictions.write.mode("overwrite").parquet(f"{path}/predictions.parquet")
    metrics.select(F.to_json(F.struct("*")).alias("value")).coalesce(1).write.mode("overwrite").text(f"{path}/metrics.json")


def window_index(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").partitionBy("split").parquet(path)


def report(df: DataFrame, path: str) -> None:
    """A rejection report as one JSON object; it has a handful of rows."""
    rows = [r.asDict() for r in df.collect()]
    with open(path, "w") as f:
        json.dump({"rows": rows}, f)
