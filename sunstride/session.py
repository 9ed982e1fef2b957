"""A session with the settings that the operators assume."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(name: str = "sunstride", **conf: str) -> SparkSession:
    """Pinned to UTC, with adaptive execution; partition counts and broadcast limits come from the cluster or ``conf``."""
    build = SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    build = build.config("spark.sql.adaptive.skewJoin.enabled", "true").config("spark.sql.parquet.aggregatePushdown", "true")
    for key, value in conf.items():
        build = build.config(key.replace("__", "."), value)
    return build.getOrCreate()
