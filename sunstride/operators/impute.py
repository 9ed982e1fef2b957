"""Imputation from training rows only, and causal fills."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from .stats import quantiles


def bounded_ffill(x: str, by: Sequence[str], order: str, limit: int = 4) -> Column:
    """The last value of the row or of at most ``limit`` rows before it."""
    return F.last(x, ignorenulls=True).over(Window.partitionBy(*by).orderBy(order).rowsBetween(-limit, 0))


def medians(train: DataFrame, entity: str, columns: Sequence[str]) -> DataFrame:
    """Exact medians by entity, and over all rows in the row whose entity is NULL."""
    own = train.where(F.col(entity).isNotNull())
    values = own.select(F.col(entity).alias("_e"), *(F.col(c).cast("double").alias(c) for c in columns)).unpivot(["_e"], list(columns), "_name", "_value")
    keyed = values.select(F.explode(F.array(F.col("_e"), F.lit(None).cast(own.schema[entity].dataType))).alias("_e"), "_name", "_value")  # each value for its entity and for all
    found = quantiles(keyed, "_value", ["_e", "_name"], [0.5])
    return found.groupBy(F.col("_e").alias(entity)).pivot("_name", list(columns)).agg(F.first(F.col("q")[0]))


def fill_from_train(df: DataFrame, train: Column, entity: str, columns: Sequence[str], check: bool = True) -> DataFrame:
    """Value, else the entity's training median, else the training median of all; raises at run time if a column has none."""
    found = medians(df.where(train), entity, columns)
    own = found.where(F.col(entity).isNotNull()).select(F.col(entity).alias("_e"), *(F.col(c).alias(f"_s_{c}") for c in columns))
    over = found.where(F.col(entity).isNull()).select(*(F.col(c).alias(f"_g_{c}") for c in columns), F.lit(1).alias("_one"))
    out = df.join(own, F.col(entity) == F.col("_e"), "left").withColumn("_one", F.lit(1)).join(F.broadcast(over), "_one", "left")  # one row
    for c in columns:
        last = F.coalesce(f"_g_{c}", F.raise_error(F.lit(f"training data has no value for {c}")).cast("double")) if check else F.col(f"_g_{c}")
        out = out.withColumn(c, F.coalesce(c, f"_s_{c}", last))
    return out.drop("_e", "_one", *(f"_{k}_{c}" for k in "sg" for c in columns))
