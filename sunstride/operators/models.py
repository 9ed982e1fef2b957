"""Learned forecasters over pyspark.ml behind one interface."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import Column, DataFrame, functions as F

from ..sources.config import read


def _ridge(df: DataFrame, label: str, alpha: float = 1.0, **_) -> LinearRegression:
    """Minimises |y - Xw|^2 + alpha |w|^2. The library averages the loss and scales the label by its deviation; this undoes both."""
    n, sd = df.agg(F.count(label), F.stddev_pop(label)).first()
    return LinearRegression(labelCol=label, regParam=alpha * (sd or 1.0) / max(1, n), elasticNetParam=0.0, standardization=False, solver="normal")


def _forest(df: DataFrame, label: str, trees: int = 20, depth: int = 6, seed: int = 42, **_) -> RandomForestRegressor:
    return RandomForestRegressor(labelCol=label, numTrees=trees, maxDepth=depth, seed=seed)


def _boosted(df: DataFrame, label: str, trees: int = 20, depth: int = 4, rate: float = 0.1, seed: int = 42, validation: str | None = None, **_) -> GBTRegressor:
    out = GBTRegressor(labelCol=label, maxIter=trees, maxDepth=depth, stepSize=rate, seed=seed)
    return out.setValidationIndicatorCol(validation) if validation else out


#: Builders by name; "xgboost" and "lightgbm" name gradient boosting here, as those libraries are not part of Spark.
MODELS = {"linear": _ridge, "rf": _forest, "gbt": _boosted, "xgboost": _boosted, "lightgbm": _boosted}
#: Named settings.
PRESETS = {"fast": {"trees": 5, "depth": 3}, "default": {"trees": 20, "depth": 5}}


def preset(name: str, path: str | None = None) -> dict:
    """A fresh copy of a named preset, of a JSON (or, with that library, YAML) file if one is given."""
    known = PRESETS if path is None else read(path)
    if name not in known:
        raise KeyError(f"no preset {name}; there are {sorted(known)}")
    return dict(known[name])


class Forecaster:
    """fit, predict, save, load. Rows with a missing feature are skipped in fitting and get no prediction."""

    def __init__(self, name: str, features: Sequence[str], label: str = "target_y", **params):
        if name not in MODELS:
            raise ValueError(f"unknown model {name}; there are {sorted(MODELS)}")
        self.name, self.features, self.label, self.params, self.model = name, list(features), label, params, None

    def fit(self, df: DataFrame) -> Forecaster:
        df = df.na.drop(subset=[*self.features, self.label])
        gather = VectorAssembler(inputCols=self.features, outputCol="features")
        self.model = Pipeline(stages=[gather, MODELS[self.name](df, self.label, **self.params)]).fit(df)
        return self

    def predict(self, df: DataFrame, inverse: Callable[[Column], Column] | None = None) -> DataFrame:
        """``df`` with y_pred, in the label's own units if the scaler's ``inverse`` is given. Keys travel with their rows."""
        if self.model is None:
            raise RuntimeError("fit or load the model first")
        out = self.model.transform(df.na.drop(subset=self.features)).withColumnRenamed("prediction", "y_pred").drop("features")
        return out.withColumn("y_pred", inverse(F.col("y_pred"))) if inverse else out

    def importances(self) -> list[tuple[str, float]]:
        return sorted(zip(self.features, map(float, self.model.stages[-1].featureImportances.toArray())), key=lambda x: (-x[1], x[0]))

    def trees(self) -> str:
        """The trees as text; raises for models that have none."""
        return self.model.stages[-1].toDebugString

    def save(self, path: str) -> None:
        self.model.write().overwrite().save(path)

    def load(self, path: str) -> Forecaster:
        self.model = PipelineModel.load(path)
        return self


def cosine_rate(step: int, warmup: int, total: int, base: float) -> float:
    """Learning rate: linear warm-up, then a half cosine to zero."""
    from math import cos, pi

    return base * step / max(1, warmup) if step < warmup else base * 0.5 * (1 + cos(pi * min(1.0, (step - warmup) / max(1, total - warmup))))


def mlp_predict(df: DataFrame, x: str, layers: list[tuple[list[list[float]], list[float]]], out: str = "y_pred") -> DataFrame:
    """A stored fully connected network (ReLU between layers) over an array column, in Arrow batches."""
    import numpy as np

    weights = [(np.array(w), np.array(b)) for w, b in layers]

    @F.pandas_udf("double")
    def run(v: pd.Series) -> pd.Series:
        h = np.stack(v.to_numpy()).astype(float) if len(v) else np.zeros((0, len(weights[0][0])))
        for k, (w, b) in enumerate(weights):
            h = h @ w + b
            h = np.maximum(h, 0) if k + 1 < len(weights) else h
        return pd.Series(h.ravel())

    return df.withColumn(out, run(x))
