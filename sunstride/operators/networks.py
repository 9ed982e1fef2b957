"""A fully connected regressor (ReLU between layers), trained next to the data.

In each epoch every task trains on its own rows from the same weights, and the weights are averaged by the rows' weights:
one job an epoch, and what comes to the driver is a set of weights for each task, of which there are ``tasks`` at most.
Training stops after ``patience`` epochs without an improvement of the validation loss, and the best weights are kept.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .models import cosine_rate

Layers = list[tuple[np.ndarray, np.ndarray]]


def start(sizes: Sequence[int], seed: int) -> Layers:
    pick = np.random.default_rng(seed)
    return [(pick.normal(0, np.sqrt(2 / a), (a, b)), np.zeros(b)) for a, b in zip(sizes[:-1], sizes[1:])]


def forward(layers: Layers, x: np.ndarray) -> list[np.ndarray]:
    """The input and what follows each layer."""
    out = [x]
    for k, (w, b) in enumerate(layers):
        h = out[-1] @ w + b
        out.append(np.maximum(h, 0) if k + 1 < len(layers) else h)
    return out


def gradients(layers: Layers, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> Layers:
    """Of the weighted mean squared error."""
    hs, out = forward(layers, x), []
    g = 2 * (hs[-1][:, 0] - y)[:, None] * weight[:, None] / weight.sum()
    for k in reversed(range(len(layers))):
        out.append((hs[k].T @ g, g.sum(axis=0)))
        g = (g @ layers[k][0].T) * (hs[k] > 0)
    return out[::-1]


@dataclass
class Network:
    """``hidden`` layers; AdamW with warm-up and a cosine, gradients clipped to a norm; ``least`` is what counts as an improvement."""

    features: Sequence[str]
    hidden: Sequence[int] = (64, 64)
    label: str = "target_y"
    weight: str | None = None
    epochs: int = 60
    batch: int = 256
    rate: float = 3e-3
    decay: float = 1e-4
    clip: float = 1.0
    patience: int = 8
    least: float = 1e-6
    tasks: int = 32
    seed: int = 42
    layers: Layers = field(default_factory=list)
    last: Layers = field(default_factory=list)
    losses: list[float] = field(default_factory=list)

    def _rows(self, df: DataFrame) -> DataFrame:
        w = F.col(self.weight).cast("double") if self.weight else F.lit(1.0)
        own = df.na.drop(subset=[*self.features, self.label])
        return own.select(F.array(*(F.col(c).cast("double") for c in self.features)).alias("x"), F.col(self.label).cast("double").alias("y"), w.alias("w"))

    def fit(self, train: DataFrame, validation: DataFrame) -> Network:
        """Rows with a missing feature or label are skipped. Both tables are kept in memory or on disk of the executors while training lasts."""
        sets = [self._rows(train).coalesce(self.tasks).persist(), self._rows(validation).coalesce(self.tasks).persist()]
        try:
            n, mean, var = sets[0].agg(F.sum("w"), F.sum(F.col("w") * F.col("y")) / F.sum("w"), F.var_pop("y")).first()
            if not n:
                raise ValueError("no training rows")
            layers = start([len(self.features), *self.hidden, 1], self.seed)
            layers[-1][1][:] = mean
            self.layers, best, waited, self.losses = layers, float("inf"), 0, []
            for epoch in range(self.epochs):
                layers = self._epoch(sets[0], layers, epoch)
                loss = self._loss(sets[1], layers)
                self.losses.append(loss)
                if loss < best - self.least:
                    best, waited, self.layers = loss, 0, layers
                else:
                    waited += 1
                    if waited >= self.patience:
                        break
            self.last = layers
        finally:
            for s in sets:
                s.unpersist()
        return self

    def _epoch(self, rows: DataFrame, layers: Layers, epoch: int) -> Layers:
        rate, batch, decay, clip, seed = cosine_rate(epoch + 1, 3, self.epochs, self.rate), self.batch, self.decay, self.clip, self.seed

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own, total, t = [(w.copy(), b.copy()) for w, b in layers], 0.0, 0
            flat = [p for pair in own for p in pair]
            m, v = [np.zeros_like(p) for p in flat], [np.zeros_like(p) for p in flat]
            for part, b in enumerate(batches):
                if not b.num_rows:
                    continue
                x = np.stack(b.column(0).to_numpy(zero_copy_only=False))
                y, w = b.column(1).to_numpy(), b.column(2).to_numpy()
                order = np.random.default_rng([seed, epoch, part]).permutation(len(y))
                for at in np.split(order, range(batch, len(order), batch)):
                    if w[at].sum() <= 0:
                        continue
                    g = [p for pair in gradients(own, x[at], y[at], w[at]) for p in pair]
                    norm = np.sqrt(sum((p * p).sum() for p in g))
                    t += 1
                    for k, (p, d) in enumerate(zip(flat, g)):
                        d = d * min(1.0, clip / max(norm, 1e-12))
                        m[k], v[k] = 0.9 * m[k] + 0.1 * d, 0.999 * v[k] + 0.001 * d * d
                        p -= rate * (m[k] / (1 - 0.9**t) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8) + (decay * p if p.ndim > 1 else 0))
                total += w.sum()
            if total:
                yield pa.RecordBatch.from_arrays([pa.array([total]), pa.array([np.concatenate([p.ravel() for p in flat]).tobytes()], pa.binary())], ["n", "weights"])

        found = sorted((r["n"], bytes(r["weights"])) for r in rows.mapInArrow(run, "n double, weights binary").collect())
        mean = sum(n * np.frombuffer(raw) for n, raw in found) / sum(n for n, _ in found)
        out, at = [], 0
        for w, b in layers:
            out.append((mean[at : at + w.size].reshape(w.shape), mean[at + w.size : at + w.size + b.size].copy()))
            at += w.size + b.size
        return out

    def _loss(self, rows: DataFrame, layers: Layers) -> float:
        e = F.col("y") - _applied(layers)("x")
        got = rows.select((F.col("w") * e * e).alias("e"), "w").agg(F.sum("e") / F.sum("w")).first()[0]
        if got is None:
            raise ValueError("no validation rows")
        return got

    def predict(self, df: DataFrame, out: str = "y_pred") -> DataFrame:
        if not self.layers:
            raise RuntimeError("fit or load the network first")
        own = df.na.drop(subset=list(self.features))
        return own.withColumn(out, _applied(self.layers)(F.array(*(F.col(c).cast("double") for c in self.features))))

    def save(self, path: str, which: str = "best") -> None:
        """The best weights, or (``last``) those that training ended with."""
        layers = {"best": self.layers, "last": self.last}[which]
        with open(path, "w") as f:
            json.dump({"features": list(self.features), "losses": self.losses, "layers": [[w.tolist(), b.tolist()] for w, b in layers]}, f)

    @classmethod
    def load(cls, path: str) -> Network:
        with open(path) as f:
            saved = json.load(f)
        layers = [(np.array(w), np.array(b)) for w, b in saved["layers"]]
        return cls(saved["features"], [len(b) for _, b in layers[:-1]], layers=layers, last=layers, losses=saved["losses"])


def _applied(layers: Layers):
    @F.pandas_udf("double")
    def run(v: pd.Series) -> pd.Series:
        return pd.Series(forward(layers, np.stack(v.to_numpy()))[-1][:, 0] if len(v) else [], dtype=float)

    return run
