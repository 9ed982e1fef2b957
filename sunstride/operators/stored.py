"""Stored neural forecasters applied to tables: an encoder over histories (or over their patches), and a convolutional net over image stacks.

Weights are mappings from names to arrays, trained elsewhere; a task applies them to an Arrow batch at a time. Dropout is
no part of applying a network, and batch normalisation uses its stored statistics.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from math import erf, sqrt

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from .sequence import positions

Weights = Mapping[str, np.ndarray]
_erf = np.vectorize(erf, otypes=[float])


def gelu(x: np.ndarray) -> np.ndarray:
    return 0.5 * x * (1 + _erf(x / sqrt(2)))


def normed(x: np.ndarray, gain: np.ndarray, shift: np.ndarray, eps: float = 1e-5) -> np.ndarray:
    """Over the last axis, with the population variance."""
    d = x - x.mean(axis=-1, keepdims=True)
    return d / np.sqrt((d * d).mean(axis=-1, keepdims=True) + eps) * gain + shift


def attention(x: np.ndarray, w: Weights, heads: int) -> np.ndarray:
    """Self-attention over the middle axis of (batch, step, width)."""
    n, steps, width = x.shape
    parts = [(x @ w[f"{k}.w"] + w[f"{k}.b"]).reshape(n, steps, heads, width // heads).transpose(0, 2, 1, 3) for k in ("query", "key", "value")]
    near = parts[0] @ parts[1].transpose(0, 1, 3, 2) / sqrt(width // heads)
    near = np.exp(near - near.max(axis=-1, keepdims=True))
    mixed = near / near.sum(axis=-1, keepdims=True) @ parts[2]
    return mixed.transpose(0, 2, 1, 3).reshape(n, steps, width) @ w["out.w"] + w["out.b"]


def encoder(x: np.ndarray, layers: Sequence[Weights], heads: int) -> np.ndarray:
    """Layers of attention and a two-layer net, each added to its input and normalised after."""
    for w in layers:
        x = normed(x + attention(x, w, heads), w["norm1.w"], w["norm1.b"])
        x = normed(x + gelu(x @ w["net1.w"] + w["net1.b"]) @ w["net2.w"] + w["net2.b"], w["norm2.w"], w["norm2.b"])
    return x


def sequence_forecast(x: np.ndarray, ends: Weights, layers: Sequence[Weights], heads: int) -> np.ndarray:
    """(batch, history, channels) to (batch, horizon): projected, sinusoidal positions added, encoded, averaged over time."""
    x = x @ ends["in.w"] + ends["in.b"]
    return encoder(x + np.array(positions(*x.shape[1:])), layers, heads).mean(axis=1) @ ends["head.w"] + ends["head.b"]


def patch_forecast(x: np.ndarray, ends: Weights, layers: Sequence[Weights], heads: int, size: int, stride: int, eps: float = 1e-5) -> np.ndarray:
    """(batch, history) to (batch, horizon): each window by its own mean and deviation, patches with learned positions encoded and read side by side, and back."""
    mean, dev = x.mean(axis=1, keepdims=True), np.sqrt(x.var(axis=1, keepdims=True) + eps)
    gain, shift = ends.get("gain", 1.0), ends.get("shift", 0.0)
    patches = np.lib.stride_tricks.sliding_window_view((x - mean) / dev * gain + shift, size, axis=1)[:, ::stride]
    z = encoder(patches @ ends["in.w"] + ends["in.b"] + ends["positions"], layers, heads)
    return ((z.reshape(len(x), -1) @ ends["head.w"] + ends["head.b"]) - shift) / gain * dev + mean


def convolved(x: np.ndarray, w: np.ndarray, b: np.ndarray) -> np.ndarray:
    """(batch, channel, height, width) by kernels (out, in, k, k), zeros around."""
    k = w.shape[-1] // 2
    seen = np.lib.stride_tricks.sliding_window_view(np.pad(x, ((0, 0), (0, 0), (k, k), (k, k))), w.shape[-2:], axis=(2, 3))
    return np.einsum("nihwkl,oikl->nohw", seen, w, optimize=True) + b[:, None, None]


def image_forecast(images: np.ndarray, history: np.ndarray, blocks: Sequence[Weights], dense: Sequence[tuple[np.ndarray, np.ndarray]], eps: float = 1e-5) -> np.ndarray:
    """Blocks of convolution, ReLU, stored normalisation and the maximum of 2 by 2; then the history beside, and dense layers with ReLU between."""
    for w in blocks:
        x = np.maximum(convolved(images, w["w"], w["b"]), 0)
        x = (x - w["mean"][:, None, None]) / np.sqrt(w["var"][:, None, None] + eps) * w["gain"][:, None, None] + w["shift"][:, None, None]
        n, c, h, v = x.shape
        images = x[:, :, : h // 2 * 2, : v // 2 * 2].reshape(n, c, h // 2, 2, v // 2, 2).max(axis=(3, 5))
    z = np.concatenate([images.reshape(len(images), -1), history], axis=1)
    for k, (w, b) in enumerate(dense):
        z = z @ w + b
        z = np.maximum(z, 0) if k + 1 < len(dense) else z
    return z


def applied(df: DataFrame, inputs: Sequence[tuple[str, Sequence[int]]], forecast: Callable[..., np.ndarray], out: str = "y_pred") -> DataFrame:
    """``out``, an array of what ``forecast`` gives for the inputs: flat array columns and their shapes. NULL where an input is."""

    @F.pandas_udf("array<double>")
    def run(*columns: pd.Series) -> pd.Series:
        ok = np.logical_and.reduce([c.notna().to_numpy() for c in columns])
        found: list = [None] * len(ok)
        if ok.any():
            arrays = [np.stack([np.asarray(v, float) for v in c[ok]]).reshape(-1, *shape) for c, (_, shape) in zip(columns, inputs)]
            for i, row in zip(np.flatnonzero(ok), forecast(*arrays)):
                found[i] = row
        return pd.Series(found, dtype=object)

    return df.withColumn(out, run(*(c for c, _ in inputs)))
