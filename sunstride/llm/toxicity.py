"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic texts are the positives; rows drawn from all training rows, whatever their label, are unlabelled. A text
is the vector of its different words' root counts over the root of its length, and a word adds its value to the buckets of
its bare form and of its beginnings (so inflected forms meet), among 2**20. Every bucket enters the learner at the scale of its log
ratio between positives and unlabelled, shrunk by two standard errors and by ``shrink`` (else a language that positives
favour would speak through thousands of buckets); rows of a sample whose least or greatest shingle hash is the same are
near copies and count once. Scores that folds give each other
estimate the class prior, and the slope and the bias at which training begins; numpy then minimises
pi * R_p(+) + max(0, R_u(-) - pi * R_p(-))  over the weights of all buckets, by Adam.

Bounds: ``positives`` and ``unlabelled`` rows at most are used to fit. Every row is scored over its whole text.
Defined results: null and empty texts get the score of a text without any bucket; without positives, or without a bucket that
tells them apart, every score is 0; a null identifier counts as not held out and is never learned from; a document with both
labels is a positive; rows that repeat an identifier are learned from once and scored each; extra columns are not read;
an empty table gives an empty result.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from math import sqrt
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import local_table, settled
from .jaccard import Shingler
from .labelled import draw, lean, remainder, scored, small_batches

_EDGE = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum()) + "«»„“”‘’¡¿…–—"
_CACHE, _BUCKETS, _FOLDS = 60_000, 1 << 20, 3


def word_features(word: str) -> tuple[int, ...]:
    """Buckets of the bare lower-case word and of its beginnings of 4 to 7 characters."""
    w = word.strip(_EDGE).lower()
    return tuple(crc32(x.encode()) % _BUCKETS for x in (w, *(w[:n] + "*" for n in range(4, 8) if len(w) >= n))) if w else ()


class _Features(dict):
    def __missing__(self, word: str) -> tuple[int, ...]:
        self[word] = found = word_features(word)
        return found


def vector(text: str | None, features: _Features) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of a text in order and their values."""
    if len(features) > _CACHE:  # only a memo
        features.clear()
    count = Counter((text or "").split())
    each = list(map(features.__getitem__, count))
    flat = np.fromiter((f for e in each for f in e), np.int32, sum(map(len, each)))
    value = np.repeat(np.sqrt(np.fromiter(count.values(), float, len(count)) / max(1, sum(count.values()))), [len(e) for e in each])
    found, at = np.unique(flat, return_inverse=True)
    return found, np.bincount(at, weights=value, minlength=len(found)).astype(np.float32)


def _vectors(texts: DataFrame, ident: str) -> DataFrame:
    """(positive, fold, mark, low, high, bucket array, value array) of each row of text and positive; mark orders the rows, low and high are its least and greatest shingle hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features, shingles = _Features(), Shingler()
        for b in batches:
            texts = b.column(0).to_pylist()
            found = [vector(t, features) for t in texts]
            lists = [pa.array([f[k] for f in found], pa.list_(t)) for k, t in enumerate((pa.int32(), pa.float32()))]
            hashes = [shingles((t or "").encode()).view(np.int64) for t in texts]
            ends = [pa.array([int(h[k]) if len(h) else 0 for h in hashes], pa.int64()) for k in (0, -1)]
            yield pa.RecordBatch.from_arrays([*b.columns[1:], *ends, *lists], ["positive", "fold", "mark", "low", "high", "bucket", "value"])

    mark = F.xxhash64(F.lit(9), ident)
    rows = texts.select("text", "positive", F.pmod(mark, F.lit(_FOLDS)).cast("int"), mark)
    return rows.mapInArrow(lean(run), "positive int, fold int, mark long, low long, high long, bucket array<int>, value array<float>")


def _once(rows: DataFrame) -> DataFrame:
    """``rows`` of a sample without near copies of others: of equal ``low``, then of equal ``high``, the least mark stays. The sample is bounded, and so is its list of marks."""
    found = rows.select("positive", "low", "high", "mark").toArrow().to_pandas().sort_values("mark")
    for end in ("low", "high"):
        found = found.drop_duplicates(["positive", end])
    kept = local_table(rows.sparkSession, list(zip(found["positive"].tolist(), found["mark"].tolist())), "_positive int, _mark long")
    return rows.join(F.broadcast(kept), (F.col("positive") == F.col("_positive")) & (F.col("mark") == F.col("_mark"))).select("positive", "fold", "mark", "bucket", "value")


def _ratio(p: Column, u: Column, n_p: int, n_u: int, shrink: float) -> Column:
    """The log ratio of the shares of positives and unlabelled rows that have a bucket, shrunk towards 0."""
    ratio = F.log((p / n_p + 1 / n_p) / (u / n_u + 1 / n_p))
    return F.signum(ratio) * F.greatest(F.abs(ratio) - 2 * F.sqrt(1 / (p + 1) + 1 / (u + 1)) - shrink, F.lit(0.0))


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def class_prior(p: np.ndarray, u: np.ndarray) -> float:
    """The least ratio, over thresholds of a score, of unlabelled to positive texts above it: the share of positives that can be among the unlabelled."""
    best = 1.0
    for cut in np.unique(np.quantile(p, np.linspace(0.02, 0.9, 45))):
        a, b = np.mean(p >= cut), np.mean(u >= cut)
        best = min(best, (b + 1.0 / np.sqrt(len(u)) * np.sqrt(max(b * (1 - b), 1e-6))) / a)
    return float(np.clip(best, 1e-4, 0.5))


class Sparse:
    """Rows of (column, value) and their linear maps."""

    def __init__(self, cols: list[np.ndarray], values: list[np.ndarray], width: int):
        self.rows, self.width = len(cols), width
        self.col = np.concatenate([np.asarray(c, np.int64) for c in cols] or [np.zeros(0, np.int64)])
        self.value = np.concatenate([np.asarray(v, float) for v in values] or [np.zeros(0)])
        self.row = np.repeat(np.arange(len(cols)), [len(c) for c in cols])

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, weights=w[self.col] * self.value, minlength=self.rows)

    def back(self, g: np.ndarray) -> np.ndarray:
        return np.bincount(self.col, weights=g[self.row] * self.value, minlength=self.width)


def fit_nnpu(p: Sparse, u: Sparse, w: np.ndarray, bias: float, prior: float, rounds: int, rate: float | np.ndarray) -> tuple[np.ndarray, float]:
    """Weights and bias after ``rounds`` steps of Adam (``rate`` for each weight, its last entry for the bias) on the non-negative risk under the logistic loss."""
    w = np.append(w, bias)
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, rounds + 1):
        zp, zu = p.dot(w) + w[-1], u.dot(w) + w[-1]
        negative = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
        wrong, low, high = prior * sigmoid(-zp) / p.rows, prior * sigmoid(zp) / p.rows, sigmoid(zu) / u.rows
        gp, gu = (-wrong - low, high) if negative >= 0 else (low, -high)  # where the corrected risk falls below zero, only that is undone
        g = np.append(p.back(gp) + u.back(gu), gp.sum() + gu.sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-12)
    return w[:-1], float(w[-1])


class Model:
    """Buckets with a weight, their weights, the bias and the class prior."""

    def __init__(self, buckets: np.ndarray, weights: np.ndarray, bias: float, prior: float):
        self.buckets, self.weights, self.bias, self.prior = buckets, weights, bias, prior

    def scorer(self):
        weight = np.zeros(_BUCKETS)
        weight[self.buckets] = self.weights

        class Words(dict):
            def __missing__(self, word: str) -> float:
                self[word] = w = float(sum(weight[f] for f in word_features(word)))
                return w

        words = Words()

        def one(text: str | None) -> float:
            count = Counter((text or "").split())
            if not count:
                return 0.0
            has = np.fromiter(map(words.__getitem__, count), float, len(count))
            at = np.flatnonzero(has)
            if not len(at):
                return 0.0
            return float(has[at] @ np.sqrt(np.fromiter(count.values(), float, len(count))[at])) / sqrt(sum(count.values()))

        def score(texts: list[str | None]) -> dict[str, np.ndarray]:
            if not len(self.weights):
                return {"score": np.zeros(len(texts))}
            if len(words) > _CACHE:
                words.clear()
            return {"score": sigmoid(np.array([one(t) for t in texts]) + self.bias)}

        return score


def fit(docs: DataFrame, labels: DataFrame, learn: Column, text: str = "text", ident: str = "doc_id", label: str = "toxic", positives: int = 6000, unlabelled: int = 12000, shrink: float = 0.4, rounds: int = 200) -> Model:
    """``learn`` says, from the identifier, which rows may be learned from."""
    nothing = Model(np.zeros(0, np.int64), np.zeros(0), 0.0, 0.0)
    small_batches(docs.sparkSession)
    own = docs.select(ident, F.col(text).alias("text")).where(learn)
    known = draw(own, labels.where((F.col(label) == 1) & learn), positives, None, ident).select(ident, "text", F.lit(1).alias("positive"))
    other = draw(own, own, unlabelled, None, ident, seed=6).select(ident, "text", F.lit(0).alias("positive"))
    rows = _once(settled(_vectors(known.unionByName(other), ident), "toxic-vectors"))
    sizes = {(r[0], r[1]): r[2] for r in rows.groupBy("positive", "fold").agg(F.count(F.lit(1))).collect()}
    n = [[sizes.get((y, k), 0) for k in range(_FOLDS)] for y in (0, 1)]
    if any(min(x) == 0 for x in n):  # a fold without either kind
        return nothing
    counts = rows.select("positive", "fold", F.explode("bucket").alias("bucket")).groupBy("bucket").agg(
        *(F.count_if((F.col("positive") == y) & (F.col("fold") == k)).alias(f"c{y}{k}") for y in (0, 1) for k in range(_FOLDS))
    )

    def scale(without: int | None) -> Column:
        count = lambda y: sum((F.col(f"c{y}{k}") for k in range(_FOLDS) if k != without), F.lit(0))
        size = lambda y: sum(x for k, x in enumerate(n[y]) if k != without)
        return _ratio(count(1), count(0), size(1), size(0), shrink)

    scales = counts.select("bucket", *(scale(k).alias(f"s{k}") for k in range(_FOLDS)), scale(None).alias("s"))
    live = scales.where(" OR ".join(f"{c} <> 0" for c in scales.columns[1:])).orderBy("bucket").toArrow()  # 2**20 buckets at most
    buckets = live["bucket"].to_numpy()
    if not len(buckets):
        return nothing
    sent = docs.sparkSession.sparkContext.broadcast(buckets)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            flat, value = (b.column(k).flatten().to_numpy(zero_copy_only=False) for k in (3, 4))
            row = np.repeat(np.arange(b.num_rows), b.column(3).value_lengths().to_numpy(zero_copy_only=False))
            at = np.minimum(np.searchsorted(sent.value, flat), len(sent.value) - 1)
            has = sent.value[at] == flat
            ends = np.append(0, np.cumsum(np.bincount(row[has], minlength=b.num_rows))).astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(x[has], t)) for x, t in ((at, pa.int32()), (value, pa.float32()))]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], *lists], ["positive", "fold", "mark", "bucket", "value"])

    found = rows.mapInArrow(lean(run), rows.schema).toArrow()
    order = np.lexsort((found["mark"].to_numpy(), found["positive"].to_numpy()))
    positive, fold = (found[c].to_numpy()[order] for c in ("positive", "fold"))
    cols, values = (found[c].to_numpy()[order] for c in ("bucket", "value"))
    p, u = (Sparse(list(cols[positive == y]), list(values[positive == y]), len(buckets)) for y in (1, 0))
    zp, zu = np.zeros(p.rows), np.zeros(u.rows)
    for k in range(_FOLDS):
        s = live[f"s{k}"].to_numpy()
        for rows_, z, f in ((p, zp, fold[positive == 1]), (u, zu, fold[positive == 0])):
            z[f == k] = rows_.dot(s)[f == k]
    prior = class_prior(zp, zu)
    middle, spread = zu.mean(), np.concatenate([zp, zu]).std() + 1e-9
    flat_p, flat_u = (Sparse([np.zeros(1, int)] * len(z), [np.array([x]) for x in (z - middle) / spread], 1) for z in (zp, zu))
    slope, bias = fit_nnpu(flat_p, flat_u, np.ones(1), float(np.log(prior / (1 - prior))), prior, 300, 0.1)
    slope = max(float(slope[0]), 0.01) / spread
    s = live["s"].to_numpy()
    use = np.flatnonzero(s)
    place = np.full(len(buckets), -1)
    place[use] = np.arange(len(use))

    def scaled(x: Sparse) -> Sparse:
        keep = place[x.col] >= 0
        x.col, x.value, x.row, x.width = place[x.col[keep]], (x.value * s[x.col])[keep], x.row[keep], len(use)
        return x

    if not len(use):
        return nothing
    rate = np.append(np.full(len(use), 0.03 * slope), 0.03)
    weights, bias = fit_nnpu(scaled(p), scaled(u), np.full(len(use), slope), bias - slope * middle, prior, rounds, rate)
    return Model(buckets[use], weights * s[use], bias, prior)


def score(docs: DataFrame, model: Model, text: str = "text", ident: str = "doc_id") -> DataFrame:
    """The identifier and the score of every row."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    memo: list = []

    def of(texts: list[str | None]) -> dict[str, np.ndarray]:
        if not memo:
            memo.append(sent.value.scorer())
        return memo[0](texts)

    return scored(docs, of, "score double", ident, text)


def judged(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    held = remainder("doc_id", 3) == 1
    found = score(docs, fit(docs, labels, ~held))
    return found.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """``docs`` without the rows that are scored ``threshold`` or more; columns and texts stay."""
    model = fit(docs, labels, remainder("doc_id", 3) != 1)
    sent, columns = docs.sparkSession.sparkContext.broadcast(model), docs.columns
    memo: list = []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not memo:
                memo.append(sent.value.scorer())
            yield b.filter(pa.array(memo[0](b.column("text").to_pylist())["score"] < threshold))

    return docs.mapInArrow(lean(run), docs.schema).select(*columns)
