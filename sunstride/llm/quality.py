"""Quality classifier: random-indexing word vectors, a two-layer numpy network, temperature calibration.

A word gives two items: its bare lower-case form and its look (case, marks around it, whether it repeats the word
before). Each item has a sparse random index vector; the index vectors of its neighbours, summed over the sample, make
its context vector. A text is the mean of its items' vectors over their occurrences, joined with the mean over its
different words. The network is trained on the sample, the temperature on a part that training didn't see.

Bounds: ``rows`` labelled rows, spread by a seeded hash, fit everything; items share 2**14 buckets. Every row is scored
over its whole text. Defined results: null and empty texts have the zero vector and the score that the network gives it;
without labels every score is 0.5; null identifiers are never learned from; of a document's conflicting labels the lower
counts; rows that repeat an identifier are learned from once and scored each; extra columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

from zlib import crc32

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from .labelled import draw, remainder, scored

_BUCKETS, _SIZE, _ONES, _CACHE = 1 << 14, 48, 6, 200_000


def items(word: str) -> tuple[int, int]:
    """Buckets of a word's bare form (lower half) and of its look (upper half)."""
    a, b = 0, len(word)
    while a < b and not word[a].isalnum():
        a += 1
    while b > a and not word[b - 1].isalnum():
        b -= 1
    bare = word[a:b]
    case = "N" if not bare else "U" if len(bare) > 1 and bare.isupper() else "T" if bare[:1].isupper() else "D" if bare.isdigit() else "l"
    look = f"{word[:a][:3]} {case} {word[b:][:3]}"
    half = _BUCKETS // 2
    return crc32(bare.lower().encode()) % half, half + crc32(look.encode()) % (half - 2)


class Words:
    """From a text to its item buckets, in order."""

    def __init__(self):
        self.memo: dict[str, tuple[int, int]] = {}

    def __call__(self, text: str | None) -> np.ndarray:
        """Two rows (form, look) by word; the look of a word that repeats the one before is the last bucket."""
        words = (text or "").split()
        if len(self.memo) > _CACHE:
            self.memo.clear()
        memo = self.memo
        flat = []
        for w in words:
            got = memo.get(w)
            if got is None:
                got = memo[w] = items(w)
            flat.append(got)
        out = np.array(flat, dtype=np.int32).reshape(-1, 2)
        same = out[1:, 0] == out[:-1, 0]
        out[1:][same, 1] = _BUCKETS - 1
        return out


def index_vectors(seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of the ones of each bucket's index vector."""
    pick = np.random.default_rng(seed)
    return pick.integers(0, _SIZE, (_BUCKETS, _ONES)), pick.choice([-1.0, 1.0], (_BUCKETS, _ONES))


def word_vectors(texts: list[np.ndarray]) -> np.ndarray:
    """Each bucket's index vector plus the direction of what stands within two words of it."""
    place, sign = index_vectors()
    context = np.zeros(_BUCKETS * _SIZE)
    for t in texts:
        for step in (1, 2):
            if len(t) > step:
                for me, near in ((t[step:], t[:-step]), (t[:-step], t[step:])):
                    for k in range(2):
                        at = (me[:, k][:, None].astype(np.int64) * _SIZE + place[near[:, k]]).ravel()
                        np.add.at(context, at, sign[near[:, k]].ravel())
    context = context.reshape(_BUCKETS, _SIZE)
    own = np.zeros((_BUCKETS, _SIZE))
    np.add.at(own, (np.repeat(np.arange(_BUCKETS), _ONES), place.ravel()), sign.ravel())
    norm = lambda x: x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)
    return (norm(own) + norm(context)).astype(np.float32)


def pooled(texts: list[np.ndarray], vectors: np.ndarray) -> np.ndarray:
    """Three means for each text: of forms, of looks, and of forms counted once."""
    out = np.zeros((len(texts), 3 * _SIZE), dtype=np.float32)
    for i, t in enumerate(texts):
        if len(t):
            n = np.bincount(t.ravel(), minlength=_BUCKETS)
            seen = np.flatnonzero(n)
            cut = np.searchsorted(seen, _BUCKETS // 2)
            form, look = seen[:cut], seen[cut:]
            v = vectors[form]
            out[i, :_SIZE] = n[form] @ v / len(t)
            out[i, _SIZE : 2 * _SIZE] = n[look] @ vectors[look] / len(t)
            out[i, 2 * _SIZE :] = v.mean(axis=0) * np.sqrt(len(form) / len(t))
    return out


class Network:
    """One hidden layer, trained by Adam under the logistic loss; probabilities at a temperature."""

    def __init__(self, x: np.ndarray, y: np.ndarray, hidden: int = 24, epochs: int = 60, rate: float = 3e-3, decay: float = 1e-4, seed: int = 7):
        pick = np.random.default_rng(seed)
        self.mean, self.std = x.mean(axis=0), x.std(axis=0) + 1e-4
        x = (x - self.mean) / self.std
        hold = pick.random(len(x)) < 0.15
        hold &= len(x) >= 40
        tx, ty, hx, hy = x[~hold], y[~hold], x[hold], y[hold]
        w = self.w = [pick.normal(0, np.sqrt(2 / x.shape[1]), (x.shape[1], hidden)), np.zeros(hidden), pick.normal(0, np.sqrt(1 / hidden), hidden), np.zeros(1)]
        m, v, t = [np.zeros_like(p) for p in w], [np.zeros_like(p) for p in w], 0
        for _ in range(epochs):
            order = pick.permutation(len(tx))
            for at in range(0, len(order), 128):
                b = order[at : at + 128]
                h = np.maximum(tx[b] @ w[0] + w[1], 0)
                g = (1 / (1 + np.exp(-np.clip(h @ w[2] + w[3], -40, 40))) - ty[b]) / len(b)
                gh = np.outer(g, w[2]) * (h > 0)
                t += 1
                for k, grad in enumerate((tx[b].T @ gh + decay * w[0], gh.sum(axis=0), h.T @ g + decay * w[2], g.sum(keepdims=True))):
                    m[k] = 0.9 * m[k] + 0.1 * grad
                    v[k] = 0.999 * v[k] + 0.001 * grad**2
                    w[k] -= rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
        self.temperature = 1.0
        if len(hy) and 0 < hy.mean() < 1:
            z, sign = self._logit(hx), 2 * hy - 1
            self.temperature = float(min(np.geomspace(0.25, 8, 71), key=lambda s: np.logaddexp(0, -sign * z / s).mean()))

    def _logit(self, x: np.ndarray) -> np.ndarray:
        return np.maximum(x @ self.w[0] + self.w[1], 0) @ self.w[2] + self.w[3]

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self._logit((x - self.mean) / self.std) / self.temperature, -40, 40)))


def fit(docs: DataFrame, labels: DataFrame, learn: Column, text: str = "text", ident: str = "doc_id", label: str = "quality", rows: int = 8000) -> tuple[np.ndarray, Network] | None:
    """Word vectors and network from at most ``rows`` labelled rows; None without any."""
    known = labels.where(F.col(label).isin(0, 1) & learn)
    drawn = draw(docs, known, rows, label, ident, text=text)
    words, sets, y = Words(), [], []
    for _, body, mark in drawn.orderBy(F.xxhash64(F.lit(8), ident), text).toLocalIterator():
        sets.append(words(body))
        y.append(mark)
    if not y:
        return None
    vectors = word_vectors(sets)
    return vectors, Network(pooled(sets, vectors), np.array(y, dtype=float))


def judged(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    held = remainder("doc_id", 4) == 2
    sent = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, ~held))
    memo: list = []

    def of(texts: list[str | None]) -> dict[str, np.ndarray]:
        if not memo:
            memo.append(Words())
        if sent.value is None:
            return {"score": np.full(len(texts), 0.5)}
        vectors, network = sent.value
        return {"score": network(pooled([memo[0](t) for t in texts], vectors)).astype(float)}

    found = scored(docs, of, "score double", "doc_id", "text")
    return found.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
