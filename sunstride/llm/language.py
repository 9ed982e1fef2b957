"""Language identification as mixture inference.

Each language is a distribution over hashed character trigrams, counted from labelled texts. A document's words are
draws from a mixture of languages: expectation-maximisation estimates the proportions from the words' n-gram
likelihoods, first over all languages, then over the most frequent k of them for k = 1, 2, ...; the set with the best
likelihood less half a logarithm of the number of words for each further language is kept. The prediction is the
language with the largest proportion in that set, and the score is that proportion.

Bounds: of each language the documents with the lowest share of seeded hashes that makes about ``rows`` fit the n-gram
counts, which executors add up; the model holds the counted trigrams of every language, so it grows with the number of
languages and not with the corpus. Every row is judged over its whole text; groups of texts share ``_CELLS`` likelihoods, a longer text has its own.
Defined results: null texts and those without a letter get ``und`` and score 0, as all do where nothing can be learned;
a language whose texts have no letter is a language that nothing favours; of equal proportions the language that is first by code point wins;
null identifiers are never learned from; repeated rows count and are judged each; extra columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .labelled import lean, lowest, remainder, scored, small_batches

_BUCKETS, _CACHE = 1 << 16, 400_000
_CELLS = 1 << 23  # likelihoods (words times languages) that are held at once


def letters(word: str) -> str:
    return "".join(filter(str.isalpha, word.lower()))


def grams(words: list[str]) -> np.ndarray:
    """Buckets of the trigrams of words between blanks, one for each letter, word after word; words have letters only."""
    c = np.frombuffer(f" {' '.join(words)} ".encode("utf-32-le"), "<u4").astype(np.uint64)
    h = (c[:-2] * np.uint64(0x9E3779B97F4A7C15) + c[1:-1]) * np.uint64(0xBF58476D1CE4E5B9) + c[2:]
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
    return (h >> np.uint64(48)).astype(np.int64)[c[1:-1] != 32]


def trigrams(word: str) -> list[int]:
    """Buckets of one word's trigrams; none without a letter."""
    w = letters(word)
    return grams([w]).tolist() if w else []


class Model:
    """Languages in order and, by bucket, the log-probabilities of those that have it; others have their language's least."""

    def __init__(self, languages: list[str], lang: np.ndarray, bucket: np.ndarray, count: np.ndarray, smooth: float = 0.1, temper: float = 0.6):
        """``lang`` (its number), ``bucket`` and ``count`` side by side, each pair once."""
        self.languages, m = languages, len(languages)
        total = np.bincount(lang, weights=count, minlength=m)
        self.least = temper * (np.log(smooth) - np.log(total + smooth * _BUCKETS))
        order = np.lexsort((lang, bucket))
        self.lang, self.more = lang[order].astype(np.int32), temper * (np.log(count[order] + smooth) - np.log(smooth))
        self.begin = np.searchsorted(bucket[order], np.arange(_BUCKETS + 1))
        self.memo: dict[str, int] = {}
        self.used, self.table = 0, np.empty((1 << 12, m))  # likelihoods of remembered words, the greatest of each as 1

    def _likelihoods(self, bare: list[str]) -> np.ndarray:
        """(word, language); words have letters only."""
        g, n, m = grams(bare), np.array([len(b) for b in bare]), len(self.languages)
        first, many = self.begin[g], self.begin[g + 1] - self.begin[g]
        at = np.repeat(first - np.append(0, np.cumsum(many)[:-1]), many) + np.arange(many.sum())
        cell = np.repeat(np.repeat(np.arange(len(bare)), n) * m, many) + self.lang[at]
        sums = np.bincount(cell, weights=self.more[at], minlength=len(bare) * m).reshape(-1, m) + n[:, None] * self.least
        return np.exp(sums - sums.max(axis=1, keepdims=True))

    def learn(self, words: list[str]) -> None:
        """Adds words to the memo: their rows in the table, or -1 for those without a letter."""
        step = max(1, _CELLS // 16 // len(self.languages))
        for i in range(0, len(words), step):
            part = words[i : i + step]
            bare = [letters(w) for w in part]
            kept = [b for b in bare if b]
            while self.used + len(kept) > len(self.table):
                self.table = np.concatenate([self.table, np.empty_like(self.table)])
            if kept:
                self.table[self.used : self.used + len(kept)] = self._likelihoods(kept)
            for w, b in zip(part, bare):
                self.memo[w] = self.used if b else -1
                self.used += bool(b)

    def _some(self, counts: list[Counter]) -> tuple[np.ndarray, np.ndarray]:
        if len(self.memo) > min(_CACHE, _CELLS // len(self.languages)):
            self.memo, self.used, self.table = {}, 0, np.empty((1 << 12, len(self.languages)))
        self.learn(list(set().union(*counts) - self.memo.keys()))
        rows = [np.fromiter(map(self.memo.__getitem__, c), np.int64, len(c)) for c in counts]
        often = [np.fromiter(c.values(), float, len(c))[r >= 0] for c, r in zip(counts, rows)]
        rows = [r[r >= 0] for r in rows]
        n = np.array([len(r) for r in rows])
        out, has = np.zeros((len(self.languages), len(counts))), n > 0
        if has.any():
            out[:, has] = infer(np.ascontiguousarray(self.table[np.concatenate(rows)].T), n[has], np.concatenate(often))
        return out, has

    def __call__(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """For each text the proportions of the kept set (zero elsewhere), and whether it has a letter."""
        if not self.languages:
            return np.zeros((0, len(texts))), np.zeros(len(texts), bool)
        found, group, cells = [(np.zeros((len(self.languages), 0)), np.zeros(0, bool))], [], 0
        for t in texts:
            c = Counter((t or "").split())
            if group and cells + len(c) * len(self.languages) > _CELLS:
                found.append(self._some(group))
                group, cells = [], 0
            group.append(c)
            cells += len(c) * len(self.languages)
        if group:
            found.append(self._some(group))
        return np.concatenate([f[0] for f in found], axis=1), np.concatenate([f[1] for f in found])


def _em(like: np.ndarray, starts: np.ndarray, n: np.ndarray, often: np.ndarray, allowed: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Proportions [languages, texts] and log-likelihoods, over the allowed languages of each text."""
    pi, total = allowed / allowed.sum(axis=0), np.add.reduceat(often, starts)
    for _ in range(rounds):
        joint = np.repeat(pi, n, axis=1)
        joint *= like
        joint *= often / np.maximum(joint.sum(axis=0), 1e-300)
        pi = np.add.reduceat(joint, starts, axis=1) / total
    return pi, _fit(like, starts, n, often, pi)


def _fit(like: np.ndarray, starts: np.ndarray, n: np.ndarray, often: np.ndarray, pi: np.ndarray) -> np.ndarray:
    return np.add.reduceat(often * np.log(np.maximum((like * np.repeat(pi, n, axis=1)).sum(axis=0), 1e-300)), starts)


def infer(like: np.ndarray, n: np.ndarray, often: np.ndarray | None = None, rounds: int = 8) -> np.ndarray:
    """Proportions of each text; ``like`` holds its words' likelihoods side by side, ``n`` how many different words each has, ``often`` how often each occurs."""
    often = np.ones(like.shape[1]) if often is None else often
    starts = np.append(0, np.cumsum(n)[:-1])
    total = np.add.reduceat(often, starts)
    pi, _ = _em(like, starts, n, often, np.ones((len(like), len(n))), rounds)
    rank = np.argsort(np.argsort(-pi, axis=0, kind="stable"), axis=0, kind="stable")
    best = (rank == 0).astype(float)
    fit = _fit(like, starts, n, often, best)
    open_ = np.arange(len(n))  # texts whose set may still grow
    for k in range(2, len(like) + 1):
        least = np.sort(pi[:, open_], axis=0)[-k]
        open_ = open_[least * total[open_] > 0.5]
        if not len(open_):
            break
        take = np.concatenate([np.arange(starts[i], starts[i] + n[i]) for i in open_])
        m, size = n[open_], total[open_]
        got, ll = _em(like[:, take], np.append(0, np.cumsum(m)[:-1]), m, often[take], (rank[:, open_] < k).astype(float), 2 * rounds)
        better = ll - 0.5 * np.log(size + 1) > fit[open_]
        best[:, open_[better]], fit[open_[better]] = got[:, better], ll[better] - 0.5 * np.log(size[better] + 1)
        open_ = open_[better]
    return best


def _counted(texts: DataFrame) -> DataFrame:
    """(lang, bucket, n): the trigrams of rows of lang and text, added up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, np.ndarray] = {}
        memo: dict[str, list[int]] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            for name, row in counts.items():
                at = np.flatnonzero(row)
                if len(at):
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(row[at], pa.int64())], ["lang", "bucket", "n"])
            counts.clear()

        for b in batches:
            for name, body in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if len(memo) > _CACHE:
                    memo.clear()
                found: list[int] = []
                for w, k in Counter(body.split()).items():
                    g = memo.get(w)
                    if g is None:
                        g = memo[w] = trigrams(w)
                    found.extend(g * k)
                if name not in counts and len(counts) >= 64:  # partial counts: they are added up after the shuffle
                    yield from flush()
                row = counts.setdefault(name, np.zeros(_BUCKETS, np.int64))
                if found:
                    row += np.bincount(found, minlength=_BUCKETS)
        yield from flush()

    return texts.mapInArrow(lean(run), "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


def fit(docs: DataFrame, learn: Column, text: str = "text", lang: str = "lang", ident: str = "doc_id", rows: int = 1500) -> Model:
    """Trigram counts by language, each from about ``rows`` documents."""
    spark = docs.sparkSession
    small_batches(spark)
    known = docs.where(learn & F.col(lang).isNotNull() & F.col(text).isNotNull() & F.col(ident).isNotNull())
    known = known.select(F.col(lang).cast("string").alias("lang"), F.col(text).alias("text"), F.xxhash64(F.lit(4), ident).alias("near"))
    sizes = known.groupBy("lang").count().toArrow()  # a row a language
    names = sorted(sizes["lang"].to_pylist())
    if not names:
        return Model([], *(np.zeros(0, np.int64),) * 3)
    cuts = [(n, lowest(1.05 * rows / k)) for n, k in zip(sizes["lang"].to_pylist(), sizes["count"].to_pylist())]
    drawn = known.join(F.broadcast(spark.createDataFrame(cuts, "_lang string, cut long")), F.col("lang") == F.col("_lang")).where("near <= cut").select("lang", "text")
    found, number = _counted(drawn).toArrow(), {n: i for i, n in enumerate(names)}
    at = np.fromiter(map(number.__getitem__, found["lang"].to_pylist()), np.int64, found.num_rows)
    return Model(names, at, found["bucket"].to_numpy().astype(np.int64), found["n"].to_numpy().astype(float))


def identified(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score and n_languages (size of the kept set) of every document."""
    held = remainder("doc_id", 3) == 1
    sent = docs.sparkSession.sparkContext.broadcast(fit(docs, ~held))

    def of(texts: list[str | None]) -> dict[str, np.ndarray]:
        model = sent.value
        share, has = model(texts)
        if not model.languages:
            return {"lang_pred": np.array(["und"] * len(texts)), "score": np.zeros(len(texts)), "n_languages": np.zeros(len(texts), np.int32)}
        top = share.argmax(axis=0)
        names = np.array([*model.languages, "und"])[np.where(has, top, len(model.languages))]
        return {"lang_pred": names, "score": np.where(has, share.max(axis=0), 0.0).clip(0, 1), "n_languages": (share > 0.005).sum(axis=0).astype(np.int32)}

    found = scored(docs, of, "lang_pred string, score double, n_languages int", "doc_id", "text")
    return found.select("doc_id", held.alias("held_out"), "lang_pred", "score", "n_languages")
