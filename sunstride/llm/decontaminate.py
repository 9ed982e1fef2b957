"""Benchmark decontamination with a BM25 index of test items and block-max WAND.

Test items are the indexed documents, passages of the training texts are the queries. Passages are as long as two of the
longest items and start an item's length apart, so an item's copy always lies whole in one of them. Impacts are divided
by the item's own score, so that one threshold holds for all items. A passage for which no block of items reaches the
threshold even with the largest impacts of its terms is settled for a whole batch at once by sums over the block maxima.
Others run document-at-a-time WAND with block maxima and full evaluation. Items above the threshold are verified: enough of the
word trigrams of both the question (all sentences but the last) and the answer (the last one) must occur in the passage.

Counts behind the scores (items, lengths, document frequencies) cover the whole benchmark. The index itself is built by
executors in parts of ``items_a_part`` items, which lie in the shared folder; a task of the one scan over the texts holds
one part at a time (all, if they are few), so neither a large benchmark nor the driver's memory bounds it, and the
result is the same for any number of parts. Long texts are screened by runs of passages.
Defined results: words are compared in lower case without marks around them; items without words match nothing, items
of one sentence have their last third as the answer; null and empty texts have no passage; repeated items, and items
with equal scores, are each found; repeated rows are each searched; an empty table gives an empty result; extra columns
are not read by ``contaminated``, and ``without_leaks`` keeps them, whatever their names.
"""

from __future__ import annotations

import pickle
import re
from collections import Counter
from collections.abc import Iterator
from math import log

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, functions as F

from .common import free, in_bloom, row_key, scratch, settled, spread, text_hash
from .labelled import lean, small_batches

_EDGE = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum()) + "«»„“”‘’¡¿…–—"
_MEMO = 100_000
_CELLS = 2_000_000  # sums (passages times blocks) that are held at once
_HELD, _CHUNK = 4, 32 << 20  # parts that a task keeps; characters of texts that it holds where there are more parts
_END = re.compile(r"(?<=[.!?])\s+")


def plain(text: str | None) -> list[str]:
    return [w for w in (x.strip(_EDGE).lower() for x in (text or "").split()) if w]


def grams(words: list[str], k: int = 3) -> set[tuple[str, ...]]:
    k = min(k, len(words))
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if k else set()


def question_answer(text: str) -> tuple[list[str], list[str]]:
    parts = [w for w in map(plain, _END.split(text)) if w]
    if len(parts) > 1:
        return [x for p in parts[:-1] for x in p], parts[-1]
    words = plain(text)
    cut = len(words) - max(1, len(words) // 3)
    return words[:cut], words[cut:]


class Index:
    """Postings by term: items in order with their share of the item's own score, largest shares of blocks and of the list."""

    def __init__(self, rows: list[tuple[int, str, dict[str, int]]], items: int, mean: float, longest: int, k1: float = 1.2, b: float = 0.75, block: int = 8):
        """Each row's identifier, text and, for its words, how many items of the whole benchmark have them; the other counts are of the whole benchmark, too."""
        self.ids, self.parts, self.own, self.longest = [], [], [], longest
        posts: dict[str, list[tuple[int, float]]] = {}
        for d, (ident, text, df) in enumerate(rows):
            words = plain(text)
            self.ids.append(ident), self.parts.append(tuple(map(grams, question_answer(text))))
            norm = k1 * (1 - b + b * len(words) / mean)
            part = {t: log(1 + (items - df[t] + 0.5) / (df[t] + 0.5)) * f * (k1 + 1) / (f + norm) for t, f in sorted(Counter(words).items())}
            self.own.append(sum(part.values()))
            for t, s in part.items():
                posts.setdefault(t, []).append((d, s / self.own[-1]))
        self.term = {t: i for i, t in enumerate(posts)}
        self.items = [np.array([d for d, _ in p]) for p in posts.values()]
        self.share = [np.array([s for _, s in p]) for p in posts.values()]
        self.block_last = [x[np.minimum(np.arange(block, len(x) + block, block), len(x)) - 1] for x in self.items]
        self.block_most = [np.maximum.reduceat(s, np.arange(0, len(s), block)) for s in self.share]
        self.most = np.array([s.max() for s in self.share] or [0.0])

    def above(self, terms: list[int], threshold: float) -> list[tuple[int, float]]:
        """Every item whose score for the query reaches the threshold, by block-max WAND."""
        end, out = len(self.ids), []
        cursors = [[0, t] for t in terms]  # place in the posting list, term
        at = lambda c: self.items[c[1]][c[0]] if c[0] < len(self.items[c[1]]) else end
        slack = threshold - 1e-9
        while True:
            cursors = sorted((c for c in cursors if at(c) < end), key=at)
            total, pivot = 0.0, -1
            for k, c in enumerate(cursors):
                total += self.most[c[1]]
                if total >= slack:
                    pivot = k
                    break
            if pivot < 0:
                return out
            d = at(cursors[pivot])
            while pivot + 1 < len(cursors) and at(cursors[pivot + 1]) == d:
                pivot += 1
            blocks = [(c, int(np.searchsorted(self.block_last[c[1]], d))) for c in cursors[: pivot + 1]]
            blocks = [(c, k) for c, k in blocks if k < len(self.block_last[c[1]])]  # else that list ends before d
            if sum(self.block_most[c[1]][k] for c, k in blocks) >= slack:
                if at(cursors[0]) == d:
                    score = sum(self.share[c[1]][c[0]] for c in cursors[: pivot + 1])
                    if score >= slack:
                        out.append((d, float(score)))
                    for c in cursors[: pivot + 1]:
                        c[0] += 1
                else:
                    for c in cursors[:pivot]:
                        if at(c) < d:
                            c[0] += int(np.searchsorted(self.items[c[1]][c[0] :], d))
            else:  # none before the first of these blocks ends, or the next list begins, can reach it
                to = min([int(self.block_last[c[1]][k]) + 1 for c, k in blocks] + ([at(cursors[pivot + 1])] if pivot + 1 < len(cursors) else []))
                to = max(to, d + 1)
                for c in cursors[: pivot + 1]:
                    c[0] += int(np.searchsorted(self.items[c[1]][c[0] :], to))


class _Terms(dict):
    """Term numbers of raw words: -1 for words that no item has, -2 for mere marks."""

    def __init__(self, term: dict[str, int]):
        super().__init__()
        self.term = term

    def __missing__(self, word: str) -> int:
        bare = word.strip(_EDGE).lower()
        self[word] = k = self.term.get(bare, -1) if bare else -2
        return k


class Search:
    """Batches of texts against an index."""

    def __init__(self, index: Index, threshold: float, question: float, answer: float, entries: int = 8_000_000):
        self.index, self.threshold, self.question, self.answer = index, threshold, question, answer
        self.terms, self.step = _Terms(index.term), max(1, index.longest)
        # the block maxima of all lists as one matrix of a bounded size: (term, block of items)
        block = 2
        while len(index.items) * -(-len(index.ids) // block) > entries:
            block *= 2
        self.most = np.zeros((len(index.items), max(1, -(-len(index.ids) // block))), np.float32)
        for t, (d, share) in enumerate(zip(index.items, index.share)):
            np.maximum.at(self.most[t], d // block, share)

    def _open(self, terms: list[np.ndarray]) -> list[tuple[int, int]]:
        """(text, passage) where some block's largest shares, a term counting once in each half, reach the threshold."""
        halves = [-(-len(t) // self.step) for t in terms]
        text = np.repeat(np.arange(len(terms)), halves)
        first = np.append(0, np.cumsum(halves))
        at = np.concatenate([np.arange(len(t)) // self.step + f for t, f in zip(terms, first)])
        flat = np.concatenate(terms)
        key = np.unique((at * len(self.most) + flat)[flat >= 0])
        if not len(key):
            return []
        half, term = np.divmod(key, len(self.most))
        follows = np.append(text[1:] == text[:-1], False)
        starts = follows | (np.arange(len(text)) == first[text])  # the last half has a passage of its own only where it is the only one
        out, run = [], max(1, _CELLS // self.most.shape[1])
        for low in range(0, len(text), run):  # so many passages at once; a run's last one reaches into the next run's first half
            high = min(low + run, len(text))
            i, j = np.searchsorted(half, (low, high + 1))
            sums = np.zeros((high - low + 1, self.most.shape[1]), np.float32)
            if j > i:
                seen, begin = np.unique(half[i:j], return_index=True)
                for k in range(0, len(seen), run):
                    end = begin[k + run] if k + run < len(seen) else j - i
                    sums[seen[k : k + run] - low] = np.add.reduceat(self.most[term[i + begin[k] : i + end]], begin[k : k + run] - begin[k], axis=0)
            bound = (sums[:-1] + np.where(follows[low:high, None], sums[1:], 0)).max(axis=1)
            out.append(low + np.flatnonzero(starts[low:high] & (bound >= self.threshold - 1e-4)))
        found = np.concatenate(out)
        return list(zip(text[found].tolist(), (found - first[text[found]]).tolist()))

    def __call__(self, texts: list[str | None]) -> Iterator[tuple[int, int, float, float, float, int]]:
        """(text, item, its BM25, question overlap, answer overlap, first word of the passage), the best passage of each item."""
        ix, step, slack = self.index, self.step, self.threshold - 1e-9
        if len(self.terms) > _MEMO:
            self.terms.clear()
        raw = [(t or "").split() for t in texts]
        terms = [np.fromiter(map(self.terms.__getitem__, r), np.int64, len(r)) for r in raw]
        terms = [t[t != -2] for t in terms]
        best: dict[tuple[int, int], tuple] = {}
        for i, h in self._open(terms) if ix.ids and texts else ():
            s = h * step
            part = np.unique(terms[i][s : s + 2 * step])
            part = part[part >= 0]
            if self.most[part].sum(axis=0).max() < self.threshold - 1e-4:
                continue
            found = ix.above(part.tolist(), self.threshold)
            if found:
                has = grams([w for w in (x.strip(_EDGE).lower() for x in raw[i]) if w][s : s + 2 * step])
                small = {g[j : j + k] for g in has for k in (1, 2) for j in range(len(g) - k + 1)}
                for d, score in found:
                    q, a = (len([g for g in p if g in has or g in small]) / len(p) if p else 1.0 for p in ix.parts[d])
                    if q >= self.question and a >= self.answer and score >= slack and (score, q, a) > best.get((i, d), (0,))[:3]:
                        best[i, d] = (score, q, a, s)
        for (i, d), (score, q, a, s) in best.items():
            yield i, ix.ids[d], score * ix.own[d], q, a, s


def _parts(benchmark: DataFrame, items_a_part: int) -> list[str]:
    """Paths of the index's parts; none for a benchmark without words."""
    spark = benchmark.sparkSession
    kind = benchmark.schema["item_id"].dataType.simpleString()

    def terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words = [plain(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([len(w) for w in words], pa.int64()), pa.array([sorted(set(w)) for w in words], pa.list_(pa.string()))], ["item_id", "text", "length", "terms"])

    items = benchmark.where("text IS NOT NULL").select("item_id", "text").mapInArrow(lean(terms), f"item_id {kind}, text string, length long, terms array<string>")
    items = settled(items.where("length > 0").withColumn("no", F.monotonically_increasing_id()), "benchmark-items")
    n, mean, longest = items.agg(F.count(F.lit(1)), F.avg("length"), F.max("length")).first()
    if not n:
        return []
    parts, folder = -(-n // items_a_part), scratch(spark, "benchmark-index")
    each = items.select("no", F.explode("terms").alias("term"))
    counted = each.join(each.groupBy("term").agg(F.count(F.lit(1)).alias("df")), "term").groupBy("no").agg(F.map_from_entries(F.collect_list(F.struct("term", "df"))).alias("df"))
    rows = items.join(counted, "no").withColumn("part", F.pmod(F.xxhash64("no"), F.lit(parts)).cast("int"))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for b in batches:
            for part, *row in zip(*(c.to_pylist() for c in b.columns)):
                held.setdefault(part, []).append((row[0], row[1], dict(row[2])))
        store, base = fs.FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)
        for part, found in held.items():
            found.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
            with store.open_output_stream(f"{base}/part-{part}", compression=None) as f:  # the same bytes in any attempt
                f.write(pickle.dumps(Index(found, n, mean, longest)))
            yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/part-{part}"])], ["path"])

    dealt = rows.select("part", "item_id", "text", "df").repartitionById(min(parts, 10_000), F.pmod("part", F.lit(min(parts, 10_000))))
    return sorted(r[0] for r in dealt.mapInArrow(lean(build), "path string").collect())


def _load(path: str) -> Index:
    store, at = fs.FileSystem.from_uri(path)
    with store.open_input_file(at) as f:
        return pickle.loads(f.read())


def contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text", ident: str = "doc_id", threshold: float = 0.5, question: float = 0.6, answer: float = 0.5, items_a_part: int = 20_000) -> DataFrame:
    """(ident, item_id, bm25, question_overlap, answer_overlap, first_word) for each item that a row contains."""
    spark = docs.sparkSession
    small_batches(spark)
    kind, item_kind = docs.schema[ident].dataType.simpleString(), benchmark.schema["item_id"].dataType.simpleString()
    schema = f"`{ident}` {kind}, item_id {item_kind}, bm25 double, question_overlap double, answer_overlap double, first_word long"
    parts = _parts(benchmark, items_a_part)
    if not parts:
        return spark.createDataFrame([], schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[str, Search] = {}

        def search(path: str) -> Search:
            if path in kept:
                return kept[path]
            found = Search(_load(path), threshold, question, answer)
            if len(parts) <= _HELD:
                kept[path] = found
            return found

        def found(ids: pa.Array, texts: list[str | None]) -> Iterator[pa.RecordBatch]:
            names = ids.to_pylist()
            for path in parts:
                hits = [(names[i], *hit) for i, *hit in search(path)(texts)]
                if hits:
                    cols = list(zip(*hits))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(cols[0], ids.type), pa.array(cols[1]), *(pa.array(c, pa.float64()) for c in cols[2:5]), pa.array(cols[5], pa.int64())],
                        [ident, "item_id", "bm25", "question_overlap", "answer_overlap", "first_word"],
                    )

        ids, texts, held = [], [], 0
        for b in batches:
            ids.append(b.column(0)), texts.extend(b.column(1).to_pylist())
            held += b.column(1).nbytes
            if len(parts) <= _HELD or held > _CHUNK:
                yield from found(pa.concat_arrays(ids), texts)
                ids, texts, held = [], [], 0
        if texts:
            yield from found(pa.concat_arrays(ids), texts)

    return spread(docs.select(ident, text)).mapInArrow(lean(run), schema)


def without_leaks(docs: DataFrame, benchmark: DataFrame, text: str = "text", ident: str = "doc_id") -> DataFrame:
    """``docs`` without the rows that contain a test item; only rows that may go are moved. Other rows of the same identifier stay."""
    key, gone, may = free(docs, "key", "gone", "may")
    keyed = docs.withColumn(key, row_key(ident, text_hash(text)))
    leaks = settled(contaminated(keyed, benchmark, text, key).select(F.col(key).alias(gone)).distinct(), "leaks")
    marked = keyed.withColumn(may, in_bloom(leaks, F.xxhash64(gone), F.xxhash64(key)))
    stay = marked.where(F.col(may)).join(leaks, F.col(key) == F.col(gone), "left_anti")
    return marked.where(~F.col(may)).unionByName(stay).select(*docs.columns)
