"""N-gram Jaccard self-join by a count-vector R-tree.

Texts become sets of hashed word shingles. Two sets whose Jaccard similarity is at least 4/5 differ in few shingles, which
bounds both how many of a set's lowest hashes the other must have too and how far their count vectors can be apart:

1. Equal sets are one class. Each class deals its lowest n/5 + 1 + 3n/10 hashes over the cluster (as packed arrays). A
   partner shares at least t = 1 + 3/10 * 4n/5 of them, so classes that share fewer with all others together go. A task
   holds a part of the hashes; owners of a hash that would fill it are passed on at once, as of a hash more common than all others.
2. Of the hashes that a class shares, the t - 1 that most classes have are set aside: a partner still shares the rarest
   one. Classes that share one of the others form candidate clusters (connected components), a superset of the links.
3. Inside a cluster the shingles are hashed into groups; the counts by group are points, packed into an R-tree. The
   summed coordinate minima of a point and a node's upper corner bound any overlap below it. Pairs that survive and are
   not yet connected are verified on the whole sets. Of clusters too large for a task each block meets the cluster's
   first member; a member that this doesn't connect then meets those of comparable size that share one of its hashes.
4. Verified links give the components.

No pair of texts is lost and no group is expanded into all pairs. Shingles have hashes of 64 bits, classes and texts of
128 bits; those of step 1 are shortened to 32 within their part, which can only add candidates.

Defined results: words are runs without space, tab, LF, VT, FF, CR, with A-Z in lower case; texts with fewer words than a
shingle are one shingle; null and wordless texts have no shingles, link with nothing and are their own component. A
component's id is its least identifier (null only if all are null); repeated rows are members like any other; an empty
table gives an empty result; a very long text is held whole, with its hashes, by the tasks that shingle it; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import discard, free, in_bloom, join_groups, row_key, settled, spread, text_hash
from .components import components
from .labelled import lean, small_batches

#: Words of a shingle.
WIDTH = 5
_FLUSH = 1 << 19  # hashes that a task packs at once
_MEMO = 100_000
#: Shingles and members of a cluster that one task takes.
TASK_SHINGLES, TASK_MEMBERS = 3_000_000, 6000
#: Bytes of text whose hashes make a part, parts at most (above 12.8 TB they get larger), and parts that are tasks of their own.
_PART_BYTES, _MOST_PARTS, _MOST_TASKS = 64 << 20, 200_000, 20_000
#: Hashes of a part that are met at once, that a task holds before it looks for common ones, and owners that make a hash common.
_RUN, _HELD, _COMMON = 1 << 22, 1 << 25, 1 << 17
_TOP = 2**31 - 1


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


class Shingler:
    """From a text's bytes to its sorted different shingle hashes."""

    def __init__(self, width: int = WIDTH):
        self.width, self.words = width, _Hashes()
        self.by = np.random.default_rng(97).integers(1, 1 << 63, width + 1, dtype=np.uint64) | np.uint64(1)

    def __call__(self, body: bytes | None) -> np.ndarray:
        words = (body or b"").lower().split()  # of bytes: ASCII letters, ASCII white space
        if not words:
            return np.zeros(0, np.uint64)
        if len(self.words) > _MEMO:
            self.words.clear()
        h = np.fromiter(map(self.words.__getitem__, words), np.uint64, len(words))
        k = min(self.width, len(h))
        m = len(h) - k + 1
        s = np.full(m, int(self.by[-1]) * k % (1 << 64), np.uint64)
        for i in range(k):
            s += h[i : i + m] * self.by[i]
            s ^= s >> np.uint64(29)
            s *= np.uint64(0xBF58476D1CE4E5B9)
        s ^= s >> np.uint64(32)
        return np.unique(s)


def _prefix(n: int) -> int:
    return n // 5 + 1 + 3 * n // 10


#: SQL: how many of its dealt hashes a class of ``n`` shingles shares with any partner at least.
_NEED = "1 + div(3 * div(4 * n + 4, 5), 10)"


def _binary(pairs: np.ndarray) -> pa.Array:
    """Rows of two 64-bit numbers as binaries of 16 bytes."""
    raw = np.ascontiguousarray(pairs)
    return pa.Array.from_buffers(pa.binary(16), len(raw), [None, pa.py_buffer(raw.tobytes())]).cast(pa.binary())


class _Part:
    """The hashes of one part: owners of common ones leave early, those of others when all are there."""

    def __init__(self, held: int, common: int):
        self.limit = self.held = held
        self.common, self.hot, self.count = common, np.zeros(0, np.uint32), 0
        self.blobs: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []

    def add(self, raw: bytes, named: bytes, sizes: bytes) -> Iterator[tuple]:
        both = np.frombuffer(raw, np.uint32)
        blob = (both[: len(both) // 2], both[len(both) // 2 :], np.frombuffer(named, np.uint64).reshape(-1, 2), np.frombuffer(sizes, np.int32))
        yield from self._keep(blob)
        if self.count > self.limit:
            keys, often = np.unique(np.concatenate([b[0] for b in self.blobs]), return_counts=True)
            self.hot = np.union1d(self.hot, keys[often > self.common])
            blobs, self.blobs, self.count = self.blobs, [], 0
            for b in blobs:
                yield from self._keep(b)
            self.limit = max(self.held, 2 * self.count)

    def _keep(self, blob: tuple) -> Iterator[tuple]:
        k, no, c, z = blob
        if len(self.hot):
            is_hot = np.isin(k, self.hot)
            if is_hot.any():
                yield k[is_hot], c[no[is_hot]], z[no[is_hot]], np.full(is_hot.sum(), _TOP, np.int32)
                k, no = k[~is_hot], no[~is_hot]
        if len(k):
            self.blobs.append((k, no, c, z))
            self.count += len(k)

    def rest(self) -> Iterator[tuple]:
        """(hash, class, size, owners) of what classes of comparable size share, a run of hashes at a time."""
        runs = np.uint64(max(1, -(-self.count // _RUN)))
        for run in range(int(runs)):
            of = [np.flatnonzero((b[0].astype(np.uint64) * runs) >> np.uint64(32) == run) for b in self.blobs]
            again = np.sort(np.concatenate([b[0][at] for b, at in zip(self.blobs, of)] or [np.zeros(0, np.uint32)]))
            again = np.unique(again[1:][again[1:] == again[:-1]])  # most hashes are there once: only the others get their classes
            if not len(again):
                continue
            of = [at[again[np.minimum(np.searchsorted(again, b[0][at]), len(again) - 1)] == b[0][at]] for b, at in zip(self.blobs, of)]
            k, c, z = (np.concatenate(x) for x in zip(*((k[at], c[no[at]], z[no[at]]) for (k, no, c, z), at in zip(self.blobs, of))))
            order = np.lexsort((c[:, 0], c[:, 1], z, k))
            k, c, z = k[order], c[order], z[order]
            new = np.append(True, (k[1:] != k[:-1]) | (c[1:] != c[:-1]).any(axis=1))
            k, c, z = k[new], c[new], z[new]
            df = np.bincount(np.cumsum(np.append(False, k[1:] != k[:-1])))
            df = np.repeat(df, df).astype(np.int32)
            near = np.append((k[1:] == k[:-1]) & (4 * z[1:].astype(np.int64) <= 5 * z[:-1].astype(np.int64)), False)  # with the next larger one
            keep = near | np.append(False, near[:-1])
            yield k[keep], c[keep], z[keep], df[keep]


def _dealt(docs: DataFrame, ident: str, text: str, parts: int, width: int, held: int, common: int) -> DataFrame:
    """Two kinds of rows: one for each text (key is null), and (key, class, n, df) for each dealt hash that classes of comparable size share; df is how many classes have it."""
    kind = docs.schema[ident].dataType.simpleString()
    names = ["doc_id", "n", "class", "body_hash", "part", "keys", "classes", "sizes"]

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingler(width)
        keys, owners, classes, sizes, held, seen, ident_type = [], [], [], [], 0, set(), None

        def flush() -> pa.RecordBatch:
            nonlocal held
            k, o = np.concatenate(keys), np.repeat(np.arange(len(owners)), owners)
            c, z = np.frombuffer(b"".join(classes), np.uint64).reshape(-1, 2), np.array(sizes, np.int32)
            k = (k ^ (k >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
            at = ((k & np.uint64(0xFFFFFFFF)) % np.uint64(parts)).astype(np.int64)
            order = np.argsort(at, kind="stable")
            k, o = (k >> np.uint64(32)).astype(np.uint32)[order], o[order]
            ends = np.searchsorted(at[order], np.arange(parts + 1))
            out = []  # for each part its hashes, the number of each one's class among the classes named, and those
            for p in np.flatnonzero(np.diff(ends)):
                i, j = ends[p], ends[p + 1]
                used, no = np.unique(o[i:j], return_inverse=True)
                out.append((int(p), k[i:j].tobytes() + no.astype(np.uint32).tobytes(), c[used].tobytes(), z[used].tobytes()))
            keys.clear(), owners.clear(), classes.clear(), sizes.clear()
            held = 0
            m, cols = len(out), list(zip(*out))
            return pa.RecordBatch.from_arrays([pa.nulls(m, ident_type), pa.nulls(m, pa.int32()), pa.nulls(m, pa.binary()), pa.nulls(m, pa.binary()), pa.array(cols[0], pa.int32()), *(pa.array(x, pa.binary()) for x in cols[1:])], names)

        for b in batches:
            ident_type, n, c = b.column(0).type, [], []
            for body in b.column(1).to_pylist():
                s = shingles(body)
                n.append(len(s))
                c.append(xxhash.xxh3_128_digest(s.tobytes()))
                if len(s) and c[-1] not in seen:  # an equal set in this task has been dealt already
                    if len(seen) > _MEMO:
                        seen.clear()
                    seen.add(c[-1])
                    p = s[: _prefix(len(s))]
                    keys.append(p), owners.append(len(p)), classes.append(c[-1]), sizes.append(len(s))
                    held += len(p)
                    if held > _FLUSH:
                        yield flush()
            m = b.num_rows
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int32()), pa.array(c, pa.binary()), b.column(2), pa.array(np.arange(m) % parts, pa.int32()), *[pa.nulls(m, pa.binary())] * 3], names)
        if keys:
            yield flush()

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, part, ident_type = -1, _Part(held, common), None

        def rows(found: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
            for k, c, z, df in found:
                for i in range(0, len(k), 50_000):
                    at = slice(i, i + 50_000)
                    m = len(k[at])
                    key = k[at].astype(np.int64) | (np.int64(now) << 32)
                    yield pa.RecordBatch.from_arrays([pa.nulls(m, ident_type), pa.array(z[at]), _binary(c[at]), pa.nulls(m, pa.binary()), pa.array(key), pa.array(df[at])], ["doc_id", "n", "class", "body_hash", "key", "df"])

        for b in batches:
            ident_type, own = b.column(0).type, b.filter(b.column(5).is_null())
            if own.num_rows:
                yield pa.RecordBatch.from_arrays([*own.columns[:4], pa.nulls(own.num_rows, pa.int64()), pa.nulls(own.num_rows, pa.int32())], ["doc_id", "n", "class", "body_hash", "key", "df"])
            packed = b.filter(b.column(5).is_valid())
            for p, *blob in zip(*(c.to_pylist() for c in packed.columns[4:])):
                if p != now:
                    yield from rows(part.rest())
                    now, part = p, _Part(held, common)
                yield from rows(part.add(*blob))
        yield from rows(part.rest())

    body = F.col(text).cast("binary")
    packed = spread(docs.select(F.col(ident), body, text_hash(text))).mapInArrow(lean(deal), f"doc_id {kind}, n int, class binary, body_hash binary, part int, keys binary, classes binary, sizes binary")
    tasks = min(parts, _MOST_TASKS)
    met = packed.repartitionById(tasks, F.pmod("part", F.lit(tasks)))
    met = met.sortWithinPartitions("part") if parts > tasks else met
    return met.mapInArrow(lean(meet), f"doc_id {kind}, n int, class binary, body_hash binary, key long, df int")


class Tree:
    """Count vectors packed into nodes of ``fan`` points and nodes of as many nodes, with their upper corners."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray, fan: int = 16):
        spread = points.var(axis=0).argmax()
        self.order = np.lexsort((points[:, spread], sizes * 64 // max(1, sizes.max())))  # slices by size, then along one coordinate
        self.points, self.sizes, self.fan = points[self.order], sizes[self.order], fan
        self.high, self.least, self.most = [], [], []
        at = (self.points, self.sizes, self.sizes)
        while len(at[0]) > 1:
            cuts = np.arange(0, len(at[0]), fan)
            at = (np.maximum.reduceat(at[0], cuts), np.minimum.reduceat(at[1], cuts), np.maximum.reduceat(at[2], cuts))
            self.high.append(at[0]), self.least.append(at[1]), self.most.append(at[2])

    def __call__(self, point: np.ndarray, size: int) -> np.ndarray:
        """Entries whose size and summed minima with ``point`` allow a similarity of 4/5."""
        found = np.array([0])
        for high, least, most in zip(self.high[::-1], self.least[::-1], self.most[::-1]):
            fits = (4 * least[found] <= 5 * size) & (5 * most[found] >= 4 * size)
            found = found[fits]
            low = np.maximum(least[found], -(-4 * size // 5))
            found = found[9 * np.minimum(high[found], point).sum(axis=1, dtype=np.int64) >= 4 * (size + low)]
            count = len(self.points) if high is self.high[0] else len(self.high[[h is high for h in self.high].index(True) - 1])
            found = (found[:, None] * self.fan + np.arange(self.fan)).ravel()
            found = found[found < count]
        s = self.sizes[found]
        fits = (4 * s <= 5 * size) & (5 * s >= 4 * size)
        found, s = found[fits], s[fits]
        return self.order[found[9 * np.minimum(self.points[found], point).sum(axis=1, dtype=np.int64) >= 4 * (size + s)]]


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    both = len(a) + len(b) - len(np.union1d(a, b))
    return 100 * both >= 80 * (len(a) + len(b) - both)


def forest(sets: list[np.ndarray], asked: list[bool] | None = None) -> list[tuple[int, int]]:
    """Links that connect what all links between an asked set and any set connect; those already connected aren't verified."""
    sizes = np.array([len(s) for s in sets], np.int64)
    if len(sets) < 2:
        return []
    groups = 1 << int(np.clip(np.ceil(np.log2(max(1, np.median(sizes) / 4))), 3, 9))
    points = np.stack([np.bincount((s & np.uint64(groups - 1)).astype(np.int64), minlength=groups) for s in sets]).astype(np.int32)
    tree, label, out = Tree(points, sizes), np.arange(len(sets)), []
    for i in range(len(sets)):
        if asked is not None and not asked[i]:
            continue
        near = tree(points[i], int(sizes[i]))
        near = near[near < i] if asked is None else near
        near = near[label[near] != label[i]]
        while len(near):
            j, near = near[0], near[1:]
            if similar(sets[i], sets[j]):
                out.append((i, int(j)))
                label[label == label[j]] = label[i]
                near = near[label[near] != label[i]]
    return out


def _links(rows: DataFrame, width: int) -> DataFrame:
    """Links (a, b) between the classes of each group; rows has grp (long), node, body (binary) and asked (boolean)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles, now, held = Shingler(width), None, ([], [], [])

        def solved() -> pa.RecordBatch:
            pairs = forest(held[1], None if all(held[2]) else held[2])
            ends = [[held[0][p[k]] for p in pairs] for k in (0, 1)]
            return pa.RecordBatch.from_arrays([pa.array(e, pa.int64()) for e in ends], ["a", "b"])

        for b in batches:
            for g, c, body, q in zip(*(x.to_pylist() for x in b.columns)):
                if g != now and held[0]:
                    yield solved()
                    held = ([], [], [])
                now = g
                held[0].append(c), held[1].append(shingles(body)), held[2].append(q)
        if held[0]:
            yield solved()

    dealt = rows.select("grp", "node", "body", "asked").repartition(F.col("grp")).sortWithinPartitions("grp", "node")
    return dealt.mapInArrow(lean(run), "a long, b long")


def _large(members: DataFrame, shared: DataFrame, width: int, task_shingles: int, task_members: int) -> DataFrame:
    """Links of clusters too large for one task; members has cluster, node, n, body and parts (tasks its cluster needs), shared the hashes (key) by node."""
    members = members.withColumn("block", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    first = members.groupBy("cluster").agg(F.min_by(F.struct("node", "body", "parts"), "node").alias("f"))
    sent = first.select("cluster", F.col("f.node").alias("node"), F.col("f.body").alias("body"), F.explode(F.sequence(F.lit(0), (F.col("f.parts") - 1).cast("int"))).alias("block"))
    own = members.select("cluster", "node", "body", "block").unionByName(sent).dropDuplicates(["cluster", "node", "block"])
    links = settled(_links(own.select(F.xxhash64("cluster", "block").alias("grp"), "node", "body", F.lit(True).alias("asked")), width), "jaccard-blocks")
    # members that their block doesn't connect with the first meet, hash by hash, those of comparable size
    roots = settled(components(links), "jaccard-roots")
    heads = first.select("cluster", F.col("f.node").alias("head")).join(roots.withColumnRenamed("node", "_node"), F.col("head") == F.col("_node")).select("cluster", F.col("root").alias("main"))
    tied = members.select("cluster", "node", "n").join(roots.withColumnRenamed("node", "_node"), F.col("node") == F.col("_node"), "left").join(heads, "cluster", "left")
    tied = settled(tied.select("node", "n", F.coalesce(F.col("root") != F.col("main"), F.lit(True)).alias("apart")), "jaccard-tied")
    size = F.floor(F.log("n") / F.log(F.lit(1.25))).cast("int")
    rows = shared.join(tied, "node").withColumn("size", F.explode(F.array(size, size + 1))).withColumn("at", F.xxhash64("key", "size"))
    groups = rows.groupBy("at").agg(F.count(F.lit(1)).alias("m"), F.count_if("apart").alias("a"), F.sum("n").alias("s"), F.bit_xor(F.xxhash64("node")).alias("x"), F.bit_xor(F.xxhash64(F.lit(1), "node")).alias("y"))
    groups = settled(groups.where("m > 1 AND a > 0").groupBy("m", "a", "s", "x", "y").agg(F.min("at").alias("at")).select("at", "m", "s"), "jaccard-groups")  # those of the same members once
    met = join_groups(rows.select("at", "node", "apart"), "at", F.col("node"), groups, "m")
    met = met.withColumn("tasks", F.greatest(F.ceil(F.col("m") / task_members), F.ceil(F.col("s") / task_shingles)).cast("int"))
    every, part = F.explode(F.sequence(F.lit(0), F.col("tasks") - 1)), lambda k: F.pmod(F.xxhash64("node", F.lit(k)), F.col("tasks")).cast("int")
    left = met.select("at", "node", part(0).alias("block"), every.alias("chunk"), F.lit(False).alias("asked"))
    right = met.where("apart").select("at", "node", every.alias("block"), part(1).alias("chunk"), F.lit(True).alias("asked"))
    again = left.unionByName(right).groupBy("at", "block", "chunk", "node").agg(F.max("asked").alias("asked")).join(members.select("node", "body"), "node")
    return links.unionByName(_links(again.select(F.xxhash64("at", "block", "chunk").alias("grp"), "node", "body", "asked"), width))


def _tied(docs: DataFrame, text: str, ident: str, width: int, task_shingles: int, task_members: int, held: int, common: int) -> DataFrame:
    """For each row doc_id, n, body_hash, and tie: its component among those that have shingles. Settled."""
    spark = docs.sparkSession
    small_batches(spark)
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    size = size if size < 1 << 60 else 0  # a plan without an estimate has the largest number
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(size // _PART_BYTES, _MOST_PARTS))
    dealt = settled(_dealt(docs, ident, text, parts, width, held, common), "jaccard-dealt")
    texts = dealt.where("key is null").select("doc_id", "n", "class", "body_hash")

    own = Window.partitionBy("class")
    shared = dealt.where("key is not null").select("key", "class", "n", "df")
    shared = shared.withColumn("has", F.count(F.lit(1)).over(own)).where(f"has >= {_NEED}")
    shared = shared.withColumn("place", F.row_number().over(own.orderBy(F.desc("df"), F.desc("key")))).where(f"place >= {_NEED}")
    # a number for each class: the graph's nodes; hashes of 128 bits are not needed beyond this point
    shared = shared.withColumn("at", F.monotonically_increasing_id()).withColumn("node", F.min("at").over(own))
    shared = settled(shared.select("key", "node", F.when(F.col("at") == F.col("node"), F.col("class")).alias("class")), "jaccard-shared")
    nodes = shared.where("class IS NOT NULL").select("class", "node")
    hubs = settled(shared.groupBy("key").agg(F.min("node").alias("hub"), F.max("node").alias("top")).where("hub <> top").select("key", "hub"), "jaccard-hubs")
    near = shared.join(hubs, "key").select(F.col("node").alias("a"), F.col("hub").alias("b"))
    clusters = components(near).select("node", F.col("root").alias("cluster"))

    # one text for each class of a cluster
    reps = texts.where("n > 0").groupBy("class").agg(F.min(F.struct("body_hash", "n")).alias("one")).join(nodes, "class").select("node", "one.*").join(clusters, "node")
    per = reps.groupBy("cluster").agg(F.sum("n").alias("shingles"), F.count(F.lit(1)).alias("members"))
    per = per.withColumn("parts", F.greatest(F.ceil(F.col("shingles") / task_shingles), F.ceil(F.col("members") / task_members)).cast("int"))
    reps = settled(reps.join(per.select("cluster", "parts"), "cluster"), "jaccard-reps")
    bodies = docs.select(F.col(text).cast("binary").alias("body"), text_hash(text).alias("body_hash"))
    bodies = bodies.where(in_bloom(reps, F.xxhash64("body_hash"), F.xxhash64("body_hash")))
    bodies = bodies.groupBy("body_hash").agg(F.first("body").alias("body"))
    members = reps.join(bodies, "body_hash").select("cluster", "node", "n", "body", "parts")
    links = _links(members.where("parts = 1").select(F.col("cluster").alias("grp"), "node", "body", F.lit(True).alias("asked")), width)
    if not reps.where("parts > 1").isEmpty():
        large = settled(members.where("parts > 1"), "jaccard-large")
        links = links.unionByName(_large(large, shared, width, task_shingles, task_members))
    roots = components(links).withColumnRenamed("node", "_node").join(nodes, F.col("_node") == F.col("node")).select(F.col("class").alias("_class"), "root")
    own = texts.join(roots, (F.col("class") == F.col("_class")) & (F.col("n") > 0), "left")
    own = settled(own.select("doc_id", "n", "body_hash", F.coalesce(F.col("root").cast("string"), F.hex("class")).alias("tie")), "jaccard-ties")
    for done in (dealt, shared, hubs, reps):
        discard(done)
    return own


def joined(docs: DataFrame, text: str = "text", ident: str = "doc_id", width: int = WIDTH, task_shingles: int = TASK_SHINGLES, task_members: int = TASK_MEMBERS, held: int = _HELD, common: int = _COMMON) -> DataFrame:
    """For each row its identifier, n_shingles (long) and component_id."""
    own = _tied(docs, text, ident, width, task_shingles, task_members, held, common)
    least = settled(own.where("n > 0").groupBy("tie").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("rows")), "jaccard-least")
    # a group of copies may hold a third of all rows: its rows are dealt over tasks
    tied = join_groups(own.where("n > 0"), "tie", F.struct("doc_id", "body_hash"), least, "rows").select("doc_id", "n", "least")
    out = tied.unionByName(own.where("n = 0").select("doc_id", "n", F.col("doc_id").alias("least")))
    return out.select(F.col("doc_id").alias(ident), F.col("n").cast("long").alias("n_shingles"), F.col("least").alias("component_id"))


def deduplicated(docs: DataFrame, text: str = "text", ident: str = "doc_id") -> DataFrame:
    """``docs`` with one row of each component: the least identifier's (nulls last), of its rows the text with the least MD5, of equal rows one.

    Rows without shingles all stay. Only rows that may go are moved; columns of any name are kept.
    """
    own = _tied(docs, text, ident, WIDTH, TASK_SHINGLES, TASK_MEMBERS, _HELD, _COMMON)
    rank = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "body_hash")
    rows = own.where("n > 0").groupBy("tie", "doc_id", "body_hash").agg(F.count(F.lit(1)).alias("n"))
    first = rows.groupBy("tie").agg(F.min(rank).alias("first"), F.count(F.lit(1)).alias("of"))
    gone, may, key = free(docs, "gone", "may", "key")
    fate = join_groups(rows, "tie", rank, first, "of").select(row_key("doc_id", F.col("body_hash")).alias(key), (rank != F.col("first")).alias(gone), "n")
    fate = settled(fate.where(F.col(gone) | (F.col("n") > 1)), "jaccard-fate")
    keyed = docs.withColumn(key, row_key(ident, text_hash(text)))
    marked = keyed.withColumn(may, in_bloom(fate, F.xxhash64(key), F.xxhash64(key)))
    several = fate.where(~F.col(gone)).select(key)
    some = marked.where(F.col(may)).join(fate.where(gone).select(key), key, "left_anti")
    stay = some.join(several, key, "left_anti")
    once = some.join(several, key, "left_semi").dropDuplicates([key])
    return marked.where(~F.col(may)).unionByName(stay).unionByName(once).select(*docs.columns)
