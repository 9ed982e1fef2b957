"""Token-ID output in training order.

Texts are tokenised and strung together within their scan task, each ended by the end token, and cut into sequences of
one length. Sequences are numbered through; a keyed Feistel permutation with cycle-walking gives each number its slot in
the training order, so any slot can be traced without a table. Slots are dealt by range: each task writes its shards,
files of little-endian 16-bit ids at a fixed stride, so sequence ``slot`` lies at byte ``slot % per_shard * stride`` of
shard ``slot // per_shard`` and a reader can go on anywhere.

Recovery: tokens are written once to the shared folder and reread by whatever needs them, so numbers never change between
attempts; a shard is written under a new name and renamed, and a shard that is already there whole is left as it is.

Defined results: null texts count as empty and give the end token alone; of an empty table no shard is written; the last
sequence of a task is filled up with the end token; repeated rows are tokenised each; a very long text is tokenised whole by one task and may
fill many sequences; extra columns are not read.
"""

from __future__ import annotations

import base64
import json
import sys
import uuid
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import local_table, scratch, settled
from .labelled import lean, small_batches

#: Where the vocabulary's rank file lies on the driver, and the pattern that belongs to it.
RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
END = 50_256
_MEMO = 300_000
_PACK = 4 << 20  # bytes of ids that are packed together: larger packs compress better


class _OddSpace(Exception):
    """White space next to a blank: the text is tokenised as a whole."""


class Tokenizer(dict):
    """Byte-level BPE; remembers the ids of words with the blank before them, as 16-bit bytes."""

    def __init__(self, ranks: dict[bytes, int]):
        super().__init__()
        self.coder = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def _ids(self, text: str) -> bytes:
        ids = array("H", self.coder.encode_ordinary(text))
        if sys.byteorder == "big":
            ids.byteswap()
        return ids.tobytes()

    def __missing__(self, word: str) -> bytes:
        if not word or word[0].isspace() or word[-1].isspace():
            raise _OddSpace
        if len(self) > _MEMO:
            self.clear()
        self[word] = ids = self._ids(" " + word)
        return ids

    def __call__(self, text: str | None) -> bytes:
        if not text:
            return b""
        first, *words = text.split(" ")
        if not first or first[-1].isspace():
            return self._ids(text)
        try:  # no merge reaches across a single blank between words, so each word's ids are its own
            return self._ids(first) + b"".join(map(self.__getitem__, words))
        except _OddSpace:
            return self._ids(text)


def load_ranks(path: str = RANKS) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class Feistel:
    """A permutation of range(n) chosen by a key; six-round Feistel network on the next even number of bits."""

    def __init__(self, n: int, key: int, rounds: int = 6):
        self.n, half = n, max(1, (max(1, n - 1).bit_length() + 1) // 2)
        self.half, self.mask = np.uint64(half), np.uint64((1 << half) - 1)
        self.keys = np.random.default_rng(key).integers(0, 1 << 63, rounds, dtype=np.uint64)

    def _mix(self, x: np.ndarray, key: np.uint64) -> np.ndarray:
        x = (x + key) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        return (x ^ (x >> np.uint64(32))) & self.mask

    def _once(self, x: np.ndarray, keys: np.ndarray, back: bool) -> np.ndarray:
        a, b = x >> self.half, x & self.mask
        for k in keys:
            a, b = (b ^ self._mix(a, k), a) if back else (b, a ^ self._mix(b, k))
        return a << self.half | b

    def _walk(self, x: np.ndarray, keys: np.ndarray, back: bool) -> np.ndarray:
        out = self._once(np.asarray(x, np.uint64), keys, back)
        while (far := out >= self.n).any():  # outside: go on until inside
            out[far] = self._once(out[far], keys, back)
        return out.astype(np.int64)

    def slot(self, number: np.ndarray) -> np.ndarray:
        return self._walk(number, self.keys, False)

    def number(self, slot: np.ndarray) -> np.ndarray:
        return self._walk(slot, self.keys[::-1], True)


def _tokenised(docs: DataFrame, text: str, ident: str, length: int, ranks: str) -> DataFrame:
    """Two kinds of rows: a row for each text (n_tokens, seq, at), and packs of sequences (tokens); task and seq number both."""
    spark = docs.sparkSession
    small_batches(spark)
    sent = spark.sparkContext.broadcast(load_ranks(ranks))  # a vocabulary's size, whatever the corpus
    kind = docs.schema[ident].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, pack, end = Tokenizer(sent.value), zstandard.ZstdCompressor(level=6), np.array([END], "<u2").tobytes()
        done, parts, held = 0, [], 0  # sequences packed; ids not yet packed, and their bytes
        names = ["doc_id", "n_tokens", "seq", "at", "count", "tokens"]
        ident_type = None

        def packed(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal done, parts, held
            ids = b"".join(parts)
            if last and len(ids) % (2 * length):
                ids += end * (length - len(ids) // 2 % length)
            n = len(ids) // (2 * length)
            if n:
                blob = pack.compress(ids[: n * 2 * length])
                yield pa.RecordBatch.from_arrays([pa.nulls(1, ident_type), pa.nulls(1, pa.int64()), pa.array([done], pa.int64()), pa.nulls(1, pa.int32()), pa.array([n], pa.int32()), pa.array([blob], pa.binary())], names)
            parts, done = [ids[n * 2 * length :]], done + n
            held = len(parts[0])

        for b in batches:
            ident_type, begin, sizes = b.column(0).type, [], []
            for body in b.column(1).to_pylist():
                ids = coder(body)
                parts += (ids, end)
                begin.append(held // 2)
                sizes.append(len(ids) // 2)
                held += len(ids) + 2
            at, m = np.array(begin, np.int64), len(sizes)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(sizes, pa.int64()), pa.array(done + at // length, pa.int64()), pa.array(at % length, pa.int32()), pa.nulls(m, pa.int32()), pa.nulls(m, pa.binary())], names
            )
            if held >= _PACK:
                yield from packed(False)
        if held:
            yield from packed(True)

    out = docs.select(ident, text).mapInArrow(lean(run), f"doc_id {kind}, n_tokens long, seq long, at int, count int, tokens binary")
    return settled(out.withColumn("task", F.spark_partition_id()), "tokens")


def _write_shards(packs: DataFrame, n: int, feistel: Feistel, folder: str, per_shard: int, stride: int) -> DataFrame:
    """Writes the shards; a row for each: shard, path, sequences, crc32."""
    shards = -(-n // per_shard)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack, unpack = zstandard.ZstdCompressor(level=3), zstandard.ZstdDecompressor()
        for b in batches:
            for first, count, blob in zip(*(c.to_pylist() for c in b.columns)):
                ids = np.frombuffer(unpack.decompress(blob, max_output_size=count * stride), np.uint8).reshape(count, stride)
                slots = feistel.slot(np.arange(first, first + count))
                order = np.argsort(slots)
                slots, ids = slots[order], ids[order]
                cuts = np.flatnonzero(np.append(True, slots[1:] // per_shard != slots[:-1] // per_shard))
                out = [(int(s[0] // per_shard), (s % per_shard).astype("<i4").tobytes(), pack.compress(i.tobytes())) for s, i in zip(np.split(slots, cuts[1:]), np.split(ids, cuts[1:]))]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int32(), pa.binary(), pa.binary()))], ["shard", "places", "tokens"])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)
        unpack, now, done = zstandard.ZstdDecompressor(), None, []

        def close() -> tuple[int, str, int, int]:
            shard, body = now
            name, raw = f"{base}/shard-{shard:08d}.u16", body.tobytes()
            known = store.get_file_info(name)
            if known.type != fs.FileType.File or known.size != len(raw):
                part = f"{base}/.{uuid.uuid4().hex}"
                with store.open_output_stream(part, compression=None) as f:
                    f.write(raw)
                store.move(part, name)
            return shard, f"{folder}/shard-{shard:08d}.u16", len(raw) // stride, zlib.crc32(raw)

        for b in batches:
            for shard, places, tokens in zip(*(c.to_pylist() for c in b.columns)):
                if now is None or now[0] != shard:
                    if now:
                        done.append(close())
                    now = (shard, np.zeros((min(per_shard, n - shard * per_shard), stride), np.uint8))
                at = np.frombuffer(places, "<i4")
                now[1][at] = np.frombuffer(unpack.decompress(tokens, max_output_size=len(at) * stride), np.uint8).reshape(-1, stride)
        if now:
            done.append(close())
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done), (pa.int32(), pa.string(), pa.int64(), pa.int64()))], ["shard", "path", "sequences", "crc32"])

    dealt = packs.mapInArrow(lean(deal), "shard int, places binary, tokens binary")
    tasks = int(packs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by_range = dealt.repartitionById(tasks, F.floor(F.col("shard").cast("long") * F.lit(tasks) / F.lit(shards)).cast("int")).sortWithinPartitions("shard")
    return settled(by_range.mapInArrow(lean(write), "shard int, path string, sequences long, crc32 long"), "shards")


def materialised(
    docs: DataFrame, folder: str, text: str = "text", ident: str = "doc_id", length: int = 1024, shard_bytes: int = 16 << 20, key: int = 20, ranks: str = RANKS
) -> tuple[DataFrame, DataFrame]:
    """Writes the shards and ``order.json``. Where each text is: ident, n_tokens, sequence, at, slot, shard, byte_offset of its first token; and the shards.

    A text's further tokens are in the sequences that follow by number, so in the slots that the permutation gives them.
    """
    spark = docs.sparkSession
    tokens = _tokenised(docs, text, ident, length, ranks)
    counts = tokens.where("count is not null").groupBy("task").agg(F.max(F.col("seq") + F.col("count")).alias("n")).orderBy("task").collect()
    first, n = [], 0
    for task, k in counts:
        first.append((task, n))
        n += k
    offsets = local_table(spark, first, "_task int, _first long")  # a row for each scan task
    numbered = tokens.join(F.broadcast(offsets) if len(first) <= 100_000 else offsets, F.col("task") == F.col("_task")).withColumn("sequence", F.col("_first") + F.col("seq"))
    stride, per_shard, feistel = 2 * length, max(1, shard_bytes // (2 * length)), Feistel(n, key)
    shards = _write_shards(numbered.where("count is not null").select("sequence", "count", "tokens"), n, feistel, folder, per_shard, stride) if n else spark.createDataFrame([], "shard int, path string, sequences long, crc32 long")
    store, base = fs.FileSystem.from_uri(folder)
    store.create_dir(base, recursive=True)
    with store.open_output_stream(f"{base}/order.json", compression=None) as f:
        f.write(json.dumps({"sequences": n, "length": length, "stride": stride, "per_shard": per_shard, "key": key, "end": END}).encode())

    @F.arrow_udf("long")
    def slot(number: pa.Array) -> pa.Array:
        return pa.array(feistel.slot(number.to_numpy(zero_copy_only=False).astype(np.uint64)))

    # called nondeterministic so that it is evaluated once: a join on the shard would copy it into a filter, and each task would hold two workers
    once = slot.asNondeterministic()("sequence").alias("slot")
    where = numbered.where("n_tokens is not null").select(F.col("doc_id").alias(ident), "n_tokens", "sequence", "at", once)
    where = where.withColumns({"shard": F.floor(F.col("slot") / per_shard).cast("int"), "byte_offset": F.col("slot") % per_shard * stride + F.col("at") * 2})
    return where, shards


def read_sequences(folder: str, start: int = 0, stop: int | None = None) -> Iterator[np.ndarray]:
    """The sequences of slots [start, stop) in order; goes on from any slot by seeking."""
    store, base = fs.FileSystem.from_uri(folder)
    with store.open_input_stream(f"{base}/order.json", compression=None) as f:
        about = json.loads(f.read())
    stop, at = about["sequences"] if stop is None else min(stop, about["sequences"]), start
    while at < stop:
        shard, place = divmod(at, about["per_shard"])
        with store.open_input_file(f"{base}/shard-{shard:08d}.u16") as f:
            f.seek(place * about["stride"])
            for _ in range(min(stop - at, about["per_shard"] - place)):
                yield np.frombuffer(f.read(about["stride"]), "<u2")
                at += 1


def ordered(docs: DataFrame) -> DataFrame:
    """The place of every document in shards newly written to the shared folder."""
    where, shards = materialised(docs, scratch(docs.sparkSession, "training-order"))
    return where.join(F.broadcast(shards.select(F.col("shard").alias("_s"), "path")) if shards.count() <= 100_000 else shards.select(F.col("shard").alias("_s"), "path"), F.col("shard") == F.col("_s")).drop("_s")
