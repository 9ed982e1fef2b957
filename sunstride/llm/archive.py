"""Web archives in ZIP packages: written as stored members with an index, read back by ranges.

A package holds ``archive/data.warc.gz`` (a gzip member for each record), ``indexes/index.cdxj`` (a line for each record)
and ``datapackage.json``, all stored. The reader takes the end of the file, the (ZIP64) end record and the central
directory, finds where the stored members begin, reads the index, and then reads runs of records by range; nothing is
extracted.

Records with equal payloads of at least ``least`` bytes: the one with the largest page_id is a response, others revisit
it. Defined results: a null payload is empty; a null URL is written as an empty target; a null page_id never is the
largest and is always a response; rows that repeat the largest page_id and its payload are all responses; an empty table
gives an empty result; other columns are not read. Packages are new files named anew in each attempt, and only those
that a finished task reports are read, so a lost executor leaves orphans but no wrong record.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import in_bloom, join_groups, scratch, settled
from .labelled import lean, small_batches

DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
_DATE = "2024-01-01T00:00:00Z"  # a fixed time: the tables have none, and reruns agree
_RUN = 4 << 20  # bytes that one range read takes at most, unless a record is longer


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _urn(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> tuple[bytes, str]:
    """A WARC record (not yet compressed) and its payload digest."""
    digest, revisit = payload_digest(payload), refers_to is not None
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode() + (b"" if revisit else payload)
    head = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_urn(page_id)}", f"WARC-Date: {_DATE}",
        "WARC-Target-URI: " + "".join(c for c in url or "" if c >= " "), "Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: sha1:{digest}",
    ]
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {_urn(refers_to)}"]
    return "\r\n".join([*head, f"Content-Length: {len(block)}", "", ""]).encode() + block + b"\r\n\r\n", digest


def parse(raw: bytes) -> tuple[dict[str, str], bytes, bytes]:
    """A record's WARC fields (names in lower case), its HTTP head and what follows that."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
    http, _, body = rest[: int(fields["content-length"])].partition(b"\r\n\r\n")
    return fields, http, body


class Writer:
    """Packages of about ``limit`` bytes below a folder."""

    def __init__(self, folder: str, limit: int):
        self.store, self.folder = fs.FileSystem.from_uri(folder)
        self.uri, self.limit, self.out = folder, limit, None

    def add(self, member: bytes, line: dict) -> tuple[str, int, int] | None:
        """The package's path, records and bytes if it is now full."""
        if self.out is None:
            self.name = f"{uuid.uuid4().hex}.wacz"
            self.store.create_dir(self.folder, recursive=True)
            self.out = self.store.open_output_stream(f"{self.folder}/{self.name}", compression=None)
            self.zip = zipfile.ZipFile(self.out, "w", zipfile.ZIP_STORED, allowZip64=True)
            self.data, self.at, self.lines = self.zip.open(zipfile.ZipInfo(DATA), "w", force_zip64=True), 0, []
        self.data.write(member)
        self.lines.append(json.dumps(line | {"offset": self.at, "length": len(member)}))
        self.at += len(member)
        return self.close() if self.at >= self.limit else None

    def close(self) -> tuple[str, int, int] | None:
        if self.out is None:
            return None
        self.data.close()
        with self.zip.open(zipfile.ZipInfo(INDEX), "w", force_zip64=True) as f:
            f.write("".join(f"{x}\n" for x in self.lines).encode())
        self.zip.writestr(zipfile.ZipInfo("datapackage.json"), json.dumps({"profile": "data-package", "resources": [{"path": DATA}, {"path": INDEX}]}))
        self.zip.close()
        self.out.close()
        self.out = None
        return f"{self.uri}/{self.name}", len(self.lines), self.at


def directory(f) -> dict[str, tuple[int, int, int]]:
    """Of a ZIP file open for random access: each member's method, size and where its local header begins."""
    size = f.size()
    low = max(0, size - 65_557)
    f.seek(low)
    tail = f.read(size - low)
    at = tail.rfind(b"PK\x05\x06")
    if at < 0:
        raise ValueError("no end of central directory")
    count, length, start = struct.unpack("<10xHII", tail[at : at + 20])
    if 0xFFFF == count or 0xFFFFFFFF in (length, start):
        mark = low + at - 20
        f.seek(mark)
        sign, where = struct.unpack("<IxxxxQxxxx", f.read(20))
        if sign != 0x07064B50:
            raise ValueError("no ZIP64 locator")
        f.seek(where)
        sign, count, length, start = struct.unpack("<I28xQQQ", f.read(56))
        if sign != 0x06064B50:
            raise ValueError("no ZIP64 end of central directory")
    f.seek(start)
    raw, out, at = f.read(length), {}, 0
    for _ in range(count):
        sign, method, packed, plain, n, m, k, local = struct.unpack("<I6xH8xIIHHH8xI", raw[at : at + 46])
        if sign != 0x02014B50:
            raise ValueError("broken central directory")
        name, extra = raw[at + 46 : at + 46 + n].decode(), raw[at + 46 + n : at + 46 + n + m]
        while len(extra) >= 4:
            tag, long = struct.unpack("<HH", extra[:4])
            if tag == 1:  # 64-bit values stand for those fields that are full, in this order
                wide = list(struct.unpack(f"<{long // 8}Q", extra[4 : 4 + long // 8 * 8]))
                plain = wide.pop(0) if plain == 0xFFFFFFFF else plain
                packed = wide.pop(0) if packed == 0xFFFFFFFF else packed
                local = wide.pop(0) if local == 0xFFFFFFFF else local
            extra = extra[4 + long :]
        out[name] = (method, packed, local)
        at += 46 + n + m + k
    return out


def stored(f, entry: tuple[int, int, int]) -> tuple[int, int]:
    """Where a stored member's bytes begin, and how many there are."""
    method, size, local = entry
    if method:
        raise ValueError("the member is not stored")
    f.seek(local)
    sign, n, m = struct.unpack("<I22xHH", f.read(30))
    if sign != 0x04034B50:
        raise ValueError("no local header")
    return local + 30 + n + m, size


def records(f) -> Iterator[tuple[dict, bytes]]:
    """Index line and raw record of every record, by range reads."""
    members = directory(f)
    start, size = stored(f, members[INDEX])
    f.seek(start)
    lines = [json.loads(x) for x in f.read(size).decode().splitlines()]
    lines.sort(key=lambda x: x["offset"])
    start, size = stored(f, members[DATA])
    i = 0
    while i < len(lines):
        j, first = i, lines[i]["offset"]
        while j < len(lines) and lines[j]["offset"] + lines[j]["length"] - first <= max(_RUN, lines[i]["length"]):
            j += 1
        f.seek(start + first)
        run = f.read(lines[j - 1]["offset"] + lines[j - 1]["length"] - first)
        for x in lines[i:j]:
            a = x["offset"] - first
            yield x, zlib.decompress(run[a : a + x["length"]], 31)
        i = j


def write(pages: DataFrame, folder: str, least: int = 0, package: int = 64 << 20) -> DataFrame:
    """Writes the packages; a row for each: path, records, bytes."""
    small_batches(pages.sparkSession)
    body = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select("page_id", "url", body.alias("payload"), F.sha2(body, 256).alias("key"))
    long = F.length("payload") >= least
    groups = settled(rows.where(long).groupBy("key").agg(F.max("page_id").alias("keep"), F.count(F.lit(1)).alias("n")), "warc-groups")
    # only pages whose payload may occur again are moved; large groups are dealt over several tasks
    several = groups.where("n > 1")
    again = in_bloom(several, F.xxhash64("key"), F.xxhash64("key"))
    marked = rows.withColumn("again", F.when(long, again).otherwise(F.lit(False)))
    hits = join_groups(marked.where("again").drop("again"), "key", F.struct("page_id", "url"), groups.where(again))
    refers = F.when(F.col("page_id") != F.col("keep"), F.col("keep"))
    todo = marked.where("not again").select("page_id", "url", "payload", F.lit(None).cast(rows.schema["page_id"].dataType).alias("refers_to"))
    todo = todo.unionByName(hits.select("page_id", "url", "payload", refers.alias("refers_to")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer, done = Writer(folder, package), []
        for b in batches:
            for page_id, url, payload, refers_to in zip(*(c.to_pylist() for c in b.columns)):
                raw, digest = record(page_id, url, payload, refers_to)
                done.append(writer.add(gzip.compress(raw, 2, mtime=0), {"url": url, "digest": f"sha1:{digest}", "record": _urn(page_id), "filename": DATA}))
        done = [x for x in [*done, writer.close()] if x]
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done)], ["path", "records", "bytes"])

    return settled(todo.mapInArrow(lean(run), "path string, records long, bytes long"), "warc-packages")


def read(packages: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to and url of every record in the packages (path)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = lambda urn: int(x) if (x := urn.removeprefix("<urn:page:").removesuffix(">")) else None
        for b in batches:
            for path in b.column(0).to_pylist():
                store, at = fs.FileSystem.from_uri(path)
                with store.open_input_file(at) as f:
                    out = []
                    for line, raw in records(f):
                        fields, http, body = parse(raw)
                        revisit, digest = fields["warc-type"] == "revisit", fields["warc-payload-digest"].removeprefix("sha1:")
                        size = int(http.lower().partition(b"content-length:")[2].partition(b"\r\n")[0])
                        if not revisit and (payload_digest(body) != digest or len(body) != size):
                            raise ValueError(f"{path}: record {line['record']} is damaged")
                        out.append((number(fields["warc-record-id"]), size, digest, fields["warc-type"], number(fields["warc-refers-to"]) if revisit else None, fields["warc-target-uri"]))
                kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string())
                for i in range(0, len(out), 20_000):
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out[i : i + 20_000]), kinds)], ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url"])

    spread = packages.select("path").repartition(max(1, min(packages.count(), 10_000)))
    return spread.mapInArrow(lean(run), "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string")


def round_trip(spark: SparkSession, pages: DataFrame, least: int = 0) -> DataFrame:
    return read(write(pages, scratch(spark, "wacz"), least)).drop("url")
