"""Bounded labelled samples and batched scoring, shared by the classifiers."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import spread

#: Texts that a Python worker holds at once, and the bytes at which a batch ends before it has as many.
BATCH_ROWS, BATCH_BYTES = 500, 4 << 20


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` that gives its memory back to the system when its task ends: workers live on and wait for other tasks."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ctypes
        import gc

        try:
            yield from run(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL("libc.so.6").malloc_trim(0)
            except (OSError, AttributeError):  # another C library
                pass

    return wrapped


def remainder(ident: str, modulus: int) -> Column:
    """crc32 of the identifier as text, modulo ``modulus``; a null identifier counts as an empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(ident).cast("string"), F.lit("")).cast("binary")), F.lit(modulus))


def lowest(share: float) -> int:
    """What the lowest ``share`` of 64-bit hashes lie below."""
    return min(2**63 - 1, int(-(2**63) + 2**64 * share)) if share < 1 else 2**63 - 1


def draw(docs: DataFrame, ids: DataFrame, rows: int, label: str | None, ident: str = "doc_id", seed: int = 5, text: str = "text") -> DataFrame:
    """(ident, text, ``label``) of at most ``rows`` identifiers of ``ids``, those whose seeded hash is lowest.

    A hash threshold from the number of identifiers comes first, so that only about ``rows`` of them are ever sorted. The
    bound makes the broadcast safe. Of an identifier's conflicting labels the least counts, and of its rows the text with the least hash:
    a row an identifier, however often it repeats.
    """
    near, known = F.xxhash64(F.lit(seed), ident), ids.where(F.col(ident).isNotNull())
    some = known.agg(F.approx_count_distinct(ident)).first()[0]
    if some > 2 * rows:  # the lowest share of the hashes, with more room than the estimate and chance can need
        known = known.where(near < F.lit(lowest((1.3 * rows + 200) / some)))
    picked = known.groupBy(F.col(ident).alias("_id")).agg(*([F.min(label).alias("_label")] if label else []), F.min(near).alias("_near"))
    picked = picked.orderBy("_near", "_id").limit(rows).drop("_near")
    found = docs.select(F.col(ident).alias("_own"), F.col(text).alias("_text")).join(F.broadcast(picked), F.col("_own") == F.col("_id"))
    one = found.groupBy("_id").agg(F.min_by("_text", F.xxhash64("_text")).alias(text), *([F.first("_label").alias(label)] if label else []))
    return one.withColumnRenamed("_id", ident)


def small_batches(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def scored(docs: DataFrame, score: Callable[[list[str | None]], dict[str, np.ndarray]], schema: str, ident: str, text: str) -> DataFrame:
    """``score`` of every whole text in batches; the result has the identifier and what ``score`` returns."""
    small_batches(docs.sparkSession)
    kind = docs.schema[ident].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                found = score(b.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(x) for x in found.values())], [ident, *found])

    return spread(docs.select(ident, text)).mapInArrow(lean(run), f"`{ident}` {kind}, {schema}")
