"""Exact deduplication by a stateful stream.

A file stream feeds a keyed state on disk (RocksDB, no expiry): for each digest the largest identifier, the locator of
its row (a hash of the file's path, and the row number) and the number of rows. A later call with the same ``state`` reads only new files. Rows
that hit a digest already held by another row are then compared byte for byte with the text at the kept locator; texts
that differ under one digest are grouped by their bytes instead.

Defined results: a null text counts as empty; a null identifier is below all others; of rows with equal text and equal
identifier the one with the greatest locator stays, so exactly one row of a group does; a very long text is held
only by the tasks that compare its copies; an empty table gives an empty
result; other columns of the input are not read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import in_bloom, join_groups, scratch, settled

#: Copies that share one task at most when bytes are compared: larger groups are dealt over several.
COPIES_A_TASK = 500


def sha256(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def _held(spark: SparkSession, path: str, of: list[Column], state: str, files: int) -> DataFrame:
    """Runs the stream over the files that ``state`` hasn't seen; the state as a table."""
    schema = spark.read.parquet(path).schema
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    if at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(at).isFile():
        path = path[:-1] + f"[{path[-1]}]"  # a stream takes a folder or a pattern
    settings = {
        "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
        "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
        "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "256",
        # many partitions with little state each: no space is reserved ahead for logs, and changes are kept, not whole copies
        "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
        "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    }
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path).select(*of)
        kept = stream.groupBy("digest").agg(F.max("place").alias("keep"), F.count(F.lit(1)).alias("n"))
        run = kept.writeStream.outputMode("update").format("noop").option("checkpointLocation", state).trigger(availableNow=True).start()
        run.awaitTermination()
        held = spark.read.format("statestore").load(state)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)
    value = held.schema["value"].dataType.names
    return held.select(F.col("key").getField("digest").alias("digest"), F.col("value").getField(value[0]).alias("keep"), F.col("value").getField(value[1]).alias("n"))


def exact_dedup(
    spark: SparkSession, path: str, text: str = "text", ident: str = "doc_id", digest: Callable[[Column], Column] = sha256, state: str | None = None, files: int = 10_000
) -> DataFrame:
    """A row for each row below ``path``: doc_id, keep_id, group_size, kept, text_sha256, file and row_index.

    ``files`` is how many files one micro-batch takes; ``state`` is the stream's checkpoint folder (a new one by default).
    """
    body = F.coalesce(F.col(text), F.lit(""))
    place = F.struct(F.col(ident).alias("doc_id"), F.xxhash64(F.col("_metadata.file_path")).alias("at"), F.col("_metadata.row_index").alias("row_index"))
    held = settled(_held(spark, path, [digest(body).alias("digest"), place.alias("place")], state or scratch(spark, "dedup-state"), files), "dedup-held")

    rows = spark.read.parquet(path).select(place.alias("place"), digest(body).alias("digest"), sha256(body).alias("text_sha256"), body.alias("body"), F.col("_metadata.file_path").alias("file"))
    several = held.where("n > 1")
    # only texts whose digest several rows share are moved and compared
    hits = join_groups(rows.drop("file").where(in_bloom(several, F.xxhash64("digest"), F.xxhash64("digest"))), "digest", F.col("place"), several)
    hits = hits.withColumn("part", F.pmod(F.xxhash64("place"), F.ceil(F.col("n") / COPIES_A_TASK)).cast("int"))
    first = hits.where("place = keep").select(F.col("digest").alias("d"), F.col("body").alias("kept_body"), F.explode(F.sequence(F.lit(0), (F.ceil(F.col("n") / COPIES_A_TASK) - 1).cast("int"))).alias("p"))
    odd = hits.join(first, (F.col("digest") == F.col("d")) & (F.col("part") == F.col("p"))).where("body <> kept_body")
    odd = settled(odd.select("digest", "place", "body"), "dedup-odd")

    narrow = rows.select("place", "digest", "text_sha256", "file")  # the path is read only where the caller selects it
    out = join_groups(narrow, "digest", F.col("place"), held)
    if not odd.isEmpty():  # different bytes under one digest: all rows of that digest are grouped by their bytes
        mixed = odd.select("digest").distinct()
        again = rows.join(mixed, "digest", "left_semi")
        groups = again.groupBy("digest", "body").agg(F.max("place").alias("keep"), F.count(F.lit(1)).alias("n"))
        out = out.join(mixed, "digest", "left_anti").unionByName(again.join(groups, ["digest", "body"]).drop("body"))
    return out.select(
        F.col("place.doc_id").alias("doc_id"), F.col("keep.doc_id").alias("keep_id"), F.col("n").cast("long").alias("group_size"), (F.col("place") == F.col("keep")).alias("kept"),
        "text_sha256", "file", F.col("place.row_index").alias("row_index"),
    )
