"""What the operators of this subpackage share: tables, scratch folders, bounded Bloom filters."""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_type

#: Plans of less than this a task are dealt over all tasks.
_TASK_BYTES = 4 << 20
#: A word is a run of characters other than space, tab, LF, VT, FF and CR.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the supplied Parquet tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def local_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A table of the driver's ``rows``, handed over as Arrow: a plain list would be unpickled by Python workers of a second kind, which then stay in every executor."""
    if not rows:
        return spark.createDataFrame([], schema)
    fields = T.StructType.fromDDL(schema)
    columns = [pa.array(c, to_arrow_type(f.dataType)) for c, f in zip(zip(*rows), fields)]
    return spark.createDataFrame(pa.Table.from_arrays(columns, fields.names), fields)


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors see: ``spark.checkpoint.dir``. Where it is unset, a new local one, and only in local mode: executors elsewhere would not see it."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        import tempfile

        found = "file://" + tempfile.mkdtemp(prefix="sunstride-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder; no two calls give the same one."""
    return f"{shared_dir(spark)}/sunstride/{name}-{uuid.uuid4().hex}"


#: Scratch paths of this process that are still there.
_PATHS: set[str] = set()


def settled(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back: lineage ends there and a lost executor costs no recomputation."""
    spark, path = df.sparkSession, scratch(df.sparkSession, name)
    df.write.parquet(path)
    _PATHS.add(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._sunstride_path = path
    return out


def discard(df: DataFrame) -> None:
    """Deletes what ``settled`` wrote for ``df``; no later plan may read it."""
    drop_scratch(df.sparkSession, df._sunstride_path)


def drop_scratch(spark: SparkSession, path: str | None = None) -> None:
    """Deletes a scratch path that no later plan reads; without a path, all tables that this process has settled."""
    jvm = spark.sparkContext._jvm
    for one in [path] if path else list(_PATHS):
        p = jvm.org.apache.hadoop.fs.Path(one)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
        _PATHS.discard(one)


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all tasks if it is small and so may lie in a single file; the rows are the same."""
    tasks = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(tasks) if int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) < tasks * _TASK_BYTES else df


def word_count(text: Column | str) -> Column:
    """Number of words (see WORD) as a long; 0 for null."""
    text = F.col(text) if isinstance(text, str) else text
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def row_key(ident: str, text_hash: Column) -> Column:
    """A name for a row by its identifier and the hash of its text: an identifier may repeat with other texts."""
    return F.md5(F.concat_ws("/", F.coalesce(F.col(ident).cast("string"), F.lit("-")), F.hex(text_hash)).cast("binary"))


def text_hash(text: str) -> Column:
    """128 bits of a text's bytes; null counts as empty."""
    return F.unhex(F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary")))


def free(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many marks before it as keep it apart from the columns of ``df``."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name in taken:
            name = "_" + name
        out.append(name)
        taken.add(name)
    return out


#: Bits of a Bloom filter: sixteen a key, between these.
LEAST_BITS, MOST_BITS = 1 << 20, 1 << 27


def in_bloom(keys: DataFrame, key: Column, probe: Column) -> Column:
    """A condition on ``probe`` (a long) that holds wherever its value is among ``key`` of ``keys`` (a settled table), and rarely elsewhere.

    The filter has 16 bits a key and 16 MB at most, so what is sent to executors is bounded; from some 30 million keys on
    it lets more rows through, and the exact join after it decides.
    """
    bits = LEAST_BITS
    while bits < min(MOST_BITS, 16 * keys.count()):
        bits *= 2
    places = keys.select(F.explode(F.array(key.bitwiseAND(bits - 1), F.shiftrightunsigned(key, 32).bitwiseAND(bits - 1))).alias("at"))
    words = places.groupBy(F.shiftright("at", 5).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at & 31 as int))")).alias("mask")).toArrow()
    filled = np.zeros(bits // 32, dtype=np.uint32)
    filled[words["word"].to_numpy()] = words["mask"].to_numpy().astype(np.uint32)
    sent = keys.sparkSession.sparkContext.broadcast(filled)

    @F.arrow_udf(T.BooleanType())
    def seen(h: pa.Array) -> pa.Array:
        table, v = sent.value, h.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
        found = np.ones(len(v), dtype=bool)
        for at in (v & np.uint64(bits - 1), (v >> np.uint64(32)) & np.uint64(bits - 1)):
            found &= (table[(at >> np.uint64(5)).astype(np.int64)] >> (at & np.uint64(31)).astype(np.uint32) & 1).astype(bool)
        return pa.array(found)

    return seen(probe)


#: Rows of one key that meet in a task at most before the key is dealt over several; keys above a thousandth of all rows are hot.
ROWS_A_TASK, HOT_KEYS = 500, 1000


def join_groups(rows: DataFrame, key: str, by: Column, groups: DataFrame, size: str = "n", total: int | None = None) -> DataFrame:
    """Inner join of ``rows`` with ``groups`` (one row a ``key``, ``size`` rows in each) that deals hot keys over tasks.

    Keys with more than ROWS_A_TASK rows and more than a thousandth of all are split by the hash of ``by`` and their
    group's row is repeated for each part; at most HOT_KEYS keys can be that large, so sending them to all tasks is bounded.
    ``total`` is the number of all rows, if it is known.
    """
    total = total if total is not None else groups.agg(F.sum(size)).first()[0] or 0
    bound = max(ROWS_A_TASK, total // HOT_KEYS)
    hot = F.broadcast(groups.where(F.col(size) > bound).select(F.col(key).alias("_hot"), F.ceil(F.col(size) / ROWS_A_TASK).cast("int").alias("_parts")))
    parts = F.coalesce("_parts", F.lit(1))
    left = rows.join(hot, F.col(key) == F.col("_hot"), "left").withColumn("_part", F.pmod(F.xxhash64(by), parts).cast("int")).drop("_hot", "_parts")
    right = groups.join(hot, F.col(key) == F.col("_hot"), "left").withColumn("_part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("_hot", "_parts")
    return left.join(right, [key, "_part"]).drop("_part")
