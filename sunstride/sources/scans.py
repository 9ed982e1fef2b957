"""Typed scans. NaN becomes NULL, and the stored order is kept as (file, row_index) where an operator depends on it."""

from __future__ import annotations

import io
import os
import re
import zipfile
from collections.abc import Sequence
from functools import reduce
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..functions import lenient_double, lenient_timestamp, null_if_nan

#: The measures of the day-ahead predictors.
PREDICTORS = ("VAR78", "VAR79", "VAR134", "VAR157", "VAR164", "VAR165", "VAR166", "VAR167", "VAR169", "VAR175", "VAR178", "VAR228")
#: What a station's header contains (or, after ^, begins with), lower-cased, and the name that it gets; the first that fits counts.
HEADERS = (
    ("^time", "ts"), ("total solar", "irr_total"), ("direct normal", "dni"), ("global hori", "ghi"),
    ("temperature", "temp"), ("atmosphere", "pressure"), ("humidity", "humidity"), ("power", "power"),
)
STATION = ("irr_total", "dni", "ghi", "temp", "pressure", "humidity", "power")
SHARD = T.StructType([T.StructField("image", T.StructType([T.StructField("bytes", T.BinaryType()), T.StructField("path", T.StringType())])), T.StructField("time", T.TimestampType()), T.StructField("pv", T.FloatType())])


def without_nan(df: DataFrame) -> DataFrame:
    floats = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return df.withColumns({c: null_if_nan(c) for c in floats})


def day_ahead(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """CSV with ZONEID, TIMESTAMP (``20130101 1:00``) and measures; columns ZONE and ts, in file order."""
    raw = spark.read.csv(path, header=True)
    numbers = {c: lenient_double(c) for c in raw.columns if c not in ("ZONEID", "TIMESTAMP")}
    return raw.withColumns({"ts": lenient_timestamp("TIMESTAMP"), "ZONEID": F.col("ZONEID").cast("int")} | numbers).withColumnRenamed("ZONEID", "ZONE").drop("TIMESTAMP")


def assemble_day_ahead(train: DataFrame, predictors: DataFrame, solution: DataFrame) -> DataFrame:
    """Weather with the power of train, else of the solution; and raises where weather has no power."""
    w = [train.select("ZONE", "ts", "POWER", F.lit(0).alias("_o")), solution.select("ZONE", "ts", "POWER", F.lit(1).alias("_o"))]
    power = w[0].unionByName(w[1]).groupBy("ZONE", "ts").agg(F.min_by("POWER", "_o").alias("POWER"))
    out = predictors.join(power, ["ZONE", "ts"], "left")
    return out.withColumn("POWER", F.coalesce("POWER", F.raise_error(F.lit("a weather row has no power")).cast("double")))


def load_zones(combined: DataFrame, zones: Sequence[int], measures: Sequence[str] = PREDICTORS) -> tuple[dict[int, DataFrame], DataFrame]:
    """ts, ZONE, POWER and the measures of the wanted zones: a frame for each zone, and all of them. The filter reaches the scan."""
    every = combined.where(F.col("ZONE").isin(*zones)).select("ts", "ZONE", "POWER", *measures)
    return {z: every.where(F.col("ZONE") == z) for z in zones}, every


def _renamed(columns: Sequence[str], headers=HEADERS) -> dict[str, str]:
    """New names of those columns that a header fits; the first column that fits a name has it."""
    names: dict[str, str] = {}
    for column in columns:
        low = column.lower().strip()
        found = next((name for part, name in headers if (low.startswith(part[1:]) if part[0] == "^" else part in low)), None)
        if found and found not in names.values():
            names[column] = found
    return names


def harmonise(df: DataFrame, headers=HEADERS, measures: Sequence[str] = STATION) -> DataFrame:
    """Renames by what headers contain, in order, and adds absent measures as NULL."""
    names = _renamed(df.columns, headers)
    out = df.select(*(F.col(f"`{c}`").alias(n) for c, n in names.items()))
    return out.withColumns({m: F.lit(None).cast("string") for m in measures if m not in out.columns})


_STATION_FILE = re.compile(r"site (?P<site>\d+).*?capacity-(?P<capacity>\d+)MW|capacity-(?P<capacity2>\d+)MW.*?site (?P<site2>\d+)")


def _wanted(paths: Sequence[str], sites: Sequence[int] | None) -> dict[str, tuple[int, float]]:
    """Site and capacity by path, of the wanted sites."""
    about = {}
    for p in sorted(paths):
        if not (found := _STATION_FILE.search(os.path.basename(p))):
            raise ValueError(f"no site or capacity in {os.path.basename(p)}")
        about[p] = (int(found["site"] or found["site2"]), float(found["capacity"] or found["capacity2"]))
    about = {p: x for p, x in about.items() if sites is None or x[0] in sites}
    if not about:
        raise ValueError("no station file")
    return about


def _of_files(rows: DataFrame, about: dict[str, tuple[int, float]]) -> DataFrame:
    """Rows with what their file's (``_file``) name says, without those that have no time."""
    files = rows.sparkSession.createDataFrame([(os.path.basename(p), *x, k) for k, (p, x) in enumerate(about.items())], "_name string, site int, capacity double, file_order int")
    out = rows.join(F.broadcast(files), F.col("_file") == F.col("_name"))  # a row a file
    return out.select("ts", *STATION, "site", "capacity", "file_order", "row_order").na.drop(subset=["ts"])


def stations(spark: SparkSession, paths: Sequence[str], sites: Sequence[int] | None = None) -> DataFrame:
    """CSV exports of station workbooks; site and capacity come from the file name, and files of other sites aren't opened.

    Files with the same header are one scan, so the plan grows with the different headers and not with the files.
    """
    wanted = _wanted(paths, sites)
    headers: dict[tuple[str, ...], list[str]] = {}
    for p in wanted:
        headers.setdefault(tuple(spark.read.csv(p, header=True).columns), []).append(p)
    typed = {m: lenient_double(m) for m in STATION} | {"ts": F.try_to_timestamp(F.col("ts")).cast("timestamp_ntz")}
    parts = []
    for group in headers.values():
        raw = spark.read.csv(group, header=True).select("*", F.url_decode(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1)).alias("_file"), F.monotonically_increasing_id().alias("_row"))
        parts.append(harmonise(raw, (*HEADERS, ("^_file", "_file"), ("^_row", "row_order"))).withColumns(typed).select("ts", *STATION, "_file", "row_order"))
    return _of_files(reduce(DataFrame.unionByName, parts), wanted)


def sheet_rows(raw: bytes) -> list[dict[str, str]]:
    """The rows of a workbook's first sheet as texts by column letter; an XLSX file is a ZIP of XML parts."""
    ns = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        names = z.namelist()
        shared = []
        if "xl/sharedStrings.xml" in names:
            shared = ["".join(t.text or "" for t in item.iter(f"{ns}t")) for item in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{ns}si")]
        first = min((n for n in names if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)), key=lambda n: (len(n), n))
        rows = []
        for row in ElementTree.fromstring(z.read(first)).iter(f"{ns}row"):
            cells = {}
            for c in row.iter(f"{ns}c"):
                value = c.find(f"{ns}v")
                text = "".join(t.text or "" for t in c.iter(f"{ns}t")) if c.get("t") == "inlineStr" else None if value is None else value.text
                if text is not None:
                    cells[re.sub(r"\d", "", c.get("r"))] = shared[int(text)] if c.get("t") == "s" else text
            rows.append(cells)
    return rows


def workbooks(spark: SparkSession, paths: Sequence[str], sites: Sequence[int] | None = None) -> DataFrame:
    """Station workbooks (XLSX) themselves, with the columns of ``stations``; a task holds one workbook at a time. Times may be texts or day numbers since 1899-12-30."""
    wanted = _wanted(paths, sites)
    columns = ["ts", *STATION]

    def run(batches):
        import pyarrow as pa

        for b in batches:
            for path, raw in zip(*(c.to_pylist() for c in b.columns)):
                head, *rows = sheet_rows(raw)
                place = {title: letter for letter, title in reversed(head.items())}
                letters = {name: place[title] for title, name in _renamed(list(head.values())).items()}
                out = [[r.get(letters.get(c, "")) for r in rows] for c in columns]
                n = len(rows)
                yield pa.RecordBatch.from_arrays([*(pa.array(v, pa.string()) for v in out), pa.array([path.rsplit("/", 1)[-1]] * n), pa.array(range(n), pa.int64())], [*columns, "_file", "row_order"])

    raw = spark.read.format("binaryFile").load(list(wanted)).select(F.url_decode("path"), "content")
    rows = raw.mapInArrow(run, ", ".join(f"{c} string" for c in (*columns, "_file")) + ", row_order long")
    number = F.expr("try_cast(ts AS DOUBLE)")
    ts = F.when(number.isNotNull(), F.expr("timestamp_ntz'1899-12-30' + make_dt_interval(0, 0, 0, round(try_cast(ts AS DOUBLE) * 86400))")).otherwise(F.try_to_timestamp(F.col("ts")).cast("timestamp_ntz"))
    return _of_files(rows.withColumns({m: lenient_double(m) for m in STATION} | {"ts": ts}), wanted)


def shards(spark: SparkSession, path: str, group: str, columns: Sequence[str] = ("time", "pv")) -> DataFrame:
    """Parquet shards of one group with the row's place; images are read only where asked for. Names and types are checked from the footers."""
    raw = spark.read.parquet(path)
    kinds = {f.name: f.dataType for f in raw.schema.fields}
    if missing := set(SHARD.names) - set(kinds):
        raise ValueError(f"shards lack {sorted(missing)}")
    wrong = [f.name for f in SHARD.fields if not (kinds[f.name] == f.dataType or (isinstance(f.dataType, T.TimestampType) and isinstance(kinds[f.name], T.TimestampNTZType)))]
    if wrong:
        raise ValueError(f"shards have other types: { {n: kinds[n].simpleString() for n in wrong} }")
    return raw.select(F.lit(group).alias("grp"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row_index"), *columns)


def shard_rows(spark: SparkSession, path: str) -> DataFrame:
    """Rows of each shard file, by the row numbers that its scan gives."""
    return spark.read.parquet(path).groupBy(F.col("_metadata.file_path").alias("file")).agg(F.count(F.lit(1)).alias("n_rows"))


def gather_rows(store: DataFrame, wanted: DataFrame) -> DataFrame:
    """The wanted (grp, file, row_index) with the store's columns: one join, not a lookup a row."""
    return wanted.join(store, ["grp", "file", "row_index"])


def decode_images(df: DataFrame, image: str = "image.bytes", out: str = "pixels", shape: tuple[int, int, int] = (64, 64, 3)) -> DataFrame:
    """PNG bytes to a flat array of pixels in Arrow batches; needs Pillow on the workers."""

    @F.pandas_udf("array<smallint>")
    def run(raw: pd.Series) -> pd.Series:
        from io import BytesIO

        import numpy as np
        from PIL import Image

        def one(x):
            a = np.asarray(Image.open(BytesIO(x)))
            if a.shape != shape:
                raise ValueError(f"image of shape {a.shape}, not {shape}")
            return a.astype("int16").ravel()

        return raw.map(one)

    return df.withColumn(out, run(image))


def brightness(pixels: str) -> F.Column:
    return F.aggregate(pixels, F.lit(0.0), lambda a, v: a + v) / F.size(pixels)


def channels_first(pixels: str, channels: int = 3) -> F.Column:
    """A flat height-width-channel array as channel-height-width, scaled to [0, 1]."""
    each = F.transform(F.sequence(F.lit(0), F.lit(channels - 1)), lambda c: F.filter(F.col(pixels), lambda _, i: F.pmod(i, F.lit(channels)) == c))
    return F.transform(F.flatten(each), lambda v: v / 255.0)


def metrics_from_notebooks(spark: SparkSession, path: str, wanted: Sequence[str]) -> DataFrame:
    """(name, rmse, mae) of lines ``NAME RMSE=x MAE=y`` in notebooks' outputs, printed or results; of a repeated name the last in a notebook counts. Raises if a wanted name is missing."""
    line = T.ArrayType(T.StringType())
    output = T.StructType([T.StructField("text", line), T.StructField("data", T.StructType([T.StructField("text/plain", line)]))])
    schema = T.StructType([T.StructField("cells", T.ArrayType(T.StructType([T.StructField("outputs", T.ArrayType(output))])))])
    text = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.from_json("value", schema).alias("n"))
    outputs = text.select("file", F.posexplode(F.flatten(F.transform("n.cells", lambda c: F.coalesce(c["outputs"], F.array().cast(T.ArrayType(output)))))).alias("at", "o"))
    printed = F.concat(F.coalesce("o.text", F.array().cast(line)), F.coalesce(F.col("o.data").getField("text/plain"), F.array().cast(line)))
    lines = outputs.select("file", "at", F.posexplode(F.split(F.array_join(printed, ""), "\n")).alias("line_at", "line"))
    part = lambda k: F.regexp_extract("line", r"^\s*['\"]?(.+?)\s+RMSE=([0-9.eE+-]+)\s+MAE=([0-9.eE+-]+)", k)
    named = lines.withColumns({"name": part(1), "_rmse": part(2), "_mae": part(3)}).where(F.col("name").isin(*wanted))
    found = named.groupBy("name").agg(F.max_by(F.struct(F.col("_rmse").cast("double").alias("rmse"), F.col("_mae").cast("double").alias("mae")), F.struct("file", "at", "line_at")).alias("m")).select("name", "m.*")
    lack = set(wanted) - {r[0] for r in found.select("name").collect()}
    if lack:
        raise ValueError(f"no metrics of {sorted(lack)}")
    return found
