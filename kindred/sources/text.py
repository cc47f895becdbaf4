"""Line-numbered text in any compression: plain, gzip and bzip2 by Spark, xz and lzma by Python on binary files."""

from __future__ import annotations

import lzma
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line long, value): lines in order; numbers start at 0 in each file.

    Plain, gzip and bzip2 files are numbered in two levels, within each block that Spark reads and by the lines of the
    blocks before it, so that a large file is spread over many tasks. The order of a folder is that of (file, line)."""
    packed = path.endswith((".xz", ".lzma"))
    if packed:
        raw = spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), "content")

        def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for name, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    lines = lzma.decompress(data).decode().splitlines()
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(lines), pa.string()), pa.array(range(len(lines)), pa.int64()), pa.array(lines, pa.string())], names=["file", "line", "value"])

        return raw.mapInArrow(unpack, "file string, line long, value string")
    raw = spark.read.text(path, lineSep="\n").select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_b"), F.monotonically_increasing_id().alias("_m"))
    # lines that start before a block: the same however the file is split, so a block without a count is an error
    sizes = raw.groupBy("file", "_b").agg(F.count("*").alias("_n"), F.min("_m").alias("_first"))
    before = F.sum("_n").over(Window.partitionBy("file").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1))
    first = sizes.select("file", "_b", "_n", "_first", F.coalesce(before, F.lit(0)).alias("_s"))
    # a block is read in order by one task, so its rows have consecutive ids: no line is moved or sorted, the table of blocks is small
    placed = raw.join(F.broadcast(first), ["file", "_b"], "left").withColumn("_i", F.col("_m") - F.col("_first"))
    wrong = F.raise_error(F.lit("a file was split anew while its lines were numbered")).cast("long")
    start = F.when((F.col("_i") >= 0) & (F.col("_i") < F.col("_n")), F.col("_s")).otherwise(wrong)
    return placed.select("file", (start + F.col("_i")).alias("line"), F.regexp_replace("value", "\\r$", "").alias("value"))


def placed(df: DataFrame, keys: list[str], name: str, span: int = 100_000) -> DataFrame:
    """``df`` (file, line, ...) with the place (int, from 0) of each line among those of its keys, in order of file and
    line. Two levels: within ``span`` line numbers, and by the lines of the spans before."""
    df = df.withColumn("_span", F.floor(F.col("line") / span))
    own = [*keys, "file", "_span"]
    before = F.sum("_n").over(Window.partitionBy(*(keys or [F.lit(0)])).orderBy("file", "_span").rowsBetween(Window.unboundedPreceding, -1))
    first = df.groupBy(*own).agg(F.count("*").alias("_n")).select(*own, F.coalesce(before, F.lit(0)).alias("_before"))
    inner = F.row_number().over(Window.partitionBy(*own).orderBy("line")) - 1
    return df.withColumn("_i", inner).join(first, own).withColumn(name, (F.col("_before") + F.col("_i")).cast("int")).drop("_span", "_before", "_i")


def fields(value: str = "value", delimiter: str | None = None):
    """The fields of a line: runs of white space part them unless a delimiter is named."""
    if delimiter is None:
        return F.split(F.trim(F.regexp_replace(value, "\\s+", " ")), " ")
    return F.split(F.col(value), F.lit("\\Q" + delimiter + "\\E"))


def rows(spark: SparkSession, path: str) -> DataFrame:
    """(value) of lines whose order means nothing: split by Spark wherever it likes."""
    if path.endswith((".xz", ".lzma")):
        return read_lines(spark, path).select("value")
    return spark.read.text(path)
