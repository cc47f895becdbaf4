"""Helpers shared by the corpus operators: shared-folder tables and bounded Arrow batches."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.tables import cut as materialise  # noqa: F401
from ..plans.tables import discard, shared_dir  # noqa: F401

#: Regular expression of a word: a run of characters other than space and U+0009 to U+000D.
WORD = r"[^\x20\x09-\x0D]+"

#: Text bytes that one slice of an Arrow batch holds at most (a longer single text stands alone).
SLICE_BYTES = 8 << 20

#: Rows of one bucket of a distributed running sum, about.
BUCKET_ROWS = 2000


def col(name: str) -> Column:
    """A column by its exact name, dots and backticks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def slices(batches: Iterable[pa.RecordBatch], text: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that the ``text`` column of each part has at most about ``most`` bytes."""
    for batch in batches:
        n = batch.num_rows
        col = batch.column(batch.schema.get_field_index(text))
        if n <= 1 or col.nbytes <= most:
            if n:
                yield batch
            continue
        step = max(1, int(n * most / col.nbytes))
        for at in range(0, n, step):
            part = batch.slice(at, step)
            if part.num_rows > 1 and part.column(part.schema.get_field_index(text)).nbytes > 4 * most:
                for k in range(part.num_rows):
                    yield part.slice(k, 1)
            else:
                yield part


def utf8(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column; null is empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def only(df: DataFrame, *names: str) -> DataFrame:
    """The named columns alone, so that other columns cannot clash with those that an operator adds."""
    return df.select(*[col(n) for n in names])


def starts(df: DataFrame, group: str, order: list[Column], size: str, rows: int, name: str = "start") -> DataFrame:
    """``df`` with the column ``name``: the running sum of ``size`` before each row of its group, in order of buckets and within
    them of ``order``. Two levels, so that a group of any size is spread over many tasks."""
    buckets = max(1, rows // BUCKET_ROWS)
    df = df.withColumn("_b", F.pmod(F.xxhash64(*order), F.lit(buckets)))
    base = df.groupBy(group, "_b").agg(F.sum(size).alias("_n"))
    before = Window.partitionBy(group).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    base = base.select(group, "_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    inner = Window.partitionBy(group, "_b").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    df = df.withColumn("_own", F.coalesce(F.sum(size).over(inner), F.lit(0)))
    return df.join(base, [group, "_b"]).withColumn(name, F.col("_base") + F.col("_own")).drop("_b", "_base", "_own")
