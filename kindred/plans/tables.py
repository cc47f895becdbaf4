"""Session settings and tables written between iterations."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def session(name: str = "kindred", master: str | None = None, partitions: int | None = None) -> SparkSession:
    """A session with the settings that the library expects: adaptive plans, UTC, Arrow transfer."""
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    if partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(partitions))
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
    }
    for k, v in settings.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where it is unset, a folder of our own, but only if driver and tasks are one process."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("kindred.work.dir", None)
    if not found:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="kindred-work-")
        spark.conf.set("kindred.work.dir", found)
    return found.rstrip("/")


def cut(df: DataFrame, name: str = "table", codec: str = "zstd") -> DataFrame:
    """Write to a fresh path of the shared folder and read back: short lineage that survives lost executors, and later
    jobs read only the columns that they need. :func:`discard` removes the files."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/kindred-{name}-{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.__dict__["_kindred_path"] = path
    return out


def apart(df: DataFrame) -> DataFrame:
    """``df`` for joins in which both sides are dealt out by key. Files of :func:`cut` compress so well that their size tells
    nothing: Spark would take millions of rows for a small table and send them through the driver to every task."""
    return df.hint("merge")


def discard(*tables: DataFrame | None) -> None:
    """Remove the files of tables made by :func:`cut`, once nothing lazy reads them any more."""
    for df in tables:
        path = df.__dict__.pop("_kindred_path", None) if df is not None else None
        if path:
            spark = df.sparkSession
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
