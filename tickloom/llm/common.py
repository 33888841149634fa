"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import functools
import gc
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def scratch_dir(spark: SparkSession) -> str:
    """A new folder path below spark.checkpoint.dir; a local one of our own only where that setting is absent."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir names no folder that all executors share")
        base = f"file://{tempfile.gettempdir()}/tickloom-checkpoints"
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/tickloom/{uuid.uuid4().hex}"


def materialize(df: DataFrame) -> DataFrame:
    """Write a table to the shared folder and read it back: later stages survive lost executors and reuse the work.

    The folder goes when the application ends.
    """
    spark = df.sparkSession
    path = scratch_dir(spark)
    df.write.parquet(path)
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(place)
    return spark.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Fewer rows in the batches that Python workers get: whole texts are long."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def tidy(run):
    """A function of an iterator of batches that, after the last, gives the memory it has freed back to the system.

    Python workers are reused by later tasks, beside a JVM that has its own share of an executor's memory.
    """

    @functools.wraps(run)
    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
                trim(0)

    return wrapped


def remainder(id_col: Column, n: int) -> Column:
    """crc32 of the id as text, mod n; a null id counts as 0."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % n, F.lit(0))


def words(text: str | None) -> list[bytes]:
    """Words `[^\\x20\\x09-\\x0D]+` with A-Z lower-cased, as UTF-8 (bytes.lower and bytes.split touch ASCII only)."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def small_enough(df: DataFrame, limit: int) -> bool:
    """True if the table has at most `limit` rows; reads no more than that many."""
    return df.limit(limit + 1).count() <= limit
