"""Tables kept for several uses: written to the folder that all executors share and read back, so that lost executors cost nothing."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """A new folder path below spark.checkpoint.dir, which goes when the application ends.

    Where that setting is absent a folder of this machine is taken, in local mode alone.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir names no folder that all executors share")
        base = f"file://{tempfile.gettempdir()}/tickloom-tables"
    path = f"{base.rstrip('/')}/tables/{uuid.uuid4().hex}"
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files.mkdirs(place)
    files.deleteOnExit(place)
    return path


def stored(df: DataFrame) -> DataFrame:
    """df as a table in a shared folder."""
    path = f"{shared_folder(df.sparkSession)}/rows"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
