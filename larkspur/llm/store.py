"""Where intermediate tables go: the shared folder the session names, never a machine's own disk."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: str | None = None
BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def bounded_batches(spark: SparkSession, most: str = "8m") -> None:
    """Hand Python batches of at most `most` bytes (or one longer row), unless the session has set a bound of its own."""
    if spark.conf.get(BATCH_BYTES) == "67108864b":  # the default
        spark.conf.set(BATCH_BYTES, most)


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where that is unset (a single machine), one of our own."""
    global _own
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if _own is None:
        _own = tempfile.mkdtemp(prefix="larkspur-")
        atexit.register(shutil.rmtree, _own, ignore_errors=True)
    return f"file://{_own}"


def written(df: DataFrame, tag: str) -> DataFrame:
    """Write df as Parquet to the shared folder and reread it: lineage ends there, lost executors cost nothing."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def forget(df: DataFrame) -> None:
    """Delete a table that written() made, once nothing reads it any more."""
    spark = df.sparkSession
    jvm = spark._jvm
    for name in {os.path.dirname(f) for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
