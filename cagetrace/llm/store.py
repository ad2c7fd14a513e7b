"""Shared storage: staged tables, and files written by tasks.

Everything goes below ``spark.checkpoint.dir``, the folder that driver and
executors share; ``ensure_checkpoint_dir`` sets one only in local mode.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from cagetrace.session import ensure_checkpoint_dir


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new, unused folder URI in the shared folder, removed when the JVM ends."""
    base = spark.conf.get("spark.checkpoint.dir", None) or ensure_checkpoint_dir(spark)
    uri = f"{base.rstrip('/')}/llm-{name}-{uuid.uuid4().hex[:16]}"
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(uri)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.deleteOnExit(path)
    return fs.makeQualified(path).toString()


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write *df* as Parquet in the shared folder and read it again.

    Cuts lineage like a reliable checkpoint, but columnar, so that later
    readers scan only the columns they use.
    """
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.staged_at = path
    return out


def drop(spark: SparkSession, *tables: DataFrame) -> None:
    """Remove staged *tables* that nothing reads any more, and let Spark drop the shuffle files of jobs that have ended.

    Spark's cleaner removes these once the driver's garbage collector has
    found that no plan needs them, by itself only every half hour.  The events
    of a job that has just ended still hold its plan, so it runs twice.
    """
    import gc
    import time
    jvm = spark.sparkContext._jvm
    for t in tables:
        path = jvm.org.apache.hadoop.fs.Path(t.staged_at)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    for _ in range(2):
        time.sleep(0.4)
        gc.collect()
        jvm.System.gc()


def open_fs(uri: str):
    """(pyarrow file system, path) of a shared URI; runs in tasks."""
    from pyarrow import fs
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri.split(":", 1)[1].lstrip("/")
    return fs.FileSystem.from_uri(uri)


_holder: list = [None, None]


def only(owner: str, free=None) -> None:
    """Let *owner* alone keep caches in this Python worker, which Spark reuses from stage to stage.

    What the owner before it kept goes by its *free*, and the memory back to the system.
    """
    if _holder[0] == owner:
        return
    if _holder[1]:
        _holder[1]()
    _holder[:] = owner, free
    import gc
    gc.collect()
    tidy()


def tidy() -> None:
    """Give memory that nothing holds back to the system: Arrow's pool and the C library keep it, also while the worker idles."""
    import ctypes

    import pyarrow as pa
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not glibc
        pass
