"""Spark session helpers."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession


def build_session(master: str = "local[8]", app: str = "cagetrace",
                  shuffle_partitions: int = 8, scratch: str | None = None) -> SparkSession:
    """Session for tests and the bench: UTC, AQE on, UI off."""
    b = (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "64k")   # chunk stages cost CPU, not bytes
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.codegen.cache.maxEntries", "2000")   # wide frames make many classes; 100 entries thrash
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")   # no call site per column expression
    )
    if scratch:
        b = b.config("spark.local.dir", scratch)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark, scratch)
    return spark


def ensure_checkpoint_dir(spark: SparkSession, scratch: str | None = None) -> str:
    """Return the cluster's shared checkpoint folder.

    On a cluster ``spark.checkpoint.dir`` names a shared folder and is used
    as is; if it is unset there, this raises rather than pick a
    machine-local folder.  Only in local mode (tests) is a scratch folder
    made when the setting is unset.
    """
    sc = spark.sparkContext
    d = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder (e.g. on HDFS/S3)")
        base = scratch or tempfile.mkdtemp(prefix="cagetrace-ckpt-")
        d = os.path.join(base, "checkpoints")
        spark.conf.set("spark.checkpoint.dir", d)
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(d)
    return d


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint into the shared checkpoint folder.

    Survives executor loss (unlike a local checkpoint) and keeps retries of
    later stages from recomputing the cleaning windows.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write *df* once as Parquet in the shared folder and read it again.

    Cuts lineage like a reliable checkpoint but keeps columns apart, so later
    readers scan only what they use.  The folder goes when the JVM ends.
    """
    import uuid
    spark = df.sparkSession
    base = spark.conf.get("spark.checkpoint.dir", None) or ensure_checkpoint_dir(spark)
    path = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex[:16]}"
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)  # noqa: SLF001
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop)  # noqa: SLF001
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
