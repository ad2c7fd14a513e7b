"""Which recordings a result table holds, and from what they were made.

The ledger is one Parquet table beside the result tables.  A row says that a
run wrote a family's tables for one recording, and carries a digest of all
that decides the result: the log's size and time of change, the parameters,
the subject list and the format.  New logs, changed logs and changed settings
are what the ledger does not hold (an anti-join); each run appends its own
rows, and readers take a recording from the last run that is in the ledger.
A run that ended before its ledger rows were written is never read, so it can
be repeated at any time.  Results of logs that were taken away stay.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cagetrace.session import stage
from cagetrace.sources import logs as L

SCHEMA = "recording string, family string, digest string, run string, seq long"


def table_digest(df: DataFrame) -> str:
    """Digest of a table's columns and rows in any order; one row reaches the driver.

    Two sums of row hashes, unreduced, and the count: equal rows count as often as they occur.
    """
    cols = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("\0")) for c in df.columns]
    wide = lambda h: F.sum(h.cast("decimal(38,0)"))
    r = df.select(F.xxhash64(*cols).alias("a"), F.xxhash64(F.lit(1), *cols).alias("b")).agg(F.count("*"), wide(F.col("a")), wide(F.col("b"))).first()
    return f"{df.columns} {r[0]} {r[1]} {r[2]}"


def wanted(files: DataFrame, settings: str) -> DataFrame:
    """(recording, digest) of *files* (path, size, changed) under *settings*."""
    facts = F.concat_ws("|", F.col("size").cast("string"), F.unix_micros("changed").cast("string"), F.lit(settings))
    return files.select(F.col("path").alias(L.RECORDING), F.sha2(facts, 256).alias("digest"))


def entries(spark: SparkSession, out_dir: str) -> DataFrame:
    """The newest ledger row of each recording and family."""
    path = f"{out_dir.rstrip('/')}/ledger"
    p = spark._jvm.org.apache.hadoop.fs.Path(path)  # noqa: SLF001
    if not p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):  # noqa: SLF001
        return spark.createDataFrame([], SCHEMA)
    rows = spark.read.schema(SCHEMA).parquet(path)
    last = F.max(F.struct("seq", "run", "digest")).alias("last")
    return rows.groupBy(L.RECORDING, "family").agg(last).select(L.RECORDING, "family", "last.digest", "last.run", "last.seq")


def missing(spark: SparkSession, out_dir: str, want: DataFrame, families: list[str]) -> tuple[DataFrame, list[str]]:
    """(stored (recording, digest) rows that some family lacks, those families)."""
    each = want.withColumn("family", F.explode(F.array(*map(F.lit, families)))) if families else want.withColumn("family", F.lit("")).limit(0)
    lacks = stage(each.join(entries(spark, out_dir), [L.RECORDING, "digest", "family"], "left_anti"), "lacks")
    of = [r.family for r in lacks.select("family").distinct().collect()]   # at most the three families
    return lacks.select(L.RECORDING, "digest").distinct(), sorted(of)


def new_run(spark: SparkSession, out_dir: str) -> tuple[str, int]:
    seq = (entries(spark, out_dir).agg(F.max("seq")).first()[0] or 0) + 1
    return f"r{seq:06d}-{uuid.uuid4().hex[:8]}", seq


def record(rows: DataFrame, out_dir: str, family: str, run: str, seq: int) -> None:
    """Append *rows* (recording, digest): the tables of *family* hold them from *run* on."""
    out = rows.select(L.RECORDING, F.lit(family).alias("family"), "digest", F.lit(run).alias("run"), F.lit(seq).cast("long").alias("seq"))
    out.write.mode("append").parquet(f"{out_dir.rstrip('/')}/ledger")


def newest(df: DataFrame, out_dir: str, family: str) -> DataFrame:
    """The rows of a result table that are in force."""
    now = entries(df.sparkSession, out_dir).where(F.col("family") == family).select(L.RECORDING, "run")
    return df.join(now, [L.RECORDING, "run"], "left_semi").drop("run")
