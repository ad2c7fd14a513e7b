"""Incremental sweep over a growing folder of tracker logs.

The reference processes log files one after another and appends each
file's measures to the result tables.  Here a file stream source watches
the log folder; every micro-batch holds whole new files (a file is never
split across batches), runs the same batch plan on them (line numbers,
parse, clean-and-derive, sweep) and appends the measure tables.

Writes are idempotent per micro-batch: each batch lands in its own
``batch_id=<epoch>`` partition with dynamic partition overwrite, so a
replayed epoch after a failure rewrites the same rows instead of adding
duplicates.  Files must be complete when they appear in the folder
(write elsewhere, then move in).
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cagetrace.params import CleanParams, SweepParams
from cagetrace.plans import clean_derive as P
from cagetrace.plans import sweep as SW
from cagetrace.sources import logs as L
from cagetrace.sources import subjects as SJ


def sweep_batch(raw: DataFrame, clean: CleanParams, sp: SweepParams,
                subject_list: DataFrame | None = None) -> SW.SweepTables:
    """The batch plan for one set of whole log files (``logs.with_positions``).

    Keyed by recording, as in the batch path: several cameras may share a session.
    """
    frames = L.frames_from_raw(raw)
    info = None
    if subject_list is not None:
        info = SJ.subject_info(L.number_lines(raw), subject_list).withColumnRenamed("path", L.RECORDING)
    return SW.sweep(P.behavior(frames, clean, L.RECORDING), sp, info)


def start(spark: SparkSession, log_folder: str, out_dir: str, checkpoint: str,
          clean: CleanParams, sp: SweepParams, subject_list: DataFrame | None = None,
          glob: str = "*.csv", max_files_per_trigger: int | None = None,
          available_now: bool = True):
    """Start the stream; returns the StreamingQuery.

    ``checkpoint`` (stream progress) and ``out_dir`` must be shared folders
    on a cluster.  With ``available_now`` the query processes every file
    present and stops (batch-like runs); otherwise it keeps watching.
    """
    reader = spark.readStream.format("text").option("pathGlobFilter", glob)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", int(max_files_per_trigger))
    stream = reader.load(log_folder).select(*L.file_cols(), "value")

    def process(batch: DataFrame, epoch: int) -> None:
        if batch.isEmpty():
            return
        tables = sweep_batch(L.with_positions(batch), clean, sp, subject_list)
        for key, df in tables.items():
            kind = key.split("_")[1]
            parts = ["batch_id"] + [c for c in SW.PARTITIONS[kind] if c in df.columns]
            (df.withColumn("batch_id", F.lit(int(epoch)))
             .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
             .partitionBy(*parts).parquet(os.path.join(out_dir, key)))

    w = stream.writeStream.foreachBatch(process).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="30 seconds")
    return w.start()
