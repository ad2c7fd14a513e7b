"""Parameter sweep: every measure family for a grid of windows, bin widths
and thresholds, over all sessions, in one plan per family.

The cleaned per-frame table is stored once in the shared folder, with the
threshold crossings that were found while its frames lay in order.  Each family
sums it per cell of a time lattice once (see ``operators.measures``); these
small cell tables are stored too, and every window and bin table comes from
them, dealt by recording once.
"""

from __future__ import annotations

import os
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cagetrace.operators import measures as ME
from cagetrace.operators.reshape import unpivot_measures
from cagetrace.params import SweepParams
from cagetrace.plans.clean_derive import Behavior
from cagetrace.session import stage

S = "session"

# Measure catalogue: name -> (family, kind).  Unknown names are an error.
TOTAL_INTER = [f"total_{f}" for f in ME.INTER_FIELDS]
BIN_INTER = ([f"bin_{f}" for f in ME.INTER_FIELDS if "count" in f]
             + [f"bin_{s}_cumul" for s in ("event", "approach", "receive")]
             + [f"bin_{f}" for f in ME.INTER_FIELDS if "duration" in f])
MEASURES: dict[str, tuple[str, str]] = {
    "total_activity": ("activity", "total"),
    "total_mean_dist": ("dist", "total"),
    "total_closest_dist": ("dist", "total"),
    **{m: ("inter", "total") for m in TOTAL_INTER},
    "bin_activity": ("activity", "bin"),
    "bin_mean_dist": ("dist", "bin"),
    "bin_closest_dist": ("dist", "bin"),
    **{m: ("inter", "bin") for m in BIN_INTER},
}


def measure_table(name: str) -> tuple[str, str]:
    """(family, kind) of a measure name; ValueError when unknown."""
    try:
        return MEASURES[name]
    except KeyError:
        raise ValueError(f"no table holds a measure called {name!r}") from None


@dataclass
class SweepTables:
    activity_total: DataFrame | None = None
    activity_bin: DataFrame | None = None
    dist_total: DataFrame | None = None
    dist_bin: DataFrame | None = None
    inter_total: DataFrame | None = None
    inter_bin: DataFrame | None = None

    def items(self):
        return [(k, v) for k, v in vars(self).items() if v is not None]


def sweep(b: Behavior, sp: SweepParams, info: DataFrame | None = None,
          materialize: bool = True) -> SweepTables:
    """All requested families for the whole grid.

    With ``materialize`` the per-frame table and the cell tables are stored
    (eager jobs); the returned tables are lazy.
    """
    out = SweepTables()
    if materialize:
        b = b.materialized(sp.thresholds if sp.interaction else ())
    key = b.session
    lattice = ME.Lattice.of(sp.windows, sp.bin_within, sp.bin_widths)

    def tables(cells, totals, bins):
        cells = (stage(cells, "cells") if materialize else cells).repartition(key)
        return (ME.join_info(totals(cells, lattice, sp.windows, key), info, key),
                ME.join_info(bins(cells, lattice, sp.bin_within, sp.bin_widths, key), info, key))

    if sp.activity:
        out.activity_total, out.activity_bin = tables(ME.move_cells(b.rows(("move",)), lattice, key), ME.activity_totals, ME.activity_bins)
    if sp.distance:
        out.dist_total, out.dist_bin = tables(ME.neighbour_cells(b.neighbours, lattice, key), ME.distance_totals, ME.distance_bins)
    if sp.interaction:
        out.inter_total, out.inter_bin = tables(ME.contact_cells(b.bouts(sp.thresholds), lattice, key), ME.contact_totals, ME.contact_bins)
    return out


LONG_KEYS = ["id", "family", "kind", "threshold", "window_min", "bin_min", "bin"]


def to_long(t: SweepTables, sp: SweepParams, info_cols: tuple[str, ...] = (),
            info: DataFrame | None = None, session: str = S) -> DataFrame:
    """Union of every family as (keys, measure, value) rows (+ subject facts).

    ``info_cols`` are carried from tables that already hold subject facts;
    ``info`` (session, id, facts...) is instead joined once after the union.
    """
    parts = []
    within = F.lit(float(sp.bin_within))
    null_d, null_i = F.lit(None).cast("double"), F.lit(None).cast("int")
    for key, df in t.items():
        family, kind = key.split("_")
        names = [m for m, (f, k) in MEASURES.items() if f == family and k == kind]
        base = df.select(
            session, "id", F.lit(family).alias("family"), F.lit(kind).alias("kind"),
            (F.col("threshold") if family == "inter" else null_d).alias("threshold"),
            (F.col("window_min") if kind == "total" else within).alias("window_min"),
            (F.col("bin_min").cast("int") if kind == "bin" else null_i).alias("bin_min"),
            (F.col("bin").cast("int") if kind == "bin" else null_i).alias("bin"),
            *info_cols, *names)
        parts.append(unpivot_measures(base, [session, *LONG_KEYS] + list(info_cols), names))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return ME.join_info(out, info, session) if info is not None else out


#: Family -> the switch of it in the sweep parameters
FAMILY_FLAGS = {"activity": "activity", "dist": "distance", "inter": "interaction"}


# ------------------------------------------------------------------ sinks
PARTITIONS = {"total": ["threshold", "window_min"], "bin": ["threshold", "bin_min"]}


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)  # noqa: SLF001
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p  # noqa: SLF001


def _write_text(spark: SparkSession, path: str, text: str) -> None:
    fs, p = _fs(spark, path)
    out = fs.create(p, True)
    out.write(bytearray(text.encode()))
    out.close()


def _read_text(spark: SparkSession, path: str) -> str | None:
    fs, p = _fs(spark, path)
    if not fs.exists(p):
        return None
    f = fs.open(p)
    text = spark._jvm.org.apache.commons.io.IOUtils.toString(f, "UTF-8")  # noqa: SLF001
    f.close()
    return text


def _done(spark: SparkSession, path: str, params: str = "") -> bool:
    """Whether the table is complete and was written with the same parameters,
    checked through the cluster file system (HDFS, S3, local)."""
    fs, marker = _fs(spark, path.rstrip("/") + "/_SUCCESS")
    return bool(fs.exists(marker)) and _read_text(spark, path.rstrip("/") + "/_params") == params


def write_sweep(t: SweepTables, out_dir: str, fmt: str = "parquet",
                max_records_per_file: int = 5_000_000, writers: int = 16,
                params: str = "") -> dict[str, str]:
    """One table per family/kind, partitioned by parameter columns.

    Rows are first hash-partitioned by those columns and one of ``writers``
    hash values of the recording, so a parameter cell is written by several
    tasks and makes at most that many files (``max_records_per_file`` splits
    larger ones).  A table whose folder holds ``_SUCCESS`` is skipped if it
    was written with the same ``params`` text, which is kept beside it; a
    half-written one, or one of other parameters, is redone.  ``out_dir``
    must be a shared folder on a cluster.
    """
    written = {}
    for key, df in t.items():
        path = os.path.join(out_dir, key)
        if _done(df.sparkSession, path, params):
            written[key] = path
            continue
        kind = key.split("_")[1]
        parts = [c for c in PARTITIONS[kind] if c in df.columns]
        spread = F.pmod(F.xxhash64(df.columns[0]), F.lit(int(writers)))
        w = (df.repartition(*parts, spread).write.mode("overwrite").partitionBy(*parts).format(fmt)
             .option("maxRecordsPerFile", int(max_records_per_file)))
        if fmt == "csv":
            w = w.option("header", True)
        w.save(path)
        _write_text(df.sparkSession, path.rstrip("/") + "/_params", params)
        written[key] = path
    return written


def read_table(spark: SparkSession, out_dir: str, measure: str, fmt: str = "parquet", **params) -> DataFrame:
    """Re-scan the table holding ``measure``; parameters prune partitions."""
    from cagetrace.plans import ledger
    family, kind = measure_table(measure)
    path = os.path.join(out_dir, f"{family}_{kind}")
    df = (spark.read.parquet(path) if fmt == "parquet"
          else spark.read.option("header", True).option("inferSchema", True).csv(path))
    if measure not in df.columns:
        raise ValueError(f"{measure} is not in {family}_{kind}")
    for k, v in params.items():
        if v is not None:
            df = df.filter(F.col(k).isin(list(v)) if isinstance(v, (list, tuple)) else (F.col(k) == v))
    return ledger.newest(df, out_dir, family) if "run" in df.columns else df


def append_family(t: SweepTables, family: str, out_dir: str, run: str, fmt: str = "parquet",
                  max_records_per_file: int = 5_000_000, writers: int = 16) -> dict[str, str]:
    """Append the two tables of *family* as the partition ``run`` of each."""
    written = {}
    for key, df in t.items():
        name, kind = key.split("_")
        if name != family:
            continue
        parts = [c for c in PARTITIONS[kind] if c in df.columns]
        spread = F.pmod(F.xxhash64(df.columns[0]), F.lit(int(writers)))
        w = (df.repartition(*parts, spread).withColumn("run", F.lit(run)).write.mode("append").partitionBy("run", *parts)
             .format(fmt).option("maxRecordsPerFile", int(max_records_per_file)))
        written[key] = os.path.join(out_dir, key)
        (w.option("header", True) if fmt == "csv" else w).save(written[key])
    return written


def run_project(spark: SparkSession, project_dir: str, subject_list: str, design,
                clean=None, sp: SweepParams | None = None, glob: str = "*.csv",
                fmt: str = "parquet", strict: bool = True) -> dict[str, str]:
    """The batch entry point: logs in ``<project>/data``, results in ``<project>/temp``.

    Reads the logs and the subject list, checks them and the design, derives
    and sweeps all recordings (one log each) in one plan and appends to one
    table per family/kind.  A ledger beside the tables (``plans.ledger``) tells
    which recordings a family holds already, made from the same log, parameters,
    subject list and format: only the others are read and written, and when
    there are none, nothing runs.  Read the tables with ``read_table``.
    ``strict`` raises on logs with missing or repeated metadata keys, a wrong
    marker count, an unknown header, subjects outside the listed ids, or
    frame times that do not parse.
    """
    from dataclasses import replace

    from cagetrace.operators import checks as CK
    from cagetrace.params import CleanParams
    from cagetrace.plans import ledger
    from cagetrace.plans.clean_derive import behavior
    from cagetrace.sources import logs as L
    from cagetrace.sources import subjects as SJ

    clean = clean or CleanParams()
    sp = sp or SweepParams()
    data, out = f"{project_dir.rstrip('/')}/data", f"{project_dir.rstrip('/')}/temp"
    subjects = SJ.read_subjects(spark, subject_list)
    grid = {k: v for k, v in vars(sp).items() if k not in FAMILY_FLAGS.values()}
    settings = f"{clean} {sorted(grid.items())} {design} {fmt} {ledger.table_digest(subjects)}"
    files = L.log_files(spark, data, glob)
    todo, families = ledger.missing(spark, out, ledger.wanted(files, settings), [f for f, flag in FAMILY_FLAGS.items() if getattr(sp, flag)])
    if not families:
        return {}
    sp = replace(sp, **{flag: f in families for f, flag in FAMILY_FLAGS.items()})
    some = [r[0] for r in todo.select(L.RECORDING).limit(L.FEW_FILES + 1).collect()]
    only = some if len(some) <= L.FEW_FILES else None   # few logs: the scan opens no others
    frames = L.read_frames(spark, data, glob, only=only).join(todo.select(L.RECORDING), L.RECORDING, "left_semi")
    pre = L.read_preamble(spark, data, glob, only=only).join(todo.select(F.col(L.RECORDING).alias("path")), "path", "left_semi")
    if strict:
        CK.raise_if_any(CK.log_report(pre))
        CK.raise_if_any(CK.unparsed_times(frames, L.RECORDING))
    info = SJ.subject_info(pre, SJ.validated(subjects, design)).withColumnRenamed("path", L.RECORDING)
    tables = sweep(behavior(frames, clean, L.RECORDING), sp, info)
    run, seq = ledger.new_run(spark, out)
    written = {}
    for family in families:
        written.update(append_family(tables, family, out, run, fmt))
        ledger.record(todo, out, family, run, seq)
    return written
