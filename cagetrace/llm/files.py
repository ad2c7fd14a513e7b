"""Deterministic sharded files in the shared folder, with a two-step commit.

Rows are dealt to shards by ranges of an integer key: the weight is summed
per run of keys with equal leading bits, runs heavier than a shard are summed
again by more bits, down to single keys, and the prefix sum of the runs gives
the shard, so shards are of even weight wherever the keys lie, as many as the
rows need, and depend on the rows alone.  A key heavier than a shard is split
by a hash of its rows.  A task writes whole
shards in key order under temporary names of its own attempt and reports
each file; the reported files, written as a manifest by Spark's own commit,
are then moved to their final names (again if a task is lost: a move that
was done already is left as it is).  Files of failed or doubled attempts are
in no manifest and never get a final name.
"""

from __future__ import annotations

import functools
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cagetrace.llm.store import open_fs, shared_folder, stage

#: Runs of keys: so many to a shard, and so many at least; tables of up to so many runs are broadcast (28 bytes a row)
RUNS, LEAST_RUNS, BROADCAST_RUNS = 16, 4096, 200_000
MANIFEST = "shard long, roll long, name string, tmp string, records long, units long, bytes long, keys array<long>"


def running(df: DataFrame, order: list[str], value: str, out: str) -> DataFrame:
    """Adds *out*: the sum of *value* over all rows before, in *order* (0 for the first); stored.

    Sums inside ranges of rows, then over one row a range, so no task holds all rows.
    """
    from pyspark.sql import Window
    cut = stage(df.repartitionByRange(*order).withColumn("__range", F.spark_partition_id()), "ranges")
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    here = F.coalesce(F.sum(value).over(before(Window.partitionBy("__range").orderBy(*order))), F.lit(0))
    ranges = cut.groupBy("__range").agg(F.sum(value).alias("__sum")).select(
        "__range", F.coalesce(F.sum("__sum").over(before(Window.orderBy("__range"))), F.lit(0)).alias("__start"))
    # at most a row for each shuffle partition
    return cut.withColumn("__here", here).join(F.broadcast(ranges), "__range").withColumn(out, F.col("__here") + F.col("__start")).drop("__here", "__range", "__start")


def _run(key: Column, shift: int) -> Column:
    """The leading bits of a key, in unsigned order."""
    return F.shiftrightunsigned(key.cast("long").bitwiseXOR(F.lit(-2**63)), shift)


def _shift(span: int, runs: int) -> int:
    """Trailing bits to leave out so that keys over *span* lie in at most about *runs* runs."""
    return (span // runs).bit_length()


def with_shards(df: DataFrame, key: str, weight: Column, shard_bytes: int, least: int = 64) -> DataFrame:
    """Adds ``shard``: consecutive key ranges of at most three times *shard_bytes* weight, at least about *least* of them.

    A key of more weight is split over shards of its own by a hash of its rows
    (rows equal in all columns stay together); rows without a key likewise, over
    64 shards or more below zero.
    """
    weights = stage(df.groupBy(F.col(key).cast("long").alias("k")).agg(F.sum(weight).cast("long").alias("w")), "weights")
    total, stray, lo, hi = weights.agg(F.sum("w"), F.sum(F.when(F.col("k").isNull(), F.col("w"))), F.min("k"), F.max("k")).first()
    total = total or 0
    per = max(1, min(shard_bytes, total // least))
    row = F.xxhash64(*[c for c in df.columns if c != key])
    shard = -1 - F.pmod(row, F.lit(max(64, -(-(stray or 0) // per))))
    if lo is None:
        return df.withColumn("shard", shard)
    left, shift, levels = weights.where("k is not null"), _shift(hi - lo, max(LEAST_RUNS, RUNS * (total // per + 1))), []
    while True:
        runs = stage(left.groupBy(_run(F.col("k"), shift).alias("run")).agg(F.sum("w").alias("w"), F.min("k").alias("lo"), F.max("k").alias("hi")), "runs")
        levels.append((shift, runs))
        heavy = (F.col("w") > per) & (F.col("lo") < F.col("hi"))
        span, most = runs.where(heavy).agg(F.max(F.col("hi").cast("decimal(20,0)") - F.col("lo")), F.max("w")).first()
        if span is None:
            break
        left = left.join(runs.where(heavy).select("run"), _run(F.col("k"), shift) == F.col("run"), "left_semi")
        # at least two bits more, so this ends
        shift = max(0, min(shift - 2, _shift(int(span), RUNS * (most // per + 1))))
    closed = [r.where(~heavy if i + 1 < len(levels) else F.lit(True)).select(F.lit(i).alias("level"), "run", "lo", "w") for i, (_, r) in enumerate(levels)]
    closed = running(functools.reduce(DataFrame.unionByName, closed), ["lo"], "w", "before")
    at = lambda c: F.floor(c / F.lit(per).cast("decimal(20,0)")).cast("long")
    first, end = at(F.col("before").cast("decimal(20,0)")), at((F.col("before") + F.col("w")).cast("decimal(20,0)"))
    table = stage(closed.select("level", "run", first.alias("first"), F.greatest(F.lit(1), end - first).alias("parts")), "shards")
    small = table.count() <= BROADCAST_RUNS
    out = df
    for i, (shift, _) in enumerate(levels):
        of = table.where(F.col("level") == i).select(F.col("run").alias(f"__run{i}"), F.struct("first", "parts").alias(f"__at{i}"))
        out = out.withColumn(f"__run{i}", _run(F.col(key), shift)).join(F.broadcast(of) if small else of, f"__run{i}", "left")
    found = F.coalesce(*[F.col(f"__at{i}") for i in range(len(levels))])
    return (out.withColumn("__at", found).withColumn("shard", F.coalesce(F.col("__at.first") + F.pmod(row, F.col("__at.parts")), shard))
            .select(*df.columns, "shard"))


class _File:
    def __init__(self, fs, root, tmp, shard, roll, ext):
        self.shard, self.roll, self.name = shard, roll, f"shard-{shard:06d}-{roll:04d}{ext}"
        self.fs, self.root, self.tmp = fs, root, f"{tmp}/{self.name}"
        self.out = fs.open_output_stream(f"{root}/{self.tmp}")
        self.records = self.units = self.bytes = 0
        self.keys, self.offsets = [], []

    def add(self, key, data: bytes, units: int) -> None:
        self.offsets.append(self.bytes)
        self.out.write(data)
        self.keys.append(key)
        self.records, self.units, self.bytes = self.records + 1, self.units + units, self.bytes + len(data)

    def finish(self, index) -> pa.RecordBatch:
        self.out.close()
        if index:
            with self.fs.open_output_stream(f"{self.root}/{self.tmp}.idx") as o:
                o.write(index(self.offsets, self.keys))
        return pa.RecordBatch.from_arrays([pa.array([x]) for x in (self.shard, self.roll, self.name, self.tmp, self.records, self.units, self.bytes)]
                                          + [pa.array([self.keys], pa.list_(pa.int64()))], names=[c.split()[0] for c in MANIFEST.split(", ")])


def write_files(df: DataFrame, order: list[str], columns: list[str], folder: str, ext: str, make, roll_bytes: int,
                roll_records: int = 1 << 17, index=None, prepare=None) -> DataFrame:
    """Write *df* and commit; the manifest: one row per file.

    With a column ``shard`` whole shards are dealt to tasks in turn and sorted by
    *order*; without one, each partition is written where it is, unshuffled.
    ``make()`` gives a task's function from the values of *columns*, the first
    of them the record's key, to (bytes, units); *prepare* changes a task's
    batches before.
    """
    def run(batches):
        fs, root = open_fs(folder)
        tmp = f"_temporary/{uuid.uuid4().hex}"
        fs.create_dir(f"{root}/{tmp}", recursive=True)
        record, cur = make(), None
        for b in prepare(batches) if prepare else batches:
            for shard, *row in zip(b.column("shard").to_pylist(), *(b.column(c).to_pylist() for c in columns)):
                if cur is None or shard != cur.shard or cur.bytes >= roll_bytes or cur.records >= roll_records:
                    roll = cur.roll + 1 if cur and cur.shard == shard else 0
                    if cur:
                        yield cur.finish(index)
                    cur = _File(fs, root, tmp, shard, roll, ext)
                cur.add(row[0], *record(*row))
        if cur:
            yield cur.finish(index)

    def move(batches):
        fs, root = open_fs(folder)
        for b in batches:
            for tmp, name in zip(b.column("tmp").to_pylist(), b.column("name").to_pylist()):
                for end in ("", ".idx") if index else ("",):
                    src, dst = f"{root}/{tmp}{end}", f"{root}/{name}{end}"
                    if fs.get_file_info(src).is_file:
                        fs.move(src, dst)
                    elif not fs.get_file_info(dst).is_file:
                        raise FileNotFoundError(dst)
            yield pa.RecordBatch.from_arrays([b.column("name")], names=["name"])

    if "shard" in df.columns:
        n = _tasks(df.sparkSession)
        dealt = df.select("shard", *dict.fromkeys([*columns, *order])).repartitionById(n, F.pmod("shard", F.lit(n)).cast("int")).sortWithinPartitions("shard", *order)
    else:
        dealt = df.select(F.spark_partition_id().cast("long").alias("shard"), *columns)
    wrote = stage(dealt.select("shard", *columns).mapInArrow(run, MANIFEST), "manifest")
    moved = stage(wrote.select("tmp", "name").mapInArrow(move, "name string"), "moved")
    done = wrote.join(moved, "name", "left_semi").drop("tmp")
    done.write.parquet(f"{folder}/manifest")
    return df.sparkSession.read.schema(done.schema).parquet(f"{folder}/manifest")


def new_folder(df: DataFrame, name: str) -> str:
    return shared_folder(df.sparkSession, name)


def starts(manifest: DataFrame) -> DataFrame:
    """Adds ``file_start``: units in all files before, in shard order."""
    return running(manifest.select("name", "shard", "roll", "units", "records", "bytes"), ["shard", "roll"], "units", "file_start")


def spread(files: DataFrame) -> DataFrame:
    """Deal files (or blocks of files) out to tasks."""
    return files.repartition(_tasks(files.sparkSession))


def _tasks(spark) -> int:
    return max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
