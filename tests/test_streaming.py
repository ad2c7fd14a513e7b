"""Incremental sweep: new log files append; the result equals a batch sweep."""
import os

from pyspark.sql import functions as F

from cagetrace.params import CleanParams, SweepParams
from cagetrace.sources import logs as L
from cagetrace.streaming import incremental as INC

from test_logs import write_log

CLEAN = CleanParams(fps=2)
SP = SweepParams(windows=(1, 2), bin_within=2, bin_widths=(1,), thresholds=(20, 40))


def rows(seed, n=300):
    out = []
    for i in range(n):
        r = []
        for k in range(4):
            r += [float((i * (k + 2) + seed * 7 + 13 * k) % 60), float((i * (k + 3) + seed) % 40)]
        out.append(r)
    return out


def test_incremental_equals_batch(spark, tmp_dir):
    logs = os.path.join(tmp_dir, "logs")
    os.makedirs(logs)
    out, ck = os.path.join(tmp_dir, "out"), os.path.join(tmp_dir, "ck")
    write_log(logs, "s1.csv", "S1", frames=rows(1))
    write_log(logs, "s2.csv", "S2", dialect="marker", trailing="all", frames=rows(2))
    q = INC.start(spark, logs, out, ck, CLEAN, SP)
    q.awaitTermination()
    write_log(logs, "s3.csv", "S2", frames=rows(3))        # another camera's log under the same session name
    q = INC.start(spark, logs, out, ck, CLEAN, SP)
    q.awaitTermination()
    got = spark.read.parquet(os.path.join(out, "activity_total"))
    assert got.select("batch_id").distinct().count() == 2
    per = got.groupBy("recording").count().collect()
    assert sorted(os.path.basename(r.recording) for r in per) == ["s1.csv", "s2.csv", "s3.csv"]
    assert {r["count"] for r in per} == {4 * 2}            # subjects x windows, none merged
    raw = spark.read.text(logs).select(*L.file_cols(), "value")
    batch = INC.sweep_batch(L.with_positions(raw), CLEAN, SP)
    for key, df in batch.items():
        inc = spark.read.parquet(os.path.join(out, key)).drop("batch_id")
        cols = sorted(df.columns)
        a = inc.select(*cols).select(*[F.round(c, 9).alias(c) if t == "double" else c
                                       for c, t in inc.select(*cols).dtypes])
        b = df.select(*cols).select(*[F.round(c, 9).alias(c) if t == "double" else c
                                      for c, t in df.select(*cols).dtypes])
        assert a.count() == b.count() > 0, key
        assert a.exceptAll(b).count() == 0, key
