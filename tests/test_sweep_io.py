"""Sweep sinks: partitioned tables, skip when complete, re-scan with pruning."""
import os

import pytest

from cagetrace.params import FIXTURE_CLEAN, FIXTURE_SWEEP
from cagetrace.plans import clean_derive as P
from cagetrace.plans import sweep as SW
from cagetrace.sources import fixture as FX

from conftest import SF_SMALL


def test_write_skip_and_read(spark, tmp_dir):
    b = P.behavior(FX.frames(spark, SF_SMALL), FIXTURE_CLEAN)
    t = SW.sweep(b, FIXTURE_SWEEP, FX.subjects(spark, SF_SMALL).select("session", "id", "line"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")   # tiny partitions stay apart
    out = SW.write_sweep(t, tmp_dir)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert set(out) == {"activity_total", "activity_bin", "dist_total", "dist_bin", "inter_total", "inter_bin"}
    cell = os.path.join(tmp_dir, "inter_total", "threshold=20.0", "window_min=4.0")
    assert os.path.isdir(cell)
    assert 1 <= len([f for f in os.listdir(cell) if f.startswith("part-")]) <= 16   # several writers, bounded
    stamp = os.path.getmtime(os.path.join(tmp_dir, "activity_total", "_SUCCESS"))
    SW.write_sweep(t, tmp_dir)                      # complete tables are skipped
    assert os.path.getmtime(os.path.join(tmp_dir, "activity_total", "_SUCCESS")) == stamp
    SW.write_sweep(SW.SweepTables(activity_total=t.activity_total), tmp_dir, params="windows=(2,)")   # other parameters: redone
    assert os.path.getmtime(os.path.join(tmp_dir, "activity_total", "_SUCCESS")) > stamp
    df = SW.read_table(spark, tmp_dir, "total_event_count", threshold=40.0, window_min=[2.0])
    p = df._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in p
    assert df.select("threshold").distinct().collect()[0][0] == 40.0
    a = SW.read_table(spark, tmp_dir, "total_activity").orderBy("session", "id", "window_min")
    b2 = t.activity_total.orderBy("session", "id", "window_min")
    assert [r.total_activity for r in a.collect()] == [r.total_activity for r in b2.collect()]


def test_measure_catalogue():
    assert SW.measure_table("bin_receive_cumul") == ("inter", "bin")
    assert SW.measure_table("total_closest_dist") == ("dist", "total")
    with pytest.raises(ValueError):
        SW.measure_table("total_speed")


def test_csv_export(spark, tmp_dir):
    b = P.behavior(FX.frames(spark, SF_SMALL), FIXTURE_CLEAN)
    t = SW.sweep(b, FIXTURE_SWEEP, materialize=False)
    only = SW.SweepTables(activity_total=t.activity_total)
    SW.write_sweep(only, tmp_dir, fmt="csv")
    back = spark.read.option("header", True).csv(os.path.join(tmp_dir, "activity_total"))
    assert back.count() == t.activity_total.count()
    assert "total_activity" in back.columns
    again = SW.read_table(spark, tmp_dir, "total_activity", fmt="csv")
    assert abs(again.agg({"total_activity": "sum"}).first()[0] - t.activity_total.agg({"total_activity": "sum"}).first()[0]) < 1e-6


def test_ledger_appends_only_what_is_new(spark, tmp_dir):
    """New logs, a changed list and a late family are written; what is in force equals one run over all."""
    from dataclasses import replace

    from cagetrace.params import CleanParams, StudyDesign, SweepParams
    from pyspark.sql import functions as F

    from test_logs import write_log
    from test_streaming import rows
    clean, sp = CleanParams(fps=2), SweepParams(windows=(1, 2), bin_within=2, bin_widths=(1,), thresholds=(20,), interaction=False)
    design, proj, lst = StudyDesign("drug", ("CNO", "SAL")), os.path.join(tmp_dir, "p"), os.path.join(tmp_dir, "mice.csv")
    data, out = os.path.join(proj, "data"), os.path.join(proj, "temp")
    os.makedirs(data)

    def subjects(first):
        with open(lst, "w") as fh:
            fh.write("Session,Camera,ID,drug\n")
            fh.writelines(f"{s},1,{i},{first if i % 2 else 'SAL'}\n" for s in ("S1", "S2", "S3") for i in range(1, 5))

    def go(params=sp, where=proj):
        return set(SW.run_project(spark, where, lst, design, clean, params, strict=False))

    def runs(table):
        df = spark.read.parquet(os.path.join(out, table))
        return sorted((r.run, os.path.basename(r.recording)) for r in df.select("run", "recording").distinct().collect())

    subjects("CNO")
    write_log(data, "a.csv", "S1", frames=rows(1))
    write_log(data, "b.csv", "S2", frames=rows(2))
    assert go() == {"activity_total", "activity_bin", "dist_total", "dist_bin"} and go() == set()
    write_log(data, "c.csv", "S3", frames=rows(3))
    go()
    assert [r[1] for r in runs("activity_total")] == ["a.csv", "b.csv", "c.csv"]      # the second run wrote c alone
    assert len({r[0] for r in runs("activity_total")}) == 2
    assert go(replace(sp, interaction=True)) == {"inter_total", "inter_bin"}          # the others stand
    orphan = spark.read.parquet(os.path.join(out, "dist_total")).withColumn("run", F.lit("r999999-lost"))
    orphan.write.mode("append").partitionBy("run", "window_min").parquet(os.path.join(out, "dist_total"))
    assert go(replace(sp, interaction=True)) == set()
    subjects("VEH")
    with pytest.raises(ValueError):                                                   # one of the two groups is gone: nothing is skipped
        go()
    design = StudyDesign("drug", ("VEH", "SAL"))
    go(replace(sp, interaction=True))
    whole = os.path.join(tmp_dir, "whole")
    os.makedirs(whole)
    os.symlink(data, os.path.join(whole, "data"))
    go(replace(sp, interaction=True), whole)
    for m in ("total_activity", "bin_mean_dist", "total_event_count"):
        got, want = SW.read_table(spark, out, m), SW.read_table(spark, os.path.join(whole, "temp"), m)
        cols = [c for c in sorted(want.columns) if c not in ("recording",)]
        form = lambda df: df.select(*[F.round(c, 9).alias(c) if t == "double" else c for c, t in df.select(*cols).dtypes])
        assert got.count() == want.count() > 0 and form(got).exceptAll(form(want)).count() == 0
        assert {r.drug for r in got.select("drug").distinct().collect()} <= {"VEH", "SAL", None}
