"""The README quick start, end to end on log files written from the driver tables."""
import os

from pyspark.sql import functions as F

from cagetrace.params import FIXTURE_CLEAN, FIXTURE_SWEEP, StudyDesign
from cagetrace.plans import clean_derive, compare, sweep
from cagetrace.plans.registry import fixture_lines, fixture_subject_list
from cagetrace.sources import fixture as FX
from cagetrace.sources import logs, subjects

from conftest import SF_SMALL


def test_quick_start_flow(spark, tmp_dir):
    data, out = os.path.join(tmp_dir, "data"), os.path.join(tmp_dir, "temp")
    logs.write_logs(fixture_lines(spark, SF_SMALL), data)
    lst = os.path.join(tmp_dir, "mice.csv")
    rows = fixture_subject_list(spark, SF_SMALL).orderBy("Session", "ID").collect()
    with open(lst, "w") as fh:
        fh.write("Session,Camera,ID,line,drug,mouse\n")
        fh.writelines(f"{r.Session},{r.Camera},{r.ID},{r.line},{r.drug},{r.mouse}\n" for r in rows)

    frames = logs.read_frames(spark, data, glob="*.txt")
    pre = logs.read_preamble(spark, data, glob="*.txt")
    design = StudyDesign("drug", ("CNO", "SAL"), paired_col="mouse")
    info = subjects.subject_info(pre, subjects.validated(subjects.read_subjects(spark, lst), design))
    info = info.withColumnRenamed("path", logs.RECORDING)
    b = clean_derive.behavior(frames, FIXTURE_CLEAN, logs.RECORDING)
    tables = sweep.sweep(b, FIXTURE_SWEEP, info)
    sweep.write_sweep(tables, out)
    long = sweep.to_long(tables, FIXTURE_SWEEP, ("drug", "mouse"), session=logs.RECORDING)
    tests = compare.paired(long.filter("kind = 'total'"), design, ["measure", "threshold", "window_min"])

    act = tests.filter(F.col("measure") == "total_activity").orderBy("window_min").collect()
    assert [r.window_min for r in act] == [2.0, 4.0]
    assert all(r.n == 4 and r.p is not None for r in act)         # 4 mice, each under CNO and SAL
    back = sweep.read_table(spark, out, "total_activity", window_min=4.0)
    assert back.count() == 8 and back.filter(F.col("drug").isNull()).count() == 0


def test_run_project_and_skip(spark, tmp_dir):
    proj = os.path.join(tmp_dir, "proj")
    logs.write_logs(fixture_lines(spark, SF_SMALL), os.path.join(proj, "data"))
    lst = os.path.join(tmp_dir, "mice.csv")
    rows = fixture_subject_list(spark, SF_SMALL).collect()
    with open(lst, "w") as fh:
        fh.write("Session,Camera,ID,line,drug,mouse\n")
        fh.writelines(f"{r.Session},{r.Camera},{r.ID},{r.line},{r.drug},{r.mouse}\n" for r in rows)
    design = StudyDesign("line", ("A", "B"))
    written = sweep.run_project(spark, proj, lst, design, FIXTURE_CLEAN, FIXTURE_SWEEP, glob="*.txt")
    assert set(written) == {"activity_total", "activity_bin", "dist_total", "dist_bin",
                            "inter_total", "inter_bin"}
    stamp = os.path.getmtime(os.path.join(proj, "temp", "inter_bin", "_SUCCESS"))
    assert sweep.run_project(spark, proj, lst, design, FIXTURE_CLEAN, FIXTURE_SWEEP, glob="*.txt") == {}
    assert os.path.getmtime(os.path.join(proj, "temp", "inter_bin", "_SUCCESS")) == stamp
    t = sweep.read_table(spark, os.path.join(proj, "temp"), "total_mean_dist")
    assert t.count() == 2 * 4 * 2 and "line" in t.columns


def test_compare_from_tables(spark, tmp_dir):
    from cagetrace.params import FIXTURE_PAIRED, FIXTURE_UNPAIRED
    from cagetrace.plans.registry import QUERIES, info
    b = clean_derive.behavior(FX.frames(spark, SF_SMALL), FIXTURE_CLEAN)
    sweep.write_sweep(sweep.sweep(b, FIXTURE_SWEEP, info(spark, SF_SMALL)), tmp_dir)
    got = compare.measure_tests(spark, tmp_dir, "total_activity", FIXTURE_PAIRED).orderBy("window_min")
    want = QUERIES["compare_paired"](spark, SF_SMALL).orderBy("window_min")
    g, w = got.collect(), want.collect()
    assert [(r.window_min, r.n) for r in g] == [(r.window_min, r.n) for r in w]
    assert all(abs(a.p - b.p) < 1e-6 for a, b in zip(g, w))
    u = compare.measure_tests(spark, tmp_dir, "total_event_count", FIXTURE_UNPAIRED, threshold=20.0)
    assert u.select("threshold").distinct().collect()[0][0] == 20.0
    bins = compare.measure_bins(spark, tmp_dir, "bin_activity", FIXTURE_UNPAIRED, plot_within=4)
    assert bins.count() == QUERIES["compare_bins"](spark, SF_SMALL).count()
    import pytest
    with pytest.raises(ValueError):
        compare.measure_tests(spark, tmp_dir, "bin_activity", FIXTURE_UNPAIRED)
