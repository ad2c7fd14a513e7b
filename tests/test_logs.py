"""Log files on disk: both header dialects, trailing commas, odd names, checks."""
import datetime as dt
import os

from pyspark.sql import functions as F

from cagetrace.operators import checks as CK
from cagetrace.sources import logs as L
from cagetrace.sources import subjects as SJ
from cagetrace.params import StudyDesign


def write_log(folder, name, session, dialect="plain", trailing="none", markers=4,
              drop_key=None, frames=None, describe=True):
    hdr = []
    for k in range(1, 5):
        for a in "XY":
            hdr.append(f"ID-{k} [Marker-{a}(mm)]" if dialect == "marker" else f"ID-{k} [{a}(mm)]")
    meta = [("Exp.Date", "2024/05/22"), ("Start Time", "2024/05/22 10:00:00"),
            ("Finish Time", "2024/05/22 11:30:00"), ("Project Name", "demo"),
            ("Session Name", session), ("Camera No", "2B"), ("Analysis No", "7")]
    lines = ["Tracker export"]
    for k, v in meta:
        lines.append(f"{k},{v}" if k != drop_key else "Comment,none")
    mk = [f"{k}:m{k}" if describe else f"{k}" for k in range(1, markers + 1)]
    lines.append(",".join(["Marker"] + mk))
    lines += ["-", "-", "-", "-"]
    lines.append(",".join(["date time"] + hdr))
    t0 = dt.datetime(2024, 5, 22, 10, 0, 0)
    for i, row in enumerate(frames):
        t = (t0 + dt.timedelta(milliseconds=500 * i)).strftime("%Y/%m/%d %H:%M:%S.%f")[:-3]
        line = ",".join([t] + ["" if v is None else str(v) for v in row])
        if trailing == "all" or (trailing == "some" and i % 2 == 0):
            line += ","
        lines.append(line)
    with open(os.path.join(folder, name), "w", encoding="utf-8") as fh:
        fh.write("\n".join(lines) + "\n")


ROWS = [
    [10.5, 20.0, 30.0, 40.0, 50.0, 60.0, 70.0, 80.0],
    [11.5, None, 31.0, 41.0, 51.0, 61.0, 71.0, 81.25],
    [12.5, 22.0, None, None, 52.0, 62.0, 72.0, 82.0],
]


def test_dialects_and_trailing_commas(spark, tmp_dir):
    write_log(tmp_dir, "a.csv", "S1", dialect="plain", trailing="none", frames=ROWS)
    write_log(tmp_dir, "b.csv", "S2", dialect="marker", trailing="all", frames=ROWS)
    write_log(tmp_dir, "c.csv", "S3", dialect="marker", trailing="some", frames=ROWS)
    write_log(tmp_dir, "ケージ-日本語.csv", "S4", frames=ROWS)
    with open(os.path.join(tmp_dir, "notes.txt"), "w") as fh:
        fh.write("not a log\n")
    lines = L.read_lines(spark, tmp_dir)
    fr = L.frames_from_logs(lines).orderBy("session", "frame_no", "id").collect()
    assert len(fr) == 4 * 3 * 4
    for s in ("S1", "S2", "S3", "S4"):
        got = [(r.frame_no, r.id, r.x, r.y) for r in fr if r.session == s]
        want = []
        for i, row in enumerate(ROWS):
            for k in range(4):
                want.append((15 + i, k + 1, row[2 * k], row[2 * k + 1]))
        assert got == want, s
    t = [r.time for r in fr if r.session == "S1"]
    assert (t[4] - t[0]).total_seconds() == 0.5


def test_read_frames_equals_line_path(spark, tmp_dir):
    write_log(tmp_dir, "a.csv", "S1", dialect="plain", trailing="none", frames=ROWS)
    write_log(tmp_dir, "b.csv", "S2", dialect="marker", trailing="some", frames=ROWS)
    a = L.read_frames(spark, tmp_dir)
    b = L.frames_from_logs(L.read_lines(spark, tmp_dir))
    a = a.select(b.columns)
    assert a.count() == b.count() == 2 * 3 * 4
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0
    p = a._jdf.queryExecution().executedPlan().toString()
    assert p.count("FileScan text") == 2


def test_metadata_markers_and_checks(spark, tmp_dir):
    write_log(tmp_dir, "a.csv", "S1", frames=ROWS)
    write_log(tmp_dir, "b.csv", "S2", frames=ROWS, markers=3, drop_key="Analysis No", describe=False)
    lines = L.read_lines(spark, tmp_dir)
    meta = {r.session: r for r in L.parse_metadata(lines).collect()}
    assert meta["S1"].camera_no == "2B" and meta["S1"].analysis_no == "7"
    assert meta["S2"].analysis_no is None
    assert str(meta["S1"].start_time) == "2024-05-22 10:00:00"
    mk = L.parse_markers(lines).orderBy("path", "id").collect()
    assert [(r.id, r.marker_id, r.description) for r in mk if r.path.endswith("a.csv")] == [
        (1, "1", "m1"), (2, "2", "m2"), (3, "3", "m3"), (4, "4", "m4")]
    assert [(r.id, r.marker_id, r.description) for r in mk if r.path.endswith("b.csv")] == [
        (1, "1", None), (2, "2", None), (3, "3", None)]
    rep = {(os.path.basename(r.source), r.check_name, r.detail, r.n)
           for r in CK.log_report(lines).collect()}
    assert rep == {("b.csv", "metadata_missing_key", "Analysis No", 0), ("b.csv", "marker_count", "4", 3)}


def test_preamble_matches_numbered_lines(spark, tmp_dir):
    write_log(tmp_dir, "a.csv", "S1", frames=ROWS)
    write_log(tmp_dir, "b.csv", "S2", frames=ROWS, markers=3, drop_key="Analysis No")
    pre = L.read_preamble(spark, tmp_dir)
    lines = L.read_lines(spark, tmp_dir)
    assert pre.count() == 2 * 14
    for parse in (L.parse_metadata, L.parse_markers, L.header_map):
        a, b = parse(pre), parse(lines)
        assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0
    assert {r.check for r in L.violations(pre).collect()} == {"marker_count", "metadata_missing_key"}


def test_line_numbers_across_file_blocks(spark, tmp_dir):
    rows = [[float(i), float(i)] * 4 for i in range(4000)]
    write_log(tmp_dir, "big.csv", "S9", frames=rows)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16384")
    try:
        lines = L.read_lines(spark, tmp_dir)
        assert spark.read.text(tmp_dir).rdd.getNumPartitions() > 1
        fr = L.frames_from_logs(lines).filter(F.col("id") == 1).orderBy("frame_no").collect()
        fr2 = L.read_frames(spark, tmp_dir).filter(F.col("id") == 1).orderBy("frame_no").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [r.x for r in fr] == [float(i) for i in range(4000)]
    assert [r.frame_no for r in fr] == list(range(15, 4015))
    assert [(r.frame_no, r.x) for r in fr2] == [(r.frame_no, r.x) for r in fr]


def test_subject_list_and_info(spark, tmp_dir):
    write_log(tmp_dir, "a.csv", "S1", frames=ROWS)
    lst = os.path.join(tmp_dir, "list.csv")
    with open(lst, "w") as fh:
        fh.write("Session,Camera,ID,Line,Drug,Mouse\nS1,2,1,B6,SAL,10\nS1,2,2,BTBR,CNO,10\nS1,2,3,B6,SAL,11\n")
    design = StudyDesign("Line", ("BTBR", "B6"))
    sj = SJ.validated(SJ.read_subjects(spark, lst), design)
    info = SJ.subject_info(L.read_lines(spark, tmp_dir).filter(~F.col("path").endswith("list.csv")), sj)
    got = {(r.id, r.Line) for r in info.collect()}
    assert got == {(1, "B6"), (2, "BTBR"), (3, "B6"), (4, None)}
    import pytest
    with pytest.raises(SJ.DesignError):
        SJ.validated(SJ.read_subjects(spark, lst), StudyDesign("Line", ("BTBR", "C57")))
    with pytest.raises(SJ.DesignError):
        SJ.validated(SJ.read_subjects(spark, lst), StudyDesign("Strain", ("BTBR", "B6")))
    with pytest.raises(ValueError):
        StudyDesign("Line", ("BTBR",))


def test_fixture_round_trip_through_files(spark, tmp_dir):
    """Driver-table positions written as log files (both dialects, trailing
    commas) and read back: same positions, same session facts."""
    from cagetrace.plans.registry import fixture_lines
    from cagetrace.sources import fixture as FX
    sf = "/root/testdata/sf0.001"
    L.write_logs(fixture_lines(spark, sf), tmp_dir)
    assert L.log_files(spark, tmp_dir, "*.txt").count() == 2
    back = L.read_frames(spark, tmp_dir, glob="*.txt").drop("recording", "camera")
    want = FX.frames(spark, sf).select(F.col("session").cast("string").alias("session"),
                                       (F.col("frame_no") % 500 + 15).alias("frame_no"),
                                       "time", "id", "x", "y")
    assert back.count() == want.count()
    assert back.exceptAll(want).count() == 0
    meta = L.parse_metadata(L.read_lines(spark, tmp_dir, glob="*.txt")).collect()
    assert sorted(r.session for r in meta) == ["0", "1"]


def test_two_cameras_are_two_recordings(spark, tmp_dir):
    from cagetrace.params import FIXTURE_CLEAN
    from cagetrace.plans import clean_derive as P
    write_log(tmp_dir, "s1-C1.csv", "S1", frames=ROWS)
    write_log(tmp_dir, "s1-C2.csv", "S1", frames=ROWS)
    fr = L.read_frames(spark, tmp_dir)
    assert fr.select("recording").distinct().count() == 2 and fr.select("session").distinct().count() == 1
    m = P.clean(fr, FIXTURE_CLEAN, L.RECORDING).groupBy("recording").count().collect()
    assert len(m) == 2 and m[0]["count"] == m[1]["count"] > 0


def test_time_spellings(spark):
    texts = ["2020/01/02 03:04:05.123", "2020-01-02T03:04:05.123456", "2020/1/2 3:4:5", "2020-01-02 03:04:05Z", "2020/1/2", "later", ""]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    out = [r.u for r in df.select("i", F.unix_micros(L.parse_time(F.col("t"))).alias("u")).orderBy("i").collect()]
    base = 1577934245000000
    assert out == [base + 123000, base + 123456, base, base, 1577923200000000, None, None]


def test_unknown_header_and_extra_ids_are_reported(spark):
    lines = [("a", 14, "time,col 1,col 2"), ("b", 14, "time," + ",".join(f"ID-{k} [{a}(mm)]" for k in range(1, 6) for a in "XY"))]
    df = spark.createDataFrame(lines, "path string, line_no long, value string")
    got = {(r.path, r.check, r.detail) for r in L.violations(df).collect() if r.check in ("header_unknown", "extra_id")}
    assert got == {("a", "header_unknown", ""), ("b", "extra_id", "5")}
