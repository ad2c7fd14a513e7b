"""Tracker log text files: one file per recording session.

Layout of a log (physical lines):
  1      ignored
  2-8    ``key,value`` session metadata (matched by key, not position)
  9      first field ignored; then ``marker_id:description`` per subject
  10-13  ignored
  14     header: ``date time`` then ``ID-k [X(mm)]``/``ID-k [Y(mm)]`` pairs
         (older dialect: ``ID-k [Marker-X(mm)]``)
  15+    one frame per line; empty field = missing; a trailing comma may
         follow the last field

All parsers take a *lines* DataFrame (path, line_no, value) so they run on
files read by ``read_lines`` and on lines built in memory alike.  A whole
folder is one scan; every parser is a projection or a small aggregation
keyed by path.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Fixed values of the log format.
META_KEYS = ("Exp.Date", "Start Time", "Finish Time", "Project Name", "Session Name",
             "Camera No", "Analysis No")
META_COLS = ("exp_date", "start_time", "finish_time", "project", "session", "camera_no",
             "analysis_no")
META_TIMES = ("exp_date", "start_time", "finish_time")
TIME_FORMATS = ("yyyy/M/d H:m:s[.SSSSSSSSS]", "yyyy/M/d H:m", "yyyy/M/d")
HEADER_PATTERN = r"^ID-(\d+) \[(?:Marker-)?([XY])\(mm\)\]$"
META_LINES = (2, 8)
MARKER_LINE = 9
HEADER_LINE = 14
FIRST_FRAME_LINE = 15
N_MARKERS = 4
HEADER_FIELD = r"ID-(\d+) \[(?:Marker-)?[XY]\(mm\)\]"
#: Key of a recording: one log file.  Several cameras, and so several logs, share a session name.
RECORDING = "recording"
#: So many logs at most are named one by one in the filter of a scan
FEW_FILES = 1000


def read_lines(spark: SparkSession, folder: str, glob: str = "*.csv",
               broadcast_blocks: int = 200_000) -> DataFrame:
    """Every log in ``folder`` as (path, line_no, value), one scan, no per-file task.

    A file may be split into many blocks read by different tasks.  Within
    one block the scan position (``monotonically_increasing_id``) is
    consecutive, so line_no = lines in earlier blocks of the file + the
    position within the block.  Only the block table (one row per file
    block: count and first position) is aggregated and prefix-summed; it
    is broadcast when its size, checked first, is at most
    ``broadcast_blocks`` rows, else joined by (path, block).
    """
    raw = _scan(spark, folder, glob, None)
    return number_lines(with_positions(raw), broadcast=block_bound(spark, folder, glob) <= broadcast_blocks)


def read_preamble(spark: SparkSession, folder: str, glob: str = "*.csv",
                  materialize: bool = True, broadcast_files: int = 200_000, only: list[str] | None = None) -> DataFrame:
    """Lines 1-14 of every log as (path, line_no, value), for the metadata,
    marker and header parsers.

    Only each file's first block is kept (the preamble starts the file);
    line numbers within it come from its first scan position, one small
    aggregation broadcast-joined when the listing bounds the file count.
    The result (14 rows per file) is checkpointed once so every preamble
    parser reads it instead of rescanning the logs.
    """
    raw = with_positions(_scan(spark, folder, glob, only).filter(F.col("_blk") == 0))
    first = raw.groupBy("path").agg(F.min("_pos").alias("_p0"))
    small = log_files(spark, folder, glob).count() <= broadcast_files
    j = raw.join(F.broadcast(first) if small else first, "path")
    pre = (j.select("path", (F.col("_pos") - F.col("_p0") + 1).alias("line_no"), "value")
           .filter(F.col("line_no") <= HEADER_LINE))
    if materialize:
        from cagetrace.session import cut_lineage
        pre = cut_lineage(pre)
    return pre


def file_cols():
    """File path and block start of each scanned line (batch and stream scans)."""
    return (F.col("_metadata.file_path").alias("path"),
            F.col("_metadata.file_block_start").alias("_blk"))


def with_positions(raw: DataFrame) -> DataFrame:
    """Scan position: consecutive within a block, since a block is read by one task."""
    return raw.withColumn("_pos", F.monotonically_increasing_id())


def number_lines(raw: DataFrame, broadcast: bool = False) -> DataFrame:
    """(path, _blk, _pos, value) -> (path, line_no, value) from block offsets."""
    blocks = raw.groupBy("path", "_blk").agg(F.count(F.lit(1)).alias("_n"), F.min("_pos").alias("_p0"))
    before = F.sum("_n").over(W.partitionBy("path").orderBy("_blk").rowsBetween(W.unboundedPreceding, -1))
    blocks = blocks.select("path", "_blk", "_p0", F.coalesce(before, F.lit(0)).alias("_off"))
    j = raw.join(F.broadcast(blocks) if broadcast else blocks, ["path", "_blk"])
    return j.select("path", (F.col("_off") + F.col("_pos") - F.col("_p0") + 1).alias("line_no"), "value")


def log_files(spark: SparkSession, folder: str, glob: str = "*.csv") -> DataFrame:
    """(path, size, changed) of the files a scan of ``folder`` with ``glob`` reads.

    Spark lists the folders (in tasks where there are many); no file is opened.
    """
    m = F.col("_metadata")
    return (spark.read.format("binaryFile").option("pathGlobFilter", glob).load(folder)
            .select(m["file_path"].alias("path"), m["file_size"].alias("size"), m["file_modification_time"].alias("changed")))


def block_bound(spark: SparkSession, folder: str, glob: str) -> int:
    """Upper bound on file blocks from the listing alone (no file is opened).

    Spark never splits a file finer than min(maxPartitionBytes,
    openCostInBytes), so sum(ceil(size / that)) bounds the block count.
    """
    sql_conf = spark._jsparkSession.sessionState().conf()  # noqa: SLF001
    unit = max(1, min(sql_conf.filesMaxPartitionBytes(), sql_conf.filesOpenCostInBytes()))
    return log_files(spark, folder, glob).agg(F.sum(F.greatest(F.lit(1), F.ceil(F.col("size") / unit)))).first()[0] or 0


def _scan(spark: SparkSession, folder: str, glob: str, only: list[str] | None) -> DataFrame:
    """(path, _blk, value) of every line; with ``only``, of those logs, and no other is opened."""
    text = spark.read.option("pathGlobFilter", glob).text(folder)
    if only is not None:
        text = text.where(F.col("_metadata.file_path").isin(only))
    return text.select(*file_cols(), "value")


def parse_time(c: Column) -> Column:
    """Date with ``/`` or ``-``, one- or two-digit fields, blank or ``T``, up to nine
    fraction digits, optional ``Z``; null when it does not parse."""
    c = F.regexp_replace(F.trim(c), r"^(\d{4})[-/](\d{1,2})[-/](\d{1,2})(?:[T ]+(.*?))?Z?$", "$1/$2/$3 $4")
    return F.coalesce(*[F.try_to_timestamp(F.trim(c), F.lit(f)) for f in TIME_FORMATS])


def _field(arr: Column, i: int) -> Column:
    return F.get(arr, i)


def metadata_pairs(lines: DataFrame) -> DataFrame:
    """(path, key, value) of lines 2-8."""
    lo, hi = META_LINES
    kv = F.split(F.col("value"), ",", 2)
    return (lines.filter(F.col("line_no").between(lo, hi))
            .select("path", F.trim(_field(kv, 0)).alias("key"), F.trim(_field(kv, 1)).alias("value")))


def parse_metadata(lines: DataFrame) -> DataFrame:
    """One row per file: path + the seven metadata fields, three as timestamps."""
    wide = (metadata_pairs(lines).groupBy("path").pivot("key", list(META_KEYS))
            .agg(F.first("value")))
    out = wide.select("path", *[F.col(f"`{k}`").alias(c) for k, c in zip(META_KEYS, META_COLS)])
    for c in META_TIMES:
        out = out.withColumn(c, parse_time(F.col(c)))
    return out


def parse_markers(lines: DataFrame) -> DataFrame:
    """(path, id, marker_id, description): fields 2.. of line 9, id = position."""
    fields = F.split(F.regexp_replace(F.col("value"), ",+$", ""), ",")
    m = (lines.filter(F.col("line_no") == MARKER_LINE)
         .select("path", F.posexplode(F.slice(fields, 2, N_MARKERS)).alias("pos", "v")))
    parts = F.split(F.col("v"), ":", 2)
    return m.select("path", (F.col("pos") + 1).cast("int").alias("id"),
                    F.trim(_field(parts, 0)).alias("marker_id"),
                    F.trim(_field(parts, 1)).alias("description"))


def parse_header(lines: DataFrame) -> DataFrame:
    """(path, pos, id, axis) for every coordinate column of line 14 (0-based pos)."""
    fields = F.split(F.col("value"), ",")
    h = (lines.filter(F.col("line_no") == HEADER_LINE)
         .select("path", F.posexplode(fields).alias("pos", "name")))
    name = F.trim(F.col("name"))
    return (h.select("path", "pos",
                     F.regexp_extract(name, HEADER_PATTERN, 1).alias("_id"),
                     F.lower(F.regexp_extract(name, HEADER_PATTERN, 2)).alias("axis"))
            .filter(F.col("_id") != "")
            .select("path", "pos", F.col("_id").cast("int").alias("id"), "axis"))


def header_map(lines: DataFrame) -> DataFrame:
    """(path, cols array<struct<id, px, py>>): field positions of each id's x and y."""
    h = parse_header(lines)
    per_id = (h.groupBy("path", "id")
              .agg(F.max(F.when(F.col("axis") == "x", F.col("pos"))).alias("px"),
                   F.max(F.when(F.col("axis") == "y", F.col("pos"))).alias("py")))
    return per_id.groupBy("path").agg(
        F.array_sort(F.collect_list(F.struct("id", "px", "py"))).alias("cols"))


def parse_frames(lines: DataFrame, header: DataFrame | None = None) -> DataFrame:
    """Long positions (path, line_no, time, id, x, y) from lines 15+.

    Trailing commas are stripped (the reference instead cuts one character
    off the last field, which also eats a digit on clean lines).  A field
    that is empty or not a number is null.  Works for any number of ids:
    each file's header gives the field positions of every id.
    """
    header = header if header is not None else header_map(lines)
    body = lines.filter(F.col("line_no") >= FIRST_FRAME_LINE)
    fields = F.split(F.expr("TRIM(TRAILING ',' FROM rtrim(value))"), ",")
    extra = [c for c in header.columns if c not in ("path", "cols")]
    rows = body.join(header, "path").select("path", "line_no", fields.alias("f"), "cols", *extra)

    def val(pos):
        return F.nullif(F.trim(F.get(F.col("f"), pos)), F.lit("")).try_cast("double")

    per_id = F.transform(F.col("cols"), lambda c: F.struct(c["id"].alias("id"), val(c["px"]).alias("x"),
                                                           val(c["py"]).alias("y")))
    return rows.select("path", *extra, "line_no", parse_time(F.get(F.col("f"), 0)).alias("time"),
                       F.inline(per_id))


def file_facts(lines: DataFrame) -> DataFrame:
    """One row per file from its preamble (lines 1-14) in one aggregation:
    path, session (the ``Session Name`` value) and the header layout
    ``cols`` (array of id, x position, y position)."""
    pre = lines.filter(F.col("line_no") <= HEADER_LINE)
    kv = F.split(F.col("value"), ",", 2)
    is_session = (F.col("line_no").between(*META_LINES)) & (F.trim(_field(kv, 0)) == "Session Name")
    named = pre.select("path", "line_no", "value",
                       F.when(is_session, F.trim(_field(kv, 1))).alias("_sess"))
    facts = named.groupBy("path").agg(F.max("_sess").alias("session"))
    return facts.join(header_map(pre), "path")


def frames_from_logs(lines: DataFrame, broadcast_facts: bool = False) -> DataFrame:
    """Engine frames (session, frame_no, time, id, x, y): session from metadata, frame_no = line.

    The frame lines join a single per-file table (session name + header
    layout).  ``broadcast_facts`` broadcasts it; use it when the file count
    is known to be small (``facts_broadcastable``), else the join shuffles
    by path (AQE splits a skewed file).
    """
    facts = file_facts(lines)
    frames = parse_frames(lines, F.broadcast(facts) if broadcast_facts else facts)
    return frames.select("session", F.col("line_no").cast("bigint").alias("frame_no"), "time", "id", "x", "y")


def read_frames(spark: SparkSession, folder: str, glob: str = "*.csv",
                broadcast_blocks: int = 200_000, only: list[str] | None = None) -> DataFrame:
    """Frames of every log in ``folder`` (``only``: of these paths) with two text scans and no shuffle.

    The block table (one row per file block) also carries each block's
    first header line and ``Session Name`` line, found by content, so line
    offsets, session name and header layout reach the frame lines in one
    join; broadcast when the listing bounds the block count.
    """
    raw = _scan(spark, folder, glob, only)
    return frames_from_raw(with_positions(raw),
                           broadcast=block_bound(spark, folder, glob) <= broadcast_blocks)


def _layout(header: Column) -> Column:
    """Header line -> array<struct<id, px, py>> sorted by id (pure array functions)."""
    fields = F.split(header, ",")
    named = F.transform(fields, lambda f, i: F.struct(
        F.regexp_extract(F.trim(f), HEADER_PATTERN, 1).alias("id"),
        F.lower(F.regexp_extract(F.trim(f), HEADER_PATTERN, 2)).alias("axis"), i.alias("pos")))
    named = F.filter(named, lambda e: e["id"] != "")
    ids = F.array_sort(F.array_distinct(F.transform(named, lambda e: e["id"].cast("int"))))

    def pos(k, axis):
        hit = F.filter(named, lambda e: (e["id"].cast("int") == k) & (e["axis"] == axis))
        return F.get(F.transform(hit, lambda e: e["pos"]), 0)

    return F.transform(ids, lambda k: F.struct(k.alias("id"), pos(k, "x").alias("px"),
                                                pos(k, "y").alias("py")))


def frames_from_raw(raw: DataFrame, broadcast: bool = False) -> DataFrame:
    """(path, _blk, _pos, value) -> frames (recording, session, camera, frame_no, time, id, x, y).

    The recording is the file.  The header is the first line with a coordinate
    field, whatever its time column is called.
    """
    v = F.col("value")
    first_field = F.trim(_field(F.split(v, ",", 2), 0))
    is_header = v.rlike(HEADER_FIELD)
    at = F.struct(F.col("_blk"), F.col("_pos"))

    def fact(key):
        return F.min(F.when(first_field == key, F.struct(at.alias("at"), F.trim(_field(F.split(v, ",", 2), 1)).alias("v"))))

    blocks = raw.groupBy("path", "_blk").agg(
        F.count(F.lit(1)).alias("_n"), F.min("_pos").alias("_p0"),
        F.min(F.when(is_header, F.struct(at.alias("at"), v.alias("v")))).alias("_h"),
        fact("Session Name").alias("_s"), fact("Camera No").alias("_c"))
    per_file = W.partitionBy("path")
    before = F.sum("_n").over(per_file.orderBy("_blk").rowsBetween(W.unboundedPreceding, -1))
    blocks = blocks.select(
        "path", "_blk", "_p0", F.coalesce(before, F.lit(0)).alias("_off"),
        F.min("_h").over(per_file)["v"].alias("_header"),
        F.min("_s").over(per_file)["v"].alias("session"),
        F.substring(F.min("_c").over(per_file)["v"], 1, 1).alias("camera"))
    blocks = blocks.select("path", "_blk", "_p0", "_off", "session", "camera", _layout(F.col("_header")).alias("cols"))
    j = raw.join(F.broadcast(blocks) if broadcast else blocks, ["path", "_blk"])
    line_no = F.col("_off") + F.col("_pos") - F.col("_p0") + 1
    body = j.select("path", "session", "camera", "cols", "value", line_no.alias("line_no")) \
        .filter(F.col("line_no") >= FIRST_FRAME_LINE)
    fields = F.split(F.expr("TRIM(TRAILING ',' FROM rtrim(value))"), ",")
    rows = body.select(F.col("path").alias(RECORDING), "session", "camera", "line_no", fields.alias("f"), "cols")

    def val(pos):
        return F.nullif(F.trim(F.get(F.col("f"), pos)), F.lit("")).try_cast("double")

    per_id = F.transform(F.col("cols"), lambda c: F.struct(c["id"].alias("id"), val(c["px"]).alias("x"),
                                                           val(c["py"]).alias("y")))
    return rows.select(RECORDING, "session", "camera", F.col("line_no").cast("bigint").alias("frame_no"),
                       parse_time(F.get(F.col("f"), 0)).alias("time"), F.inline(per_id))


# ---------------------------------------------------------------- checks
def violations(lines: DataFrame, markers: int = N_MARKERS) -> DataFrame:
    """(path, check, detail, n) from lines 1-14 of every file, in one aggregation:
    missing or repeated metadata keys, a marker count other than ``markers``,
    a line 14 without coordinate fields, and header ids outside 1..markers."""
    m = F.map_from_entries(F.collect_list(F.struct("line_no", "value")))      # at most 14 lines a file
    pre = lines.filter(F.col("line_no").between(1, HEADER_LINE)).groupBy("path").agg(m.alias("m"))
    line = lambda n: F.coalesce(F.try_element_at("m", F.lit(n).cast(lines.schema["line_no"].dataType)), F.lit(""))
    keys = F.array(*[F.trim(F.get(F.split(line(n), ",", 2), 0)) for n in range(META_LINES[0], META_LINES[1] + 1)])
    row = lambda when, check, detail, n: F.when(when, F.struct(check.alias("check"), detail.cast("string").alias("detail"), n.cast("bigint").alias("n")))

    def times(key):
        return F.size(F.filter(keys, lambda x: x == F.lit(key)))

    found = []
    for k in META_KEYS:
        n = times(k)
        found.append(row(n != 1, F.when(n == 0, "metadata_missing_key").otherwise("metadata_repeated_key"), F.lit(k), n))
    n = F.size(F.split(F.regexp_replace(line(MARKER_LINE), ",+$", ""), ",")) - 1
    found.append(row(n != markers, F.lit("marker_count"), F.lit(str(markers)), n))
    ids = F.array_distinct(F.regexp_extract_all(line(HEADER_LINE), F.lit(HEADER_FIELD), 1).cast("array<int>"))
    found.append(row(F.size(ids) == 0, F.lit("header_unknown"), F.lit(""), F.lit(0)))
    extra = F.transform(F.filter(ids, lambda x: (x < 1) | (x > markers)), lambda x: F.struct(
        F.lit("extra_id").alias("check"), x.cast("string").alias("detail"), F.lit(1).cast("bigint").alias("n")))
    return pre.select("path", F.inline(F.concat(F.filter(F.array(*found), lambda x: x.isNotNull()), extra)))


# ------------------------------------------------------------------ sink
def render_lines(frames: DataFrame, ids, path: Column, session: Column,
                 marker_dialect: Column, trailing_comma: Column,
                 drop_key: Column | None = None, n_markers: Column | None = None,
                 camera: Column | None = None) -> DataFrame:
    """Write positions back out as log lines (path, line_no, value).

    ``frames`` is (session, frame_no, time, id, x, y) with one session per
    ``path``.  Used to build log folders from tables (and in tests).
    Options per session: header dialect, trailing comma on frame lines,
    a metadata key left out, fewer markers.
    """
    fmt = "yyyy/MM/dd HH:mm:ss.SSS"
    wide = (frames.groupBy(path.alias("path"), session.alias("session_name"),
                           marker_dialect.alias("dialect"), trailing_comma.alias("trail"),
                           (drop_key if drop_key is not None else F.lit(None).cast("string")).alias("drop_key"),
                           (n_markers if n_markers is not None else F.lit(len(ids))).alias("n_markers"),
                           (camera if camera is not None else F.lit("1A")).alias("camera_no"),
                           "frame_no", "time")
            .agg(*[F.max(F.when(F.col("id") == k, F.col(c))).alias(f"{c}{k}")
                   for k in ids for c in ("x", "y")]))
    cells = [F.coalesce(F.col(f"{c}{k}").cast("string"), F.lit("")) for k in ids for c in ("x", "y")]
    rank = F.row_number().over(W.partitionBy("path").orderBy("frame_no"))
    frame_lines = wide.select(
        "path", (rank + (FIRST_FRAME_LINE - 1)).alias("line_no"),
        F.concat(F.concat_ws(",", F.date_format("time", fmt), *cells),
                 F.when(F.col("trail"), F.lit(",")).otherwise(F.lit(""))).alias("value"))
    per_file = wide.groupBy("path", "session_name", "dialect", "drop_key", "n_markers", "camera_no").agg(
        F.min("time").alias("t0"), F.max("time").alias("t1"))
    meta_vals = [F.date_format("t0", "yyyy/MM/dd"), F.date_format("t0", fmt), F.date_format("t1", fmt),
                 F.lit("fixture"), F.col("session_name"), F.col("camera_no"), F.col("session_name")]
    head = []
    head.append(F.struct(F.lit(1).alias("line_no"), F.lit("Tracking log").alias("value")))
    for i, (k, v) in enumerate(zip(META_KEYS, meta_vals)):
        keep = F.col("drop_key").isNull() | (F.col("drop_key") != k)
        head.append(F.struct(F.lit(2 + i).alias("line_no"),
                             F.when(keep, F.concat_ws(",", F.lit(k), v)).otherwise(F.lit("Note,-"))
                             .alias("value")))
    markers = F.concat_ws(",", F.lit("Marker"), *[
        F.when(F.col("n_markers") >= j + 1, F.lit(f"{k}:subject {k}")) for j, k in enumerate(ids)])
    head.append(F.struct(F.lit(MARKER_LINE).alias("line_no"), markers.alias("value")))
    for ln in range(MARKER_LINE + 1, HEADER_LINE):
        head.append(F.struct(F.lit(ln).alias("line_no"), F.lit("-").alias("value")))
    names = F.concat_ws(",", F.lit("date time"), *[
        F.when(F.col("dialect"), F.lit(f"ID-{k} [Marker-{a}(mm)]")).otherwise(F.lit(f"ID-{k} [{a}(mm)]"))
        for k in ids for a in ("X", "Y")])
    head.append(F.struct(F.lit(HEADER_LINE).alias("line_no"), names.alias("value")))
    head_lines = per_file.select("path", F.inline(F.array(*head)))
    return head_lines.unionByName(frame_lines)


def write_logs(lines: DataFrame, folder: str) -> None:
    """One text file per path under ``folder`` (a ``file=<name>`` folder each).

    Rows are sorted by (file, line_no) inside each task, which also meets
    the writer's own ordering by ``file``, so lines keep their order.
    """
    name = F.regexp_extract("path", r"([^/]+)\.csv$", 1).alias("file")
    (lines.select(name, "line_no", "value").repartition("file")
     .sortWithinPartitions("file", "line_no").drop("line_no")
     .write.mode("overwrite").partitionBy("file").text(folder))
