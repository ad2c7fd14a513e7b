"""Clean-and-derive job (frames -> motion, wide frames, pairs, neighbours).

One plan for recordings of any length; no task holds more than one chunk of
a recording.  Rows without a time are dropped first.  Frames are carried as
wide rows, one per time with every subject's position; a subject without a
row in a frame has a null position there, so that every subject's row index
is the frame index.

z mask (optional), in file order: frames are ranked across chunks of frame
  numbers and cut by rank into chunks with halos of half a window.
Dedup: the first frame of a time, by an aggregation with map-side combine.
Cage mask (optional): centres from value histograms.
Stage 1, key (session, time chunk): local frame index, local previous and
  next known values.  A summary row per chunk gives offsets, the known
  values of other chunks, counts and the common start, joined back on the
  same key; both read one exchange.  Fill and trim follow per row.
Stage 2, key (session, index chunk) plus halo copies of fps + 2 frames on
  each side: step length, rolling sums, pair distances and the event lag
  see their neighbours; only a chunk's own frames are emitted.
Bouts: lead/lag of events inside a chunk; each chunk's first and last event
  per pair and threshold are stitched to those of its neighbours.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cagetrace.functions.rolling import centred, edge_null_mean, edge_null_sd, strict_sum, trailing
from cagetrace.operators import clean as C
from cagetrace.operators import contacts as CT
from cagetrace.operators import motion as M
from cagetrace.operators import reshape as RS
from cagetrace.params import CleanParams
from cagetrace.session import stage

S = "session"
UNB = W.unboundedPreceding
CHUNK_MS, CHUNK_ROWS = 300_000, 20_000


def _xy(ids) -> list[str]:
    return [f"id_{k}_{a}" for k in ids for a in ("x", "y")]


def _cells(ids) -> list[Column]:
    """Per subject: its row of the smallest frame number among the grouped rows."""
    row = F.struct("frame_no", "x", "y")
    return [F.min(F.when(F.col("id") == k, row)).alias(f"_r{k}") for k in ids]


def _open(ids, frame_no: Column) -> list[Column]:
    """Positions of the frame ``frame_no`` and whether the subject has rows."""
    out = []
    for k in ids:
        r = F.col(f"_r{k}")
        here = r["frame_no"] == frame_no
        out += [F.when(here, r["x"]).alias(f"id_{k}_x"), F.when(here, r["y"]).alias(f"id_{k}_y"),
                r.isNotNull().alias(f"id_{k}_in")]
    return out


def _frame_cols(ids) -> list[str]:
    return _xy(ids) + [f"id_{k}_in" for k in ids]


def long_rows(wide: DataFrame, ids, keys, cols=("x", "y")) -> DataFrame:
    """Rows of the subjects that have any."""
    return RS.to_long(wide, ids, keys=list(keys), cols=(*cols, "in")).filter("in").drop("in")


def usable(frames: DataFrame, ids, session: str = S) -> DataFrame:
    """Rows with a recording, a time and a listed subject (the check report lists the others)."""
    return frames.filter(F.col(session).isNotNull() & F.col("time").isNotNull() & F.col("id").isin(list(ids)))


def _halos(rows: DataFrame, index: str, k: int, halo: int, chunk: str, own: str, session: str) -> DataFrame:
    """Chunks of ``k`` consecutive indices (from 1) with ``halo`` copies on each side."""
    if k < halo:
        raise ValueError("chunk rows must be at least the halo size")
    pos = (F.col(index) - 1) % k
    c = F.floor((F.col(index) - 1) / k)
    copies = F.array(
        F.struct(c.alias(chunk), F.lit(True).alias(own)),
        F.when(pos >= k - halo, F.struct((c + 1).alias(chunk), F.lit(False).alias(own))),
        F.when((pos < halo) & (c > 0), F.struct((c - 1).alias(chunk), F.lit(False).alias(own))))
    return rows.select("*", F.inline(F.filter(copies, lambda s: s.isNotNull()))).repartition(session, chunk)


def z_scores(frames: DataFrame, ids, n: int, z: float, session: str = S, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Wide frames in file order with centred rolling mean and sd over ``n`` frames of
    every axis (``id_k_x_mean``, ``id_k_x_sd``, ...) and each subject's flag ``id_k_z``:
    |v - mean| > z * sd on x or y; null comparisons count as false, frames cut
    off at an edge are null."""
    f = usable(frames, ids, session).withColumn("_fc", F.floor(F.col("frame_no") / chunk_rows)).repartition(session, "_fc")
    f = f.groupBy(session, "_fc", "frame_no", "time").agg(*_cells(ids))
    f = f.select(session, "_fc", "frame_no", "time", *_open(ids, F.col("frame_no")))
    f = f.withColumn("_l", F.row_number().over(W.partitionBy(session, "_fc").orderBy("frame_no", "time")))
    counts = f.groupBy(session, "_fc").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(W.partitionBy(session).orderBy("_fc").rowsBetween(UNB, -1))
    f = f.join(counts.select(session, "_fc", F.coalesce(before, F.lit(0)).alias("_o")), [session, "_fc"])
    f = f.withColumn("_zr", F.col("_o") + F.col("_l")).drop("_fc", "_o", "_l")
    f = _halos(f, "_zr", chunk_rows, n // 2 + 1, "_zc", "_zown", session)
    w, fr = W.partitionBy(session, "_zc").orderBy("_zr"), centred(n)
    f = f.select("*", *[g(c, w, fr).alias(f"{c}_{s}") for c in _xy(ids) for s, g in (("mean", edge_null_mean), ("sd", edge_null_sd))])
    out = [F.abs(F.col(c) - F.col(f"{c}_mean")) > F.col(f"{c}_sd") * F.lit(z) for c in _xy(ids)]
    flags = [F.coalesce(out[2 * i] | out[2 * i + 1], F.lit(False)).alias(f"id_{k}_z") for i, k in enumerate(ids)]
    return f.filter("_zown").select("*", *flags).drop("_zr", "_zc", "_zown")


def deduped(frames: DataFrame, p: CleanParams, session: str = S, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Wide frames, one per time (the first in file order), z mask applied if asked for."""
    ids = p.ids
    if p.rm_z_outlier:
        f = z_scores(frames, ids, p.z_rows, p.z_threshold, session, chunk_rows)
        bad = F.lit(False)
        for k in ids:
            bad = bad | F.col(f"id_{k}_z")
        f = f.select(session, "frame_no", "time", *[F.when(~bad, F.col(c)).alias(c) for c in _xy(ids)], *[f"id_{k}_in" for k in ids])
        first = F.min(F.struct("frame_no", *_frame_cols(ids))).alias("_f")
        return f.groupBy(session, "time").agg(first).select(session, "time", "_f.*")
    f = usable(frames, ids, session).groupBy(session, "time").agg(F.min("frame_no").alias("frame_no"), *_cells(ids))
    return f.select(session, "time", "frame_no", *_open(ids, F.col("frame_no")))


def cage_mask(d: DataFrame, p: CleanParams, session: str = S) -> DataFrame:
    """Null positions outside centre +- size/2 * scale; a null axis nulls both.

    The wide frames are stored once, so what comes before does not run
    again for the centres.
    """
    d = stage(d, "deduped")
    centre = C.cage_center(long_rows(d, p.ids, [session, "time"]), p.cage_width, p.cage_height, session).select(session, "cx", "cy")
    keys = d.select(session, _tc(p)).distinct().join(centre, session, "left")
    d = d.withColumn("_tc", _tc(p)).repartition(session, "_tc").join(keys, [session, "_tc"])
    half = {"x": p.cage_width / 2 * p.cage_scale_threshold, "y": p.cage_height / 2 * p.cage_scale_threshold}
    fix = {}
    for k in p.ids:
        v = {a: F.col(f"id_{k}_{a}") for a in ("x", "y")}
        kept = {a: F.when(~((v[a] > F.col(f"c{a}") + half[a]) | (v[a] < F.col(f"c{a}") - half[a])), v[a]) for a in v}
        both = kept["x"].isNotNull() & kept["y"].isNotNull()
        fix |= {f"id_{k}_{a}": F.when(both, kept[a]) for a in v}
    return d.withColumns(fix).drop("cx", "cy")


def _tc(p: CleanParams, chunk_ms: int = CHUNK_MS) -> Column:
    return F.floor(F.unix_millis("time") / F.lit(int(chunk_ms))).alias("_tc")


def located(frames: DataFrame, p: CleanParams, session: str = S, chunk_ms: int = CHUNK_MS,
            chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Wide frames, key (session, _tc), with the chunk summary joined: frame index
    ``_gi``, previous and next known value of each axis, the common start, and
    each subject's first complete time.

    Frames are shuffled by chunk once: the summary and the frames it is joined to
    read the same columns of the same exchange (Spark reuses it).  Rows are
    sorted in a chunk and numbered as they come, so the summary needs no window;
    only differences of these numbers within a chunk are used.
    """
    d = deduped(frames, p, session, chunk_rows)
    if p.rm_cage_outlier:
        d = cage_mask(d, p, session).drop("_tc")
    cols = _xy(p.ids)
    f = d.withColumn("_tc", _tc(p, chunk_ms)).repartition(session, "_tc").sortWithinPartitions(session, "_tc", "time")
    f = f.withColumn("_r", F.monotonically_increasing_id())

    def known(c):
        return f"CASE WHEN {c} IS NOT NULL THEN _r END"

    s = f.groupBy(session, "_tc").agg(*[F.expr(e) for e in (
        "count(1) AS n", "min(_r) AS _r0", *[f"count({c}) AS _k_{c}" for c in cols],
        *[x for c in cols for x in (f"min({known(c)}) AS fi_{c}", f"min_by({c}, {known(c)}) AS fv_{c}", f"max({known(c)}) AS li_{c}", f"max_by({c}, {known(c)}) AS lv_{c}")],
        *[f"min(CASE WHEN id_{k}_x IS NOT NULL AND id_{k}_y IS NOT NULL THEN time END) AS mt_{k}" for k in p.ids],
        *[f"max(id_{k}_in) AS in_{k}" for k in p.ids])])
    up, down = (f"(PARTITION BY `{session}` ORDER BY _tc{way} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)" for way in ("", " DESC"))
    s = s.selectExpr("*", f"coalesce(sum(n) OVER {up}, 0L) AS _off")
    s = s.selectExpr(f"`{session}`", "_tc", "_off", *[f"_k_{c}" for c in cols], *[f"{m}_{k}" for m in ("mt", "in") for k in p.ids],
                     *[x for e in "fl" for c in cols for x in (f"_off + {e}i_{c} - _r0 + 1 AS {e}i_{c}", f"{e}v_{c}")])
    s = s.selectExpr("*", *[x for c in cols for x in (f"last(li_{c}, true) OVER {up} AS _ppi_{c}", f"last(lv_{c}, true) OVER {up} AS _ppv_{c}",
                                                      f"last(fi_{c}, true) OVER {down} AS _nni_{c}", f"last(fv_{c}, true) OVER {down} AS _nnv_{c}")],
                     *[f"coalesce(sum(_k_{c}) OVER {w}, 0L) AS _k{i}_{c}" for i, w in enumerate((up, down)) for c in cols],
                     *[f"min(mt_{k}) OVER {w} AS mt{i}_{k}" for i, w in enumerate((up, down)) for k in p.ids],
                     *[f"coalesce(max(in_{k}) OVER {w}, false) AS in{i}_{k}" for i, w in enumerate((up, down)) for k in p.ids])
    s = s.selectExpr(f"`{session}`", "_tc", "_off", *[f"_{e}_{c}" for e in ("ppi", "ppv", "nni", "nnv") for c in cols], *[f"_k_{c} + _k0_{c} + _k1_{c} AS _k_{c}" for c in cols],
                     *[f"least(mt_{k}, mt0_{k}, mt1_{k}) AS _mt_{k}" for k in p.ids], *[f"in_{k} OR in0_{k} OR in1_{k} AS _in_{k}" for k in p.ids])
    never = " OR ".join(f"(_in_{k} AND _mt_{k} IS NULL)" for k in p.ids)
    seen = ", ".join(f"CASE WHEN _in_{k} THEN _mt_{k} END" for k in p.ids)
    s = s.selectExpr("*", f"CASE WHEN NOT ({never}) THEN greatest({seen}) END AS _start")
    asc, desc = (f"(PARTITION BY `{session}`, _tc ORDER BY time{way} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)" for way in ("", " DESC"))
    f = f.selectExpr("*", f"first(_r) OVER {asc} AS _r0",
                     *[x for c in cols for e, w in (("p", asc), ("n", desc)) for x in (f"last({known(c)}, true) OVER {w} AS _{e}i_{c}", f"last({c}, true) OVER {w} AS _{e}v_{c}")])
    # true for every frame; with it both sides of the join read the same columns
    f = f.filter(" OR ".join(f"id_{k}_in" for k in p.ids)).drop(*[f"id_{k}_in" for k in p.ids])
    j = f.join(s, [session, "_tc"]).withColumn("_gi", F.expr("_off + _r - _r0 + 1"))
    return j.withColumnsRenamed({f"_in_{k}": f"id_{k}_in" for k in p.ids})


def starts(frames: DataFrame, p: CleanParams, session: str = S, **chunks) -> DataFrame:
    """(session, id, first_seen, start, kept_rows): a subject's first complete time, the
    recording's common start (null if a subject is never complete) and the frames from it on."""
    j = located(frames, p, session, **chunks)
    e = F.array(*[F.struct(F.lit(k).alias("id"), F.col(f"_mt_{k}").alias("first_seen"), F.col(f"id_{k}_in").alias("in")) for k in p.ids])
    return (j.select(session, "time", "_start", F.inline(e)).filter("in").groupBy(session, "id")
            .agg(F.min("first_seen").alias("first_seen"), F.min("_start").alias("start"),
                 F.count_if(F.col("time") >= F.col("_start")).alias("kept_rows")))


def _cleaned(frames: DataFrame, p: CleanParams, session: str, chunk_ms: int, chunk_rows: int) -> DataFrame:
    """Wide frames from the common start on, gaps filled, with ``time0`` and ``_gi``.

    Linear in the frame index; leading and trailing gaps take the nearest
    known value; an axis with fewer than two known values keeps them and
    leaves its gaps null.
    """
    j = located(frames, p, session, chunk_ms, chunk_rows).filter("time >= _start")

    def fill(c):
        p0, n0 = (f"coalesce(_{e}i_{c} + _off - _r0 + 1, _{e}{e}i_{c})" for e in "pn")
        p1, n1 = (f"coalesce(_{e}v_{c}, _{e}{e}v_{c})" for e in "pn")
        return (f"CASE WHEN {c} IS NOT NULL THEN {c} WHEN _k_{c} < 2 THEN CAST(NULL AS DOUBLE) WHEN {p0} IS NULL THEN {n1} WHEN {n0} IS NULL THEN {p1} "
                f"ELSE {p1} + ({n1} - {p1}) * (_gi - {p0}) / ({n0} - {p0}) END AS {c}")

    t0 = f"(unix_micros(time) - unix_micros(_start)) / {M.US_PER_MIN!r}D AS time0"
    return j.selectExpr(f"`{session}`", "frame_no", "time", t0, "_gi", *[e for k in p.ids for e in (fill(f"id_{k}_x"), fill(f"id_{k}_y"))],
                        *[f"id_{k}_in" for k in p.ids])


def clean(frames: DataFrame, p: CleanParams, session: str = S, chunk_ms: int = CHUNK_MS,
          chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Cleaned long positions: session, frame_no, time, id, x, y (trimmed, filled)."""
    return long_rows(_cleaned(frames, p, session, chunk_ms, chunk_rows), p.ids, [session, "frame_no", "time"])


@dataclass
class Behavior:
    """The derived tables of one clean-and-derive run.

    ``wide_all`` (one row per recording and time, every subject's x, y, move and
    rolling sums, halo copies included) is the shared intermediate of every
    measure family; ``materialized()`` writes it once to the shared folder,
    columnar, so the families read only their columns of it.
    """

    wide_all: DataFrame
    ids: tuple[int, ...]
    session: str = S
    crossed: tuple[float, ...] = ()   # thresholds whose crossings are stored in ``_ev``

    @property
    def wide(self) -> DataFrame:
        return self.wide_all.filter("_own").drop("_ic", "_own", "_ev", *[f"id_{k}_in" for k in self.ids])

    def rows(self, cols) -> DataFrame:
        """Long rows of some derived columns; only these are read from a stored table."""
        return long_rows(self.wide_all.filter("_own"), self.ids, [self.session, "time", "time0"], cols)

    @property
    def motion(self) -> DataFrame:
        return self.rows(M.MOTION_COLS)

    @property
    def pairs(self) -> DataFrame:
        return M.pair_rows(self.wide, self.ids, session=self.session)

    @property
    def neighbours(self) -> DataFrame:
        return M.neighbour_distance(self.wide.select(self.session, "time", "time0", *_xy(self.ids)), self.ids, session=self.session)

    def events(self, thresholds) -> DataFrame:
        """Contact events for every threshold, keyed (session, _ic)."""
        stored = bool(self.crossed) and self.crossed == tuple(thresholds)
        rows = self.wide_all if stored else CT.with_crossings(self.wide_all.drop("_ev"), self.ids, thresholds, self.session, ("_ic",))
        return CT.crossing_events(rows.filter("_own"), self.session, ("_ic",))

    def bouts(self, thresholds) -> DataFrame:
        """Contact events with bout attributes for every threshold."""
        return chunked_bouts(self.events(thresholds), self.session)

    def materialized(self, thresholds=()) -> "Behavior":
        """Stored; with *thresholds* their crossings too, found where the frames still lie in order, so that
        reading the events later shuffles events only."""
        rows = CT.with_crossings(self.wide_all, self.ids, thresholds, self.session, ("_ic",)) if thresholds else self.wide_all
        return Behavior(stage(rows, "behavior"), self.ids, self.session, tuple(thresholds))


def chunked_bouts(ev: DataFrame, session: str = S) -> DataFrame:
    """Bouts of chunk-keyed events (lag taken over own + halo frames).

    Lead and lag run inside a chunk first.  Only the first and the last event of
    each pair and threshold in a chunk lack a neighbour there; in a second pass
    these form a series of their own over the chunks, where the next row of a
    last event is the first one of the chunk after it.  All other events stay
    dealt by chunk.
    """
    pair = f"PARTITION BY `{session}`, threshold, ida, idb, _ic"
    ev = ev.selectExpr("*", *[f"{g}({c}) OVER ({pair} ORDER BY time) AS {a}" for g, c, a in (
        ("lead", "time", "_nt"), ("lead", "moving_f_id", "_nf"), ("lag", "time", "_pt"), ("lag", "moving_r_id", "_pr"))])
    ev = ev.selectExpr("*", "CASE WHEN _nt IS NOT NULL AND _pt IS NOT NULL THEN _ic END AS _inside")
    edge = f"(PARTITION BY `{session}`, threshold, ida, idb, _inside ORDER BY time)"
    ev = ev.selectExpr("*", f"lead(time) OVER {edge} AS _et", f"lead(moving_f_id) OVER {edge} AS _ef", f"lag(moving_r_id) OVER {edge} AS _er")
    return ev.selectExpr(f"`{session}`", "threshold", "time", "time0", "ida", "idb", "dist", "nearing", "nearing_event", "moving_r_id", "moving_f_id",
                         "(unix_micros(coalesce(_nt, _et)) - unix_micros(time)) / 1e6D AS duration",
                         "CASE WHEN nearing_event = -1 THEN CASE WHEN _nt IS NULL THEN _ef ELSE _nf END END AS depart_id",
                         "CASE WHEN nearing_event = 1 THEN CASE WHEN _pt IS NULL THEN _er ELSE _pr END END AS approach_id")


def behavior(frames: DataFrame, p: CleanParams, session: str = S, chunk_ms: int = CHUNK_MS,
             chunk_rows: int = CHUNK_ROWS) -> Behavior:
    """Clean-and-derive; chunk sizes change the tasks, not the result."""
    rows = _halos(_cleaned(frames, p, session, chunk_ms, chunk_rows).drop("frame_no"), "_gi", chunk_rows, p.fps + 2, "_ic", "_own", session)
    w = f"(PARTITION BY `{session}`, _ic ORDER BY _gi)"

    def step(k):
        dx, dy = (f"(id_{k}_{a} - lag(id_{k}_{a}) OVER {w})" for a in "xy")
        return f"sqrt({dx} * {dx} + {dy} * {dy}) AS id_{k}_move"

    rows = rows.selectExpr("*", *[step(k) for k in p.ids])
    w = W.partitionBy(session, "_ic").orderBy("_gi")
    rows = rows.select("*", *[strict_sum(f"id_{k}_move", w, trailing(p.fps)).alias(f"id_{k}_roll_r") for k in p.ids])
    # the frames that start here are those that end fps - 1 frames later
    rows = rows.select("*", *[F.lead(f"id_{k}_roll_r", p.fps - 1).over(w).alias(f"id_{k}_roll_f") for k in p.ids])
    return Behavior(rows.drop("_gi"), p.ids, session)
