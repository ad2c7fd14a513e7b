"""Per-subject measures over whole windows and over time bins.

A whole grid of parameters comes from one aggregation of the frames.  Times
are cut into cells of the greatest width that divides every window and bin
width; frames (or events) are summed per cell once, with map-side combine, and
windows and bins of any width are sums of cells.  What lies beyond the last
window is one cell, so a subject has a number of cells that the parameters
bound.  Cell tables are small: ``plans.sweep`` stores them, and deals them by
recording once for all the measures taken from them.

Cells are cut in whole microseconds, so a cell's frames are in a window or bin
exactly if their own times are.  Bins: ``bin = int(floor(time0 / w) * w)``,
time0 >= 0.
"""

from __future__ import annotations

from dataclasses import dataclass
from fractions import Fraction
from math import ceil, gcd

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cagetrace.functions.rolling import running

S = "session"
US_PER_MIN = 60_000_000


def _us(minutes) -> int:
    """The first whole microsecond that is not below *minutes*."""
    return ceil(Fraction(str(minutes)) * US_PER_MIN)


@dataclass(frozen=True)
class Lattice:
    """Cells of *unit* microseconds, and as the last one all time from ``unit * last`` on."""

    unit: int
    last: int

    @staticmethod
    def of(windows=(), within=None, widths=()) -> "Lattice":
        ends = [_us(w) for w in windows] + ([_us(within)] if within is not None else [])
        unit = gcd(*ends, *[_us(w) for w in widths])
        return Lattice(unit, max(ends) // unit)

    @property
    def cell(self) -> Column:
        return F.expr(f"least(bigint(round(time0 * {US_PER_MIN}D)) div {self.unit}L, {self.last}L)").alias("cell")

    def before(self, minutes) -> Column:
        """Whether a cell lies before a time that the lattice was made for."""
        return F.col("cell") < F.lit(_us(minutes) // self.unit)

    def bins(self, widths) -> Column:
        """Rows (bin_min, bin) of a cell for every width."""
        return F.expr("inline(array(" + ", ".join(
            f"named_struct('bin_min', {int(w)}, 'bin', int(cell * {self.unit}L div {_us(w)}L * {int(w)}))" for w in widths) + "))")


def _unpivot(df: DataFrame, keys: list[str], tag: str, tag_values, fields: dict[str, list[Column]]):
    """Rows per tag value from per-tag columns: fields[name][i] belongs to tag_values[i]."""
    structs = [F.struct(F.lit(v).alias(tag), *[cols[i].alias(name) for name, cols in fields.items()])
               for i, v in enumerate(tag_values)]
    return df.select(*keys, F.inline(F.array(*structs)))


def cell_sums(rows: DataFrame, keys: list[str], lattice: Lattice, sums: dict[str, Column]) -> DataFrame:
    """(keys, cell) and the sums; rows that have none of a sum's values give null."""
    return rows.groupBy(*keys, lattice.cell).agg(*[F.sum(c).alias(n) for n, c in sums.items()])


def _binned(cells: DataFrame, keys: list[str], lattice: Lattice, within: float, widths) -> DataFrame:
    """(keys, bin_min, bin) and the sums of the cells before *within*."""
    names = [c for c in cells.columns if c not in (*keys, "cell")]
    rows = cells.filter(lattice.before(within)).select(*keys, *names, lattice.bins(widths))
    return rows.groupBy(*keys, "bin_min", "bin").agg(*[F.sum(c).alias(c) for c in names])


def _regular(within: float, width: float) -> list[int]:
    last = (int(within // width) - 1) * int(width)
    if last < 0:
        raise ValueError(f"bin width {width} exceeds window {within}")
    return list(range(0, last + 1, int(width)))


def complete_bins(agg: DataFrame, keys: list[str], item: str, regular: dict[int, list[int]],
                  fill: dict[str, object]) -> DataFrame:
    """Zero-fill a bin table: every item x (regular bins of its width U observed bins).

    ``keys`` identify an independent table (session, [threshold,] bin_min).
    One aggregation per table gathers its items, observed bins and values
    (at most items x bins entries: bounded by the id list and the bin
    grid, never by frame count), then the grid is exploded and looked up.
    Keyed by session first, so no shuffle beyond the session partitioning.
    """
    vals = [c for c in agg.columns if c not in (*keys, item, "bin")]
    reg_map = F.create_map(*[x for w, bins in regular.items()
                             for x in (F.lit(int(w)), F.array(*[F.lit(int(b)) for b in bins]))])
    cell = F.struct(F.col(item).alias("i"), F.col("bin").alias("b"))
    g = agg.groupBy(*keys).agg(
        F.collect_set(item).alias("_items"),
        F.collect_set("bin").alias("_obs"),
        F.map_from_entries(F.collect_list(F.struct(cell, F.struct(*vals)))).alias("_vals"))
    reg = F.coalesce(F.element_at(reg_map, F.col("bin_min")), F.array().cast("array<int>"))
    g = g.select(*keys, "_items", "_vals", F.array_union("_obs", reg).alias("_bins"))
    grid = (g.select(*keys, F.explode("_items").alias(item), "_bins", "_vals")
            .select(*keys, item, F.explode("_bins").alias("bin"), "_vals"))
    hit = F.element_at(F.col("_vals"), F.struct(F.col(item).alias("i"), F.col("bin").alias("b")))
    return grid.select(*keys, item, "bin", *[
        (F.coalesce(hit[c], F.lit(fill[c])) if c in fill else hit[c]).alias(c) for c in vals])


# ---------------------------------------------------------------- activity
def activity_totals(cells: DataFrame, lattice: Lattice, windows, session: str = S) -> DataFrame:
    """Path length per subject in [0, w) minutes, metres; 0 when no move."""
    windows = [float(w) for w in windows]
    g = cells.groupBy(session, "id").agg(*[F.coalesce(F.sum(F.when(lattice.before(w), F.col("s_move"))), F.lit(0.0)).alias(f"_a{i}")
                                           for i, w in enumerate(windows)])
    return _unpivot(g, [session, "id"], "window_min", windows, {"total_activity": [F.col(f"_a{i}") / 1000 for i in range(len(windows))]})


def activity_bins(cells: DataFrame, lattice: Lattice, within: float, widths, session: str = S) -> DataFrame:
    """Path length per subject and bin (metres), every regular bin present."""
    agg = _binned(cells.select(session, "id", "cell", "s_move"), [session, "id"], lattice, within, widths)
    agg = agg.select(session, "id", "bin_min", "bin", (F.coalesce("s_move", F.lit(0.0)) / 1000).alias("bin_activity"))
    return complete_bins(agg, [session, "bin_min"], "id", {int(w): _regular(within, w) for w in widths}, {"bin_activity": 0.0})


def move_cells(motion: DataFrame, lattice: Lattice, session: str = S) -> DataFrame:
    return cell_sums(motion, [session, "id"], lattice, {"s_move": F.col("move")})


def total_activity(motion: DataFrame, windows, session: str = S) -> DataFrame:
    lattice = Lattice.of(windows)
    return activity_totals(move_cells(motion, lattice, session).repartition(session), lattice, windows, session)


def bin_activity(motion: DataFrame, within: float, widths, session: str = S) -> DataFrame:
    lattice = Lattice.of((), within, widths)
    return activity_bins(move_cells(motion, lattice, session).repartition(session), lattice, within, widths, session)


# ---------------------------------------------------------------- distance
DIST = {"s_mean": "mean_dist", "s_close": "closest_dist"}


def neighbour_cells(neigh: DataFrame, lattice: Lattice, session: str = S) -> DataFrame:
    sums = {n: F.col(c) for n, c in DIST.items()} | {f"n{n[1:]}": F.when(F.col(c).isNotNull(), 1) for n, c in DIST.items()}
    return cell_sums(neigh, [session, "id"], lattice, sums)


def _mean(s: Column, n: Column) -> Column:
    return F.try_divide(s, n.cast("double"))


def distance_totals(cells: DataFrame, lattice: Lattice, windows, session: str = S) -> DataFrame:
    """Mean over frames of the per-frame mean and closest distance to others."""
    windows = [float(w) for w in windows]
    parts = {(n, i): F.sum(F.when(lattice.before(w), F.col(n))) for i, w in enumerate(windows) for n in ("s_mean", "n_mean", "s_close", "n_close")}
    g = cells.groupBy(session, "id").agg(*[c.alias(f"{n}{i}") for (n, i), c in parts.items()])
    return _unpivot(g, [session, "id"], "window_min", windows, {
        f"total_{m}_dist": [_mean(F.col(f"s_{e}{i}"), F.col(f"n_{e}{i}")) for i in range(len(windows))] for m, e in (("mean", "mean"), ("closest", "close"))})


def distance_bins(cells: DataFrame, lattice: Lattice, within: float, widths, session: str = S) -> DataFrame:
    """Per-bin means of the frame distances; bins are not gap filled."""
    names = [session, "id", "cell", "s_mean", "n_mean", "s_close", "n_close"]
    agg = _binned(cells.select(*names), [session, "id"], lattice, within, widths)
    return agg.select(session, "id", "bin_min", "bin", _mean(F.col("s_mean"), F.col("n_mean")).alias("bin_mean_dist"),
                      _mean(F.col("s_close"), F.col("n_close")).alias("bin_closest_dist"))


def total_distance(neigh: DataFrame, windows, session: str = S) -> DataFrame:
    lattice = Lattice.of(windows)
    return distance_totals(neighbour_cells(neigh, lattice, session).repartition(session), lattice, windows, session)


def bin_distance(neigh: DataFrame, within: float, widths, session: str = S) -> DataFrame:
    lattice = Lattice.of((), within, widths)
    return distance_bins(neighbour_cells(neigh, lattice, session).repartition(session), lattice, within, widths, session)


# ------------------------------------------------------------- interaction
INTER_FIELDS = ("event_count", "approach_count", "receive_count",
                "duration", "approach_duration", "receive_duration")


def contact_cells(bouts: DataFrame, lattice: Lattice, session: str = S) -> DataFrame:
    """Approaches per subject (ida), threshold and cell: their counts and durations, of its own moves and of others'."""
    mine, d = F.col("moving_r_id") == F.col("ida"), F.col("duration")
    other = F.col("moving_r_id") != F.col("ida")
    fields = (F.lit(1), F.when(mine, 1).otherwise(0), F.when(other, 1).otherwise(0),
              F.coalesce(d, F.lit(0.0)), F.coalesce(F.when(mine, d), F.lit(0.0)), F.coalesce(F.when(other, d), F.lit(0.0)))
    appr = bouts.filter(F.col("nearing_event") == -1).withColumn("id", F.col("ida"))
    return cell_sums(appr, [session, "threshold", "id"], lattice, dict(zip(INTER_FIELDS, fields)))


def contact_totals(cells: DataFrame, lattice: Lattice, windows, session: str = S) -> DataFrame:
    """Approach counts and bout durations per subject and threshold.

    Only approach rows (-1) count; a subject with no approach in the
    window gets no row.  Durations were set before the window filter, so
    a bout that starts inside the window counts in full.
    """
    windows = [float(w) for w in windows]
    g = cells.groupBy(session, "threshold", "id").agg(*[F.sum(F.when(lattice.before(w), F.col(f))).alias(f"{f}{i}")
                                                        for i, w in enumerate(windows) for f in INTER_FIELDS])
    out = _unpivot(g, [session, "threshold", "id"], "window_min", windows,
                   {f"total_{f}": [F.col(f"{f}{i}") for i in range(len(windows))] for f in INTER_FIELDS})
    return out.filter(F.col("total_event_count") > 0)


def contact_bins(cells: DataFrame, lattice: Lattice, within: float, widths, session: str = S) -> DataFrame:
    """Per-bin contact measures, zero filled, with running totals of the counts.

    Filled only for subjects with at least one approach in the window.
    """
    agg = _binned(cells, [session, "threshold", "id"], lattice, within, widths).withColumnsRenamed({f: f"bin_{f}" for f in INTER_FIELDS})
    fill = {f"bin_{f}": (0.0 if "duration" in f else 0) for f in INTER_FIELDS}
    done = complete_bins(agg, [session, "threshold", "bin_min"], "id", {int(w): _regular(within, w) for w in widths}, fill)
    w = running(W.partitionBy(session, "threshold", "bin_min", "id").orderBy("bin"))
    return done.withColumns({f"bin_{short}_cumul": F.sum(f"bin_{short}_count").over(w)
                             for short in ("event", "approach", "receive")})


def total_interaction(bouts: DataFrame, windows, session: str = S) -> DataFrame:
    lattice = Lattice.of(windows)
    return contact_totals(contact_cells(bouts, lattice, session).repartition(session), lattice, windows, session)


def bin_interaction(bouts: DataFrame, within: float, widths, session: str = S) -> DataFrame:
    lattice = Lattice.of((), within, widths)
    return contact_bins(contact_cells(bouts, lattice, session).repartition(session), lattice, within, widths, session)


def join_info(measures: DataFrame, info: DataFrame | None, session: str = S) -> DataFrame:
    """Left join subject facts on (session, id)."""
    if info is None:
        return measures
    return measures.join(info, [session, "id"], "left")
