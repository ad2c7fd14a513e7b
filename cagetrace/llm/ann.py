"""Approximate nearest neighbours by an adaptive dimension scan.

Vectors get one more component that turns largest inner product into
smallest distance, and are rotated at random.  Each belongs to the list of
its nearest centroid; a query probes the lists nearest to it.  The very nearest
lists are searched first and give the query a threshold, its k-th distance
there, which all its lists share.  Then the rotated dimensions of each probed
list are read in blocks: after each block a hypothesis test compares the
distance estimated from the dimensions so far with the threshold, and abandons
the candidates that are too far.  A block is one matrix product at first, and
one gather over the remaining pairs of a tile from then on.  Survivors are
scored on the original vectors in double precision.

Large lists are split into blocks of candidates and of queries, so that a
hot list is many tasks.  The centroids are fitted on a bounded sample
(SAMPLE vectors with the smallest hash of the id); every vector is indexed.

Defined results: vectors null, zero, or with a null or non-finite component,
without an id, or not of the most common length take no part; equal rows are
one; a vector is never its own neighbour, also not where rows share its id.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cagetrace.llm.store import stage

#: The share of all lists that a query probes: vectors without clusters need this much for a recall of 0.9
SAMPLE, MOST_LISTS, PROBED = 20_000, 1024, 0.85
#: The share of the lists that give a query its threshold
SEEDS = 1 / 16
CANDIDATES, QUERIES, DIMS, AT_ONCE = 4096, 512, 8, 1024
#: Significance of the abandonment test: how far beyond its expectation an estimate must be
EPSILON = 1.0


def _matrix(col) -> np.ndarray:
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    return col.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(col), -1)


def rotation(dim: int) -> np.ndarray:
    """A random orthogonal matrix, the same for every task."""
    q, r = np.linalg.qr(np.random.default_rng(5).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def lift(x: np.ndarray, norm: float, rot: np.ndarray, query: bool = False) -> np.ndarray:
    """Rotated vectors whose distance order to a query is that of the inner products."""
    rest = np.zeros(len(x)) if query else np.sqrt(np.maximum(0, norm**2 - (x * x).sum(axis=1)))
    return np.concatenate([x, rest[:, None]], axis=1) @ rot


def centroids(x: np.ndarray, count: int, rounds: int = 12) -> np.ndarray:
    """k-means over a bounded sample."""
    rng = np.random.default_rng(11)
    c = x[rng.choice(len(x), min(count, len(x)), replace=False)]
    for _ in range(rounds):
        near = nearest(x, c, 1)[:, 0]
        n = np.bincount(near, minlength=len(c))
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        c = np.where(n[:, None] > 0, total / np.maximum(1, n)[:, None], c)
    return c


def nearest(x: np.ndarray, c: np.ndarray, k: int) -> np.ndarray:
    """The *k* nearest centroids of each vector, nearest first."""
    d = (c * c).sum(axis=1)[None, :] - 2 * (x @ c.T)
    k = min(k, len(c))
    near = np.argpartition(d, k - 1, axis=1)[:, :k] if k < len(c) else np.broadcast_to(np.arange(k), d.shape)
    return np.take_along_axis(near, np.argsort(np.take_along_axis(d, near, axis=1), axis=1), axis=1)


def _distances(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    return np.maximum(0, (q * q).sum(axis=1)[:, None] + (v * v).sum(axis=1)[None, :] - 2 * q @ v.T)


def adaptive_scan(q: np.ndarray, v: np.ndarray, worst: np.ndarray, dims: int = DIMS, epsilon: float = EPSILON) -> tuple[np.ndarray, np.ndarray, int]:
    """Pairs (row of *q*, row of *v*) of rotated vectors that no test abandons, and how many dimensions were read.

    *worst* is each query's threshold.  All pairs within it are returned, but for the test's error.
    """
    dim, read = v.shape[1], 0
    cuts = [*range(dims, dim, dims), dim]
    left, right = [], []
    for lo in range(0, len(v), AT_ONCE):
        part, seen = v[lo:lo + AT_ONCE], cuts[0]
        d = _distances(q[:, :seen], part[:, :seen])
        read += d.size * seen
        i, j = np.nonzero(d * (dim / seen) <= worst[:, None] * (1 + (epsilon / np.sqrt(seen) if seen < dim else 0)) ** 2 + 1e-9)
        d = d[i, j]
        for nxt in cuts[1:]:
            if not len(i):
                break
            diff = part[j, seen:nxt] - q[i, seen:nxt]
            d, read, seen = d + np.einsum("ij,ij->i", diff, diff), read + diff.size, nxt
            near = d * (dim / seen) <= worst[i] * (1 + (epsilon / np.sqrt(seen) if seen < dim else 0)) ** 2 + 1e-9
            i, j, d = i[near], j[near], d[near]
        left.append(i), right.append(j + lo)
    return np.concatenate(left), np.concatenate(right), read


_FOUND = "query_id long, vec_id long, score double"


def _best(q_ids, v_ids, i, j, score, k: int, *more) -> list[np.ndarray]:
    """Of the pairs (i, j) of a tile, each query's *k* best: its id, the other's, the score, and the same of *more*."""
    other = v_ids[j] != q_ids[i]
    i, j, score, *more = (c[other] for c in (i, j, score, *more))
    order = np.lexsort((v_ids[j], -score, i))
    order = order[np.arange(len(i)) - np.searchsorted(i[order], i[order]) < k]
    return [q_ids[i[order]], v_ids[j[order]], *(c[order] for c in (score, *more))]


def _scan(norm: float, k: int, epsilon: float | None):
    """A tile's function: each query's *k* best in the tile, by the adaptive scan; without *epsilon* by all distances, which are returned too."""
    names = ["query_id", "vec_id", "score", *(["distance"] if epsilon is None else [])]
    kinds = [pa.int64(), pa.int64(), pa.float64(), pa.float64()]

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.Table.from_arrays([pa.array([], t) for t, _ in zip(kinds, names)], names=names)
        q, v = _matrix(left.column("embedding")), _matrix(right.column("embedding"))
        q_ids, v_ids = left.column("query_id").to_numpy(), right.column("vec_id").to_numpy()
        rot = rotation(q.shape[1] + 1)
        lq, lv = lift(q, norm, rot, True), lift(v, norm, rot)
        if epsilon is None:
            d = _distances(lq, lv)
            few = min(k + 1 + int((q_ids[:, None] == v_ids[None, :]).sum(axis=1).max()), d.shape[1])   # beyond the query's own rows
            j = np.argpartition(d, few - 1, axis=1)[:, :few]
            i, j = np.repeat(np.arange(len(q)), few), j.ravel()
            more = [d[i, j]]
        else:
            i, j, _ = adaptive_scan(lq, lv, left.column("worst").to_numpy(), epsilon=epsilon)
            more = []
        cols = _best(q_ids, v_ids, i, j, np.einsum("ij,ij->i", v[j], q[i]), k, *more)
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=names)
    return run


def usable(vectors: DataFrame) -> DataFrame:
    """Distinct (vec_id, embedding) rows that take part."""
    v = vectors.select("vec_id", "embedding").where("vec_id is not null and size(embedding) > 0")
    # no norm is null, NaN or infinite unless a component is (or the squares overflow)
    v = v.where(F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0))
    common = v.groupBy(F.size("embedding").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return v.where(F.size("embedding") == (common["n"] if common else 0)).dropDuplicates(["vec_id", "embedding"])


def _tiles(asked: DataFrame, indexed: DataFrame):
    """*asked* and *indexed* (both by list) grouped into tiles: a block of a list's queries, a block of its candidates."""
    # one row per list: how many blocks its candidates and its queries make
    size = (indexed.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / CANDIDATES).alias("vs"))
            .join(asked.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / QUERIES).alias("qs")), "list"))
    size = F.broadcast(stage(size, "lists"))  # at most MOST_LISTS rows
    upto = lambda c: F.explode(F.sequence(F.lit(0).cast("long"), F.col(c) - 1))
    right = indexed.join(size, "list").select("list", "vec_id", "embedding", F.pmod(F.xxhash64("vec_id"), "vs").alias("vb"), upto("qs").alias("qb"))
    left = asked.join(size, "list").select(*asked.columns, F.pmod(F.xxhash64("query_id"), "qs").alias("qb"), upto("vs").alias("vb"))
    key = ["list", "vb", "qb"]
    return left.groupBy(*key).cogroup(right.groupBy(*key))


def search(vectors: DataFrame, is_query, k: int = 20, probed: float = PROBED, epsilon: float = EPSILON) -> DataFrame:
    """query_id, rank, vec_id, score: the *k* nearest found of each query row of *vectors* (vec_id, embedding)."""
    v = stage(usable(vectors), "vectors")
    n, norm = v.agg(F.count(F.lit(1)), F.max(F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))))).first()
    if not n:
        return v.select(F.col("vec_id").alias("query_id"), F.lit(1).alias("rank"), "vec_id", F.lit(0.0).alias("score")).limit(0)
    sample = v.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("embedding").toArrow()
    x = _matrix(sample.column("embedding"))
    rot = rotation(x.shape[1] + 1)
    cent = centroids(lift(x, norm, rot), int(np.clip(np.sqrt(n) / 2, 1, MOST_LISTS)))
    probes, kind = int(np.ceil(probed * len(cent))), v.schema["embedding"].dataType.simpleString()
    seeds = min(probes, max(2, int(SEEDS * len(cent))))

    def assign(query: bool, many: int):
        def run(batches):
            for b in batches:
                if b.num_rows:
                    near = nearest(lift(_matrix(b.column("embedding")), norm, rot, query), cent, many)
                    yield pa.RecordBatch.from_arrays([*b.columns, pa.array(near.astype(np.int32).tolist(), pa.list_(pa.int32()))], names=[*b.schema.names, "lists"])
        return run

    indexed = stage(v.mapInArrow(assign(False, 1), f"vec_id long, embedding {kind}, lists array<int>")
                    .select("vec_id", "embedding", F.col("lists")[0].alias("list")), "index")
    asked = stage(v.where(is_query).select(F.col("vec_id").alias("query_id"), "embedding")
                  .mapInArrow(assign(True, probes), f"query_id long, embedding {kind}, lists array<int>"), "queries")
    first = asked.select("query_id", "embedding", F.explode(F.slice("lists", 1, seeds)).alias("list"))
    seen = _tiles(first, indexed).applyInArrow(_scan(norm, k, None), f"{_FOUND}, distance double")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "vec_id"))
    seen = stage(seen.withColumn("place", place).where(F.col("place") <= k), "seen")
    # a query's k-th distance there; any, where they are fewer
    worst = seen.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.max("distance").alias("d"))
    worst = worst.select("query_id", F.when(F.col("n") >= k, F.col("d")).alias("worst"))
    probe = asked.join(worst, "query_id", "left").select("query_id", "embedding", F.coalesce("worst", F.lit(float("inf"))).alias("worst"), F.explode("lists").alias("list"))
    found = _tiles(stage(probe, "probes"), indexed).applyInArrow(_scan(norm, k, epsilon), _FOUND).unionByName(seen.drop("distance", "place"))
    # rows that share an id count once, by their best score
    found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
