"""Best-fit packing by a grouping genetic algorithm, as islands with elite migration.

Documents are cut only beyond the limit.  The pieces are dealt at random to
problems of a few thousand, whatever the input's size; each problem is
evolved on several islands, which are tasks of their own.  An individual is
a grouping of pieces into sequences.  Crossover injects whole well-filled
sequences of one parent into the other, takes out the sequences that share a
piece with them, and best-fits the displaced pieces, longest first.  After
each round every island's elite migrates to the next island.  The best
grouping of a problem stands; sequences left loosely filled are taken apart
and packed again in fewer, mixed problems.

Defined results: a null or empty text is one piece, the end id alone;
repeated rows are packed as often as they came.
"""

from __future__ import annotations

import bisect
import random
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cagetrace.llm.bpe import encoder, vocabulary
from cagetrace.llm.store import only, stage
from cagetrace.llm.words import slices

LIMIT, END = 4096, 1
PROBLEM, ISLANDS, ROUNDS = 2048, 2, 2
POPULATION, OFFSPRING = 4, 8
#: Sequences filled less than this are packed again
LOOSE = 0.97


def cut(docs: DataFrame, tokenizer: str, limit: int = LIMIT, end: int = END) -> DataFrame:
    """Pieces of (doc_id, text): doc_id, piece, start, length, ids_crc32."""
    def run(batches):
        enc = encoder(tokenizer)
        for b in (part for batch in batches for part in slices(batch, "text")):
            rows = []
            for doc_id, ids in zip(b.column("doc_id").to_pylist(), enc.encode_column(b.column("text")).to_pylist()):
                ids = np.append(np.frombuffer(ids, enc.dtype).astype("<u4"), np.array([end], "<u4"))
                rows += [(doc_id, i, i * limit, len(p), zlib.crc32(p.tobytes())) for i, p in enumerate(np.split(ids, range(limit, len(ids), limit)))]
            cols = list(zip(*rows)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))],
                                             names=["doc_id", "piece", "start", "length", "ids_crc32"])
    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


class Packing:
    """A grouping of the pieces 0..n-1: lists of pieces, and the room left in each."""

    def __init__(self, sizes, limit):
        self.sizes, self.limit, self.bins, self.room = sizes, limit, [], []

    def put(self, bin_):
        self.bins.append(bin_)
        self.room.append(self.limit - sum(self.sizes[i] for i in bin_))

    def best_fit(self, pieces) -> None:
        """Each piece into the fullest sequence that takes it, else a new one."""
        order = sorted((r, k) for k, r in enumerate(self.room) if r)
        for i in pieces:
            s = self.sizes[i]
            at = bisect.bisect_left(order, (s, -1))
            if at < len(order):
                r, k = order.pop(at)
                self.bins[k].append(i)
            else:
                k, r = len(self.bins), self.limit
                self.bins.append([i])
                self.room.append(r)
            self.room[k] = r - s
            if r > s:
                bisect.insort(order, (r - s, k))

    def fitness(self) -> float:
        """Mean squared filling: few and full sequences."""
        return sum((1 - r / self.limit) ** 2 for r in self.room) / max(1, len(self.room))

    def genes(self) -> bytes:
        out = np.zeros(len(self.sizes), "<i4")
        for k, b in enumerate(self.bins):
            out[b] = k
        return out.tobytes()


def decode(sizes, limit, genes: bytes) -> Packing:
    p, g = Packing(sizes, limit), np.frombuffer(genes, "<i4")
    order = np.argsort(g, kind="stable")
    for part in np.split(order, np.flatnonzero(np.diff(g[order])) + 1) if len(g) else []:
        p.put(part.tolist())
    return p


def crossover(a: Packing, b: Packing, rng: random.Random) -> Packing:
    full = sorted(range(len(b.bins)), key=lambda k: b.room[k])
    full = full[:max(1, len(full) // 2)]
    inject = [b.bins[k] for k in rng.sample(full, max(1, len(full) // 4))]
    taken = {i for x in inject for i in x}
    child, displaced = Packing(a.sizes, a.limit), []
    loose = {k for k, r in enumerate(a.room) if r > a.limit // 50}
    loose = set(rng.sample(sorted(loose), min(len(loose), 1 + len(a.bins) // 20)))
    for x in inject:
        child.put(list(x))
    for k, x in enumerate(a.bins):
        if k in loose or not taken.isdisjoint(x):
            displaced += [i for i in x if i not in taken]
        else:
            child.put(list(x))
    child.best_fit(sorted(displaced, key=lambda i: -child.sizes[i]))
    return child


def evolve(sizes, limit, genes: list[bytes], rng: random.Random) -> list[Packing]:
    """One round of an island, best first."""
    pop = [decode(sizes, limit, g) for g in genes]
    order = sorted(range(len(sizes)), key=lambda i: -sizes[i])
    while len(pop) < POPULATION:
        p = Packing(sizes, limit)
        p.best_fit(order if not pop else sorted(order, key=lambda i: -sizes[i] * rng.uniform(0.9, 1.1)))
        pop.append(p)
    best = lambda p: (len(p.bins), -p.fitness())
    least = -(-sum(sizes) // limit)
    for _ in range(OFFSPRING):
        pop.sort(key=best)
        del pop[POPULATION:]
        if len(pop[0].bins) <= least:
            break
        x, y = rng.sample(pop, 2) if len(pop) > 1 else (pop[0], pop[0])
        pop.append(crossover(x, y, rng))
    pop.sort(key=best)
    return pop[:POPULATION]


def _round(number: int, limit: int):
    def run(key, pieces: pd.DataFrame, elite: pd.DataFrame) -> pd.DataFrame:
        only("packing")  # the encoder of the texts is not needed any more
        if not len(pieces):
            return pd.DataFrame({"problem": [], "island": [], "bins": [], "fit": [], "genes": []})
        sizes = pieces.sort_values("row")["length"].tolist()
        pop = evolve(sizes, limit, sorted(set(elite["genes"])), random.Random(f"{key[0]}/{key[1]}/{number}"))
        rows = [(key[0], key[1], len(p.bins), p.fitness(), p.genes()) for p in pop]
        # the elite migrates to the next island
        rows.append((key[0], (key[1] + 1) % ISLANDS, *rows[0][2:]))
        return pd.DataFrame(rows, columns=["problem", "island", "bins", "fit", "genes"])
    return run


def _place(limit: int):
    def run(key, pieces: pd.DataFrame, best: pd.DataFrame) -> pd.DataFrame:
        only("packing")
        names = ["row", "bin", "offset", "filled"]
        if not len(pieces):
            return pd.DataFrame({n: [] for n in names})
        pieces = pieces.sort_values("row")
        p = decode(pieces["length"].tolist(), limit, best["genes"].iloc[0])
        ids, rows = pieces["row"].tolist(), []
        for k, (b, room) in enumerate(zip(p.bins, p.room)):
            at = 0
            for i in b:
                rows.append((ids[i], k, at, limit - room))
                at += p.sizes[i]
        return pd.DataFrame(rows, columns=names)
    return run


def _pack(pieces: DataFrame, count: int, level: int, limit: int) -> DataFrame:
    """(row, sequence_id, offset, filled) of *pieces* (row, length)."""
    problems = max(1, -(-count // PROBLEM))
    dealt = pieces.select("row", "length", F.pmod(F.xxhash64(F.col("row") + level), F.lit(problems)).alias("problem"))
    on = dealt.withColumn("island", F.explode(F.array(*[F.lit(i) for i in range(ISLANDS)]))).groupBy("problem", "island")
    schema = "problem long, island int, bins long, fit double, genes binary"
    elite = pieces.sparkSession.createDataFrame([], schema)
    for n in range(ROUNDS):
        elite = stage(on.cogroup(elite.groupBy("problem", "island")).applyInPandas(_round(n, limit), schema), "islands")
    best = elite.groupBy("problem").agg(F.min_by("genes", F.struct("bins", -F.col("fit"), "genes")).alias("genes"))
    placed = dealt.withColumn("p", F.col("problem")).groupBy("p").cogroup(best.withColumn("p", F.col("problem")).groupBy("p")).applyInPandas(
        lambda key, x, y: _place(limit)(key, x, y).assign(problem=key[0]), "row long, bin long, offset long, filled long, problem long")
    return placed.select("row", ((F.lit(level).cast("long") * (1 << 56)) + F.col("problem") * (1 << 20) + F.col("bin")).alias("sequence_id"), "offset", "filled")


def pack(pieces: DataFrame, limit: int = LIMIT, levels: int = 3) -> DataFrame:
    """Adds sequence_id and offset to *pieces* (with ``length``)."""
    pieces = stage(pieces.withColumn("row", F.monotonically_increasing_id()), "pieces")
    todo, done = pieces.select("row", "length"), None
    for level in range(levels):
        count = todo.count()
        placed = stage(_pack(todo, count, level, limit), "placed")
        last = level == levels - 1 or count <= PROBLEM
        tight = placed if last else placed.where(F.col("filled") >= LOOSE * limit)
        done = tight if done is None else done.unionByName(tight)
        if last:
            break
        todo = stage(todo.join(placed.where(F.col("filled") < LOOSE * limit).select("row"), "row", "left_semi"), "loose")
    return pieces.join(done.select("row", "sequence_id", "offset"), "row").drop("row")


def pack_documents(docs: DataFrame, tokenizer: str | None = None, limit: int = LIMIT, end: int = END) -> DataFrame:
    """Pieces of all documents with their place: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    return pack(cut(docs, tokenizer or vocabulary("word_bpe_49k.json"), limit, end), limit)
