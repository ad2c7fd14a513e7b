"""Benchmark decontamination by winnowing.

Of every window of 13 words the smallest k-gram hash is a fingerprint, on
both sides alike, so any shared span of 13 words shares a fingerprint.  A
bitmap of fixed size drops document fingerprints that no item has; the rest
are joined on the hash.  Each fingerprint carries the hashes of the words
around it, all of the windows that hold it, so a hit is extended and checked
where the join puts it.  Items of fewer than 13 words are one window of
their own length; documents give their n-grams of just those lengths.

Defined results: a null or wordless text has no words and is clean; a null
or wordless item has no window; each row is judged by its own text, whatever
its id, and rows repeat as they came; null item ids are
left out of the item list but their passages still count as hits.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cagetrace.llm import words as W
from cagetrace.llm.store import stage

_U = np.uint64
WINDOW, K = 13, 8
BITMAP_LOG2 = 23


def _fingerprints(h: np.ndarray, first: np.ndarray, window: int, k: int):
    """Word positions (in the slice) and hashes of the chosen k-grams."""
    g = W.grams(h, k)
    w = window - k + 1
    row = W.text_of_word(first)
    if len(g) < w:
        return np.zeros(0, np.int64), g[:0]
    ok = row[:len(h) - window + 1] == row[window - 1:]
    view = np.lib.stride_tricks.sliding_window_view(g, w)[:len(ok)]
    chosen = np.unique((np.arange(len(ok)) + view.argmin(axis=1))[ok])
    return chosen, g[chosen]


def _context(h, row, pos, window, k):
    """Word hashes of [pos - (window-k), pos + window), zero outside the text."""
    idx = pos[:, None] + np.arange(-(window - k), window)[None, :]
    inside = (idx >= 0) & (idx < len(h))
    idx = np.clip(idx, 0, max(0, len(h) - 1))
    inside &= row[idx] == row[pos][:, None]
    return np.where(inside, h[idx], _U(0))


def _scan(id_col: str, window: int, k: int, bits: np.ndarray | None, short: tuple[int, ...]):
    """Rows (id, n_words, marks): a mark has kind (0 or the short length), hash, position, context."""
    mask = _U((1 << BITMAP_LOG2) - 1)

    def passes(g):
        return np.ones(len(g), bool) if bits is None else (bits[(g & mask) >> _U(3)] >> (g & _U(7)).astype(np.uint8)) & 1 > 0

    def run(batches):
        for batch in batches:
            for part in W.slices(batch, "text"):
                h, first, _, _ = W.words(*W.text_bytes(part.column("text")), W.ALNUM)
                row, count = W.text_of_word(first), np.diff(first)
                kinds, hashes, at = [], [], []
                pos, g = _fingerprints(h, first, window, k)
                hit = passes(g)
                kinds.append(np.zeros(hit.sum(), np.int64)), hashes.append(g[hit]), at.append(pos[hit])
                for n in short if bits is not None else range(1, window):
                    g = W.grams(h, n)
                    ok = row[:len(g)] == row[n - 1:n - 1 + len(g)]
                    if bits is None:
                        ok &= count[row[:len(g)]] == n  # an item: one window of its own length
                    g, pos = g[ok], np.flatnonzero(ok)
                    hit = passes(g)
                    kinds.append(np.full(hit.sum(), n)), hashes.append(g[hit]), at.append(pos[hit])
                kinds, hashes, at = map(np.concatenate, (kinds, hashes, at))
                order = np.argsort(at, kind="stable")
                kinds, hashes, at = kinds[order], hashes[order], at[order]
                ctx = _context(h, row, at, window, k) if len(at) else np.zeros((0, 2 * window - k), _U)
                marks = pa.StructArray.from_arrays([
                    pa.array(kinds, pa.int64()), pa.array(hashes.view(np.int64), pa.int64()),
                    pa.array(at - first[row[at]] if len(at) else at, pa.int64()),
                    pa.array([c.tobytes() for c in ctx], pa.binary())], names=["kind", "hash", "pos", "ctx"])
                off = np.searchsorted(row[at] if len(at) else np.zeros(0), np.arange(part.num_rows + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([part.column(id_col), pa.array(count, pa.int64()), pa.ListArray.from_arrays(pa.array(off), marks)],
                                                 names=["id", "n_words", "marks"])
    return run


def _extend(window: int, k: int):
    """Spans [start, end) of document words that an item's windows cover, per joined mark."""
    left = window - k

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            kind = b.column("kind").to_numpy()
            pos = b.column("pos").to_numpy()
            x, y = (np.frombuffer(b"".join(b.column(c).to_pylist()), _U).reshape(b.num_rows, -1) for c in ("ctx", "item_ctx"))
            same = (x == y) & (x != 0)
            before = np.cumprod(same[:, left - 1::-1], axis=1).sum(axis=1) if left else np.zeros(len(x), int)
            after = np.cumprod(same[:, left:], axis=1).sum(axis=1)
            start, end = pos - before, pos + after
            ok = (after >= k) & (end - start >= window)
            s = np.flatnonzero(kind > 0)  # a short item: its words are the first of the context
            exact = np.arange(window)[None, :] < kind[s][:, None]
            start[s], end[s] = pos[s], pos[s] + kind[s]
            ok[s] = (same[s][:, left:] | ~exact).all(axis=1)
            ok = np.flatnonzero(ok)
            yield pa.RecordBatch.from_arrays([b.column("id").take(pa.array(ok)), b.column("item").take(pa.array(ok)),
                                              pa.array(start[ok], pa.int64()), pa.array(end[ok], pa.int64())], names=["id", "item", "start", "end"])
    return run


def _covered(spans: F.Column) -> F.Column:
    """Number of positions in the union of sorted spans (start, end)."""
    step = lambda acc, s: F.struct(
        (acc["n"] + F.greatest(F.lit(0).cast("long"), s["end"] - F.greatest(s["start"], acc["to"]))).alias("n"),
        F.greatest(acc["to"], s["end"]).alias("to"))
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("to"))
    return F.aggregate(F.array_sort(spans), zero, step, lambda acc: acc["n"])


def contaminated_spans(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, k: int = K) -> tuple[DataFrame, DataFrame]:
    """(scanned, spans): every row's (row, id, n_words), and the spans (row, item, start, end) of words it shares."""
    spark = docs.sparkSession
    schema = "id long, n_words long, marks array<struct<kind:long,hash:long,pos:long,ctx:binary>>"
    items = stage(benchmark.select("item_id", "text").mapInArrow(_scan("item_id", window, k, None, ()), schema)
                  .select(F.col("id").alias("item"), F.explode("marks").alias("m")).select("item", "m.*"), "items")
    short = tuple(r[0] for r in items.where("kind > 0").select("kind").distinct().collect())  # at most window - 1 rows
    low = F.col("hash").bitwiseAND((1 << BITMAP_LOG2) - 1)
    words64 = (items.select(F.shiftright(low, 6).alias("w"), F.call_function("shiftleft", F.lit(1).cast("long"), low.bitwiseAND(63).cast("int")).alias("b"))
               .groupBy("w").agg(F.bit_or("b").alias("b")).collect())  # at most 2**17 rows whatever the input
    bits = np.zeros(1 << (BITMAP_LOG2 - 6), np.int64)
    for w, b in words64:
        bits[w] = b
    scanned = docs.select("doc_id", "text").mapInArrow(_scan("doc_id", window, k, bits.view(np.uint8), short), schema)
    # ids may be null or repeated: the stored number of a row tells the rows apart
    scanned = stage(scanned.withColumn("row", F.monotonically_increasing_id()), "scanned")
    marks = scanned.where(F.size("marks") > 0).select("row", F.explode("marks").alias("m")).select(F.col("row").alias("id"), "m.*")
    # equal passages of several items are compared once; the items join afterwards
    passages = stage(items.groupBy("kind", "hash", "ctx").agg(F.min(F.struct(F.col("item").isNull(), "item", "pos")).alias("f"))
                     .select("kind", "hash", F.col("ctx").alias("item_ctx"), F.xxhash64("kind", "hash", "ctx").alias("item")), "passages")
    joined = marks.join(passages, ["kind", "hash"]).select("id", "kind", "pos", "ctx", "item_ctx", "item")
    spans = joined.mapInArrow(_extend(window, k), "id long, item long, start long, end long")
    whose = items.select(F.xxhash64("kind", "hash", "ctx").alias("passage"), F.col("item").alias("item_id")).distinct()
    spans = spans.withColumnRenamed("item", "passage").join(whose, "passage", "left").select(F.col("id").alias("row"), F.col("item_id").alias("item"), "start", "end")
    return scanned.select("row", "id", "n_words"), spans


def _sha(ids: F.Column) -> F.Column:
    return F.sha2(F.concat_ws(",", F.array_sort(F.transform(ids, lambda x: x.cast("string")))), 256)


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, k: int = K, percent: int = 5) -> DataFrame:
    """Per row: doc_id, n_words, n_hit, n_items, items_sha256, contaminated.

    Contaminated: some word is hit, and at least *percent* of the words are.
    """
    scanned, spans = contaminated_spans(docs, benchmark, window, k)
    # equal spans of a row are one; what is left is bounded by its words
    per = (spans.groupBy("row", "start", "end").agg(F.collect_set("item").alias("items"))
           .groupBy("row").agg(_covered(F.collect_list(F.struct("start", "end"))).alias("n_hit"),
                              F.array_distinct(F.flatten(F.collect_set("items"))).alias("items")))
    out = scanned.join(per, "row", "left")
    hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    items = F.coalesce("items", F.array().cast("array<long>"))
    return out.select(F.col("id").alias("doc_id"), "n_words", hit.alias("n_hit"), F.size(items).cast("long").alias("n_items"),
                      _sha(items).alias("items_sha256"), ((hit > 0) & (hit * 100 >= F.col("n_words") * percent)).alias("contaminated"))
