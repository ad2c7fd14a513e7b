"""MinHash near-duplicates: one-permutation hashing with optimal densification,
banded buckets, star-shaped candidate edges, exact confirmation.

``near_duplicates`` gives each document the smallest id reachable over links
(Jaccard similarity of word-shingle sets of at least *threshold*).

1. One pass over whole texts hashes the shingles; the top bits of a hash
   choose its bin, the bin's value is its smallest hash; an empty bin copies
   the value of the filled bin that its own sequence of hashes meets first.
2. Documents with equal sets are one class, carried on by its smallest id.
3. Each band of bins is a bucket key.  A bucket links every member to its
   smallest id (a star: as many edges as members).  Edges whose signatures
   differ far beyond chance are dropped, the rest confirmed on full sets.
4. Components of the confirmed links are contracted.  Where a bucket still
   holds several components, members of different components are compared
   too, block by block, by their signatures and then on full sets.  A link
   inside a component can change nothing, so no group is expanded into all its
   pairs.  What can lose a link is chance only: its bands (MISS) and the
   signature filter (SLACK), at the rates given there.

Defined results: a null or wordless text has ``n_shingles`` 0 and is its own
component; a text of fewer words than a shingle has its whole sequence as one
shingle; a row without an id has a null component and is kept; repeated rows
of one id come back as often as they came.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cagetrace.llm import words as W
from cagetrace.llm.store import stage

BINS_LOG2 = 8
#: At most 6 of the 256 bins a band (42 bands): at a similarity of 0.85 all bands miss with a chance of 2e-9, at 0.8 of
#: 3e-6.  Lower thresholds take fewer bins a band, so that the chance stays below MISS
BAND_ROWS, MISS = 6, 5e-6
#: Pairs whose signatures agree less than the threshold by more than this are dropped unseen: of 122,397 simulated
#: pairs at exactly 0.8 (unions of 10 to 300 shingles) none was, the lowest agreement being 0.66; 0.1 dropped 26.
#: Below 0.8 it widens with the standard deviation of the agreement
SLACK = 0.15
#: Members of a block of a bucket
BLOCK = 512
_U = np.uint64


def bands_of(percent: int) -> tuple[int, int]:
    """(bins a band, bands) for links of *percent* or more; ValueError where even single bins would lose too many."""
    for rows in range(BAND_ROWS, 0, -1):
        bands = (1 << BINS_LOG2) // rows
        if (1 - (percent / 100) ** rows) ** bands <= MISS:
            return rows, bands
    raise ValueError(f"links of {percent} % are too weak for {1 << BINS_LOG2} bins")


def least_agreement(percent: int) -> float:
    """Share of equal bins below which a pair is dropped unseen."""
    t = percent / 100
    return t - SLACK * max(1.0, (t * (1 - t)) ** 0.5 / 0.4)


def shingle_hashes(h: np.ndarray, first: np.ndarray, size: int):
    """(hash, row) of every shingle of a slice; a short text is one shingle."""
    row = W.text_of_word(first)
    g = W.grams(h, size)
    ok = row[:len(g)] == row[size - 1:] if len(g) else np.zeros(0, bool)
    count = np.diff(first)
    short = np.flatnonzero((count > 0) & (count < size))
    tails = np.empty(len(short), _U)
    for i, r in enumerate(short):
        tails[i] = W.grams(h[first[r]:first[r + 1]], int(count[r]))[0]
    return np.concatenate([g[ok], tails]), np.concatenate([row[:len(g)][ok], short])


def shingle_sets(batch: pa.RecordBatch, size: int):
    """Per row of a batch: its sorted distinct shingle hashes."""
    for part in W.slices(batch, "text"):
        h, first, _, _ = W.words(*W.text_bytes(part.column("text")), W.NON_SPACE)
        g, row = shingle_hashes(h, first, size)
        order = np.argsort(row, kind="stable")
        g, cuts = g[order], np.searchsorted(row[order], np.arange(part.num_rows + 1))
        yield part, [np.unique(g[cuts[i]:cuts[i + 1]]) for i in range(part.num_rows)]


def _donors(bins: int, tries: int) -> np.ndarray:
    """For every bin the sequence of bins it asks when empty (a fixed pseudo-random table)."""
    x = np.arange(bins * tries, dtype=_U).reshape(tries, bins) * _U(0xA24BAED4963EE407) + _U(0x9FB21C651E98DF25)
    return (W.mix(x) & _U(bins - 1)).astype(np.int64)


_DONORS = _donors(1 << BINS_LOG2, 1 << 11)


def signature(s: np.ndarray) -> np.ndarray:
    """Densified one-permutation signature of a sorted set of hashes."""
    bins = 1 << BINS_LOG2
    b, at = np.unique(s >> _U(64 - BINS_LOG2), return_index=True)
    sig, full = np.zeros(bins, _U), np.zeros(bins, bool)
    sig[b.astype(np.int64)], full[b.astype(np.int64)] = s[at], True
    filled = full.copy()
    empty = np.flatnonzero(~full)
    for ask in _DONORS:
        if not len(empty):
            break
        hit = filled[ask[empty]]
        sig[empty[hit]] = sig[ask[empty[hit]]]
        empty = empty[~hit]
    if len(empty):
        sig[empty] = s[0]
    return sig


def _sketch(size: int, percent: int):
    rows, count = bands_of(percent)
    coef = W._COEF[:rows]
    band_no = W.mix(np.arange(1, count + 1, dtype=_U))

    def run(batches):
        for batch in batches:
            for part, sets in shingle_sets(batch, size):
                key, sigs, bands = [], [], []
                for s in sets:
                    if not len(s):
                        key.append(None), sigs.append(None), bands.append(None)
                        continue
                    sig = signature(s)
                    m = sig[:rows * count].reshape(count, rows)
                    with np.errstate(over="ignore"):
                        bands.append(W.mix((m * np.array(coef, _U)).sum(axis=1, dtype=_U) + band_no).view(np.int64))
                        key.append(int(W.mix(np.array([W.mix(s).sum(dtype=_U) + _U(len(s))], _U)).view(np.int64)[0]))
                    sigs.append((sig & _U(255)).astype(np.uint8).tobytes())
                yield pa.RecordBatch.from_arrays([
                    part.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array(key, pa.int64()),
                    pa.array(sigs, pa.binary()), pa.array(bands, pa.list_(pa.int64()))],
                    names=["doc_id", "n_shingles", "set_key", "sig", "bands"])
    return run


def _agreement(batches):
    for b in batches:
        x = [np.frombuffer(b"".join(b.column(c).to_pylist()), np.uint8).reshape(-1, 1 << BINS_LOG2) for c in ("sig_a", "sig_b")]
        same = (x[0] == x[1]).sum(axis=1) if b.num_rows else np.zeros(0)
        yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b"), pa.array(same / (1 << BINS_LOG2), pa.float64())], names=["a", "b", "agree"])


def _sets_of(size: int):
    def run(batches):
        for batch in batches:
            for part, sets in shingle_sets(batch, size):
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([s.tobytes() for s in sets], pa.binary())], names=["id", "set"])
    return run


def linked(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets have 100 * intersection >= percent * union."""
    both = np.concatenate([x, y])
    both.sort()
    common = int((both[1:] == both[:-1]).sum())
    return common * 100 >= percent * (len(both) - common)


def components(edges: DataFrame) -> DataFrame:
    """(id, root) of every vertex of *edges* (a, b): the smallest reachable id.

    Alternating large and small stars; each round is written to the shared
    folder, only a checksum comes to the driver.
    """
    spark = edges.sparkSession
    cur = stage(edges.select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).distinct(), "cc")
    seen = None
    while True:
        both = cur.unionByName(cur.select(F.col("u").alias("v"), F.col("v").alias("u")))
        least = both.groupBy("v").agg(F.least("v", F.min("u")).alias("m"))
        large = both.join(least, "v").where("u > v").select(F.col("u").alias("v"), F.col("m").alias("u"))
        large = large.unionByName(least.where("m < v").select("v", F.col("m").alias("u"))).where("u < v").distinct()
        least = large.groupBy("v").agg(F.min("u").alias("m"))
        small = large.join(least, "v").where("u <> m").select(F.col("u").alias("v"), F.col("m").alias("u"))
        cur = stage(small.unionByName(least.select("v", F.col("m").alias("u"))).distinct(), "cc")
        # two unreduced sums of hashes: equal for the same edges, and for no others but by a chance of 2**-128
        now = cur.agg(F.count(F.lit(1)), *(F.sum(F.xxhash64(F.lit(k), "v", "u").cast("decimal(38,0)")) for k in (0, 1))).first()
        if now == seen:
            break
        seen = now
    roots = cur.groupBy("v").agg(F.min("u").alias("root"))
    return roots.select(F.col("v").alias("id"), "root").unionByName(roots.select(F.col("root").alias("id"), "root").distinct())


def _likely(pairs: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose signatures agree about as often as the threshold asks."""
    sig = reps.select(F.col("doc_id").alias("id"), "sig", "n_shingles")
    x = (pairs.join(sig.toDF("a", "sig_a", "n_a"), "a").join(sig.toDF("b", "sig_b", "n_b"), "b")
         .where(F.least("n_a", "n_b") >= percent / 100 * F.greatest("n_a", "n_b") - 1e-6)
         .select("a", "b", "sig_a", "sig_b"))
    return x.mapInArrow(_agreement, "a long, b long, agree double").where(F.col("agree") >= least_agreement(percent)).select("a", "b")


def _confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    def run(batches):
        for b in batches:
            x, y = ([np.frombuffer(s, _U) for s in b.column(c).to_pylist()] for c in ("set_a", "set_b"))
            ok = pa.array([linked(p, q, percent) for p, q in zip(x, y)], pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column(c).filter(ok) for c in ("a", "b")], names=["a", "b"])
    x = pairs.join(sets.toDF("a", "set_a"), "a").join(sets.toDF("b", "set_b"), "b").select("a", "b", "set_a", "set_b")
    return x.mapInArrow(run, "a long, b long").distinct()


def _compare(percent: int):
    """Links in a block of a bucket between members that differ in root and share no earlier band."""
    def run(batches):
        for batch in batches:
            out = [[], []]
            for k in range(batch.num_rows):
                g = batch.slice(k, 1).to_pylist()[0]
                m, block = g["m"], np.array([x["block"] for x in g["m"]])
                ids, roots = (np.array([x[c] for x in m], np.int64) for c in ("id", "root"))
                sig = np.frombuffer(b"".join(x["sig"] for x in m), np.uint8).reshape(len(m), -1)
                bands = np.array([x["bands"] for x in m], np.int64)
                sets = [np.frombuffer(x["set"], _U) for x in m]
                here = int((bands[0] == g["bucket"]).argmax())
                for i in range(len(m) - 1):
                    j = np.flatnonzero((roots[i + 1:] != roots[i]) & ((block[i + 1:] != block[i]) | (g["lo"] == g["hi"]))) + i + 1
                    j = j[(sig[j] == sig[i]).mean(axis=1) >= least_agreement(percent)]
                    j = j[(bands[j] == bands[i]).argmax(axis=1) == here]
                    for n in j:
                        if linked(sets[i], sets[n], percent):
                            out[0].append(min(ids[i], ids[n])), out[1].append(max(ids[i], ids[n]))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], names=["a", "b"])
    return run


def _across(labelled: DataFrame, reps: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) of different roots in one bucket of *labelled* (bucket, id, root).

    A bucket is cut into blocks of about BLOCK members (fewer where sets are
    large) and two blocks meet in one task; only confirmed links come out.
    """
    m = labelled.join(reps.select(F.col("doc_id").alias("id"), "n_shingles", "sig", "bands"), "id").join(sets, "id")
    n = labelled.join(reps.select(F.col("doc_id").alias("id"), "n_shingles"), "id").groupBy("bucket").agg(
        F.ceil(F.greatest(F.count(F.lit(1)) / BLOCK, F.sum("n_shingles") / (BLOCK * 512))).alias("blocks"))
    m = (m.drop("n_shingles").join(n, "bucket").withColumn("block", F.pmod(F.xxhash64("id"), "blocks"))
         .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))))
    m = m.groupBy("bucket", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi")).agg(
        F.collect_list(F.struct("id", "root", "block", "sig", "bands", "set")).alias("m"))  # at most two blocks
    return m.where("size(m) > 1").mapInArrow(_compare(percent), "a long, b long")


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of *docs* (doc_id, text).

    Links documents whose distinct *shingle*-word sets have
    100 * intersection >= percent * union.
    """
    docs = docs.select("doc_id", "text")
    sk = stage(docs.mapInArrow(_sketch(shingle, percent), "doc_id long, n_shingles long, set_key long, sig binary, bands array<long>"), "sketch")
    known = sk.where("n_shingles > 0 and doc_id is not null")
    cls = stage(known.groupBy("set_key", "n_shingles").agg(F.min("doc_id").alias("rep"), F.min_by("sig", "doc_id").alias("sig"),
                                                           F.min_by("bands", "doc_id").alias("bands")), "classes")
    reps = cls.select(F.col("rep").alias("doc_id"), "n_shingles", "sig", "bands")
    member = cls.select("rep", F.explode("bands").alias("bucket"))
    many = member.groupBy("bucket").agg(F.min("rep").alias("center"), F.max("rep").alias("last")).where("center < last").select("bucket", "center")
    member = stage(member.join(many, "bucket"), "buckets")
    star = stage(_likely(member.where("rep <> center").select(F.col("center").alias("a"), F.col("rep").alias("b")).distinct(), reps, percent), "star")
    needed = member.select(F.col("rep").alias("doc_id")).distinct()
    sets = stage(docs.join(needed, "doc_id", "left_semi").mapInArrow(_sets_of(shingle), "id long, set binary"), "sets")
    links = stage(_confirm(star, sets, percent), "links")
    comp = stage(components(links), "components")
    # buckets that still hold several components
    labelled = stage(member.select("bucket", F.col("rep").alias("id")).join(comp, "id", "left")
                     .select("bucket", "id", F.coalesce("root", "id").alias("root")), "labelled")
    mixed = labelled.groupBy("bucket").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").select("bucket")
    labelled = stage(labelled.join(mixed, "bucket"), "mixed")
    more = stage(_across(labelled, reps, sets, percent).distinct(), "cross")
    edges = links.unionByName(more)
    # classes hang on their representative; a document of several texts is in several classes
    own = sk.select("doc_id", "n_shingles", "set_key").where("n_shingles > 0 and doc_id is not null").join(cls.select("set_key", "n_shingles", "rep"), ["set_key", "n_shingles"])
    twice = own.where("doc_id <> rep").groupBy("doc_id").agg(F.min("rep").alias("rep"), F.max("rep").alias("last"))
    edges = edges.unionByName(own.join(twice.where("rep <> last").select("doc_id"), "doc_id", "left_semi").where("doc_id <> rep").select(F.col("rep").alias("a"), F.col("doc_id").alias("b")))
    root = stage(components(edges), "roots")
    home = own.groupBy("doc_id").agg(F.min("rep").alias("rep")).join(root.withColumnRenamed("id", "rep"), "rep", "left").select(
        "doc_id", F.coalesce("root", "rep").alias("component"))
    return (sk.select("doc_id", "n_shingles").join(home, "doc_id", "left")
            .select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
            .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))))
