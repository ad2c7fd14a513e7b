"""Line deduplication by an exact set-similarity self-join.

Lines are sets of words (split at white space, A-Z lower-cased).  A line goes
if an earlier line - by document id, then line number - has a Jaccard
similarity of at least *percent* with it, whether or not that one went too.

1. Lines with equal sets are one class.
2. Sizes are cut into levels so that similar sets lie in one level or in two
   next to each other.  In a level at most d words tell similar sets apart.  The
   words are dealt by hash to more than d parts; two similar sets have all but
   d parts in common, so that of either's parts, strongest first (most bytes of
   words), the first d + 1 hold one that both have.  These are the signatures.
   Where d is 1, a set must be another less one word: the signatures are the
   set itself and the set less each of its words.
3. Signatures are dealt to buckets; a bucket's task brings equal ones together.
   Each class is first compared with the earliest class of its signatures;
   classes that match are settled, which dissolves large groups of variants
   without pairing them up.  The others are compared with the _CLOSEST earlier
   classes by map under each signature, and with all of them if there are more
   and none of these is similar.  A map of the parity of 64 word hashes (256
   later) bounds the words that differ from below; pairs that pass are verified
   on full sets.

Defined results: lines of fewer than *least* distinct words are never
removed and remove none (the query and the pipeline take EVERY line with a
word); lines without a word stay; null texts stay null, without lines; rows repeated
with one id and text are one document, unless a column numbers the rows, which
makes each a document of its own; rows without an id come last in order.
"""

from __future__ import annotations

import functools
import operator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from cagetrace.llm import words as W
from cagetrace.llm.near_dup import linked
from cagetrace.llm.store import drop, stage

_U = np.uint64
PERCENT, LEAST = 80, 5
#: The *least* with which every line that has a word takes part
EVERY = 1
#: Buckets of signatures: one is held by a task at a time, 26 bytes a signature
BUCKETS_LOG2 = 13
#: The postings are joined in so many parts by signature, so that only one part's shuffle files are on disk
PARTS = 1
#: Classes under one signature that are compared by their maps where they are; more are joined
_NEAR, _FEW = 4096, 48
#: Earlier classes under a signature, nearest first by map, that a class is compared with before it is with all
_CLOSEST = 4
_FLUSH = 1 << 16
#: Low bits of the signature (the bucket has the rest), class, place, word parities, size up to _MOST and kind (_ONE: d is 1, _WHOLE: the set itself)
_ENTRY = np.dtype([("s", "<u4"), ("k", "<i8"), ("o", "<f4"), ("m", "<u8"), ("n", "<u2")])
_WHOLE, _ONE, _MOST = 1 << 15, 1 << 14, (1 << 14) - 1
#: A class's first line in a slice, with its size and its word parities in four maps; they go through the same shuffle, in buckets below zero by class
_LINE = np.dtype([("rid", "<i8"), ("ord", "<i8"), ("line", "<i4"), ("key", "<i8"), ("n", "<i4"), *((f"m{i}", "<i8") for i in range(4))])
_LINE_BUCKETS = 1024
_SHARED = "sig long, key long, lead long, star boolean, rest boolean, rid long, ord long, line int, n int, m0 long, m1 long, m2 long, m3 long"
_WORD = r"[^\x20\x09-\x0D]"


def line_sets(part: pa.RecordBatch):
    """(token hashes, line of each, row of each line, number of each line, bytes of each): distinct words per line of a slice."""
    data, off = W.text_bytes(part.column("text"))
    h, _, st, en = W.words(data, off, W.NON_SPACE)
    nl = np.flatnonzero(data == 10)
    row = np.concatenate([np.arange(part.num_rows), np.searchsorted(off, nl, side="right") - 1])
    start = np.concatenate([off[:-1], nl + 1])
    order = np.lexsort((start, row))
    row, start = row[order], start[order]
    number = np.arange(len(row)) - np.searchsorted(row, row)
    # words are in order of place, so a line's words lie between the starts of it and the next line
    line = np.repeat(np.arange(len(start)), np.diff(np.searchsorted(st, np.append(start, len(data)))))
    by = _by_line(h, line)
    h, line = h[by], line[by]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (line[1:] != line[:-1])
    return h[new], line[new], row, number, (en - st)[by[new]]


def _by_line(h: np.ndarray, line: np.ndarray) -> np.ndarray:
    """The order of words by line, then hash: one sort of both in 64 bits, two only where the cut hashes of a line tie."""
    bits = _U(max(1, int(line[-1]).bit_length() if len(line) else 1))
    key = (line.astype(_U) << (_U(64) - bits)) | (h >> bits)
    by = np.argsort(key)
    tie = np.flatnonzero(key[by[1:]] == key[by[:-1]])
    return np.lexsort((h, line)) if (h[by[tie]] != h[by[tie + 1]]).any() else by


@functools.cache
def _levels(percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(least size, greatest size, most words that differ) of each level."""
    low, high = [1], []
    while low[-1] < 1 << 31:
        high.append(100 * low[-1] // percent)
        if low[-1] >= 8:  # wider ones: more sets lie in one level only
            high[-1] = max(high[-1], 100 * high[-1] // percent, low[-1] * 65 // 64)
        low.append(high[-1] + 1)
    most = [_apart(2 * low[max(0, i - 1)], 2 * h, percent) for i, h in enumerate(high)]
    return np.array(low[:-1]), np.array(high), np.array(most)


def _apart(a: int, b: int, percent: int) -> int:
    """The most words in just one of two similar sets of *a* to *b* words together."""
    both = np.arange(max(a, b - 99 - percent), b + 1)  # it grows from one such span to the next
    return int((both + 2 * (-percent * both // (100 + percent))).max(initial=-1))


@functools.cache
def _budget(n: int, level: int, percent: int) -> int:
    """The most words that differ between a set of *n* and a similar one of a size in *level* (or in its own, if that is lower)."""
    low, high, _ = _levels(percent)
    own = int(np.searchsorted(low, n, side="right")) - 1
    first = int(low[level if level > own else max(0, level - 1)])
    return _apart(n + max(first, -(-percent * n // 100)), n + min(int(high[level]), 100 * n // percent), percent)


def _parts(h: np.ndarray, line: np.ndarray, size: np.ndarray, weight: np.ndarray, shift: int, percent: int):
    """(signature, its line, its kind) of every line, in the level of its size (*shift* 0) or the next (1)."""
    low, high, most = _levels(percent)
    level = np.minimum(np.searchsorted(low, np.maximum(size, 1), side="right") - 1 + shift, len(low) - 1)
    sizes, at = np.unique(size, return_inverse=True)
    budget = np.array([_budget(int(n), int(np.searchsorted(low, n, side="right")) - 1 + shift, percent) if n else -1 for n in sizes])[at]
    most = most[level]
    # one word more or less: the whole set, and the set less each word
    one = (budget >= 1) & (most == 1)
    with np.errstate(over="ignore"):
        w = one[line]
        total = np.zeros(len(size), _U)
        np.add.at(total, line[w], W.mix(h[w]))
        salt = W.mix(level.astype(_U) + _U(1))
        ones = np.flatnonzero(one)
        found = [(W.mix(total[ones] + salt[ones]), ones, np.full(len(ones), _ONE | _WHOLE)),
                 (W.mix(total[line[w]] - W.mix(h[w]) + salt[line[w]]), line[w], np.full(int(w.sum()), _ONE))]
        many = (budget >= 1) & (most > 1)
        lines = np.flatnonzero(many)
        k = (most + 1 + np.maximum(1, (most + 1) // 4))[lines]
        first = np.zeros(len(size), np.int64)
        first[lines] = np.cumsum(k) - k
        w = many[line]
        lw = line[w]
        hw = W.mix(h[w] ^ salt[lw])
        pieces = np.zeros(len(size), _U)
        pieces[lines] = k.astype(_U)
        cell = first[lw] + (((hw >> _U(32)) * pieces[lw]) >> _U(32)).astype(np.int64)
        token = np.zeros(int(k.sum()), _U)
        np.add.at(token, cell, hw)
        strong = np.minimum(np.bincount(cell, weight[w], minlength=len(token)), 255).astype(_U)
        of = np.repeat(lines, k)
        place = (np.arange(len(token)) - first[of]).astype(_U)
        # the strongest first, then by hash: an order of parts that all lines share
        token = ((_U(255) - strong) << _U(56)) | (W.mix(token + W.mix(salt[of] + place)) >> _U(8))
        by = np.lexsort((token, of))
        use = by[place <= budget[of]]  # the places of a line's parts in its own order
        found.append((W.mix(token[use]), of[use], np.zeros(len(use), np.int64)))
    return [np.concatenate(c) for c in zip(*found)]


def _packed(bucket: np.ndarray, entries: np.ndarray) -> pa.RecordBatch:
    """A row per bucket of *entries*, which are in its order."""
    there, start = np.unique(bucket, return_index=True)
    off = (np.append(start, len(entries)) * entries.itemsize).astype(np.int32)
    blob = pa.Array.from_buffers(pa.binary(), len(there), [None, pa.py_buffer(off.tobytes()), pa.py_buffer(entries.tobytes())])
    return pa.RecordBatch.from_arrays([pa.array(there, pa.int32()), blob], names=["bucket", "entries"])


def _firsts(lines: np.ndarray):
    """(first line of each class, later lines of theirs); a repeated row's line is the same line."""
    lines = lines[np.lexsort((lines["line"], lines["rid"], lines["ord"], lines["key"]))]
    new = np.append(True, lines["key"][1:] != lines["key"][:-1])
    first = np.flatnonzero(new)
    of = first[np.cumsum(new) - 1]
    later = (lines["ord"] != lines["ord"][of]) | (lines["rid"] != lines["rid"][of]) | (lines["line"] != lines["line"][of])
    return lines[first], lines[later]


def _signatures(percent: int, least: int):
    """The signatures of the classes of a slice, packed by bucket, and its lines: the first of each class by class, those that go for it as they are."""
    def run(batches):
        for batch in batches:
            for part in W.slices(batch, "text"):
                h, line, row, number, weight = line_sets(part)
                size, key = _classes(h, line, len(row))
                place = part.column("ord").to_numpy()[row].astype(np.float32)
                rows = np.flatnonzero(size >= least)
                b = (W.mix(h) >> _U(56)).astype(np.int64)
                maps = np.zeros(4 * len(row), _U)
                np.bitwise_xor.at(maps, 4 * line + (b >> 6), _U(1) << (b & 63).astype(_U))
                maps = maps.reshape(-1, 4)
                lines = np.empty(len(rows), _LINE)
                lines["rid"], lines["ord"] = (part.column(c).to_numpy()[row[rows]] for c in ("rid", "ord"))
                lines["line"], lines["key"], lines["n"] = number[rows], key[rows], size[rows]
                for i in range(4):
                    lines[f"m{i}"] = maps[rows, i].view(np.int64)
                rows = rows[np.argsort(place[rows], kind="stable")]
                rows = rows[np.unique(key[rows], return_index=True)[1]]
                own = np.zeros(len(row), bool)
                own[rows] = True
                size = np.where(own, size, 0)
                w = own[line]
                h, line, weight = h[w], line[w], weight[w]
                odd = np.bitwise_xor.reduce(maps, axis=1)
                sig, of, kind = (np.concatenate(c) for c in zip(*(_parts(h, line, size, weight, shift, percent) for shift in (0, 1))))
                by = np.argsort(sig)
                sig, of, kind = sig[by], of[by], kind[by]
                out = np.empty(len(sig), _ENTRY)
                out["s"], out["k"], out["o"], out["m"] = sig & _U(0xFFFFFFFF), key[of], place[of], odd[of]
                out["n"] = np.minimum(size[of], _MOST) | kind
                yield _packed((sig >> _U(64 - BUCKETS_LOG2)).astype(np.int32), out)
                if not len(lines):
                    continue
                lines, later = _firsts(lines)
                bucket = (-1 - lines["key"] % _LINE_BUCKETS).astype(np.int32)
                by = np.argsort(bucket, kind="stable")
                yield _packed(bucket[by], lines[by])
                if len(later):
                    later["n"] = 0
                    yield _packed(np.full(len(later), -1 - int(lines["key"][0]) % _LINE_BUCKETS, np.int32), later)
    return run


def _batch(rows: int, **columns) -> pa.RecordBatch:
    """Columns of _SHARED; null where not given."""
    kinds = {"long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_()}
    names = [c.split() for c in _SHARED.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(columns[n]), kinds[k]) if n in columns else pa.nulls(rows, kinds[k]) for n, k in names], names=[n for n, _ in names])


def _shared(percent: int):
    """Of rows in order of bucket: the first line of each class, the others without their key, and classes that share a signature, and whether one is to be compared with the earliest of them, or with others."""
    def told(held):
        lines = np.frombuffer(b"".join(held), _LINE)
        gone = lines["n"] == 0
        first, later = _firsts(lines[~gone])
        later = np.concatenate([later, lines[gone]])
        yield _batch(len(first), **{c: first[c] for c in _LINE.names})
        if len(later):
            yield _batch(len(later), rid=later["rid"], line=later["line"])

    def found(bucket, held):
        if bucket < 0:
            return pa.Table.from_batches(list(told(held))).combine_chunks().to_batches()[0]
        e = np.frombuffer(b"".join(held), _ENTRY)
        s = np.ascontiguousarray(e["s"])
        by = np.argsort(s)
        s = s[by]
        same = s[1:] == s[:-1]
        e = e[by[np.append(same, False) | np.append(False, same)]]
        if not len(e):
            return None
        # a class comes once, from its earliest place
        e = e[np.lexsort((e["o"], e["k"], e["n"] < _WHOLE, e["s"]))]
        e = e[np.append(True, (e["s"][1:] != e["s"][:-1]) | (e["k"][1:] != e["k"][:-1]) | (e["n"][1:] != e["n"][:-1]))]
        e = e[np.lexsort((e["k"], e["o"], e["n"] < _WHOLE, e["s"]))]
        start = np.flatnonzero(np.append(True, e["s"][1:] != e["s"][:-1]))
        count = np.diff(np.append(start, len(e)))
        lead, end = np.repeat(start, count), np.repeat(start + count, count)
        n, odd, i = (e["n"] & _MOST).astype(np.int64), e["m"].copy(), np.arange(len(e))
        whole, one = e["n"] >= _WHOLE, (e["n"] & _ONE) > 0

        def near(x, y):
            both = n[x] + n[y]
            allowed = (np.bitwise_count(odd[x] ^ odd[y]) <= both + 2 * (-percent * both // (100 + percent))) & (np.minimum(n[x], n[y]) * 100 >= percent * np.maximum(n[x], n[y]))
            return allowed | (n[x] >= _MOST) | (n[y] >= _MOST)
        star = (i > lead) & near(i, lead) & (~one | (whole[lead] & ~whole))
        rest = (i > lead) & ~one & (end - lead > 2)
        size = end - lead
        x = i[rest & (size <= _FEW)]
        some = np.flatnonzero(rest & (size > _FEW) & (size <= _NEAR) & (i == lead + 1))
        rest &= size > _NEAR
        for step in range(1, _FEW):
            x = x[x + step < end[x]]
            if not len(x):
                break
            ok = x[near(x, x + step)]
            rest[ok] = rest[ok + step] = True
        for first in some.tolist():
            y = np.arange(first, end[first])
            for block in np.array_split(y, 1 + len(y) // 512):
                ok = near(block[:, None], y[None, :])
                ok[np.arange(len(block)), block - first] = False
                rest[block] |= ok.any(axis=1)
        use = star | rest
        sig = (np.int64(bucket) << np.int64(32)) | e["s"].astype(np.int64)
        return _batch(int(use.sum()), sig=sig[use], key=e["k"][use], lead=e["k"][lead][use], star=star[use], rest=rest[use])

    def run(batches):
        held, now, out, size = [], None, [], 0
        for batch in batches:
            for bucket, entries in zip(batch.column("bucket").to_pylist(), batch.column("entries").to_pylist()):
                if bucket != now and held:
                    out.append(found(now, held))
                    held, size = [], size + (len(out[-1]) if out[-1] else 0)
                    if size >= _FLUSH:
                        yield pa.Table.from_batches([b for b in out if b]).combine_chunks().to_batches()[0]
                        out, size = [], 0
                now = bucket
                held.append(entries)
        out = [b for b in [*out, found(now, held) if held else None] if b]
        if size or out:
            yield pa.Table.from_batches(out).combine_chunks().to_batches()[0]
    return run


def _classes(h: np.ndarray, line: np.ndarray, lines: int):
    """(size, key) of each line's word set."""
    size = np.bincount(line, minlength=lines)
    with np.errstate(over="ignore"):
        total = np.zeros(lines, _U)
        np.add.at(total, line, W.mix(h))
        return size, W.mix(total + size.astype(_U)).view(np.int64)


def _sets(batches):
    """The word sets of the lines whose classes are wanted of a document."""
    for batch in batches:
        for part in W.slices(batch, "text"):
            h, line, row, _, _ = line_sets(part)
            _, key = _classes(h, line, len(row))
            cuts = np.searchsorted(line, np.arange(len(row) + 1))
            wanted = [set(ws) for ws in part.column("wanted").to_pylist()]
            found = {k: i for i, (r, k) in enumerate(zip(row.tolist(), key.tolist())) if k in wanted[r]}
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int64()), pa.array([h[cuts[i]:cuts[i + 1]].tobytes() for i in found.values()], pa.binary())], names=["c", "set"])


def _near(percent: int) -> F.Column:
    """Whether the sizes and maps of x and y allow the similarity."""
    both = F.col("x.n") + F.col("y.n")
    apart = functools.reduce(operator.add, (F.bit_count(F.col(f"x.m{i}").bitwiseXOR(F.col(f"y.m{i}"))) for i in range(4)))
    return (F.least("x.n", "y.n") * 100 >= F.greatest("x.n", "y.n") * percent) & (apart <= both - 2 * F.ceil(both * percent / (100 + percent) - 1e-9))


def _place(x: str) -> F.Column:
    """The place of a class's first line."""
    return F.struct(f"{x}.ord", f"{x}.rid", f"{x}.line")


def _pairs(met: DataFrame) -> DataFrame:
    """(c, other) of the classes x and y of *met*, the later one first, and where their lines are."""
    later = _place("x") > _place("y")
    a, b = (F.when(later, F.struct(f"{x}.key", f"{x}.rid", f"{x}.line")).otherwise(F.struct(f"{y}.key", f"{y}.rid", f"{y}.line")) for x, y in ("xy", "yx"))
    return met.select(a.alias("a"), b.alias("b")).select(F.col("a.key").alias("c"), F.col("b.key").alias("other"), "a.rid", "a.line", F.col("b.rid").alias("there"))


def _closest(percent: int):
    """Of postings in order of signature and place: each open class with the nearest earlier ones by map, and whether there are more."""
    names = ["key", "rid", "line", "n", "m0", "m1", "m2", "m3", "sig", "open"]

    def near(t, x, y):
        both = t["n"][x] + t["n"][y]
        apart = np.bitwise_count(t["m0"][x] ^ t["m0"][y]).astype(np.int64)
        for m in ("m1", "m2", "m3"):
            apart += np.bitwise_count(t[m][x] ^ t[m][y])
        small, great = np.minimum(t["n"][x], t["n"][y]), np.maximum(t["n"][x], t["n"][y])
        return apart, (apart <= both + 2 * (-percent * both // (100 + percent))) & (small * 100 >= great * percent)

    def found(t, old, cut):
        """Pairs of the rows from *old* on, which follow on *cut* rows of the first signature that are not held any more."""
        total = len(t["sig"])
        i = np.arange(total)
        start = np.flatnonzero(np.append(True, t["sig"][1:] != t["sig"][:-1]))
        count = np.diff(np.append(start, total))
        start, count = np.repeat(start, count), np.repeat(count, count)
        xs, ys, ds = [], [], []
        x = i[t["open"] & (i >= old) & (count <= _FEW)]
        for step in range(1, _FEW):
            x = x[x - step >= start[x]]
            if not len(x):
                break
            d, ok = near(t, x, x - step)
            xs.append(x[ok]), ys.append(x[ok] - step), ds.append(d[ok])
        x = i[t["open"] & (i >= old) & (count > _FEW)]
        at = 0
        while at < len(x):
            block = x[at:at + 256]
            block = block[start[block] == start[block[0]]]
            at += len(block)
            y = np.arange(max(start[block[0]], block[0] - _NEAR), block[-1])
            d, ok = near(t, block[:, None], y[None, :])
            r, c = np.nonzero(ok & (y[None, :] < block[:, None]) & (block[:, None] - y[None, :] <= _NEAR))
            xs.append(block[r]), ys.append(y[c]), ds.append(d[r, c])
        passed = t["open"] & (i >= old) & (i - start + np.where(start == 0, cut, 0) > _NEAR)
        x, y, d = (np.concatenate([*p, i[:0]]) for p in (xs, ys, ds))
        by = np.lexsort((y, d, x))
        x, y = x[by], y[by]
        rank = np.arange(len(x)) - np.searchsorted(x, x)
        more = np.bincount(x, minlength=total) > _CLOSEST
        more |= passed
        use = rank < _CLOSEST
        x, y = x[use], y[use]
        alone = np.setdiff1d(i[passed], x)
        other, there = (pa.concat_arrays([pa.array(t[k][y], pa.int64()), pa.nulls(len(alone), pa.int64())]) for k in ("key", "rid"))
        x = np.append(x, alone)
        return pa.RecordBatch.from_arrays([pa.array(t["key"][x], pa.int64()), other, pa.array(t["rid"][x], pa.int64()), pa.array(t["line"][x], pa.int32()), there, pa.array(more[x])],
                                          names=["c", "other", "rid", "line", "there", "more"])

    def run(batches):
        held, cut = None, 0
        for b in batches:
            t = {k: b.column(k).to_numpy(zero_copy_only=False) for k in names}
            for k in names[4:8]:
                t[k] = t[k].view(_U)
            t["n"] = t["n"].astype(np.int64)
            if not len(t["sig"]):
                continue
            old = 0
            if held and held["sig"][-1] == t["sig"][0]:
                old = len(held["sig"])
                t = {k: np.concatenate([held[k], t[k]]) for k in names}
            else:
                cut = 0
            out = found(t, old, cut)
            if out.num_rows:
                yield out
            last = int(np.searchsorted(-(t["sig"] != t["sig"][-1]).astype(np.int8), 0))
            keep = max(last, len(t["sig"]) - _NEAR)
            cut = keep - last + (cut if last == 0 else 0)
            held = {k: v[keep:] for k, v in t.items()}
    return run


def _verified(pairs: DataFrame, docs: DataFrame, percent: int) -> DataFrame:
    """The later classes of *pairs* (c, other, and where their lines are) that are similar to the earlier one, with their first lines; stored."""
    def run(batches):
        for b in batches:
            ok = [linked(np.frombuffer(x, _U), np.frombuffer(y, _U), percent) for x, y in zip(b.column("set_a").to_pylist(), b.column("set_b").to_pylist())]
            yield b.select(["c", "rid", "line"]).filter(pa.array(ok, pa.bool_()))
    needed = pairs.select("c", "rid").unionByName(pairs.select(F.col("other").alias("c"), F.col("there").alias("rid")))
    wanted = needed.groupBy("rid").agg(F.collect_set("c").alias("wanted"))
    sets = docs.join(wanted, "rid").select("text", "wanted").mapInArrow(_sets, "c long, set binary")
    sets = stage(sets.groupBy("c").agg(F.any_value("set").alias("set")), "linesets")
    x = pairs.select("c", "other", "rid", "line").join(sets.toDF("c", "set_a"), "c").join(sets.toDF("other", "set_b"), "other")
    out = stage(x.select("c", "rid", "line", "set_a", "set_b").mapInArrow(run, "c long, rid long, line int").distinct(), "similar")
    drop(docs.sparkSession, sets)
    return out


def _identity(row: str | None) -> F.Column:
    """What tells documents apart: the number of the row, or its id and text."""
    return F.col(row) if row else F.xxhash64("doc_id", "text")


def _rows(docs: DataFrame, row: str | None) -> DataFrame:
    """Adds rid, the identity of a document, and ord, its place in order."""
    return docs.select(_identity(row).alias("rid"), F.coalesce("doc_id", F.lit(2**63 - 1)).alias("ord"), "text")


def removed_lines(docs: DataFrame, percent: int = PERCENT, least: int = LEAST, row: str | None = None) -> DataFrame:
    """(rid, gone) for each row of *docs* (doc_id, text) that loses lines: their numbers; stored, with nothing else left on disk."""
    rows, spark = _rows(docs, row), docs.sparkSession
    packed = rows.mapInArrow(_signatures(percent, least), "bucket int, entries binary")
    held = stage(packed.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_shared(percent), _SHARED), "shared")
    drop(spark)
    lines, shared = held.where("line is not null"), held.where("line is null")
    facts = lines.where("key is not null").select("key", "ord", "rid", "line", "n", *(f"m{i}" for i in range(4)))
    early = shared.where("star").select("key", "lead").distinct().alias("p").join(facts.alias("x"), F.col("p.key") == F.col("x.key"))
    early = early.join(facts.alias("y"), F.col("p.lead") == F.col("y.key")).where(_near(percent))
    likely = stage(_pairs(early).distinct(), "likely")
    settled = _verified(likely, rows, percent)
    drop(spark, likely)
    # a signature's earliest class has met all the others by now: what is left are the others among themselves
    postings, pairs = [], []
    for part in range(PARTS):
        some = shared.where("rest").where(F.pmod(F.col("sig"), F.lit(PARTS)) == part)
        some = some.select("sig", "key").join(facts, "key").join(settled.select(F.col("c").alias("key"), F.lit(False).alias("open")), "key", "left")
        some = stage(some.withColumn("open", F.coalesce("open", F.lit(True))), "postings")
        rest = some.repartition("sig").sortWithinPartitions("sig", "ord", "rid", "line").mapInArrow(_closest(percent), "c long, other long, rid long, line int, there long, more boolean")
        pairs.append(stage(rest.distinct(), "rest"))
        postings.append(some)
        drop(spark)
    likely = functools.reduce(DataFrame.unionByName, pairs)
    near = stage(likely.where("other is not null").drop("more").distinct(), "likely")
    closest = _verified(near, rows, percent)
    similar = [settled, closest]
    # those with more that are similar to none of the nearest
    left = stage(likely.where("more").select("c").distinct().join(closest, "c", "left_anti"), "left")
    met = []
    if not left.isEmpty():
        for some in postings:
            x, y = some.join(left.select(F.col("c").alias("key")), "key", "left_semi").alias("x"), some.alias("y")
            met.append(stage(_pairs(x.join(y, (F.col("x.sig") == F.col("y.sig")) & (_place("y") < _place("x")) & _near(percent))).distinct(), "met"))
            drop(spark)
        similar.append(_verified(functools.reduce(DataFrame.unionByName, met).distinct(), rows, percent))
    drop(spark, near, left, *postings, *pairs, *met)
    # lines that are not their class's first, and first ones of classes with a similar earlier one
    gone = functools.reduce(DataFrame.unionByName, [x.select("rid", "line") for x in (lines.where("key is null"), *similar)])
    gone = stage(gone.groupBy("rid").agg(F.sort_array(F.collect_set("line")).alias("gone")), "gone")
    drop(spark, held, *similar)
    return gone


def _left(text: pd.Series, gone: pd.Series) -> pd.Series:
    out = []
    for t, g in zip(text, gone):
        if t is not None and g is not None and len(g):
            g = set(g.tolist() if hasattr(g, "tolist") else g)
            t = "\n".join(x for i, x in enumerate(t.split("\n")) if i not in g)
        out.append(t)
    return pd.Series(out, dtype=object)


#: Declared not deterministic so that a filter on what it leaves does not run it a second time, with workers of its own
_without = F.pandas_udf(_left, StringType()).asNondeterministic()


def dedup_lines(docs: DataFrame, percent: int = PERCENT, least: int = LEAST, removed: str = "lines_removed", emptied: str = "emptied",
                row: str | None = None) -> DataFrame:
    """*docs* with later matching lines taken out of ``text``.

    Adds two columns under the names given: the number of lines removed, and
    whether every line with a word in it, however short, matches an earlier
    one.  *row* names a column of stored, distinct longs by which rows repeated
    with one id and text are documents of their own, in the order of those
    numbers.
    """
    of = docs.select("doc_id", "text", *([row] if row else []))
    gone = removed_lines(of, percent, least, row).toDF("__rid", "__gone")
    out = docs.withColumn("__rid", _identity(row)).join(gone, "__rid", "left").withColumn("__left", _without("text", "__gone"))
    left = "__left"
    if least > EVERY:  # the lines that *least* spares may be repeats too
        again = removed_lines(of, percent, EVERY, row).toDF("__rid", "__again")
        out, left = out.join(again, "__rid", "left").withColumn("__new", _without("text", "__again")), "__new"
    none = F.col("text").rlike(_WORD) & ~F.col(left).rlike(_WORD)
    out = out.withColumns({removed: F.coalesce(F.size("__gone"), F.lit(0)), emptied: F.coalesce(none, F.lit(False)), "text": F.col("__left")})
    return out.drop("__rid", "__gone", "__left", "__again", "__new")


def line_report(docs: DataFrame, percent: int = PERCENT, least: int = EVERY) -> DataFrame:
    """Per row: doc_id, n_lines, n_removed, and length and digest of what is left."""
    text = F.coalesce("text", F.lit(""))
    lines = F.when(F.col("text").isNull(), 0).otherwise(F.size(F.split("text", "\n"))).cast("long").alias("n_lines")
    out = dedup_lines(docs.select("doc_id", "text", lines), percent, least)
    return out.select("doc_id", "n_lines", F.col("lines_removed").cast("long").alias("n_removed"), F.length(text).cast("long").alias("kept_chars"), F.sha2(text, 256).alias("kept_sha256"))
