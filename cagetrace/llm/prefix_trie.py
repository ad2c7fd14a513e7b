"""The trie of conversation prefixes: which turns many conversations share.

A turn is known by a digest of its role and text, so texts never travel.  A
conversation is one row, the digests of its turns in order; equal conversations
become one row with the number, the smallest and a checksum of their ids.  These
rows are dealt to shards by ranges of the sequence, so everything below a node
lies in neighbouring shards, and a hot first turn is split by the turns after it.

A shard encodes its digests as dense ids and builds a ternary search tree: a
node has a turn id, links to smaller and larger ids at its depth, and one to the
turns that follow it.  Sequences are inserted median first, so that the links of
one depth form balanced trees.  An iterative walk lists the trie's nodes, parents
before children, and adds up members, leaves and savings from the last node back.
Only prefixes of a shard's first or last sequence can be in other shards too;
these boundary nodes, two for each depth of a shard at most, are merged in one
pass over the shards in order.  Children of a boundary node get its smallest
member by a join on the shard.

Defined results: rows without a conv_id belong to no conversation; null turn
comes first, null role and text are empty; equal turns of a conversation are
ordered by the digest of role and text, and repeated rows are turns of their
own; long texts count in full; an empty table has no nodes, not even a root;
other columns are not read.  A conversation, 28 bytes a turn, must fit a row.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cagetrace.llm.store import stage

#: Characters of a turn's digest: 120 bits of SHA-256 in base 64.
WIDTH = 20
#: Turns of a shard, and ids of a block of equal conversations.
SHARD_TURNS, BLOCK = 200_000, 512
NODE = ("conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string")
_EDGE = "array<struct<depth:long,key:string,words:long,n:long,first:long,ends:string,children:long,leaves:long,saved:long>>"
_NO_ENDS = hashlib.sha256(b"").hexdigest()


# ------------------------------------------------------------ conversations
def conversations(rows: DataFrame) -> DataFrame:
    """(conv_id, turns): each conversation's turns (key, words) in order, for *rows* (conv_id, turn, role, text)."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256))
    key = F.base64(F.substring(digest, 1, WIDTH * 6 // 8))
    n = F.size(F.regexp_extract_all(text, F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)))
    turns = rows.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.struct("turn", key.alias("key"), n.alias("words")).alias("t"))
    return turns.groupBy("conv_id").agg(F.transform(F.sort_array(F.collect_list("t")), lambda t: F.struct(t["key"].alias("key"), t["words"].alias("words"))).alias("turns"))


def with_heads(convs: DataFrame, family: int = 20, most: int = 4) -> DataFrame:
    """*convs* rebuilt: the first h turns of conversation ``c - c % family``, then c's own turns after its first h.

    h is the unsigned crc32 of the decimal id modulo *most*; ``%`` keeps the
    sign of c.  A head has under *most* turns and goes to under twice *family*
    conversations.
    """
    convs = stage(convs, "conversations")
    heads = convs.where(F.col("conv_id") % family == 0).select(F.col("conv_id").alias("base"), F.slice("turns", 1, most - 1).alias("head"))
    c = convs.select("conv_id", "turns", (F.col("conv_id") - F.col("conv_id") % family).alias("base"),
                     (F.crc32(F.col("conv_id").cast("string")) % most).cast("int").alias("h")).join(heads, "base", "left")
    empty = F.slice("turns", 1, 0)
    head = F.when(F.col("head").isNull(), empty).otherwise(F.slice("head", F.lit(1), F.col("h")))
    return c.select("conv_id", F.concat(head, F.slice("turns", F.col("h") + 1, F.size("turns"))).alias("turns"))


def _digests(batches):
    """One row per sequence from its blocks of ids in order: (seq, words, n, first, ends)."""
    at, row, sha = None, None, None
    out: list[tuple] = []

    def batch():
        cols = list(zip(*out)) if out else [[]] * 5
        kinds = (pa.string(), pa.list_(pa.int32()), pa.int64(), pa.int64(), pa.string())
        b = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["seq", "words", "n", "first", "ends"])
        out.clear()
        return b
    for b in batches:
        for seq, words, n, first, ids in zip(*(b.column(c).to_pylist() for c in ("seq", "words", "n", "first", "ids"))):
            if seq != at:
                if row:
                    out.append((*row, sha.hexdigest()))
                at, row, sha = seq, [seq, words, 0, first], hashlib.sha256()
            else:
                sha.update(b",")
            row[2] += n
            sha.update(ids.encode())
            if len(out) >= 5_000:
                yield batch()
    if row:
        out.append((*row, sha.hexdigest()))
    yield batch()


def sequences(convs: DataFrame) -> DataFrame:
    """(seq, words, n, first, ends) of each distinct sequence of turns: how many conversations have it, the smallest, and the
    SHA-256 of all their ids in order.  Ids are joined in blocks first, so that a task reads few rows of a hot sequence."""
    c = convs.select("conv_id", F.array_join(F.transform("turns", lambda t: t["key"]), "").alias("seq"), F.transform("turns", lambda t: t["words"]).alias("words"))
    blocks = c.groupBy("seq", F.floor(F.col("conv_id") / BLOCK).alias("block")).agg(
        F.first("words").alias("words"), F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("first"),
        F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda i: i.cast("string")), ",").alias("ids"))
    blocks = blocks.repartition("seq").sortWithinPartitions("seq", "block").drop("block")
    return blocks.mapInArrow(_digests, "seq string, words array<int>, n long, first long, ends string")


# ------------------------------------------------------------ a shard's tree
class Ternary:
    """A ternary search tree of id sequences; parallel lists hold the links of its nodes."""

    def __init__(self):
        self.key, self.low, self.high, self.down, self.row, self.top = [], [], [], [], [], -1

    def _node(self, k: int) -> int:
        for col, x in ((self.key, k), (self.low, -1), (self.high, -1), (self.down, -1), (self.row, -1)):
            col.append(x)
        return len(self.key) - 1

    def insert(self, seq, row: int) -> None:
        """*seq*, not empty, ends at a node of its own, which remembers *row*."""
        at, link, slot = self.top, None, -1
        i, last = 0, len(seq) - 1
        while True:
            if at < 0:
                at = self._node(seq[i])
                if link is None:
                    self.top = at
                else:
                    link[slot] = at
            k = seq[i]
            if k < self.key[at]:
                link = self.low
            elif k > self.key[at]:
                link = self.high
            elif i < last:
                link, i = self.down, i + 1
            else:
                self.row[at] = row
                return
            slot, at = at, link[at]

    def walk(self):
        """(node, depth) with smaller ids first, each before what follows it."""
        todo = [(self.top, 1, False)] if self.top >= 0 else []
        while todo:
            t, depth, out = todo.pop()
            if out:
                yield t, depth
                continue
            if self.high[t] >= 0:
                todo.append((self.high[t], depth, False))
            if self.down[t] >= 0:
                todo.append((self.down[t], depth + 1, False))
            todo.append((t, depth, True))
            if self.low[t] >= 0:
                todo.append((self.low[t], depth, False))


def _median_first(n: int):
    """0 .. n-1, the middle of each range before its halves, widest ranges first."""
    ranges = [(0, n)]
    for a, b in ranges:
        if a < b:
            m = (a + b) // 2
            yield m
            ranges += [(a, m), (m + 1, b)]


def _nodes(seqs: list[str], words: list, n: list, first: list, ends: list, shard: int):
    """Record batches of a shard's nodes: those of its own, and one row with its boundary nodes."""
    lengths = np.array([len(s) // WIDTH for s in seqs], np.int64)
    names, ids = np.unique(np.frombuffer("".join(seqs).encode(), f"S{WIDTH}"), return_inverse=True)  # ids keep the order of digests
    off = np.concatenate([[0], np.cumsum(lengths)])
    tree = Ternary()
    root = -1
    for r in _median_first(len(seqs)):
        if lengths[r]:
            tree.insert(ids[off[r]:off[r + 1]].tolist(), r)
        else:
            root = r
    # the trie, parents before children; place 0 is the root
    node, depth, parent, path = [-1], [0], [-1], [0]
    for t, d in tree.walk():
        del path[d:]
        node.append(t)
        depth.append(d)
        parent.append(path[-1])
        path.append(len(node) - 1)
    size = len(node)
    row = [root] + [tree.row[t] for t in node[1:]]
    convs, low, said = [0] * size, [None] * size, [0] * size
    kids, leaves, saved = [0] * size, [0] * size, [0] * size
    ending = [_NO_ENDS] * size
    for p in range(size):     # a node's words (and one) are those of the first sequence through it
        if row[p] >= 0:
            r = row[p]
            convs[p], low[p], ending[p] = n[r], first[r], ends[r]
            q = p
            while q > 0 and said[q] == 0:
                said[q] = words[r][depth[q] - 1] + 1
                q = parent[q]
    said = [max(0, x - 1) for x in said]
    # the boundary: all nodes on the paths of the first and the last sequence
    edge = {0}
    for p in (size - 1, next((i for i in range(size) if row[i] >= 0), 0)):
        while p > 0:
            edge.add(p)
            p = parent[p]
    place = {p: i for i, p in enumerate(sorted(edge))}
    for p in range(size - 1, 0, -1):
        q = parent[p]
        convs[q] += convs[p]
        low[q] = low[p] if low[q] is None else min(low[q], low[p])
        if p not in place:
            kids[q] += 1
            leaves[p] = leaves[p] or 1
            saved[p] += (convs[p] - 1) * said[p]
            leaves[q] += leaves[p]
            saved[q] += saved[p]
    own = [p for p in range(size) if p not in place]
    for i in range(0, len(own), 20_000):
        part = own[i:i + 20_000]
        outer = [place.get(parent[p]) for p in part]
        cols = [[shard] * len(part), outer, [low[p] for p in part], [depth[p] for p in part],
                [low[parent[p]] if o is None else None for p, o in zip(part, outer)], [convs[p] for p in part], [kids[p] for p in part],
                [leaves[p] for p in part], [saved[p] for p in part], [ending[p] for p in part], [None] * len(part)]
        yield _batch(cols)
    line = [{"depth": depth[p], "key": "" if p == 0 else names[tree.key[node[p]]].decode(), "words": said[p], "n": convs[p], "first": low[p],
             "ends": ending[p] if row[p] >= 0 else None, "children": kids[p], "leaves": leaves[p], "saved": saved[p]} for p in place]
    yield _batch([[shard], *[[None]] * 8, [None], [line]])


_LINE = pa.list_(pa.struct([(k, pa.string() if k in ("key", "ends") else pa.int64()) for k in ("depth", "key", "words", "n", "first", "ends", "children", "leaves", "saved")]))
_SHARD = f"shard long, outer long, {NODE}, edge {_EDGE}"


def _batch(cols: list) -> pa.RecordBatch:
    kinds = [pa.int64()] * 9 + [pa.string(), _LINE]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=[c.split()[0] for c in f"shard long, outer long, {NODE}, edge x".split(", ")])


def _build(batches):
    from pyspark import TaskContext
    cols = ([], [], [], [], [])
    for b in batches:
        for col, name in zip(cols, ("seq", "words", "n", "first", "ends")):
            col.extend(b.column(name).to_pylist())
    if cols[0]:
        yield from _nodes(*cols, TaskContext.get().partitionId())


# ------------------------------------------------------------ boundary nodes
class _Open:
    """A boundary node on the path that is being merged."""

    def __init__(self, e: dict):
        self.depth, self.key, self.words, self.n, self.first, self.ends = e["depth"], e["key"], e["words"], 0, e["first"], None
        self.children = self.leaves = self.saved = 0
        self.of: list[tuple[int, int]] = []   # (shard, place) of each part

    def add(self, e: dict, shard: int, place: int) -> None:
        self.n += e["n"]
        self.first = min(self.first, e["first"])
        self.ends = e["ends"] or self.ends
        for k in ("children", "leaves", "saved"):
            setattr(self, k, getattr(self, k) + e[k])
        self.of.append((shard, place))


def _merge(batches):
    """Boundary nodes of all shards in order; a node is closed when the path leaves it, its children before it."""
    path: list[_Open] = []
    done: list[tuple] = []

    def close(depth: int):
        while len(path) > depth:
            x = path.pop()
            x.leaves = x.leaves or 1
            x.saved += (x.n - 1) * x.words
            if path:
                path[-1].children += 1
                path[-1].leaves += x.leaves
                path[-1].saved += x.saved
            done.append(x)

    def batch():
        cols = [[x.first for x in done], [x.depth for x in done], [x.n for x in done], [x.children for x in done], [x.leaves for x in done],
                [x.saved for x in done], [x.ends or _NO_ENDS for x in done], [(x.up.of[0] if x.up else None) for x in done], [x.of for x in done]]
        part = pa.struct([("shard", pa.int64()), ("place", pa.int64())])
        as_part = lambda p: None if p is None else {"shard": p[0], "place": p[1]}
        cols[7], cols[8] = [as_part(p) for p in cols[7]], [[as_part(p) for p in of] for of in cols[8]]
        kinds = [pa.int64()] * 6 + [pa.string(), part, pa.list_(part)]
        b = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["conv_id", "depth", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256", "up", "of"])
        done.clear()
        return b
    for b in batches:
        for shard, line in zip(b.column("shard").to_pylist(), b.column("edge").to_pylist()):
            for place, e in enumerate(line):
                d = e["depth"]
                if len(path) <= d or path[d].key != e["key"]:
                    close(d)
                    path.append(_Open(e))
                    path[d].up = path[d - 1] if d else None
                path[d].add(e, shard, place)
            if len(done) >= 5_000:
                yield batch()
    close(0)
    yield batch()


def trie(convs: DataFrame, shard_turns: int = SHARD_TURNS) -> DataFrame:
    """One row per node (columns ``NODE``) of the prefix trie of *convs* (conv_id, turns), one row a conversation.

    A node is named by its smallest member and its depth: it stands for the
    first ``depth`` turns of that conversation.
    """
    seqs = stage(sequences(convs), "sequences")
    turns = seqs.agg(F.sum(F.size("words"))).first()[0] or 0
    shards = max(seqs.sparkSession.sparkContext.defaultParallelism, turns // shard_turns + 1)
    out = stage(seqs.repartitionByRange(int(shards), "seq").sortWithinPartitions("seq").mapInArrow(_build, _SHARD), "nodes")
    line = out.where("edge is not null").select("shard", "edge")   # one row a shard
    merged = stage(line.repartition(1).sortWithinPartitions("shard").mapInArrow(
        _merge, "conv_id long, depth long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string, "
                "up struct<shard:long,place:long>, of array<struct<shard:long,place:long>>"), "boundary")
    names = merged.select(F.col("conv_id").alias("above"), F.inline("of")).withColumnRenamed("place", "outer")
    cols = [c.split()[0] for c in NODE.split(", ")]
    nodes = out.where("edge is null")
    inner = nodes.where("outer is null").select(*cols)
    under = nodes.where("outer is not null").drop("parent_conv_id").join(names, ["shard", "outer"]).withColumnRenamed("above", "parent_conv_id").select(*cols)
    tops = merged.select("*", F.col("up.shard").alias("shard"), F.col("up.place").alias("outer")).join(names, ["shard", "outer"], "left")
    return inner.unionByName(under).unionByName(tops.withColumnRenamed("above", "parent_conv_id").select(*cols))


def prefix_trie(rows: DataFrame) -> DataFrame:
    """The trie of the rebuilt conversations of *rows* (conv_id, turn, role, text)."""
    return trie(with_heads(conversations(rows)))
