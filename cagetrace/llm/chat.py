"""Reply trees as chat texts.

``paths`` enumerates the root-to-leaf paths of reply trees by iterative
self-joins with doubled steps: after k rounds a leaf knows its 2**k nearest
ancestors, so a path of n turns takes log2(n) rounds.  The steps are doubled
before any path is laid, so branches without a root are known by then.  Branches are ranked
by the total score of their turns.  ``format_paths`` writes each path as one
text and marks the code points that count for the loss.

Template, once per turn: ``### <role>: <text></turn>`` and a line feed.  In
texts a backslash, ``###`` and ``</turn>`` get a backslash in front (in roles
a colon too), which ``parse`` takes away again, so any text comes back.

Defined results: null text, role and score count as empty, empty and 0; a
turn whose parent is missing is a root; turns on a cycle of parents, and those
below one, belong to no path; ties of rank go to the smaller leaf; rows repeated in a
conversation are turns of their own, in order of turn, role and text; rows
without a conversation id are one conversation without an id.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cagetrace.llm.store import stage

OPEN, SEP, CLOSE = "### ", ": ", "</turn>\n"
_CONTROL = r"\\|###|</turn>"


def paths(nodes: DataFrame, per_tree: int | None = None) -> DataFrame:
    """(tree, leaf, rank, depth, node) for *nodes* (tree, node, parent, score), best branches first.

    ``per_tree`` keeps that many branches of a tree; None keeps all.
    """
    nodes = stage(nodes.select("tree", "node", "parent", F.coalesce("score", F.lit(0.0)).alias("score")), "nodes")
    up = nodes.select("tree", F.col("node").alias("parent")).distinct()
    jump = stage(nodes.where("parent is not null").join(up, ["tree", "parent"], "left_semi").select("tree", "node", F.col("parent").alias("to")), "jump")
    leaves = nodes.join(jump.select("tree", F.col("to").alias("node")).distinct(), ["tree", "node"], "left_anti")
    most = nodes.groupBy("tree").count().agg(F.max("count")).first()[0] or 0
    jumps, step = [], 1
    while step <= most and not jump.isEmpty():
        jumps.append(jump)
        hop = jump.select("tree", F.col("node").alias("to"), F.col("to").alias("next"))
        jump = stage(jump.join(hop, ["tree", "to"]).select("tree", "node", F.col("next").alias("to")), "jump")
        step *= 2
    # an ancestor further up than a tree has nodes: on a cycle or below one
    leaves = leaves.join(jump.select("tree", "node").distinct(), ["tree", "node"], "left_anti")
    at = stage(leaves.select("tree", F.col("node").alias("leaf"), "node", F.lit(0).cast("long").alias("up")), "paths")
    for k, jump in enumerate(jumps):
        further = at.join(jump, ["tree", "node"]).select("tree", "leaf", F.col("to").alias("node"), (F.col("up") + 2**k).alias("up"))
        at = stage(at.unionByName(further), "paths")
    at = at.join(nodes.select("tree", "node", "score"), ["tree", "node"])
    branch = at.groupBy("tree", "leaf").agg(F.sum("score").alias("total"), F.max("up").alias("last"))
    rank = F.row_number().over(Window.partitionBy("tree").orderBy(F.desc("total"), "leaf"))
    branch = branch.withColumn("rank", rank)
    if per_tree is not None:
        branch = branch.where(F.col("rank") <= per_tree)
    return at.join(branch, ["tree", "leaf"]).select("tree", "leaf", "rank", (F.col("last") - F.col("up")).alias("depth"), "node")


def _escape(text: Column, control: str = _CONTROL) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), f"({control})", r"\\$1")


def format_paths(turns: DataFrame, key: list[str], loss_role: str = "assistant") -> DataFrame:
    """One row per *key* of *turns* (key, depth, role, text): ``formatted`` and ``loss``, spans [from, to) in code points."""
    turns = turns.withColumn("role", F.coalesce("role", F.lit("")))
    head = F.concat(F.lit(OPEN), _escape(F.col("role"), _CONTROL + "|:"), F.lit(SEP))
    turns = turns.select(*key, "depth", "role", head.alias("head"), _escape(F.col("text")).alias("body"))
    size = F.length("head") + F.length("body") + len(CLOSE)
    w = Window.partitionBy(*key).orderBy("depth")
    at = (F.sum(size).over(w) - size + F.length("head")).alias("at")
    turns = turns.select("*", at)
    row = F.struct("depth", F.concat("head", "body", F.lit(CLOSE)).alias("t"), (F.col("role") == loss_role).alias("y"),
                   F.struct(F.col("at").alias("from"), (F.col("at") + F.length("body")).alias("to")).alias("s"))
    whole = turns.groupBy(*key).agg(F.array_sort(F.collect_list(row)).alias("r"))
    return whole.select(*key, F.concat_ws("", F.transform("r", lambda x: x["t"])).alias("formatted"),
                        F.transform(F.filter("r", lambda x: x["y"]), lambda x: x["s"]).alias("loss"))


_TOKEN = re.compile(rf"\\(?:{_CONTROL}|:)|###|</turn>\n")


def unescape(text: str) -> str:
    return re.sub(rf"\\({_CONTROL}|:)", r"\1", text)


def parse(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of each turn of a formatted conversation."""
    out, start = [], 0
    for m in _TOKEN.finditer(formatted):
        if m[0] == "###":
            start = m.end() + 1
        elif m[0] == CLOSE:
            head = re.match(r"(?:\\.|[^\\:])*", formatted[start:m.start()], re.S)[0]
            out.append((unescape(head), unescape(formatted[start + len(head) + len(SEP):m.start()])))
    return out


def _read_back(batches):
    for b in batches:
        rows = []
        for text, loss in zip(b.column("formatted").to_pylist(), b.column("loss").to_pylist()):
            turns = parse(text)
            said = "".join(unescape(text[s["from"]:s["to"]]) for s in loss)
            rows.append((len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest(),
                         len(said), hashlib.sha256(said.encode()).hexdigest(), len(text)))
        cols = [pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 5, (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()))]
        yield pa.RecordBatch.from_arrays([b.column("conv_id"), *cols], names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])


def digest(formatted: DataFrame) -> DataFrame:
    """Counts and digests of formatted conversations (conv_id, formatted, loss), read back from the texts."""
    return formatted.select("conv_id", "formatted", "loss").mapInArrow(
        _read_back, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def format_conversations(rows: DataFrame) -> DataFrame:
    """(conv_id, formatted, loss) of linear conversations (conv_id, turn, role, text).

    A turn's parent is the one before it, so each conversation is a tree of one branch.
    """
    key = F.coalesce(F.col("conv_id").cast("string"), F.lit(""))
    n = F.row_number().over(Window.partitionBy("tree").orderBy("turn", "role", "text")).cast("long")
    rows = stage(rows.select(key.alias("tree"), "conv_id", "turn", "role", "text").withColumn("node", n), "turns")
    tree = rows.select("tree", "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), F.lit(1.0).alias("score"))
    turns = paths(tree).join(rows.select("tree", "node", "conv_id", "role", "text"), ["tree", "node"])
    return format_paths(turns, ["tree", "leaf", "conv_id"]).select("conv_id", "formatted", "loss")
