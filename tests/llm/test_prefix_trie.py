"""Operator 13 against brute force: many shards, hot turns and conversations, odd rows."""
import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest

from cagetrace.llm import prefix_trie as P

WORD = re.compile(r"[^\x20\x09-\x0D]+")
KINDS = "conv_id long, turn long, role string, text string"


def tie(role, text):
    import base64
    return base64.b64encode(hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()[:15]).decode()


def brute_convs(rows):
    conv = defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            r, x = r or "", x or ""
            conv[c].append((t is not None, t or 0, tie(r, x), r, x))
    return {c: [v[3:] for v in sorted(t)] for c, t in conv.items()}


def brute_trie(convs):
    members, kids, leaves, saved, out = defaultdict(list), defaultdict(set), {}, {}, set()
    for c, q in convs.items():
        for d in range(len(q) + 1):
            members[tuple(q[:d])].append(c)
            if d:
                kids[tuple(q[:d - 1])].add(tuple(q[:d]))
    for q in sorted(members, key=len, reverse=True):
        m = members[q]
        leaves[q] = sum(leaves[k] for k in kids[q]) or 1
        saved[q] = sum(saved[k] for k in kids[q]) + ((len(m) - 1) * len(WORD.findall(q[-1][1])) if q else 0)
        ends = ",".join(str(c) for c in sorted(c for c in m if tuple(convs[c]) == q))
        out.add((min(m), len(q), min(members[q[:-1]]) if q else None, len(m), len(kids[q]), leaves[q], saved[q], hashlib.sha256(ends.encode()).hexdigest()))
    return out


def rebuilt(convs):
    out = {}
    for c, t in convs.items():
        h, base = zlib.crc32(str(c).encode()) % 4, c - (abs(c) % 20) * (1 if c >= 0 else -1)
        out[c] = convs.get(base, [])[:h] + t[h:]
    return out


def random_rows(seed, n):
    """Conversations over few turns, a third of them equal and half of them with one first turn."""
    rng = random.Random(seed)
    rows = []
    for c in range(n):
        hot = c % 3 == 0
        turns = ["hot turn"] * 3 if hot else (["hot turn"] if rng.random() < .5 else []) + [f"t {rng.randrange(4)} x" for _ in range(rng.randrange(6))]
        rows += [(c * 7 - 100, i, ["user", "assistant"][i % 2], t) for i, t in enumerate(turns)]
    return rows


def check(spark, rows, **kw):
    df = spark.createDataFrame(rows, KINDS).repartition(3)
    got = [tuple(r) for r in P.trie(P.conversations(df), **kw).collect()]
    want = brute_trie(brute_convs(rows))
    assert len(got) == len(want)
    assert set(got) == want


@pytest.mark.parametrize("seed,shard_turns", [(1, 3), (2, 20), (3, P.SHARD_TURNS)])
def test_random_tries(spark, seed, shard_turns):
    check(spark, random_rows(seed, 150), shard_turns=shard_turns)


def test_rebuilt_conversations(spark):
    rows = random_rows(5, 200)
    got = {tuple(r) for r in P.prefix_trie(spark.createDataFrame(rows, KINDS)).collect()}
    assert got == brute_trie(rebuilt(brute_convs(rows)))


def test_turnless_conversations_are_members_of_the_root(spark):
    rows = [(c, 0, "user", "only") for c in range(1, 20)]     # without conversation 0 many are left empty
    want = brute_trie(rebuilt(brute_convs(rows)))
    assert {tuple(r) for r in P.prefix_trie(spark.createDataFrame(rows, KINDS)).collect()} == want
    root, = [w for w in want if w[1] == 0]
    assert root[3] == 19 and root[7] != hashlib.sha256(b"").hexdigest()


def test_ids_of_a_hot_conversation_cross_blocks(spark):
    check(spark, [(c, 0, "user", "same words") for c in range(-700, 3 * P.BLOCK)])


def test_long_conversation(spark):
    check(spark, [(c, i, "user", f"turn {i}") for c in (1, 2) for i in range(700 + c)] + [(3, 0, "user", "turn 0")], shard_turns=50)


def test_odd_rows(spark):
    rows = [(1, None, None, None), (1, 0, "user", "a b"), (1, 0, "user", "a b"), (1, 0, "user", "c"), (2, None, "", ""), (2, 0, "user", "a b"), (None, 0, "user", "lost"),
            (3, 5, "user", "w " * 50_000), (3, -5, None, "　\x1c x"), (-3, 1, "user", ""), (4, 0, "use", "ra b"), (4, 1, "1:u", "x"), (5, 0, "", "1:ux")]
    kinds = KINDS + ", shard long, seq string, n int, edge string"
    df = spark.createDataFrame([(*r, 1, "x", 2, "y") for r in rows], kinds).repartition(3)
    assert {tuple(r) for r in P.trie(P.conversations(df)).collect()} == brute_trie(brute_convs(rows))
    assert {tuple(r) for r in P.prefix_trie(df).collect()} == brute_trie(rebuilt(brute_convs(rows)))
    assert P.prefix_trie(df.where("conv_id > 99")).collect() == []


def test_median_insertion_keeps_siblings_balanced():
    tree = P.Ternary()
    for r in P._median_first(1023):
        tree.insert([r], r)

    def height(t):
        return 0 if t < 0 else 1 + max(height(tree.low[t]), height(tree.high[t]))
    assert height(tree.top) == 10
    assert [tree.row[t] for t, _ in tree.walk()] == list(range(1023))
