"""Operator 11 against brute force, with states split down to a few words, and on odd rows."""
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from cagetrace.llm import spelling
from cagetrace.llm.spelling import Acceptor

AZ = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def brute_words(rows, least_length, least_count, noise):
    c = Counter()
    for d, t in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = w.translate(AZ)
            h = zlib.crc32(f"{'' if d is None else d}:{w}".encode())
            if noise and h % noise == 0:
                w = w[:h % len(w)] + w[h % len(w) + 1:]
            c[w] += 1
    return {w: n for w, n in c.items() if len(w) >= least_length and n >= least_count}


def brute_variants(voc, ratio=5):
    near = {w: [x for x in voc if one_edit(w, x)] for w in voc}
    form = {}
    for w, n in voc.items():
        best = min(near[w], key=lambda x: (-voc[x], x), default=None)
        if best is not None and voc[best] >= ratio * n:
            form[w] = best
    out = set()
    for w, n in voc.items():
        r = w
        while r in form:
            r = form[r]
        out.add((w, form.get(w), r, n, len(near[w]), voc.get(form.get(w))))
    return out


def random_words(seed, n):
    """Words over few letters, many of them one edit apart, of 1 to 9 code points."""
    rng = random.Random(seed)
    words = {"".join(rng.choice("abé") for _ in range(rng.randrange(1, 9))) for _ in range(n)}
    return words | {w[:i] + rng.choice("abcé") + w[i:] for w in words for i in (0, len(w) // 2, len(w))}


@pytest.mark.parametrize("seed", range(4))
def test_composition_of_random_vocabularies(seed):
    words = random_words(seed, 40)
    auto = Acceptor()
    for size in range(1, 8):
        short, long = (sorted(w for w in words if len(w) == k) for k in (size, size + 1))
        a = auto.add(short)
        assert sorted(auto.replaced(a)) == [(i, j) for i, x in enumerate(short) for j, y in enumerate(short) if i < j and one_edit(x, y)]
        if long:
            got = auto.inserted(a, auto.add(long), False)
            assert sorted(got) == [(i, j) for i, x in enumerate(short) for j, y in enumerate(long) if one_edit(x, y)]
            inner = auto.inserted(a, auto.add(long), True)
            assert sorted(inner) == [(i, j) for i, j in sorted(got) if not long[j].startswith(short[i])]


def test_equal_continuations_are_one_state():
    auto = Acceptor()
    auto.add(["abx", "aby", "cbx", "cby"])
    assert len(auto.arcs) == 4   # the empty rest, {x, y}, b{x, y}, the start


@pytest.mark.parametrize("most", [3, spelling.MOST])
def test_pairs_and_forms(spark, most):
    rng = random.Random(7)
    voc = {w: rng.choice([1, 1, 2, 6, 40, 200]) for w in random_words(9, 150)}
    voc |= {"x" * 400: 3, "x" * 401: 30, "x" * 200 + "y" + "x" * 199: 1}
    df = spark.createDataFrame(list(voc.items()), "word string, n long")
    pairs = [(r.word, r.near) for r in spelling.near_pairs(df, most).collect()]
    assert len(pairs) == len(set(pairs))
    assert set(pairs) == {(w, x) for w in voc for x in voc if one_edit(w, x)}
    assert {tuple(r) for r in spelling.variants(df, most=most).collect()} == brute_variants(voc)


def test_chains_lead_to_their_end(spark):
    chain = [("aaaaaa" + "b" * i, 2 * 5 ** i) for i in range(9)]
    out = {r.word: r for r in spelling.variants(spark.createDataFrame(chain, "word string, n long")).collect()}
    assert {r.root for r in out.values()} == {chain[-1][0]}
    assert [out[w].form for w, _ in chain[:-1]] == [w for w, _ in chain[1:]]


def test_odd_rows(spark):
    rows = [(1, "Grüßen GRÜßen grüßen aÀÿ×÷b letter letters, letter"), (1, "Grüßen GRÜßen grüßen aÀÿ×÷b letter letters, letter"),
            (2, None), (3, ""), (None, "letter " * 30 + "lettre"), (4, "word" * 20_000 + " letter"), (4, "lettex " * 6), (-5, "漢字letter1lettera\nletterb")] * 5
    docs = spark.createDataFrame([(*r, "x", 1, "y") for r in rows], "doc_id long, text string, word string, n int, near string").repartition(3)
    want = brute_words(rows, 6, 5, 3)
    got = spelling.vocabulary(docs, 6, 5, 3)
    assert {r.word: r.n for r in got.collect()} == want
    assert {tuple(r) for r in spelling.variants(got).collect()} == brute_variants(want)


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert spelling.variants(spelling.vocabulary(docs)).collect() == []


def test_held_counts_are_passed_on(spark, monkeypatch):
    rows = [(i, f"common{chr(97 + i % 26)} unique{chr(97 + i % 26)}{chr(97 + i // 26)}") for i in range(200)]
    batches = spark.createDataFrame(rows, "doc_id long, text string").toArrow().to_batches(max_chunksize=20)
    monkeypatch.setattr(spelling, "HELD", 10)
    out, total = list(spelling._counter(6, 0)(iter(batches))), defaultdict(int)
    for b in out:
        for w, n in zip(b.column("word").to_pylist(), b.column("n").to_pylist()):
            total[w] += n
    assert len(out) > 5
    assert dict(total) == brute_words(rows, 6, 1, 0)
