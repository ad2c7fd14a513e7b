"""Operator 12 against brute force, on odd rows, with merged sketches and both joins."""
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from cagetrace.llm import adaptive_rules as A

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_counts(text):
    text = text or ""
    w, seen, lines, dup = WORD.findall(text), set(), 0, 0
    for line in text.split("\n"):
        if WORD.search(line):
            lines += 1
            dup += line in seen
            seen.add(line)
    g = list(zip(w, w[1:], w[2:]))
    n = Counter(g)
    hit = {i + k for i, x in enumerate(g) if n[x] > 1 for k in range(3)}
    return len(w), sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), lines, dup, len(hit)


def bucket(v):
    k = max(0, v.bit_length() - A.BITS)
    return v >> k << k


def brute_kept(rows, least):
    """(base_failed, kept) of each (lang, source, text), thresholds from the whole lists of values."""
    counts = [brute_counts(t) for _, _, t in rows]
    base = [c[0] < 50 or 100 * c[5] > 50 * c[0] for c in counts]
    vals = [None if b else {"word_length": 100 * c[1] // c[0], "symbols": 1000 * c[2] // c[1], "dup_lines": 1000 * c[4] // c[3], "repeats": 1000 * c[5] // c[0]}
            for c, b in zip(counts, base)]

    def cuts(rule, members):
        v = sorted(bucket(x[rule.name]) for x in members)
        q1, q2, q3 = (v[-(-k * len(v) // 4) - 1] for k in (1, 2, 3))
        reach = min(q2 - q1, q3 - q2)
        return (q2 - rule.spread * reach - rule.slack if rule.low else -10**9), q2 + rule.spread * reach + rule.slack
    out = []
    for (lang, source, _), v, b in zip(rows, vals, base):
        ok = not b
        if ok:
            for pick in (lambda r: r[:2] == (lang, source), lambda r: r[0] == lang, lambda r: True):
                members = [x for r, x in zip(rows, vals) if x and pick(r)]
                if len(members) >= least:
                    break
            ok = all(lo <= v[r.name] <= hi for r in A.RULES for lo, hi in [cuts(r, members)])
        out.append((b, ok))
    return out


def text(rng, kind):
    n = rng.randrange(20, 120)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randrange(3, 8 if kind != "long" else 30))) for _ in range(n)]
    if kind == "symbols":
        words = [w + rng.choice("#*$%&|<>") * 2 for w in words]
    if kind == "repeats":
        words = words[:6] * 3 + words
    lines = [" ".join(words[i:i + 9]) for i in range(0, n, 9)]
    return "\n".join(lines * 2 if kind == "lines" else lines)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    kinds = ["plain"] * 14 + ["symbols", "long", "repeats", "lines"]
    return [(rng.choice(["en", "de", None]), rng.choice(["hot", "hot", "s1", "s2", None]), text(rng, rng.choice(kinds))) for _ in range(400)]


@pytest.mark.parametrize("least,groups", [(1, A.BROADCAST_GROUPS), (30, 0), (100, A.BROADCAST_GROUPS), (10_000, 0)])
def test_kept_rows(spark, rows, least, groups):
    docs = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "doc_id long, lang string, source string, text string").repartition(5)
    got = {r.doc_id: r for r in A.quality_rules(docs, least=least, broadcast_groups=groups).collect()}
    assert len(got) == len(rows)
    assert [(got[i].base_failed, got[i].kept) for i in range(len(rows))] == brute_kept(rows, least)
    assert [(got[i].n_words, got[i].word_chars, got[i].n_symbols, got[i].n_lines, got[i].n_dup_lines, got[i].n_repeat_words) for i in range(len(rows))] \
        == [brute_counts(t) for _, _, t in rows]
    assert any(not r.kept and not r.base_failed for r in got.values())


def test_merged_sketches_are_those_of_the_union(spark, rows):
    docs = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "doc_id long, lang string, source string, text string")
    f = A.features(docs).where("n_words > 0").cache()
    fine = A.sketch(f, ["lang", "source"])
    for keys in (["lang"], []):
        assert sorted(map(repr, A.merged(fine, keys).collect())) == sorted(map(repr, A.sketch(f, keys).collect()))
    f.unpersist()


def test_quartiles_are_within_a_bucket(spark):
    values = [int(1.03 ** i) for i in range(1, 900)]
    s = A.sketch(spark.createDataFrame([(v,) for v in values], "v long"), [], [A.Rule("v", "v", 1, 1)])
    q, = A.quartiles(s, []).collect()
    for k, got in ((1, q.q1), (2, q.q2), (3, q.q3)):
        true = sorted(values)[-(-k * len(values) // 4) - 1]
        assert got <= true < got * (1 + 2 ** (1 - A.BITS)) + 1


def test_odd_rows(spark):
    rows = [(1, "en", "a", None), (1, "en", "a", ""), (None, None, None, " \t\n\x0b "), (2, None, "a", "é" * 70_000 + " x y z x y z"), (3, "de", None, "a b\r\na b\n\na b\na b"),
            (3, "de", None, "a b\r\na b\n\na b\na b"), (4, "en", "a", "　\x1c # | 漢字 < >"), (5, "en", "a", "w%d " * 3 + " ".join(f"w{i}" for i in range(40_000)))]
    docs = spark.createDataFrame([(*r, 1, "x", True) for r in rows], "doc_id long, lang string, source string, text string, n_words int, rule string, kept boolean")
    got = sorted(tuple(r)[3:9] for r in A.quality_rules(docs).collect())
    assert got == sorted(brute_counts(t) for *_, t in rows)
    assert A.quality_rules(docs.where("doc_id > 99")).collect() == []
    assert A.quality_rules(docs).where(F.col("doc_id").isNull()).count() == 1
