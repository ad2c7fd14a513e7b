"""Near copies that are not like the earliest of their group are not paired with all the others."""

import random

import numpy as np
import pyarrow as pa
import pytest

from cagetrace.llm import line_dedup as L


def test_group_of_near_copies_makes_few_pairs(spark, monkeypatch):
    rng, n = random.Random(5), 150
    base = [f"word{i}" for i in range(30)]

    def near(k, edits):
        words = list(base)
        for i in rng.sample(range(30), edits):
            words[i] = f"own{k}x{i}"
        return " ".join(words)
    # the earliest ones, and the last n, differ from the base in two words: they are like the n in the middle, with one, and rarely like each other
    texts = [near(k, 2 if k < 12 or k >= 12 + n else 1) for k in range(12 + 2 * n)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    made, keep = {}, L.stage

    def stage(df, name):
        out = keep(df, name)
        made[name] = made.get(name, 0) + out.count()
        return out
    monkeypatch.setattr(L, "stage", stage)
    out = {r.doc_id: r.n_removed for r in L.line_report(docs).collect()}
    sets = [set(t.split()) for t in texts]
    assert out == {d: int(any(100 * len(s & e) >= 80 * len(s | e) for e in sets[:d])) for d, s in enumerate(sets)}
    assert 0 < made["rest"] <= 2 * n and made.get("met", 0) <= 2 * n


def test_nothing_but_the_result_stays_on_disk(spark, monkeypatch):
    kept, keep, drop = set(), L.stage, L.drop

    def stage(df, name):
        out = keep(df, name)
        kept.add(out.staged_at)
        return out
    monkeypatch.setattr(L, "stage", stage)
    monkeypatch.setattr(L, "drop", lambda spark, *tables: kept.difference_update(t.staged_at for t in tables) or drop(spark, *tables))
    docs = spark.createDataFrame([(1, "a b c d e f"), (2, "a b c d e f g"), (3, "g h")], "doc_id long, text string")
    assert [(r.gone) for r in L.removed_lines(docs).collect()] == [[0]] and len(kept) == 1


@pytest.mark.parametrize("near, few, rows", [(4096, 48, 10**6), (4096, 2, 7), (6, 3, 5), (6, 3, 1000)])
def test_nearest_earlier_classes(monkeypatch, near, few, rows):
    monkeypatch.setattr(L, "_NEAR", near)
    monkeypatch.setattr(L, "_FEW", few)
    rng = np.random.default_rng(near + rows)
    sig = np.sort(rng.integers(0, 12, 200))
    maps = rng.integers(0, 4, (200, 4)) * 5  # few bits differ
    size, opened = rng.integers(18, 22, 200), rng.random(200) < 0.7
    t = pa.table({"key": np.arange(200), "rid": np.arange(200) + 1000, "line": np.arange(200, dtype=np.int32), "n": size.astype(np.int32),
                  **{f"m{i}": maps[:, i] for i in range(4)}, "sig": sig, "open": opened})
    got, more = {}, set()
    for r in pa.Table.from_batches(L._closest(80)(t.to_batches(max_chunksize=rows))).to_pylist():
        assert r["rid"] == r["c"] + 1000 and (r["other"] is None or r["there"] == r["other"] + 1000)
        got.setdefault(r["c"], []).extend([] if r["other"] is None else [r["other"]])
        if r["more"]:
            more.add(r["c"])
    for x in range(200):
        apart = {y: sum(int(maps[x, k] ^ maps[y, k]).bit_count() for k in range(4)) for y in range(x) if sig[y] == sig[x]}
        ok = [y for y in apart if apart[y] <= size[x] + size[y] - 2 * -(-80 * (size[x] + size[y]) // 180) and min(size[x], size[y]) * 100 >= 80 * max(size[x], size[y])]
        seen = sorted((y for y in ok if x - y <= near), key=lambda y: (apart[y], y))
        assert got.get(x, []) == (seen[:L._CLOSEST] if opened[x] else [])
        assert (x in more) == bool(opened[x] and (len(seen) > L._CLOSEST or len(apart) > near))
