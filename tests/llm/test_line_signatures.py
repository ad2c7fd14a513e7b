"""Signatures of line dedup: every similar pair meets under one, and lines that share a word or two are not paired."""

import random

import numpy as np
import pyarrow as pa
import pytest

from cagetrace.llm import line_dedup as L
from cagetrace.llm.near_dup import linked


def _pairs(texts, percent):
    """(similar pairs by brute force, pairs that signatures bring together), by class."""
    n = np.arange(len(texts))
    batches = [pa.RecordBatch.from_arrays([pa.array(n[i:i + 200]), pa.array(n[i:i + 200]), pa.array(texts[i:i + 200])], names=["rid", "ord", "text"]) for i in range(0, len(texts), 200)]
    rows = sorted((k, e) for b in L._signatures(percent, 1)(batches) for k, e in zip(b.column(0).to_pylist(), b.column(1).to_pylist()))
    out = pa.Table.from_batches(L._shared(percent)([pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows], pa.int32()), pa.array([e for _, e in rows], pa.binary())], names=["bucket", "entries"])]))
    found, groups, lines = set(), {}, 0
    for r in out.to_pylist():
        if r["line"] is not None:
            lines += 1
            continue
        if r["star"]:
            found.add(frozenset((r["key"], r["lead"])))
        if r["rest"]:
            groups.setdefault(r["sig"], set()).add(r["key"])
    found |= {frozenset((a, b)) for g in groups.values() for a in g for b in g if a != b}
    assert lines == len(texts)
    h, line, row, _, _ = L.line_sets(pa.RecordBatch.from_arrays([pa.array(texts)], names=["text"]))
    _, key = L._classes(h, line, len(row))
    cut = np.searchsorted(line, np.arange(len(row) + 1))
    sets = {int(k): h[cut[i]:cut[i + 1]] for i, k in enumerate(key)}
    keys = list(sets)
    return {frozenset((a, b)) for i, a in enumerate(keys) for b in keys[:i] if linked(sets[a], sets[b], percent)}, found


@pytest.mark.parametrize("percent", [70, 80, 90])
def test_similar_lines_share_a_signature(percent):
    rng = random.Random(percent)
    words, texts = [f"w{i}" for i in range(300)], []
    for n in [*range(1, 34), 60, 150] * 3:
        base = rng.sample(words, n)
        texts.append(" ".join(base))
        for _ in range(3):
            near = list(base)
            for _ in range(rng.randrange(max(2, n // 7 + 2))):
                near[rng.randrange(len(near))] = rng.choice(words)
            texts.append(" ".join(near[:rng.randrange(max(1, n - n // 6), n + 1)]))
    rng.shuffle(texts)
    similar, found = _pairs(texts, percent)
    assert len(similar) > 20 and similar <= found


def test_lines_with_a_word_in_common_are_not_paired():
    # every two lines share the words that stand in every line, under which all of them were joined
    rng = random.Random(1)
    texts = ["the of and in to " + " ".join(rng.sample([f"word{i}" for i in range(2000)], 9)) for _ in range(600)]
    similar, found = _pairs(texts, 80)
    assert not similar and len(found) < 60
