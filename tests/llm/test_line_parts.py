"""Line dedup joins its postings in parts by word: each is on disk for itself, and the lines removed are the same."""

import random

from cagetrace.llm import line_dedup


def test_postings_come_in_parts(spark, monkeypatch):
    rng = random.Random(7)
    base = [[f"w{rng.randrange(60)}" for _ in range(rng.randrange(4, 12))] for _ in range(40)]
    lines = [" ".join(b + ([f"x{rng.randrange(9)}"] if rng.random() < 0.6 else [])) for b in base for _ in range(6)]
    rng.shuffle(lines)
    docs = spark.createDataFrame([(i, "\n".join(lines[i::30])) for i in range(30)], "doc_id long, text string")
    staged = []
    keep = line_dedup.stage
    monkeypatch.setattr(line_dedup, "stage", lambda df, name: staged.append(name) or keep(df, name))
    found = []
    for parts in (1, 3):
        monkeypatch.setattr(line_dedup, "PARTS", parts, raising=False)
        staged.clear()
        found.append(sorted((r.rid, tuple(r.gone)) for r in line_dedup.removed_lines(docs, least=1).collect()))
        assert staged.count("postings") == parts == staged.count("rest")
    assert found[0] == found[1] and sum(len(g) for _, g in found[0]) > 100
