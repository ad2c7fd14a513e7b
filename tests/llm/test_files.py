"""Shards of even weight wherever the keys lie, and prefix sums over ranges."""
import random

import pytest
from pyspark.sql import functions as F

from cagetrace.llm import files, near_dup, quality
from test_llm import brute_components


def sharded(spark, keys, weight=10, **kw):
    df = spark.createDataFrame([(k, f"t{i}") for i, k in enumerate(keys)], "key long, text string").repartition(4)
    return files.with_shards(df, "key", F.lit(weight), **kw).collect()


def even(rows, most):
    per, ends = {}, {}
    for r in rows:
        per[r.shard] = per.get(r.shard, 0) + 1
        lo, hi = ends.get(r.shard, (r.key, r.key))
        ends[r.shard] = min(lo, r.key), max(hi, r.key)
    assert max(per.values()) <= most
    cuts = [ends[s] for s in sorted(ends)]
    assert all(a[1] <= b[0] for a, b in zip(cuts, cuts[1:]))      # shards are in key order
    return len(per)


@pytest.mark.parametrize("more", [[2**62], [-2**63, 2**63 - 1], [2**40 + i * 2**20 for i in range(50)], []])
def test_outlying_keys_do_not_fill_a_shard(spark, more):
    keys = list(range(5000)) + more
    assert even(sharded(spark, keys, shard_bytes=1000), 300) >= len(keys) // 300
    assert even(sharded(spark, keys, shard_bytes=1 << 30), 3 * len(keys) // 64 + 3) >= 20      # at least about 64


def test_a_hot_key_is_split(spark):
    keys = [7] * 3000 + list(range(3000))
    random.Random(1).shuffle(keys)
    rows = sharded(spark, keys, shard_bytes=1000)
    assert even(rows, 300) > 20 and len({r.shard for r in rows if r.key == 7}) >= 25


def test_rows_without_a_key(spark):
    rows = sharded(spark, [None] * 3000 + [1, 2], shard_bytes=200)
    assert len({r.shard for r in rows if r.key is None}) > 100 and max(r.shard for r in rows if r.key is None) < 0
    assert all(r.shard >= 0 for r in rows if r.key is not None)
    assert {r.shard < 0 for r in sharded(spark, [None] * 10, shard_bytes=200)} == {True}


def test_runs_too_many_to_broadcast(spark, monkeypatch):
    want = sorted((r.text, r.shard) for r in sharded(spark, list(range(3000)) + [2**50], shard_bytes=1000))
    monkeypatch.setattr(files, "BROADCAST_RUNS", 0)
    assert sorted((r.text, r.shard) for r in sharded(spark, list(range(3000)) + [2**50], shard_bytes=1000)) == want


def test_running_sums(spark):
    rng = random.Random(2)
    rows = [(i // 3, i % 3, rng.randrange(100)) for i in range(2000)]
    got = files.running(spark.createDataFrame(rows, "a long, b long, v long").repartition(7), ["a", "b"], "v", "before").collect()
    at = 0
    for (a, b, v), r in zip(sorted(rows), sorted(got)):
        assert (a, b, v, at) == (r.a, r.b, r.v, r.before)
        at += v


def test_bands_follow_the_threshold(spark):
    assert near_dup.bands_of(85) == near_dup.bands_of(80) == (6, 42)
    for p in range(5, 100):
        rows, bands = near_dup.bands_of(p)
        assert (1 - (p / 100) ** rows) ** bands <= near_dup.MISS and rows * bands <= 256
    with pytest.raises(ValueError):
        near_dup.bands_of(2)
    rng, base = random.Random(4), [f"w{i}" for i in range(90)]
    rows = []
    for d in range(80):
        w = list(base)
        for _ in range(rng.randrange(4, 30)):
            w[rng.randrange(90)] = f"x{rng.random()}"
        rows.append((d, " ".join(w)))
    for percent in (40, 60):
        out = near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 3, percent).collect()
        assert {r.doc_id: r.component_id for r in out} == brute_components(rows, 3, percent)


def test_scores_see_dictionary_differences_only():
    """Equal dictionaries tell nothing apart, however long or repetitive a text is."""
    texts = [b"", b"a", b"word " * 5000, bytes(range(256)) * 40]
    assert (quality.Model(b"some words " * 50, b"some words " * 50).features(texts) == 0).all()
    x = quality.Model(b"good words here " * 50, b"bad junk there " * 50).features([b"good words here", b"bad junk there"])
    assert x[0, 0] > 0 > x[1, 0]
    assert [len(p) for p in quality._pieces(b"x" * 200, 64)] == [66, 67, 67] and quality._pieces(b"", 64) == [b""]
