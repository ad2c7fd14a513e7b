"""Operator 2: the hypothesis test abandons most of what it should, and nothing is returned beyond a threshold."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from cagetrace.llm import ann, queries


def test_scan_abandons_and_finds():
    rng = np.random.default_rng(1)
    x = rng.standard_normal((20_000, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    rot = ann.rotation(65)
    v, q = ann.lift(x, 1.0, rot), ann.lift(x[:64], 1.0, rot, True)
    d = ann._distances(q, v)
    worst = np.partition(d, 20, axis=1)[:, 20]
    i, j, read = ann.adaptive_scan(q, v, worst)
    assert read < 0.5 * d.size * 65
    assert (d[i, j] <= worst[i] + 1e-6).all()
    assert len(set(zip(i.tolist(), j.tolist()))) == len(i) >= 0.93 * (d <= worst[:, None]).sum()
    i, j, read = ann.adaptive_scan(q[:3], v[:500], np.full(3, np.inf))      # no threshold: all pairs, all read
    assert len(i) == 1500 and read == 1500 * 65
    assert [len(a) for a in ann.adaptive_scan(q[:3], v[:500], np.full(3, -1.0))[:2]] == [0, 0]


def test_many_copies_of_the_nearest_vectors(spark):
    """Equal distances are abandoned together or not at all; what the seed lists gave stays."""
    rng = np.random.default_rng(2)
    x = rng.standard_normal((60, 16))
    rows = [(i, x[0 if i % 2 else i % 60].tolist()) for i in range(1200)]
    out = ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 100 == 0).toPandas()
    assert (out.groupby("query_id").size() == 20).all() and out.query_id.nunique() == 12
    e = np.array([r[1] for r in rows])
    assert np.allclose(out.score, [e[a] @ e[b] for a, b in zip(out.query_id, out.vec_id)], rtol=1e-12)


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.1"])
def test_recall(spark, sf):
    v = spark.read.parquet(f"{sf}/embeddings.parquet").toPandas()
    x, ids = np.array(v.embedding.tolist(), float), v.vec_id.to_numpy()
    got = queries.op2_adaptive_scan(spark, sf).toPandas().groupby("query_id").vec_id.apply(set)
    s = x[ids % 20 == 0] @ x.T
    s[ids[ids % 20 == 0][:, None] == ids[None, :]] = -np.inf
    hits = sum(len(got[q] & set(ids[np.argsort(-row)[:20]])) for q, row in zip(ids[ids % 20 == 0], s))
    assert hits >= 0.93 * 20 * len(s)
