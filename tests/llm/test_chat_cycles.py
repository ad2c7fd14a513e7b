"""Branches without a root are no paths, and cost none."""
from cagetrace.llm import chat


def test_leaf_below_a_cycle(spark):
    rows = [("t", 1, None, 1.0), ("t", 2, 1, 1.0), ("t", 3, 2, 5.0), ("t", 4, 1, 2.0),
            ("t", 8, 9, 9.0), ("t", 9, 8, 9.0), ("t", 10, 8, 9.0), ("t", 11, 10, 9.0),
            ("u", 5, 5, 1.0), ("u", 6, 5, 1.0), ("v", 7, None, None)] + [("w", i, i - 1 if i else None, 0.0) for i in range(40)]
    nodes = spark.createDataFrame(rows, "tree string, node long, parent long, score double")
    got = {}
    for r in chat.paths(nodes).orderBy("tree", "rank", "depth").collect():
        got.setdefault((r.tree, r.rank, r.leaf), []).append(r.node)
    assert got == {("t", 1, 3): [1, 2, 3], ("t", 2, 4): [1, 4], ("v", 1, 7): [7], ("w", 1, 39): list(range(40))}
    assert chat.paths(nodes.where("tree = 'u'")).count() == 0
    assert chat.paths(nodes.limit(0)).count() == 0
