"""The cage centre's histogram is dealt to as many tasks as its rows need."""

from cagetrace.operators import clean as C


def test_tasks_follow_the_rows(spark, monkeypatch):
    rows = [(s, float(v * (s + 3) % 97) + v / 1000, float(v * 7 % 31)) for s in range(40) for v in range(50)]
    frames = spark.createDataFrame(rows, "session int, x double, y double")
    want = sorted(map(str, C.cage_center(frames, 20, 9).collect()))
    monkeypatch.setattr(C, "HIST_ROWS", 60, raising=False)
    out = C.cage_center(frames, 20, 9)
    assert sorted(map(str, out.collect())) == want and len(want) == 40
    # 50 distinct x and 31 distinct y in each of 40 sessions
    assert f", {-(-40 * 81 // 60)}), REPARTITION_BY_NUM" in out._jdf.queryExecution().executedPlan().toString()
