"""A filter on what line dedup leaves does not remove the lines twice."""

import corpus_pipeline
from cagetrace.llm import line_dedup


def test_lines_are_removed_once(spark):
    docs = spark.createDataFrame([(1, "a b c d e f"), (2, "a b c d e f"), (3, "g h"), (4, None)], "doc_id long, text string")
    for out, left in ((corpus_pipeline.dedup_lines(spark, docs, ""), {1, 3, 4}), (line_dedup.line_report(docs), {1, 2, 3, 4})):
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("ArrowEvalPython") == 1, plan
        assert {r.doc_id for r in out.collect()} == left
