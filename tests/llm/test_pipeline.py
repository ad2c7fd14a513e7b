"""The document pipeline on the small tables: each stage judged on its own input."""
import corpus_pipeline as P
from pyspark.sql import functions as F

from cagetrace.llm import line_dedup, near_dup, quality, queries, winnow

SF = "/root/testdata/sf0.001"


def test_stages_keep_columns_and_apply_decisions(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("gone", F.lit(1)).withColumn("emptied", F.lit(True))
    cols, kept = docs.columns, {}
    for name, step in P.STAGES[:-1]:
        out = P.stage(step(spark, docs, SF), name)
        assert out.columns == cols
        before, after = ({r[0] for r in x.select("doc_id").collect()} for x in (docs, out))
        assert after <= before
        if name == "quality":
            good = quality.classify(docs, queries.table(spark, SF, "labels")).where("predicted = 1")
        elif name == "line_dedup":
            good = line_dedup.dedup_lines(docs.select("doc_id", "text")).where("not emptied")
        elif name == "near_duplicates":
            good = near_dup.near_duplicates(docs).where("kept")
        else:
            good = winnow.decontaminate(docs, queries.table(spark, SF, "benchmark")).where("not contaminated")
        assert after == {r[0] for r in good.select("doc_id").collect()}
        kept[name], docs = len(after), out
    pieces = P.STAGES[-1][1](spark, docs, SF)
    assert {r[0] for r in pieces.select("doc_id").distinct().collect()} == {r[0] for r in docs.select("doc_id").collect()}
    assert 0 < kept["decontamination"] <= kept["quality"] < 200


def test_rows_without_an_id_and_empty_input(spark):
    docs = spark.createDataFrame([(None, "a b c d e f g", "en", "s", 13), (None, None, None, None, None), (1, "", "en", "s", 0)],
                                 "doc_id long, text string, lang string, source string, n_chars long")
    for _, step in P.STAGES[1:-1]:
        docs = P.stage(step(spark, docs, SF), "t")
        assert docs.count() == 3
    none = docs.limit(0)
    for _, step in P.STAGES:
        assert step(spark, none, SF).count() == 0


def test_line_dedup_keeps_what_is_left(spark):
    """A document whose only long line was seen before keeps its short lines; one with nothing left goes."""
    seen = "this licence line is shared by every text"
    docs = spark.createDataFrame([(1, seen), (2, f"{seen}\nroses are red\n\nviolets"), (3, f" \n{seen}\n\t"), (4, "\n "), (5, None)], "doc_id long, text string")
    got = {r.doc_id: r.text for r in P.dedup_lines(spark, docs, SF).collect()}
    assert got == {1: seen, 2: "roses are red\n\nviolets", 4: "\n ", 5: None}


def test_rows_are_judged_one_by_one(spark):
    """Null and repeated ids: copies go, rejected rows go, and no row goes for another's text."""
    item = next(r.text for r in queries.table(spark, SF, "benchmark").orderBy("item_id").collect() if len(r.text.split()) >= 13)
    texts = {c: " ".join(f"{c}{i}" for i in range(60)) for c in "abcd"}
    rows = [(None, texts["a"])] * 3 + [(5, texts["a"]), (6, texts["b"]), (6, texts["b"]), (6, item), (None, item), (None, texts["c"]), (None, texts["c"]), (6, texts["d"])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = sorted([(5, texts["a"]), (6, texts["b"]), (6, texts["d"]), (None, texts["c"])], key=str)
    unique = lambda df: sorted(((r.doc_id, r.text) for r in df.collect()), key=str)
    kept = want + [(6, item)]
    assert unique(P.dedup_lines(spark, docs, SF)) == sorted(kept, key=str)
    assert unique(P.near_duplicates(spark, docs, SF)) == sorted(kept, key=str)
    assert unique(P.decontaminate(spark, docs, SF)) == sorted((r for r in rows if r[1] != item), key=str)
    found = quality.classify(docs, queries.table(spark, SF, "labels"))
    assert P.classify_quality(spark, docs, SF).count() == found.where("predicted = 1").count()


def test_quality_rejects_rows_without_an_id(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    good = quality.classify(docs, queries.table(spark, SF, "labels")).select("doc_id", "predicted")
    more = docs.unionByName(docs.join(good.where("predicted = 0"), "doc_id", "left_semi").withColumn("doc_id", F.lit(None).cast("long")))
    out = P.classify_quality(spark, more, SF)
    assert out.where("doc_id is null").count() == 0 and out.count() == good.where("predicted = 1").count() > 0
