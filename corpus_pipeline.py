"""The document pipeline: quality, line dedup, near duplicates, decontamination, packing.

Each stage takes what the one before it kept, written as Parquet and read
again; all but the last return the columns of ``documents``.  Decisions are
made per row, by its text: ids may be null or repeated.  Rows repeated with one
id and text, or without an id, are copies like any others, of which the first
stays - by id, those without one last, then in the order they are stored.
Texts without a word are copies of nothing.
No stage is expressed in SQL as a whole (the classifier and the packing are
fitted), so ``ORACLE_SQL`` is None and the tests hold the stages against
brute force.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cagetrace.llm import line_dedup, near_dup, packing, quality, winnow
from cagetrace.llm.queries import table
from cagetrace.llm.store import stage


def _numbered(docs: DataFrame) -> DataFrame:
    """*docs* with ``__row``, a number of its own for each row; stored, so that every reader sees the same."""
    return stage(docs.withColumn("__row", F.monotonically_increasing_id()), "numbered")


def _texts(rows: DataFrame) -> DataFrame:
    """(doc_id, text) of *rows* with the row's number for its id."""
    return rows.select(F.col("__row").alias("doc_id"), "text")


def classify_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the compression classifier rejects go."""
    return quality.good_rows(docs, table(spark, sf_dir, "labels"))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later matching lines go, and rows that this leaves without a line with a word in it."""
    out = line_dedup.dedup_lines(_numbered(docs), least=line_dedup.EVERY, removed="__removed", emptied="__none_left", row="__row").where(~F.col("__none_left"))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("__removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first row of each near-duplicate group (five-word shingles, similarity 0.8) stays."""
    rows = _numbered(docs)
    group = near_dup.near_duplicates(_texts(rows)).select(F.col("doc_id").alias("__row"), "component_id")
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "__row")
    first = rows.select("__row", "doc_id").join(group, "__row").groupBy("component_id").agg(F.min(place).alias("first"))
    return rows.join(first.select("first.__row"), "__row", "left_semi").select(*docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows contaminated by the benchmark go."""
    rows = _numbered(docs)
    found = winnow.decontaminate(_texts(rows), table(spark, sf_dir, "benchmark"))
    return rows.join(found.where("contaminated").select(F.col("doc_id").alias("__row")), "__row", "left_anti").select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The kept documents as packed pieces."""
    return packing.pack_documents(docs)


STAGES = [
    ("quality", classify_quality),
    ("line_dedup", dedup_lines),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontaminate),
    ("packing", pack),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES:
        docs = stage(step(spark, docs, sf_dir), name)
    return docs
