"""Quality rules whose cut-offs follow the data of each language and source.

``features`` counts words, symbols, repeated lines and repeated word windows
of every whole text.  Fixed base rules come first.  For the texts that pass
them each rule's value goes into a quantile sketch per language and source: a
histogram whose buckets keep the value's leading bits, so a quantile is off by
under one part in 64.  Sketches are rows (key, rule, bucket, n), and merging
them is adding up n: first inside tasks, then over tasks, then from sources to
languages to the whole corpus.  A group of fewer than ``LEAST`` texts takes the
thresholds of its language, and a small language those of the corpus.

A threshold is the median plus or minus a multiple of the smaller of the two
distances between the median and the quartiles, and a slack.  So up to a
quarter of junk on one side, or half of it on the other, does not move a
threshold, and where all texts agree small differences stay allowed.  The
thresholds are joined to the texts again and decide what is kept.

Defined results: null text counts as empty (no words, base rules fail); null
languages and sources are groups of their own; rows are judged one by one, so
null, repeated and tied ids change nothing; an empty table gives no rows;
other columns than ``doc_id``, ``lang``, ``source`` and ``text`` are not read.
Lines and word windows of one text are compared by 64-bit hashes.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cagetrace.llm.store import stage
from cagetrace.llm.words import AS_IS, NON_SPACE, grams, slices, text_bytes, text_of_word, words

#: A group of fewer texts is judged by the merged sketch of the next wider group.
LEAST = 200
#: Bits of a value that a bucket keeps.
BITS = 7
#: Thresholds of at most so many groups are broadcast (about 100 bytes each).
BROADCAST_GROUPS = 50_000
SALTS = 16


@dataclass(frozen=True)
class Rule:
    """*value* (SQL, a whole number) must lie within *spread* quartile distances and *slack* of its group's median."""

    name: str
    value: str
    spread: int
    slack: int
    low: bool = False


RULES = (
    Rule("word_length", "100 * word_chars div nullif(n_words, 0)", 12, 50, low=True),
    Rule("symbols", "1000 * n_symbols div nullif(word_chars, 0)", 6, 30),
    Rule("dup_lines", "1000 * n_dup_lines div nullif(n_lines, 0)", 6, 400),
    Rule("repeats", "1000 * n_repeat_words div nullif(n_words, 0)", 6, 350),
)
BASE = "n_words < 50 OR 100 * n_repeat_words > 50 * n_words"

SYMBOLS = np.isin(np.arange(256), [ord(c) for c in "#*$%&|<>"])
NOT_LF = np.arange(256) != 10
_COUNTS = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")


def _per_text(mask: np.ndarray, off: np.ndarray) -> np.ndarray:
    """How often *mask* holds in each text."""
    c = np.zeros(len(mask) + 1, np.int64)
    np.cumsum(mask, out=c[1:])
    return c[off[1:]] - c[off[:-1]]


def _groups(row: np.ndarray, h: np.ndarray):
    """(order, start of each group of equal (row, hash) in that order)."""
    order = np.lexsort((h, row))
    r, g = row[order], h[order]
    new = np.ones(len(order), bool)
    new[1:] = (r[1:] != r[:-1]) | (g[1:] != g[:-1])
    return order, new


def _duplicates(row: np.ndarray, h: np.ndarray, n: int) -> np.ndarray:
    """Per text, the members of each group of equals beyond its first."""
    order, new = _groups(row, h)
    return np.bincount(row[order[~new]], minlength=n)


def _repeated_words(h: np.ndarray, first: np.ndarray, size: int = 3) -> np.ndarray:
    """Per text, the words in windows of *size* words that the text holds twice or more."""
    row, n = text_of_word(first), len(first) - 1
    if len(h) < size:
        return np.zeros(n, np.int64)
    at = np.flatnonzero(row[:len(h) - size + 1] == row[size - 1:])
    order, new = _groups(row[at], grams(h, size)[at])
    single = new.copy()
    single[:-1] &= new[1:]
    at = at[order[~single]]
    hit = np.zeros(len(h), bool)
    for k in range(size):
        hit[at + k] = True
    return np.bincount(row[hit], minlength=n)


def _count(batches):
    for batch in batches:
        for b in slices(batch, "text"):
            data, off = text_bytes(b.column("text"))
            n = len(off) - 1
            h, first, _, _ = words(data, off, NON_SPACE, AS_IS)
            lh, lfirst, s, e = words(data, off, NOT_LF, AS_IS)
            solid = np.zeros(len(data) + 1, np.int64)
            np.cumsum(NON_SPACE[data], out=solid[1:])
            real = solid[e] > solid[s]
            line_row = text_of_word(lfirst)[real]
            cols = (np.diff(first), _per_text(NON_SPACE[data] & ((data & 0xC0) != 0x80), off), _per_text(SYMBOLS[data], off),
                    np.bincount(line_row, minlength=n), _duplicates(line_row, lh[real], n), _repeated_words(h, first))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("lang"), b.column("source"), *(pa.array(c, pa.int64()) for c in cols)],
                                             names=["doc_id", "lang", "source", *_COUNTS])


def features(docs: DataFrame) -> DataFrame:
    """(doc_id, lang, source) and the counts of each text."""
    kind = dict(docs.dtypes)["doc_id"]
    d = docs.select("doc_id", F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"), F.col("text").cast("string").alias("text"))
    return d.mapInArrow(_count, f"doc_id {kind}, lang string, source string, " + ", ".join(f"{c} long" for c in _COUNTS))


def sketch(rows: DataFrame, keys: list[str], rules=RULES) -> DataFrame:
    """(keys, rule, bucket, n): a histogram of each rule's value, buckets named by their lower end."""
    values = F.array(*[F.struct(F.lit(r.name).alias("rule"), F.expr(r.value).alias("v")) for r in rules])
    long = rows.select(*keys, F.inline(values)).withColumn("shift", F.expr(f"greatest(length(bin(v)) - {BITS}, 0)"))
    return long.groupBy(*keys, "rule", F.expr("shiftleft(shiftright(v, shift), shift)").alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def merged(sketches: DataFrame, keys: list[str]) -> DataFrame:
    """Sketches of finer groups added up to those of *keys*."""
    return sketches.groupBy(*keys, "rule", "bucket").agg(F.sum("n").alias("n"))


def quartiles(sketches: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, rule, total, q1, q2, q3): the first bucket that holds a quarter, half and three quarters of the values."""
    w = Window.partitionBy(*keys, "rule")
    s = sketches.select("*", F.sum("n").over(w.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)).alias("upto"),
                        F.sum("n").over(w).alias("total"))
    return s.groupBy(*keys, "rule").agg(F.max("total").alias("total"), *[
        F.min(F.when(4 * F.col("upto") >= k * F.col("total"), F.col("bucket"))).alias(f"q{k}") for k in (1, 2, 3)])


def thresholds(rows: DataFrame, rules=RULES, least: int = LEAST) -> DataFrame:
    """(lang, source, level, low_<rule>, high_<rule>) for each group of *rows*, the texts that pass the base rules.

    ``level`` says whose sketch was used: source, lang or all.
    """
    fine = stage(sketch(rows, ["lang", "source"], rules), "sketch")
    by = {"source": quartiles(fine, ["lang", "source"]), "lang": quartiles(merged(fine, ["lang"]), ["lang"]),
          "all": quartiles(merged(fine, []), [])}
    q = {lv: t.select(*[c for c in ("lang", "source") if c in t.columns], "rule",
                      F.struct("total", "q1", "q2", "q3", F.lit(lv).alias("level")).alias(f"s_{lv}")) for lv, t in by.items()}
    t = q["source"]
    o = q["lang"].withColumnsRenamed({"lang": "lang_", "rule": "rule_"})
    t = t.join(o, t["lang"].eqNullSafe(o["lang_"]) & (t["rule"] == o["rule_"])).drop("lang_", "rule_").join(q["all"], "rule")
    s = F.when(F.col("s_source.total") >= least, F.col("s_source")).when(F.col("s_lang.total") >= least, F.col("s_lang")).otherwise(F.col("s_all"))
    t = t.select("lang", "source", "rule", s.alias("s")).select("lang", "source", "rule", "s.*")
    reach = F.least(F.col("q2") - F.col("q1"), F.col("q3") - F.col("q2"))
    cuts = []
    for r in rules:
        mine = F.col("rule") == r.name
        if r.low:
            cuts.append(F.max(F.when(mine, F.col("q2") - r.spread * reach - r.slack)).alias(f"low_{r.name}"))
        cuts.append(F.max(F.when(mine, F.col("q2") + r.spread * reach + r.slack)).alias(f"high_{r.name}"))
    return t.groupBy("lang", "source").agg(F.max("level").alias("level"), *cuts)


def with_thresholds(rows: DataFrame, cuts: DataFrame, broadcast_groups: int = BROADCAST_GROUPS) -> DataFrame:
    """*rows* with their group's thresholds; a group without any keeps nulls.

    Few groups are broadcast.  Many are joined by key and a salt, so that a
    group of a third of all rows is dealt to ``SALTS`` tasks.
    """
    cuts = stage(cuts.withColumnsRenamed({"lang": "lang_", "source": "source_"}), "cuts")
    same = rows["lang"].eqNullSafe(cuts["lang_"]) & rows["source"].eqNullSafe(cuts["source_"])
    if cuts.count() <= broadcast_groups:
        return rows.join(F.broadcast(cuts), same, "left").drop("lang_", "source_")
    salted = cuts.withColumn("salt_", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    rows = rows.withColumn("salt", (F.monotonically_increasing_id() % SALTS).cast("int"))
    same = rows["lang"].eqNullSafe(salted["lang_"]) & rows["source"].eqNullSafe(salted["source_"]) & (rows["salt"] == salted["salt_"])
    return rows.join(salted, same, "left").drop("lang_", "source_", "salt", "salt_")


def quality_rules(docs: DataFrame, rules=RULES, least: int = LEAST, broadcast_groups: int = BROADCAST_GROUPS) -> DataFrame:
    """One row per row of *docs*: its counts, ``base_failed``, the thresholds' ``level``, the rules it ``failed`` and ``kept``."""
    rows = stage(features(docs).withColumn("base_failed", F.expr(BASE)), "features")
    out = with_thresholds(rows, thresholds(rows.where("NOT base_failed"), rules, least), broadcast_groups)
    beyond = []
    for r in rules:
        v = F.expr(r.value)
        bad = v > F.col(f"high_{r.name}")
        if r.low:
            bad = bad | (v < F.col(f"low_{r.name}"))
        beyond.append(F.when(~F.col("base_failed") & bad, F.lit(r.name)))
    out = out.withColumn("failed", F.array_compact(F.array(*beyond)))
    return out.select("doc_id", "lang", "source", *_COUNTS, "base_failed", F.when(~F.col("base_failed"), F.col("level")).alias("level"), "failed",
                      (~F.col("base_failed") & (F.size("failed") == 0)).alias("kept"))
