"""Compression quality classifier.

Two zstandard dictionaries are built from good and from bad labelled texts.
A text is compressed with either one, whole and in even pieces of about SPANS
bytes, and each pair of sizes gives a normalised difference (bad - good) /
(bad + good).  Pieces show what a dictionary knows where a long or repetitive
text would soon compress by itself; of the smallest ones the least, the
largest difference and their spread count too.  A logistic curve over these
differences and their products, fitted on labelled texts that the
dictionaries have not seen, is the score.  Nothing else of a text is used.

Labels are learnt from a bounded sample: of each class the SAMPLE_DOCS
documents with the smallest hash of the id, and of those as many whole texts
as fit SAMPLE_BYTES.  Class weights undo the sample's balance.

Defined results: a null text is empty; without labels of both classes every
score is 0.5; rows come back as often as they came; an id with several texts is
learnt from by its longest.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cagetrace.llm.store import only, stage
from cagetrace.llm.words import slices

SAMPLE_DOCS, SAMPLE_BYTES, DICTIONARY_BYTES, LEVEL = 5000, 24 << 20, 112 << 10, 3
#: Bytes of a piece; the whole text comes first, the spread is taken of the last
SPANS = (256, 64)
THRESHOLD = 0.3


def held_out(doc_id: Column) -> Column:
    """Rows that are never learnt from: crc32 of the id's text divisible by 5."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


class Model:
    def __init__(self, good: bytes, bad: bytes):
        self.dictionaries = (good, bad)
        self.mean = self.scale = self.weights = None
        self._tools = None

    def __getstate__(self):
        return {**self.__dict__, "_tools": None}

    def _differences(self, pieces: list[bytes]) -> tuple[np.ndarray, float]:
        """Normalised size difference of each piece, and of all together."""
        if self._tools is None:
            self._tools = []
            for d in self.dictionaries:
                d = zstandard.ZstdCompressionDict(d)
                d.precompute_compress(level=LEVEL)
                self._tools.append(zstandard.ZstdCompressor(dict_data=d, level=LEVEL, write_content_size=False, write_checksum=False, write_dict_id=False).compress)
        good, bad = (np.array([len(z(p)) for p in pieces], float) for z in self._tools)
        return (bad - good) / (bad + good), (bad.sum() - good.sum()) / (bad.sum() + good.sum())

    def features(self, texts: list[bytes]) -> np.ndarray:
        out = np.empty((len(texts), len(SPANS) + 4))
        for row, text in zip(out, texts):
            row[0] = self._differences([text])[1]
            for k, span in enumerate(SPANS):
                each, row[k + 1] = self._differences(_pieces(text, span))
            row[len(SPANS) + 1:] = each.min(), each.max(), each.std()
        return out

    def _design(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        i, j = np.triu_indices(z.shape[1])
        return np.concatenate([np.ones((len(z), 1)), z, z[:, i] * z[:, j]], axis=1)

    def calibrate(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-2) -> None:
        self.mean, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-9
        a = self._design(x)
        w = np.zeros(a.shape[1])

        def loss(w):
            t = a @ w
            return (weight * (np.logaddexp(0, t) - y * t)).sum() + ridge / 2 * w @ w

        for _ in range(60):  # Newton steps on the penalised likelihood, halved until they descend
            p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
            h = (a * (weight * p * (1 - p))[:, None]).T @ a + ridge * np.eye(len(w))
            step, now = np.linalg.solve(h, a.T @ (weight * (y - p)) - ridge * w), loss(w)
            while loss(w + step) > now and np.abs(step).max() > 1e-9:
                step = step / 2
            w = w + step
        self.weights = w

    def score(self, texts: list[bytes]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self._design(self.features(texts)) @ self.weights, -30, 30)))


def _pieces(text: bytes, span: int) -> list[bytes]:
    """*text* cut evenly into pieces of *span* bytes or little more; a shorter one is one piece."""
    n = max(1, len(text) // span)
    cuts = [len(text) * i // n for i in range(n + 1)]
    return [text[a:b] for a, b in zip(cuts[:-1], cuts[1:])]


def _sample(docs: DataFrame, labels: DataFrame) -> dict[int, tuple[int, list[bytes]]]:
    """Per class: number of labelled documents, and a bounded sample of whole texts.

    Only ids and lengths are joined with the labels; the texts of the sample
    are then filtered out of one scan.
    """
    own = labels.where("quality in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.max("quality").alias("__y"))
    known = docs.where("doc_id is not null").where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(
        F.max(F.coalesce(F.octet_length("text"), F.lit(0))).alias("__n"))
    known = stage(known.join(own, "doc_id"), "labelled")
    counts, label = {}, {}
    for y, count in known.groupBy("__y").count().collect():  # two rows
        counts[y], room = count, SAMPLE_BYTES
        rows = known.where(F.col("__y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_DOCS).select("doc_id", "__n").collect()
        for doc_id, n in rows:
            if n <= room:
                label[doc_id] = y
                room -= n
    # of rows that share an id the longest text, of these the last in order: one row an id, at most 2 * SAMPLE_BYTES
    picked = docs.where(F.col("doc_id").isin(list(label))).groupBy("doc_id").agg(
        F.max(F.struct(F.coalesce(F.octet_length("text"), F.lit(0)), F.coalesce("text", F.lit("")).alias("t")))["t"].alias("t")).collect()
    texts = {r["doc_id"]: r["t"].encode() for r in picked}
    return {y: (n, [texts[d] for d in label if label[d] == y]) for y, n in counts.items()}


def fit(docs: DataFrame, labels: DataFrame) -> Model | None:
    """A model of *labels* (doc_id, quality) over *docs*; None without both classes."""
    sample = _sample(docs, labels)
    if len(sample) < 2:
        return None
    unseen = lambda t: zlib.crc32(t, 1) % 2
    model = Model(*(_dictionary([t for t in sample[y][1] if not unseen(t)] or sample[y][1]) for y in (1, 0)))
    texts, labelled, weight = [], [], []
    for y, (count, all_texts) in sample.items():
        own = [t for t in all_texts if unseen(t)] or all_texts
        texts, labelled, weight = texts + own, labelled + [y] * len(own), weight + [count / len(own)] * len(own)
    weight = np.array(weight)
    model.calibrate(model.features(texts), np.array(labelled, float), weight * len(weight) / weight.sum())
    return model


def _dictionary(texts: list[bytes]) -> bytes:
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, texts, level=LEVEL).as_bytes()
    except zstandard.ZstdError:  # too few texts to train on: their own bytes are the dictionary
        return b"\n".join(texts)[:DICTIONARY_BYTES] or b"\n" * 8


def _scored(model: Model | None, batches):
    """(slice, scores) of batches with a column ``text``, a few megabytes of text at a time."""
    only("quality")
    for batch in batches:
        for b in slices(batch, "text"):
            texts = [(t or "").encode() for t in b.column("text").to_pylist()]
            yield b, np.full(len(texts), 0.5) if model is None else model.score(texts)


def classify(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of *docs*."""
    model = fit(docs, labels)

    def run(batches):
        for b, s in _scored(model, batches):
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(s, pa.float64())], names=["doc_id", "held_out", "score"])
    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double").withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def good_rows(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of *docs* that ``classify`` predicts good, each judged by its own text, with all their columns."""
    model = fit(docs, labels)

    def run(batches):
        for b, s in _scored(model, batches):
            yield b.filter(pa.array(s >= threshold))
    return docs.mapInArrow(run, docs.schema)
