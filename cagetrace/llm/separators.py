"""Token counts of flat, unindexed token files by a separator scan.

A file is nothing but ids of one width; every document ends with the
end-of-document id, which occurs nowhere else.  Files are cut into blocks of
fixed size that any task can read on its own; a block reports the places of
its separators, found by one vectorised comparison.  A prefix scan over the
blocks of a file then gives each block the last separator before it and the
number of documents so far, which stitches documents across blocks.

Defined results: an empty document counts 0 tokens; tokens after a file's
last separator are a last, unterminated document; a null text is empty.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cagetrace.llm import files
from cagetrace.llm.bpe import encode_batches, encoder, vocabulary
from cagetrace.llm.store import open_fs, stage

ROLL_BYTES = 64 << 20
BLOCK_TOKENS = 1 << 20


def write_flat(docs: DataFrame, folder: str, tokenizer: str, end: int) -> DataFrame:
    """Encode (doc_id, text) into flat files, in the rows' order and without a shuffle; the manifest keeps the order of the ids."""
    def make():
        kind = encoder(tokenizer, split_special=True).dtype
        tail = np.array([end], kind).tobytes()

        def record(doc_id, ids):
            data = ids + tail
            return data, len(data) // kind.itemsize
        return record

    return files.write_files(docs.select("doc_id", "text"), [], ["doc_id", "text"], folder, ".bin", make, ROLL_BYTES,
                             prepare=lambda batches: encode_batches(batches, tokenizer, split_special=True))  # the separator is in no document


def scan(listing: DataFrame, folder: str, end: int, width: int, block: int = BLOCK_TOKENS) -> DataFrame:
    """Documents of the files of *listing* (name, bytes): name, ordinal, start, n_tokens, terminated."""
    def run(batches):
        fs, root = open_fs(folder)
        for b in batches:
            for name, k, size in zip(*(b.column(c).to_pylist() for c in ("name", "block", "bytes"))):
                at = k * block * width
                with fs.open_input_file(f"{root}/{name}") as f:
                    ids = np.frombuffer(f.read_at(min(block * width, size - at), at), f"<u{width}")
                seps = np.flatnonzero(ids == end) + k * block
                yield pa.RecordBatch.from_arrays([
                    pa.array([name]), pa.array([k], pa.int64()), pa.array([len(ids)], pa.int64()), pa.array([len(seps)], pa.int64()),
                    pa.array([int(seps[-1]) if len(seps) else None], pa.int64()), pa.array([seps], pa.list_(pa.int64()))],
                    names=["name", "block", "n", "n_sep", "last_sep", "seps"])

    last = F.greatest(F.lit(0), F.ceil(F.col("bytes") / (block * width)) - 1)
    blocks = listing.where("bytes > 0").select("name", "bytes", F.explode(F.sequence(F.lit(0).cast("long"), last.cast("long"))).alias("block"))
    found = stage(files.spread(blocks).mapInArrow(run, "name string, block long, n long, n_sep long, last_sep long, seps array<long>"), "blocks")
    w = Window.partitionBy("name").orderBy("block")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    carry = found.select("name", "block", F.coalesce(F.max("last_sep").over(before), F.lit(-1)).alias("from"),
                         F.coalesce(F.sum("n_sep").over(before), F.lit(0)).alias("docs"))
    here = found.where("n_sep > 0").select("name", "block", "seps").join(carry, ["name", "block"])
    whole = here.select("name", "from", "docs", "seps", F.posexplode("seps").alias("i", "sep")).select(
        "name", (F.col("docs") + F.col("i")).alias("ordinal"),
        (F.when(F.col("i") == 0, F.col("from")).otherwise(F.get("seps", F.col("i") - 1)) + 1).alias("start"), "sep")
    whole = whole.select("name", "ordinal", "start", (F.col("sep") - F.col("start")).alias("n_tokens"), F.lit(True).alias("terminated"))
    ends = found.groupBy("name").agg(F.sum("n").alias("n"), F.sum("n_sep").alias("ordinal"), (F.coalesce(F.max("last_sep"), F.lit(-1)) + 1).alias("start"))
    tails = ends.where("n > start").select("name", "ordinal", "start", (F.col("n") - F.col("start")).alias("n_tokens"), F.lit(False).alias("terminated"))
    return whole.unionByName(tails)


def token_counts(docs: DataFrame, tokenizer: str | None = None, end: int = 50256) -> DataFrame:
    """doc_id and n_tokens (without the end id) of each row, counted in flat files of *docs*."""
    folder = files.new_folder(docs, "flat")
    tokenizer = tokenizer or vocabulary("byte_bpe_50k.json")
    manifest = write_flat(docs, folder, tokenizer, end)
    found = scan(manifest.select("name", "bytes"), folder, end, encoder(tokenizer).dtype.itemsize)
    order = manifest.select("name", F.posexplode("keys").alias("ordinal", "doc_id"))
    return found.join(order, ["name", "ordinal"]).select("doc_id", "n_tokens")
