"""Token ids in length-delimited binary records, with an offset index.

A record: unsigned 64-bit length, masked checksum of the length, payload,
masked checksum of the payload (both CRC-32, rotated right by 15 bits plus a
constant, little-endian).  The payload: document id (64 bits), a flag byte
(1: the id is present), id width in bytes, then the ids, little-endian.
``<file>.idx`` holds offset and document id of each record (two signed
64-bit integers), so records can be read in any order.

Defined results: a null or empty text is just the end id; repeated rows are
all written, next to each other; rows without an id sort first; the rows of one
id are in order of their text, unless they fill more than a shard, when a hash
of the text comes before it.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cagetrace.llm import files
from cagetrace.llm.bpe import encode_batches, encoder, vocabulary
from cagetrace.llm.store import open_fs

SHARD_BYTES, ROLL_BYTES = 256 << 20, 64 << 20
END = 2


def masked(data: bytes) -> int:
    c = zlib.crc32(data)
    return ((c >> 15 | c << 17) + 0xA282EAD8) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    n = struct.pack("<Q", len(payload))
    return b"".join((n, struct.pack("<I", masked(n)), payload, struct.pack("<I", masked(payload))))


def unframe(data, at: int = 0) -> tuple[bytes, int]:
    """(payload, position after the record); raises on any damage."""
    head = bytes(data[at:at + 12])
    if len(head) < 12 or struct.unpack("<I", head[8:])[0] != masked(head[:8]):
        raise ValueError(f"damaged length at {at}")
    n = struct.unpack("<Q", head[:8])[0]
    payload, end = bytes(data[at + 12:at + 12 + n]), at + 16 + n
    if len(payload) < n or struct.unpack("<I", bytes(data[end - 4:end]))[0] != masked(payload):
        raise ValueError(f"damaged payload at {at}")
    return payload, end


def pack(doc_id: int | None, ids: np.ndarray) -> bytes:
    return struct.pack("<qBB", doc_id or 0, doc_id is not None, ids.dtype.itemsize) + ids.tobytes()


def unpack(payload: bytes) -> tuple[int | None, np.ndarray]:
    doc_id, present, width = struct.unpack_from("<qBB", payload)
    return (doc_id if present else None), np.frombuffer(payload, f"<u{width}", offset=10)


def _index(offsets, keys) -> bytes:
    return np.array([offsets, [0 if k is None else k for k in keys]], "<i8").T.tobytes()


def write_records(docs: DataFrame, folder: str, tokenizer: str, end: int = END) -> DataFrame:
    """Encode (doc_id, text) and write records in ascending doc_id order; the manifest."""
    def make():
        kind = encoder(tokenizer).dtype
        tail = np.array([end], kind)

        def record(doc_id, ids):
            ids = np.concatenate([np.frombuffer(ids, kind), tail])
            return frame(pack(doc_id, ids)), len(ids)
        return record

    docs = files.with_shards(docs.select("doc_id", "text"), "doc_id", F.coalesce(F.octet_length("text"), F.lit(0)) + 16, SHARD_BYTES)
    return files.write_files(docs, ["doc_id", "text"], ["doc_id", "text"], folder, ".rec", make, ROLL_BYTES, index=_index, prepare=lambda batches: encode_batches(batches, tokenizer))


def read_records(manifest: DataFrame, folder: str) -> DataFrame:
    """Every record, through its index: doc_id, start, n_tokens, ids_crc32, file, offset."""
    def run(batches):
        fs, root = open_fs(folder)
        for b in batches:
            for name, start in zip(b.column("name").to_pylist(), b.column("file_start").to_pylist()):
                with fs.open_input_stream(f"{root}/{name}.idx") as f:
                    index = np.frombuffer(f.read(), "<i8").reshape(-1, 2)
                rows = []
                with fs.open_input_file(f"{root}/{name}") as f:
                    size, k = f.size(), 0
                    while k < len(index):  # some MB at a time
                        to = max(k + 1, int(np.searchsorted(index[:, 0], index[k, 0] + (4 << 20))))
                        base = int(index[k, 0])
                        data = memoryview(f.read_at((int(index[to, 0]) if to < len(index) else size) - base, base))
                        for off in index[k:to, 0].tolist():
                            doc_id, ids = unpack(unframe(data, off - base)[0])
                            rows.append((doc_id, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), name, off))
                            start += len(ids)
                        k = to
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(),) * 4 + (pa.string(), pa.int64()))],
                                                         names=["doc_id", "start", "n_tokens", "ids_crc32", "file", "offset"])
                        rows = []
    return files.spread(files.starts(manifest)).mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long, file string, offset long")


def read_at(refs: DataFrame, folder: str) -> DataFrame:
    """Records of *refs* (file, offset), in the order of each task's rows: doc_id, ids."""
    def run(batches):
        fs, root = open_fs(folder)
        for b in batches:
            out = []
            for name, off in zip(b.column("file").to_pylist(), b.column("offset").to_pylist()):
                with fs.open_input_file(f"{root}/{name}") as f:
                    n = struct.unpack("<Q", f.read_at(8, off))[0]
                    out.append(unpack(unframe(f.read_at(n + 16, off))[0]))
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.int64()), pa.array([x.astype(np.int64) for _, x in out], pa.list_(pa.int64()))], names=["doc_id", "ids"])
    return refs.select("file", "offset").mapInArrow(run, "doc_id long, ids array<long>")


def round_trip(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """Write *docs* to a new shared folder and read the files back."""
    folder = files.new_folder(docs, "records")
    return read_records(write_records(docs, folder, tokenizer or vocabulary("byte_bpe_50k.json")), folder)
