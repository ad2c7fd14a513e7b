"""Vectorised word hashing over whole Arrow text columns.

Texts are handled as UTF-8 bytes: both word rules used here keep every byte
of a non-ASCII character, so byte classes decide exactly as the character
patterns do.  A word's 64-bit hash is a polynomial over its lower-cased
(A-Z) bytes, finished by a mixer; equal words have equal hashes.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa

from cagetrace.llm.store import only, tidy

U = np.uint64
_BASE = U(0x9E3779B97F4A7C15)
_BASE_INV = U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_BLOCK, _LONG = 1 << 16, 1 << 16  # a block of products stays in a core's cache
_pow: list[np.ndarray] = []

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
AS_IS = np.arange(256, dtype=np.uint8)
_b = np.arange(256)
#: ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]`` after lower-casing
ALNUM = ((_b >= 0x30) & (_b <= 0x39)) | ((_b >= 0x41) & (_b <= 0x5A)) | ((_b >= 0x61) & (_b <= 0x7A)) | (_b >= 0x80)
#: ``[^\x20\x09-\x0D]``
NON_SPACE = ~((_b == 0x20) | ((_b >= 0x09) & (_b <= 0x0D)))


def _powers() -> list[np.ndarray]:
    only("words", _pow.clear)
    if not _pow:
        n = _BLOCK + 2 * _LONG
        for base in (_BASE, _BASE_INV):
            p = np.full(n, base, dtype=U)
            p[0] = 1
            with np.errstate(over="ignore"):
                _pow.append(np.cumprod(p, dtype=U))
    return _pow


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finisher (the public splitmix64 constants)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
        return x ^ (x >> U(31))


def text_bytes(col) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of an Arrow string column; null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if not pa.types.is_large_string(col.type):
        col = col.cast(pa.large_string())
    if col.null_count:
        col = col.fill_null("")
    if not len(col):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, off, data = col.buffers()
    off = np.frombuffer(off, np.int64)[col.offset:col.offset + len(col) + 1]
    lo, hi = int(off[0]), int(off[-1])
    data = np.frombuffer(data, np.uint8)[lo:hi] if data is not None and hi > lo else np.zeros(0, np.uint8)
    return data, off - lo


def slices(batch: pa.RecordBatch, column: str, most: int = 2 << 20):
    """Cut a batch into row slices of about *most* text bytes (one row at least); then memory left unused goes back."""
    if not batch.num_rows:
        return
    _, off = text_bytes(batch.column(column))
    i = 0
    while i < batch.num_rows:
        j = max(i + 1, int(np.searchsorted(off, off[i] + most, side="right")) - 1)
        yield batch.slice(i, j - i)
        i = j
    tidy()


def words(data: np.ndarray, off: np.ndarray, cls: np.ndarray, fold: np.ndarray = LOWER):
    """(hash per word, index of each text's first word (n+1), start byte, end byte).

    Words are runs of bytes in *cls*; *fold* maps the bytes that are hashed
    (``AS_IS`` keeps upper case apart).
    """
    n = len(data)
    if not n:
        z = np.zeros(0, np.int64)
        return np.zeros(0, U), np.zeros(len(off), np.int64), z, z
    isw = cls[data]
    st, en = isw.copy(), isw.copy()
    st[1:] &= ~isw[:-1]
    en[:-1] &= ~isw[1:]
    inner = off[(off > 0) & (off < n)]
    st[inner] = isw[inner]
    en[inner - 1] = isw[inner - 1]
    starts, ends = np.flatnonzero(st), np.flatnonzero(en) + 1
    first = np.searchsorted(starts, off)
    out = np.empty(len(starts), U)
    pw, ipw = _powers()
    long = np.flatnonzero(ends - starts > _LONG)
    k = 0
    with np.errstate(over="ignore"):
        while k < len(starts):
            if ends[k] - starts[k] > _LONG:
                d = fold[data[starts[k]:ends[k]]].tobytes()
                out[k] = int.from_bytes(hashlib.blake2b(d, digest_size=8).digest(), "little")
                k += 1
                continue
            a = starts[k]
            e = int(np.searchsorted(starts, a + _BLOCK))
            nxt = np.searchsorted(long, k)
            if nxt < len(long):
                e = min(e, int(long[nxt]))
            b = ends[e - 1]
            c = np.zeros(b - a + 1, U)
            np.cumsum(fold[data[a:b]].astype(U) * pw[:b - a], out=c[1:])
            s, t = starts[k:e] - a, ends[k:e] - a
            out[k:e] = (c[t] - c[s]) * ipw[s] + (t - s).astype(U) * U(0xD6E8FEB86659FD93)
            k = e
    return mix(out), first, starts, ends


_COEF = [U(x) for x in (np.arange(1, 65, dtype=np.uint64) * U(0xC2B2AE3D27D4EB4F) | U(1))]


def grams(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of *n* word hashes (across texts; callers mask ends)."""
    if len(h) < n:
        return np.zeros(0, U)
    with np.errstate(over="ignore"):
        g = np.full(len(h) - n + 1, U(n))
        for k in range(n):
            g += h[k:len(h) - n + 1 + k] * _COEF[k]
    return mix(g)


def text_of_word(first: np.ndarray) -> np.ndarray:
    """Row number of each word."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


def array_column(values: np.ndarray, counts: np.ndarray, kind=pa.int64()) -> pa.ListArray:
    """A list column from flat values and the number of values per row."""
    off = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=off[1:])
    return pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.array(values.view(np.int64) if values.dtype == U else values, kind))
