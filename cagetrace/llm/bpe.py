"""Whole-text encoding with a tokenizers file, a column of texts at a time.

Both pre-tokenizers used here never let a token cross from a non-space
character into white space, nor between ASCII or Latin-1 letters, ASCII digits
and ASCII punctuation (the apostrophe aside), so a text may be cut there, but
not inside a special token's literal, and the parts encoded on their own; runs
of white space stay in one part with what follows.  Arrow finds a column's
distinct parts, and a worker keeps their packed ids.  New parts that are one
pre-token go to the file's BPE model, many at a time where a byte that no text
holds and no merge takes can stand between them; others to the whole tokenizer.
"""

from __future__ import annotations

import os
import re
import struct

import numpy as np
import pyarrow as pa

from cagetrace.llm.store import only
from cagetrace.llm.words import slices, text_bytes

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

_encoders: dict = {}
#: Parts in each of a worker's two cache generations (under 150 MB in all), and the longest kept
_MOST_PARTS, _LONGEST_PART = 300_000, 48
#: Text bytes encoded at a time
SLICE_BYTES = 4 << 20


def _byte_chars() -> dict[int, int]:
    """Byte -> character of the public byte-level alphabet: printable Latin-1 as is, others from 256 on."""
    keep = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return {b: b if b in keep else next(rest) for b in range(256)}


_CHARS = _byte_chars()
_CHAR_TABLE = np.array([_CHARS[b] for b in range(256)], "<u2")

#: A byte that is in no UTF-8 text, between pre-tokens that go to the model together, and how many do
_BETWEEN, _TOGETHER = 0xFF, 16
_LETTERS, _PUNCT = rb"(?:[A-Za-z]|\xC3[\x80-\x96\x98-\xB6\xB8-\xBF])+", rb"[!-&(-/:-@\[-`{-~]+"
#: One pre-token under the byte-level pattern; the other file makes each digit one and drops spaces
_ONE, _ONE_NO_SPACE = (re.compile(b" ?(?:" + b"|".join(x) + b")") for x in ((_LETTERS, b"[0-9]+", _PUNCT), (_LETTERS, _PUNCT)))
_OTHER, _LETTER, _DIGIT, _MARK, _SPACE, _LINE, _WHITE, _HIGH = range(8)
_CUT, _IF_NOT_WHITE, _IF_ALONE = 1, 2, 3
#: Last bytes of white space characters outside ASCII
_WIDE_WHITE = [0xE19A80, *range(0xE28080, 0xE2808B), 0xE280A8, 0xE280A9, 0xE280AF, 0xE2819F, 0xE38080]


def _classes() -> tuple[np.ndarray, np.ndarray]:
    """(class of a byte, what to do between bytes of two classes: 8 * class before + class after)."""
    of, pair = np.zeros(256, np.uint8), np.zeros((8, 8), np.uint8)
    for c in range(0x21, 0x7F):
        of[c] = _LETTER if chr(c).isalpha() else _DIGIT if chr(c).isdigit() else _MARK
    of[ord("'")] = _OTHER  # may start a contraction
    of[0x80:] = _HIGH
    of[[*range(9, 14), *range(28, 32)]] = _WHITE
    of[0x20], of[0x0A] = _SPACE, _LINE
    runs = [_LETTER, _DIGIT, _MARK]
    for a in runs:
        pair[a, [b for b in runs if b != a]] = _CUT
    pair[np.ix_([_OTHER, *runs], [_SPACE, _LINE])] = _CUT
    pair[_HIGH, [_SPACE, _LINE]] = _IF_NOT_WHITE
    pair[_LINE, runs] = _IF_ALONE
    return of, pair.ravel()


_CLASS, _PAIR = _classes()


def _cuts(data: np.ndarray, off: np.ndarray, literals: list[bytes]) -> np.ndarray:
    """Bounds of the parts of texts (bytes, offsets): where no token crosses and either side is encoded as in the whole."""
    cut = np.zeros(len(data) + 1, bool)
    cls = _CLASS[data]
    lead = np.flatnonzero(data[:-1] == 0xC3)
    lead = lead[~np.isin(data[lead + 1], (0x97, 0xB7))]  # the signs between the letters
    cls[lead] = cls[lead + 1] = _LETTER
    what = _PAIR[cls[:-1] << 3 | cls[1:]]
    at = np.flatnonzero(what) + 1
    what = what[at - 1]
    cut[at[what == _CUT]] = True
    high = at[what == _IF_NOT_WHITE]
    last = [data[np.maximum(high - k, 0)].astype(np.int64) for k in (3, 2, 1)]
    two = last[1] << 8 | last[2]
    cut[high] = ~(np.isin(last[0] << 16 | two, _WIDE_WHITE) | np.isin(two, (0xC285, 0xC2A0)))
    whole = None
    for x in literals:
        whole = data.tobytes() if whole is None else whole
        i = whole.find(x)
        while i >= 0:
            cut[i + 1:i + len(x)] = False
            i = whole.find(x, i + 1)
    cut[off] = True
    line = at[what == _IF_ALONE]  # a line's end between two other characters, a token of its own
    cut[line] |= cut[line - 1]
    return np.flatnonzero(cut)


def vocabulary(name: str) -> str:
    """Path of a public tokenizer file."""
    import public_tokenizers
    return public_tokenizers.path(name)


class Encoder:
    """Encodes texts to packed little-endian ids (uint16 if the vocabulary fits).

    With *split_special* the literals of special tokens are ordinary text, so
    that their ids occur in no document.
    """

    def __init__(self, path: str, split_special: bool = False):
        from tokenizers import Tokenizer
        self.tok = Tokenizer.from_file(path)
        self.tok.encode_special_tokens = split_special
        added = self.tok.get_added_tokens_decoder().values()
        added = [t for t in added if not (split_special and t.special)]
        self.literals = [t.content for t in added]
        # Literals that could reach over a cut: then texts are not cut at all.
        self.reach = any(re.search(r"\s", t.content) or t.lstrip or t.rstrip or t.single_word or t.normalized and self.tok.normalizer for t in added)
        self.model = self.tok.model
        self.dtype = np.dtype("<u2" if self.tok.get_vocab_size() <= 1 << 16 else "<u4")
        # A normalizer that folds white space drops it: any cut at a space is safe.
        self.drops_space = self.tok.normalizer is not None
        self.parts: dict[bytes, bytes] = {}
        self.parts_older: dict[bytes, bytes] = {}
        self.between = None
        between = chr(_CHARS[_BETWEEN])
        if not self.drops_space and not self.model.continuing_subword_prefix and not self.model.end_of_word_suffix:
            vocab = self.tok.get_vocab(with_added_tokens=False)
            if sum(between in t for t in vocab) == 1:  # so it is in no merge
                self.between = vocab.get(between)

    def _pack(self, ids: list[int]) -> bytes:
        return struct.pack(f"<{len(ids)}{'H' if self.dtype.itemsize == 2 else 'I'}", *ids)

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [self._pack(e.ids) for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def _models(self, parts: list[bytes]):
        """Ids of parts that are one pre-token each, by the file's BPE model."""
        tokenize = self.model.tokenize
        if self.between is None:
            chars = ((p.strip().decode().lower().encode() if self.drops_space else p).decode("latin1").translate(_CHARS) for p in parts)
            yield from (self._pack([t.id for t in tokenize(c)]) for c in chars)
            return
        joined = bytes([_BETWEEN]).join(parts)
        chars = _CHAR_TABLE[np.frombuffer(joined, np.uint8)].tobytes().decode("utf-16-le")
        ends = np.cumsum([len(p) + 1 for p in parts]).tolist()
        ids, start = [], 0
        for end in [*ends[_TOGETHER - 1:-1:_TOGETHER], *ends[-1:]]:
            ids += [t.id for t in tokenize(chars[start:end - 1])]
            ids.append(self.between)
            start = end
        ids = np.array(ids, self.dtype)
        data, width, start = ids.tobytes(), self.dtype.itemsize, 0
        for end in np.flatnonzero(ids == self.between).tolist():
            yield data[start * width:end * width]
            start = end + 1

    def _look_up(self, parts: list[bytes]) -> list[bytes]:
        """Ids of distinct parts: known, or by the library now."""
        if len(self.parts) > _MOST_PARTS:
            self.parts, self.parts_older = {}, self.parts
        found = list(map(self.parts.get, parts))
        one, rest = [], []
        pattern = (_ONE_NO_SPACE if self.drops_space else _ONE).fullmatch
        for i in [i for i, x in enumerate(found) if x is None]:
            p = parts[i]
            x = self.parts_older.get(p)
            if x is None:
                (one if pattern(p) and len(p) <= _LONGEST_PART else rest).append(i)
            else:
                found[i] = self.parts[p] = x
        for at, new in ((one, self._models([parts[i] for i in one])), (rest, self._whole([parts[i].decode() for i in rest]))):
            for i, x in zip(at, new):
                found[i] = x
                if len(parts[i]) <= _LONGEST_PART:
                    self.parts[parts[i]] = x
        return found

    def encode_column(self, texts) -> pa.Array:
        """Packed ids of each text of an Arrow column; empty for an empty or null one."""
        data, off = text_bytes(texts)
        bounds = np.unique(off) if self.reach else _cuts(data, off, [x.encode() for x in self.literals])
        parts = _binary(bounds, data).dictionary_encode()
        _, at, distinct = parts.dictionary.buffers()
        at = np.frombuffer(at, np.int64)[:len(parts.dictionary) + 1].tolist()
        distinct = distinct.to_pybytes() if distinct else b""
        ids = self._look_up([distinct[a:b] for a, b in zip(at, at[1:])])
        ends = np.zeros(len(ids) + 1, np.int64)
        np.cumsum([len(x) for x in ids], out=ends[1:])
        ids = _binary(ends, b"".join(ids)).take(parts.indices)
        _, ends, data = ids.buffers()
        ends = np.frombuffer(ends, np.int64)[:len(ids) + 1]
        return _binary(ends[np.searchsorted(bounds, off)], data)

    def encode(self, text: str) -> bytes:
        """Packed ids of one text; empty for an empty text."""
        return self.encode_column(pa.array([text]))[0].as_py()


def _binary(off: np.ndarray, data) -> pa.Array:
    """Byte strings from offsets and bytes."""
    return pa.Array.from_buffers(pa.large_binary(), len(off) - 1, [None, pa.py_buffer(np.ascontiguousarray(off, np.int64)), data if isinstance(data, pa.Buffer) else pa.py_buffer(data)])


def encoder(path: str, split_special: bool = False) -> Encoder:
    """The worker's encoder of a file."""
    only("bpe", _encoders.clear)
    if (path, split_special) not in _encoders:
        _encoders[path, split_special] = Encoder(path, split_special)
    return _encoders[path, split_special]


def encode_batches(batches, tokenizer: str, split_special: bool = False):
    """Slices of a task's batches with packed ids in place of ``text``."""
    enc = encoder(tokenizer, split_special)
    for b in (part for batch in batches for part in slices(batch, "text", SLICE_BYTES)):
        yield b.set_column(b.schema.get_field_index("text"), "text", enc.encode_column(b.column("text")))
