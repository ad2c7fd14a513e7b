"""A whole column of texts encoded at once: the library's ids, each distinct pre-token by the library once."""

import random

import numpy as np
import pyarrow as pa
import pytest

from cagetrace.llm import bpe

ATOMS = [" ", "  ", "\n", "\n\n", "\t", "\r\n", "\x1c", "\x85", "\xa0", "\u2003", "\u2028", "\u3000", "'", "'s", "'re", "’", "”", ".", "...", "-", "×", "÷", "é", "ß",
         "É", "e\u0301", "\u0301", "Σ", "İ", "한", "漢字", "жук", "ª", "²", "½", "7", "123", "a", "Foo", "don't", "naïve", "<|endoftext|>", "<|startoftext|>",
         "<|", "|>", "😀", "_", "\x7f", "ÿ", "þ", "\x00", "Ġ"]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
@pytest.mark.parametrize("split", [False, True])
def test_column_equals_the_library(name, split, monkeypatch):
    from tokenizers import Tokenizer
    monkeypatch.setattr(bpe, "_MOST_PARTS", 40)
    rng = random.Random(5)
    texts = ["".join(rng.choices(ATOMS, k=rng.randrange(14))) for _ in range(3000)] + [None, "", "x" * 90 + " é" * 90]
    tok, e = Tokenizer.from_file(bpe.vocabulary(name)), bpe.Encoder(bpe.vocabulary(name), split_special=split)
    tok.encode_special_tokens = split
    for k in range(0, len(texts), 500):
        some = pa.array(["before", *texts[k:k + 500]]).slice(1)
        for t, ids in zip(some.to_pylist(), e.encode_column(some).to_pylist(), strict=True):
            assert np.frombuffer(ids, e.dtype).tolist() == tok.encode(t or "", add_special_tokens=False).ids, t


def test_library_gets_each_distinct_word_once():
    """Blank lines and punctuation send no text to the library whole, nor a word again."""
    e, sent = bpe.Encoder(bpe.vocabulary("byte_bpe_50k.json")), []
    models, whole = e._models, e._whole
    e._models = lambda parts: (sent.extend(parts), models(parts))[1]
    e._whole = lambda texts: (sent.extend(texts), whole(texts))[1]
    rng = random.Random(3)
    words, marks = [f"wo{chr(97 + i)}rd" for i in range(20)], [",", ";;", " -", "\n\n", ".\n", " ("]
    for _ in range(4):
        texts = ["".join(f" {rng.choice(words)}{rng.choice(marks)}" for _ in range(50)) for _ in range(30)]
        got = e.encode_column(pa.array(texts)).to_pylist()
        assert [np.frombuffer(x, e.dtype).tolist() for x in got] == [x.ids for x in e.tok.encode_batch(texts, add_special_tokens=False)]
    assert len(sent) == len(set(sent)) <= 3 * len(words) + 10  # after a space, a blank line, a line's end and a space
