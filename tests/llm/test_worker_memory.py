"""What Python workers hold on to between the stages."""

import numpy as np
import pandas as pd
import pyarrow as pa

from cagetrace.llm import bpe, packing, store, words


def test_packing_rounds_free_the_encoder():
    bpe.encoder(bpe.vocabulary("word_bpe_49k.json")).encode("some words here")
    none = pd.DataFrame({"problem": [], "island": [], "bins": [], "fit": [], "genes": []})
    out = packing._round(0, 4096)((0, 0), pd.DataFrame({"row": [1, 2], "length": [5, 7]}), none)
    assert out["bins"].tolist()[0] == 1 and not bpe._encoders


def test_slices_give_unused_memory_back(monkeypatch):
    called = []
    monkeypatch.setattr(words, "tidy", lambda: called.append(1), raising=False)
    batch = pa.RecordBatch.from_arrays([pa.array(["abc def"] * 9)], names=["text"])
    assert sum(s.num_rows for s in words.slices(batch, "text", 20)) == 9 and called == [1]


def test_pieces_come_in_order_from_slices(monkeypatch):
    rows = [(i, "word " * (i * 700)) for i in range(12)]
    whole = {i: bpe.encoder(bpe.vocabulary("word_bpe_49k.json")).encode(t) for i, t in rows}
    held = []

    class Docs:
        def select(self, *_):
            return self

        def mapInArrow(self, run, _):
            held.append(run)
    packing.cut(Docs(), bpe.vocabulary("word_bpe_49k.json"), limit=256)
    monkeypatch.setattr(packing, "slices", lambda b, c: words.slices(b, c, 4000))
    batch = pa.RecordBatch.from_arrays([pa.array([i for i, _ in rows]), pa.array([t for _, t in rows])], names=["doc_id", "text"])
    out = pa.Table.from_batches(held[0]([batch])).to_pandas()
    for i, t in rows:
        n = len(np.frombuffer(whole[i], "<u2")) + 1
        mine = out[out.doc_id == i]
        assert mine.piece.tolist() == list(range(-(-n // 256))) and mine.length.sum() == n
    assert store._holder[0] == "bpe"
