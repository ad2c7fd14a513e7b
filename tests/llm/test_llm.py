"""Operators of the llm subpackage against brute force, round trips and odd rows."""
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from cagetrace.llm import (ann, bpe, chat, files, line_dedup, near_dup, packing, quality, queries, records,
                           separators, warc, winnow, words)

SF = "/root/testdata/sf0.001"
AZ = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
#: names that the operators use themselves
CLASH = "rid string, gone string, key string, n string, id string, first string, shard string, marks string"


def prose(rng, n):
    return " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "eps", "zeta", "eta"]) + str(rng.randrange(40)) for _ in range(n))


def odd_rows():
    rng = random.Random(1)
    a, b = prose(rng, 120), prose(rng, 90)
    long = prose(rng, 30_000)
    near = a.split(" ")
    near[60] = "changed"
    return [(1, a), (1, a), (2, None), (3, ""), (4, " \n\t "), (5, "one"), (6, "one two"), (7, " ".join(near)), (8, b + "\n" + b),
            (9, long), (None, a), (None, None), (10, "É é́ \x1c a　b \n\n x  y"), (11, "y" * 70_000), (12, b), (None, a)]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(d, t, *["x"] * 8) for d, t in odd_rows()]
    return spark.createDataFrame(rows, f"doc_id long, text string, {CLASH}").repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string")


def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def shingles(text, size):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(AZ))
    return {tuple(w[i:i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()


def brute_components(rows, size, percent):
    sets = [(d, shingles(t, size)) for d, t in rows if d is not None]
    root = {d: d for d, _ in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for i, (a, s) in enumerate(sets):
        for b, t in sets[:i]:
            if s and t and 100 * len(s & t) >= percent * len(s | t):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {d: find(d) for d, _ in sets}


@pytest.mark.parametrize("size,percent", [(3, 85), (5, 80)])
def test_near_duplicates_brute(spark, odd, size, percent):
    for df in (docs(spark).select("doc_id", "text"), odd):
        rows = [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
        want, out = brute_components(rows, size, percent), near_dup.near_duplicates(df, size, percent).collect()
        assert len(out) == len(rows)
        assert {r.doc_id: r.component_id for r in out if r.doc_id is not None} == want
        assert all(r.kept for r in out if r.doc_id is None)
        assert sorted((r.doc_id, r.n_shingles) for r in out if r.doc_id is not None) == sorted((d, len(shingles(t, size))) for d, t in rows if d is not None)


def test_near_duplicates_chain_and_small_blocks(spark, monkeypatch):
    """Members of a bucket that its centre misses are still linked with each other, also across blocks."""
    monkeypatch.setattr(near_dup, "BLOCK", 4)
    rng, base = random.Random(7), [f"w{i}" for i in range(200)]
    rows = []
    for d in range(60):
        w = list(base)
        for _ in range(rng.randrange(1, 14)):
            w[rng.randrange(200)] = f"x{rng.random()}"
        rows.append((d, " ".join(w)))
    out = near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 3, 85).collect()
    assert {r.doc_id: r.component_id for r in out} == brute_components(rows, 3, 85)


def test_signature_filter_spares_pairs_at_the_threshold():
    """10,000 pairs of exactly 0.8, a union of 50 shingles."""
    rng, least = np.random.default_rng(5), 1.0
    for _ in range(10_000):
        x = rng.integers(0, 1 << 64, 50, dtype=np.uint64)
        a, b = (near_dup.signature(np.sort(s)) & np.uint64(255) for s in (x[:45], np.concatenate([x[:40], x[45:]])))
        least = min(least, (a == b).mean())
    assert 0.8 - near_dup.SLACK <= least < 0.7


def brute_lines(rows, least, percent):
    """Kept line numbers per row, rows in order."""
    seen, kept = [], []
    for _, text in rows:
        own = []
        for i, line in enumerate((text or "").split("\n")):
            s = set(re.findall(r"[^\x20\x09-\x0D]+", line.translate(AZ)))
            if len(s) < least:
                own.append(i)
                continue
            if not any(100 * len(s & t) >= percent * len(s | t) for t in seen):
                own.append(i)
            seen.append(s)
        kept.append(own)
    return kept


def test_line_dedup_brute(spark, odd):
    rng = random.Random(3)
    lines = [prose(rng, rng.randrange(3, 14)) for _ in range(60)]
    lines += [" ".join(w for w in x.split() if rng.random() > 0.08) for x in lines]
    rows = [(d, "\n".join(rng.choices(lines, k=rng.randrange(1, 6)))) for d in range(80)]
    out = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()
    got = {r.doc_id: r.text for r in out}
    for (d, t), keep in zip(rows, brute_lines(rows, 5, 80)):
        parts = t.split("\n")
        assert got[d] == "\n".join(parts[i] for i in keep), d
    rows = sorted(set(odd_rows()), key=lambda r: (r[0] is None, r[0] or 0, r[1] or ""))
    out = line_dedup.dedup_lines(odd)
    assert set(odd.columns) < set(out.columns) and out.count() == odd.count()
    got = {(r.doc_id): r.text for r in out.where("doc_id is not null").collect()}
    for (d, t), keep in zip(rows, brute_lines(rows, 5, 80)):
        if d is not None:
            assert got[d] == (None if t is None else "\n".join(t.split("\n")[i] for i in keep)), d


def test_line_dedup_takes_short_lines(spark):
    """Lines of one to five words, and lines without spaces, against brute force."""
    rng = random.Random(9)
    lines = [" ".join(rng.sample(["a", "b", "c", "d", "e", "f", "g"], rng.randrange(1, 7))) for _ in range(40)]
    lines += ["", " \t", "All rights reserved.", "all RIGHTS reserved.", "一行没有空格", "http://x/" + "y" * 300]
    rows = [(d, "\n".join(rng.choices(lines, k=rng.randrange(1, 4)))) for d in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r.doc_id: r.text for r in line_dedup.dedup_lines(docs, least=line_dedup.EVERY).collect()}
    report = {r.doc_id: r.n_removed for r in line_dedup.line_report(docs).collect()}
    for (d, t), keep in zip(rows, brute_lines(rows, 1, 80)):
        parts = t.split("\n")
        keep = sorted({*keep, *(i for i, x in enumerate(parts) if not x.strip())})
        assert got[d] == "\n".join(parts[i] for i in keep), d
        assert report[d] == len(parts) - len(keep), d


def test_winnowing_brute_with_short_items_and_nulls(spark, odd):
    rng = random.Random(5)
    rows = [(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect()]
    items = [(0, "one two"), (1, " ".join(odd_rows()[0][1].split(" ")[20:45])), (2, None), (3, ""), (4, prose(rng, 30)), (None, "one"), (5, "one two")]
    bench = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, marks string")
    word = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(AZ))
    out = winnow.decontaminate(odd, bench).collect()
    assert len(out) == len(rows)
    for r in out:
        if r.doc_id is None:
            continue
        w = word(next(t for d, t in rows if d == r.doc_id))
        hit, found = set(), set()
        for i, t in items:
            x = word(t)
            n = min(13, len(x))
            for k in range(len(x) - n + 1 if x else 0):
                for j in range(len(w) - n + 1):
                    if w[j:j + n] == x[k:k + n]:
                        hit |= set(range(j, j + n))
                        found |= {i} - {None}
        ids = ",".join(sorted(map(str, found)))
        assert (r.n_words, r.n_hit, r.n_items, r.items_sha256) == (len(w), len(hit), len(found), hashlib.sha256(ids.encode()).hexdigest()), r.doc_id
        assert r.contaminated == (len(hit) > 0 and 20 * len(hit) >= len(w))


def test_winnowing_judges_each_row_by_its_text(spark):
    """Null and repeated ids: every row has the hits of its own text."""
    passage, clean = " ".join(f"p{i}" for i in range(20)), " ".join(f"c{i}" for i in range(30))
    rows = [(None, passage), (None, clean), (None, passage), (None, None), (1, passage), (1, clean), (1, f"x {passage} {clean}"), (2, clean), (3, passage), (3, passage)]
    out = winnow.decontaminate(spark.createDataFrame(rows, "doc_id long, text string").repartition(3),
                               spark.createDataFrame([(7, passage)], "item_id long, text string")).collect()
    want = [(d, len((t or "").split()), 20 * (passage in (t or "")), int(passage in (t or "")), passage in (t or "")) for d, t in rows]
    assert sorted(((r.doc_id, r.n_words, r.n_hit, r.n_items, r.contaminated) for r in out), key=str) == sorted(want, key=str)


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_encoder_equals_the_library(spark, name):
    e = bpe.Encoder(bpe.vocabulary(name))
    texts = [t for _, t in odd_rows() if t] + [r.text for r in docs(spark).select("text").collect()]
    texts += ["a   b", " a", "a ", "a\n\n b", "it's\tx", "<|endoftext|> <|startoftext|>", "\r\n", "Σ ΑΣ b", "한 글", "é x"]
    for t in texts:
        assert np.frombuffer(e.encode(t), e.dtype).tolist() == e.tok.encode(t, add_special_tokens=False).ids, t[:60]


SPECIAL = ["a <|endoftext|> b", "<|endoftext|>", "x<|startoftext|>y z", "a  <|ENDOFTEXT|>", "b\n<|endoftext|>\n\nc <|endoftext|"]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_special_literals_as_the_library_encodes_them(spark, name):
    from tokenizers import Tokenizer
    path = bpe.vocabulary(name)
    tok, split = Tokenizer.from_file(path), Tokenizer.from_file(path)
    split.encode_special_tokens = True
    ids = lambda t, x: x.encode(t, add_special_tokens=False).ids
    for t in SPECIAL + [t for _, t in odd_rows() if t]:
        for e, x in ((bpe.Encoder(path), tok), (bpe.Encoder(path, split_special=True), split)):
            assert np.frombuffer(e.encode(t), e.dtype).tolist() == ids(t, x), t[:60]


def test_special_literals_in_the_operators(spark):
    """op4 and op9 give a literal its special id; op6 splits it, so its separator is in no document."""
    from tokenizers import Tokenizer
    ids = lambda name, t: Tokenizer.from_file(bpe.vocabulary(name)).encode(t, add_special_tokens=False).ids
    crc = lambda x: zlib.crc32(np.array(x, "<u4").tobytes())
    df = spark.createDataFrame(list(enumerate(SPECIAL)), "doc_id long, text string")
    got = {r.doc_id: (r.n_tokens, r.ids_crc32) for r in records.round_trip(df).collect()}
    for d, t in enumerate(SPECIAL):
        x = [*ids("byte_bpe_50k.json", t), records.END]
        assert got[d] == (len(x), crc(x)), t
    got = {r.doc_id: (r.length, r.ids_crc32) for r in packing.pack_documents(df).collect()}
    for d, t in enumerate(SPECIAL):
        x = [*ids("word_bpe_49k.json", t), packing.END]
        assert got[d] == (len(x), crc(x)), t
    counts = separators.token_counts(df).collect()
    assert sorted(r.doc_id for r in counts) == list(range(len(SPECIAL))) and min(r.n_tokens for r in counts) > 1


def test_records_and_separators_round_trip(spark, odd, monkeypatch):
    monkeypatch.setattr(records, "ROLL_BYTES", 20_000)
    tok = bpe.Encoder(bpe.vocabulary("byte_bpe_50k.json")).tok
    ids = lambda t: tok.encode(t or "", add_special_tokens=False).ids
    folder = files.new_folder(odd, "t")
    manifest = records.write_records(odd, folder, bpe.vocabulary("byte_bpe_50k.json"))
    back = records.read_records(manifest, folder)
    want = sorted(((d, len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for d, x in ((d, [*ids(t), 2]) for d, t in odd_rows())), key=lambda r: (r[0] is not None, r))
    got = sorted(((r.doc_id, r.n_tokens, r.ids_crc32, r.start) for r in back.collect()), key=lambda r: r[3])
    assert [r[0] for r in got if r[0] is not None] == sorted(d for d, _ in odd_rows() if d is not None)
    assert sorted((r[:3] for r in got), key=lambda r: (r[0] is not None, r[0] or 0, r)) == sorted(want, key=lambda r: (r[0] is not None, r[0] or 0, r))
    total = 0
    for r in got:
        assert r[3] == total
        total += r[1]
    assert manifest.count() > 3
    refs = back.select("file", "offset").orderBy(F.rand(3)).limit(5)
    assert all(x.ids[-1] == 2 for x in records.read_at(refs, folder).collect())
    with pytest.raises(ValueError):
        records.unframe(records.frame(b"abc")[:-1] + b"\0")
    counts = separators.token_counts(odd).collect()
    assert sorted((r.doc_id or -1, r.n_tokens) for r in counts) == sorted((d or -1, len(ids(t))) for d, t in odd_rows())


def test_separator_scan_stitches_blocks(spark, tmp_dir):
    rng = np.random.default_rng(1)
    folder, rows = f"file://{tmp_dir}", []
    for f, tail in ((0, 5), (1, 0), (2, 0)):
        x = rng.integers(10, 20, 5000).astype("<u4")
        x[rng.choice(5000, 40, replace=False)] = 3
        x[100:102] = 3                       # an empty document
        x[4999 - tail] = 3
        x[5000 - tail:] = 9
        (x[:0] if f == 2 else x).tofile(f"{tmp_dir}/f{f}")
        rows.append((f"f{f}", 0 if f == 2 else 20000))
    out = separators.scan(spark.createDataFrame(rows, "name string, bytes long"), folder, 3, 4, block=64).orderBy("name", "ordinal").collect()
    for f, tail in ((0, 5), (1, 0)):
        x = np.fromfile(f"{tmp_dir}/f{f}", "<u4")
        ends = np.flatnonzero(x == 3)
        want = list(np.diff(np.concatenate([[-1], ends])) - 1) + [tail] * (tail > 0)
        own = [r for r in out if r.name == f"f{f}"]
        assert [r.n_tokens for r in own] == want and [r.ordinal for r in own] == list(range(len(want)))
        assert [r.terminated for r in own] == [True] * len(ends) + [False] * (tail > 0)
    assert not [r for r in out if r.name == "f2"]


def test_packing(spark, odd):
    for df in (docs(spark), odd):
        out = packing.pack_documents(df).collect()
        by = {}
        for r in out:
            by.setdefault(r.sequence_id, []).append((r.offset, r.length))
        for rows in by.values():
            at = 0
            for o, n in sorted(rows):
                assert o == at
                at += n
            assert at <= 4096
        total = sum(r.length for r in out)
        assert len(by) <= total / 4096 * 1.05 + 1
        per = {}
        for r in out:
            per.setdefault((r.doc_id, r.piece), []).append(r)
        assert len(out) >= df.count() and all(r.start == r.piece * 4096 for r in out)
    enc = bpe.Encoder(bpe.vocabulary("word_bpe_49k.json"))
    ids = np.append(np.array(enc.tok.encode(odd_rows()[9][1], add_special_tokens=False).ids, "<u4"), np.array([1], "<u4"))
    mine = sorted((r for r in out if r.doc_id == 9), key=lambda r: r.piece)
    assert [r.ids_crc32 for r in mine] == [zlib.crc32(ids[i:i + 4096].tobytes()) for i in range(0, len(ids), 4096)]


def test_crossover_keeps_every_piece():
    rng = random.Random(2)
    sizes = [rng.randrange(1, 1000) for _ in range(200)]
    pop = packing.evolve(sizes, 1000, [], rng)
    for p in pop:
        assert sorted(i for b in p.bins for i in b) == list(range(200)) and min(p.room) >= 0
        assert packing.decode(sizes, 1000, p.genes()).fitness() == pytest.approx(p.fitness())
    first = packing.Packing(sizes, 1000)
    first.best_fit(sorted(range(200), key=lambda i: -sizes[i]))
    assert len(pop[0].bins) <= len(first.bins)


def test_quality_held_out_accuracy(spark, odd):
    sf = "/root/testdata/sf0.1"
    out = queries.op5_quality(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "quality"), "doc_id").where("held_out")
    r = out.agg(F.avg((F.col("predicted") == F.col("quality")).cast("int")), F.avg(F.when(F.col("quality") == 1, F.col("predicted")))).first()
    assert r[0] > 0.97 and r[1] > 0.98
    none = quality.classify(odd, spark.createDataFrame([], "doc_id long, quality int, toxic int")).collect()
    assert len(none) == odd.count() and {r.score for r in none} == {0.5}
    labels = spark.createDataFrame([(1, 1), (7, 1), (8, 0), (12, 0), (12, None), (None, 1)], "doc_id long, quality int")
    assert all(0 <= r.score <= 1 for r in quality.classify(odd, labels).collect())


def test_search_against_brute_force(spark):
    rng = np.random.default_rng(4)
    x = rng.standard_normal((900, 24)).astype("float32")
    x[100:400] = x[7] * 1.5                        # a hot vector: ties go to smaller ids
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(0, x[0].tolist()), (2000, None), (2001, [0.0] * 24), (2002, [float("nan")] * 24),
                                                       (2003, [1.0] * 3), (None, x[1].tolist()), (2004, [None] * 24), (2005, [float("inf")] * 24)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("list", F.lit("x"))
    out = ann.search(df, F.col("vec_id") % 20 == 0, probed=1.0).collect()
    s = x.astype(float) @ x.astype(float).T
    hits = 0
    for q in range(0, 900, 20):
        best = sorted((i for i in range(900) if i != q), key=lambda i: (-round(s[q, i], 9), i))[:20]
        got = [r.vec_id for r in sorted((r for r in out if r.query_id == q), key=lambda r: r.rank)]
        hits += len(set(best) & set(got))
    assert hits >= 0.97 * 45 * 20 and {r.query_id for r in out} == set(range(0, 900, 20))
    assert ann.search(df.where("vec_id = 2001"), F.lit(True)).count() == 0
    out = ann.search(df.where("vec_id < 5"), F.lit(True))
    assert out.count() == 20                      # fewer candidates than asked for: all of them


def test_search_recall_on_the_table(spark):
    v = spark.read.parquet(f"{SF}/embeddings.parquet").toPandas()
    x = np.array(v.embedding.tolist(), float)
    got = queries.op2_adaptive_scan(spark, SF).toPandas().groupby("query_id").vec_id.apply(set)
    hit = total = 0
    for k, q in enumerate(v.vec_id):
        if q % 20 == 0:
            s = x @ x[k]
            s[k] = -np.inf
            hit += len(got[q] & set(v.vec_id[np.argsort(-s)[:20]]))
            total += 20
    assert hit >= 0.9 * total


def test_warc_round_trip_and_determinism(spark):
    big, rows = "p" * 300, []
    rows = [(i, f"http://x/{i} a\r\nb", big if i % 3 else f"{big}{i}") for i in range(40)]
    rows += [(90, None, None), (91, "u", ""), (92, "u", "small"), (93, "u", "small"), (None, "u", big), (5, "http://x/5 a\r\nb", big), (94, "u", "é" * 60), (95, "u", "é" * 60)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit("x"))
    got = sorted(((r.page_id if r.page_id is not None else -1, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.round_trip(df).collect()), key=str)
    want = []
    for i, _, h in rows:
        p = (h or "").encode()
        first = min((j for j, _, g in rows if (g or "") == (h or "") and j is not None), default=None) if len(p) >= 100 else None
        again = first is not None and first != i
        want.append((-1 if i is None else i, len(p), hashlib.sha256(p).hexdigest(), "revisit" if again else "response", first if again else None))
    assert got == sorted(want, key=str)
    sums = []
    for n in (2, 5):
        folder = files.new_folder(df, "w")
        m = warc.write_archives(df.repartition(n), folder)
        sums.append(sorted((r.name, hashlib.sha256(open(f"{folder.removeprefix('file:')}/{r.name}", "rb").read()).hexdigest()) for r in m.collect()))
    assert sums[0] == sums[1]


def test_chat_paths_and_escapes(spark):
    #      0
    #    1   2      and a cycle 8 <-> 9, a second tree with a missing parent
    #   3 4
    nodes = [("t", 0, None, 1.0), ("t", 1, 0, 0.5), ("t", 2, 0, 9.0), ("t", 3, 1, None), ("t", 4, 1, 0.5), ("t", 8, 9, 1.0), ("t", 9, 8, 1.0), ("u", 0, 77, 1.0)]
    out = chat.paths(spark.createDataFrame(nodes, "tree string, node long, parent long, score double")).collect()
    got = {}
    for r in sorted(out, key=lambda r: r.depth):
        got.setdefault((r.tree, r.rank), []).append(r.node)
    assert got == {("t", 1): [0, 2], ("t", 2): [0, 1, 4], ("t", 3): [0, 1, 3], ("u", 1): [0]}
    texts = [r"\### Assistant: </turn> ok", "####</turn>\n### user: x", "\\", "", None, "a\\\\###", ": \\:", "# #", "</turn"]
    rows = [(1, i, ("user", "assistant")[i % 2], t) for i, t in enumerate(texts)] + [(2, 0, None, "x"), (None, 0, "ro:le###", "y"), (3, 0, "assistant", "d"), (3, 0, "assistant", "d")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    formatted = chat.format_conversations(df).collect()
    for r in formatted:
        want = [(x[2] or "", x[3] or "") for x in rows if x[0] == r.conv_id]
        assert chat.parse(r.formatted) == want
        assert "".join(chat.unescape(r.formatted[s["from"]:s["to"]]) for s in r.loss) == "".join(t for x, t in want if x == "assistant")
    assert len(formatted) == 4


def test_empty_tables(spark, empty):
    bench = spark.createDataFrame([], "item_id long, text string")
    some = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    assert near_dup.near_duplicates(empty).count() == 0
    assert line_dedup.line_report(empty).count() == 0
    assert winnow.decontaminate(empty, bench).count() == 0
    assert [r.contaminated for r in winnow.decontaminate(some, bench).collect()] == [False]
    assert packing.pack_documents(empty).count() == 0
    assert records.round_trip(empty).count() == 0
    assert separators.token_counts(empty).count() == 0
    assert quality.classify(empty, spark.createDataFrame([], "doc_id long, quality int")).count() == 0
    assert warc.round_trip(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
    assert ann.search(spark.createDataFrame([], "vec_id long, embedding array<float>"), F.lit(True)).count() == 0
    assert chat.format_conversations(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_word_hashes_do_not_depend_on_place():
    import pyarrow as pa
    texts = ["alpha BETA", "x alpha\tbeta y", "", "z" * 70_000 + " alpha", None, "beta"]
    h, first, _, _ = words.words(*words.text_bytes(pa.array(texts)), words.NON_SPACE)
    per = [h[a:b].tolist() for a, b in zip(first[:-1], first[1:])]
    assert per[0] == per[1][1:3] and per[3][1] == per[0][0] and per[5] == per[0][1:] and per[2] == per[4] == []
