"""Spelling variants: pairs of words one edit apart, by composing automata.

The vocabulary acceptor A, a one-edit transducer T and A again are composed,
A o T o A, and its accepted pairs are enumerated.  The composition is cut by
initial states.  Let L be the shorter length of a pair and h = L // 2: either
the words agree in their first h code points, or the edit lies within those
and they agree in the last L - h.  So each word goes into two *fronts* (the
state that A reaches after its first h code points) and two *backs* (the same,
read from the end), for L its own length and one less, and every pair is found
in exactly one of them.  A state with more than ``MOST`` words is split in
the same way again by what remains of them, until one code point is left, so
no task depends on how many words share a beginning.

A task takes some initial states at a time.  It builds the minimised acceptor
of what remains of their words (equal continuations are one state, over all of
them) and walks pairs of states: together while the words agree, then along two
different arcs (replaced) or one arc of the longer word (inserted), then
together again.  Pairs of states are solved once, and equal states need no walk.

Defined results: null and empty texts hold no words; rows are counted one by
one, so repeated rows count again; a null doc_id reads as an empty string; ties
of largest n go to the smaller word in code-point order; an empty table gives
no rows; other columns than ``doc_id`` and ``text`` are not read; a word may
be of any length.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cagetrace.llm.store import stage

LETTERS = "A-Za-zÀ-ÿ"
#: Words that an initial state may hold before it is split, that a task takes at a time, and that it counts before it passes counts on.
MOST, AT_ONCE, HELD = 20_000, 50_000, 200_000
#: A word's form must be so many times as frequent.
RATIO = 5
_AZ = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _counter(least_length: int, noise: int):
    """Counts of the words of each batch; *noise* deletes a code point from one in so many of a document's words, by checksum."""
    word = re.compile(f"[{LETTERS}]{{{least_length},}}")  # matches start where a run starts, as shorter ends of a run are too short

    def batch_of(held: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])

    def run(batches):
        held: Counter = Counter()
        for b in batches:
            for doc, text in zip(b.column("doc_id"), b.column("text")):
                start = zlib.crc32(f"{doc.as_py() if doc.is_valid else ''}:".encode())
                for w, n in Counter(word.findall((text.as_py() or "").translate(_AZ))).items():
                    if noise and (h := zlib.crc32(w.encode(), start)) % noise == 0:
                        i = h % len(w)
                        w = w[:i] + w[i + 1:]
                        if len(w) < least_length:
                            continue
                    held[w] += n
                if len(held) > HELD:
                    yield batch_of(held)
                    held.clear()
        if held:
            yield batch_of(held)
    return run


def vocabulary(docs: DataFrame, least_length: int = 6, least_count: int = 5, noise: int = 0) -> DataFrame:
    """(word, n): words of at least *least_length* code points found at least *least_count* times.

    A word is a run of ``LETTERS`` with A-Z in lower case.
    """
    d = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("text").cast("string").alias("text"))
    part = d.mapInArrow(_counter(least_length, noise), "word string, n long")
    return part.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


# ------------------------------------------------------------ initial states
def _cut(state: str, size: str, part: str, cls: str, no_end: str) -> str:
    """The front and the back of a word's *part* (SQL), where the shorter words' parts have *size* code points."""
    front = (f"named_struct('state', concat({state}, 'F', {size}, ' ', substr({part}, 1, {size} div 2)), 'size', cast({size} - {size} div 2 AS int), "
             f"'cls', {cls}, 'no_end', {no_end}, 'rest', substr({part}, int({size} div 2 + 1)))")
    back = (f"named_struct('state', concat({state}, 'B', {size}, ' ', right({part}, int({size} - {size} div 2))), 'size', cast({size} div 2 AS int), "
            f"'cls', {cls}, 'no_end', true, 'rest', substr({part}, 1, int(length({part}) - ({size} - {size} div 2))))")
    return f"{front}, {back}"


def initial_states(vocab: DataFrame, most: int = MOST) -> DataFrame:
    """(state, size, cls, no_end, rest, word, n): what remains of each word behind its initial states.

    ``cls`` 0 marks the shorter words of a state, whose rest has ``size`` code
    points, 1 the longer ones; where ``no_end`` holds, an insertion at the end
    of the rest belongs to another state.
    """
    at = f"array({_cut(repr(''), 'len', 'word', '0', 'false')}, {_cut(repr(''), '(len - 1)', 'word', '1', 'false')})"
    rows = stage(vocab.select("word", "n", F.length("word").alias("len")).selectExpr(f"inline({at})", "word", "n"), "states")
    done = None
    while True:
        big = stage(rows.where("size > 1").groupBy("state").count().where(F.col("count") > most).select("state"), "big")
        if big.isEmpty():
            return rows if done is None else done.unionByName(rows)
        big = F.broadcast(big)  # at most 4 / most of the vocabulary
        kept = rows.join(big, "state", "left_anti")
        done = kept if done is None else done.unionByName(kept)
        hot = rows.join(big, "state", "left_semi")
        rows = stage(hot.selectExpr(f"inline(array({_cut('state', 'size', 'rest', 'cls', 'no_end')}))", "word", "n"), "states")


# ------------------------------------------------------------ automata in a task
def _solve(start, table: dict, needs, result) -> list:
    """``table[start]``, every entry that it needs first; without recursion, as words may be long."""
    todo = [start]
    while todo:
        k = todo[-1]
        if k in table:
            todo.pop()
        elif missing := [x for x in needs(k) if x not in table]:
            todo.extend(missing)
        else:
            table[k] = result(k)
    return table[start]


class Acceptor:
    """A minimised acyclic acceptor with several initial states, and the composition of its states with one edit."""

    def __init__(self):
        self.arcs: list[dict[str, int]] = [{}]   # state 0 accepts the empty word only
        self.size, self._final = [1], [True]     # words that a state accepts, and whether the empty word is one
        self._known = {((), True): 0}
        self._same, self._replaced, self._inserted = {}, {}, {}

    def add(self, words: list[str]) -> int:
        """The state that accepts the sorted distinct *words*; a word's number is its place among them.

        A state is looked up among its equals as soon as no later word can change it.
        """
        path, last = [[False, []]], ""

        def close(depth: int):
            while len(path) - 1 > depth:
                final, arcs = path.pop()
                path[-1][1].append((last[len(path) - 1], self._state(final, tuple(arcs))))
        for w in words:
            p = 0
            while p < len(last) and p < len(w) and last[p] == w[p]:
                p += 1
            close(p)
            path.extend([False, []] for _ in range(len(w) - p))
            path[-1][0] = True
            last = w
        close(0)
        return self._state(path[0][0], tuple(path[0][1]))

    def _state(self, final: bool, arcs: tuple) -> int:
        found = self._known.get((arcs, final))
        if found is None:
            found = self._known[arcs, final] = len(self.arcs)
            self.arcs.append(dict(arcs))
            self._final.append(final)
            self.size.append(final + sum(self.size[q] for _, q in arcs))
        return found

    def _numbered(self, a: int):
        """(code point, next state, number of the first word behind it) of each arc."""
        at = int(self._final[a])
        for c, q in self.arcs[a].items():
            yield c, q, at
            at += self.size[q]

    def same(self, a: int, b: int) -> list[tuple[int, int]]:
        """The words that both states accept, by their numbers: the walk with no edit left."""
        def needs(k):
            a, b = k
            return [] if a == b else [(q, self.arcs[b][c]) for c, q in self.arcs[a].items() if c in self.arcs[b]]

        def result(k):
            a, b = k
            if a == b:
                return [(i, i) for i in range(self.size[a])]
            out = [(0, 0)] if self._final[a] and self._final[b] else []
            there = {c: (q, at) for c, q, at in self._numbered(b)}
            for c, q, at in self._numbered(a):
                if c in there:
                    r, to = there[c]
                    out += [(i + at, j + to) for i, j in self._same[q, r]]
            return out
        return _solve((a, b), self._same, needs, result)

    def replaced(self, a: int) -> list[tuple[int, int]]:
        """Pairs of words of *a* that differ by one replaced code point."""
        def result(a):
            out, arcs = [], list(self._numbered(a))
            for x, (_, q, at) in enumerate(arcs):
                out += [(i + at, j + at) for i, j in self._replaced[q]]
                for _, r, to in arcs[x + 1:]:
                    out += [(i + at, j + to) for i, j in self.same(q, r)]
            return out
        return _solve(a, self._replaced, lambda a: list(self.arcs[a].values()), result)

    def inserted(self, a: int, b: int, no_end: bool) -> list[tuple[int, int]]:
        """Pairs (word of *a*, word of *b*) where the second has one code point more, at the first place where they differ."""
        def needs(k):
            a, b, no_end = k
            return [(q, self.arcs[b][c], no_end) for c, q in self.arcs[a].items() if c in self.arcs[b]]

        def result(k):
            a, b, no_end = k
            out, mine = [], {c: (q, at) for c, q, at in self._numbered(a)}
            for c, q, at in self._numbered(b):
                if c in mine:
                    p, to = mine[c]
                    out += [(i + to, j + at) for i, j in self._inserted[p, q, no_end]]
                if self._final[a] and self._final[q] and not no_end:
                    out.append((0, at))
                for d, r, beyond in self._numbered(q):
                    if d != c and d in mine:
                        p, to = mine[d]
                        out += [(i + to, j + at + beyond) for i, j in self.same(p, r)]
            return out
        return _solve((a, b, no_end), self._inserted, needs, result)


def _pairs(states: list) -> pa.RecordBatch:
    """The pairs of some initial states, (no_end, {cls: (rests, words, counts)}) each, in both directions."""
    auto, found = Acceptor(), ([], [], [], [])

    def put(u, n, v, m):
        for col, x in zip(found, (u, n, v, m)):
            col.append(x)
    for no_end, of in states:
        if 0 not in of:
            continue
        rests, words, counts = of[0]
        a = auto.add(rests)
        near = [(words[i], counts[i], words[j], counts[j]) for i, j in auto.replaced(a)]
        if 1 in of:
            rests, longer, many = of[1]
            near += [(words[i], counts[i], longer[j], many[j]) for i, j in auto.inserted(a, auto.add(rests), no_end)]
        for u, n, v, m in near:
            put(u, n, v, m)
            put(v, m, u, n)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(found, (pa.string(), pa.int64(), pa.string(), pa.int64()))], names=["word", "n", "near", "near_n"])


def _compose(batches):
    states, held, state, of = [], 0, None, None
    for b in batches:
        for s, cls, no_end, rest, word, n in zip(*(b.column(c).to_pylist() for c in ("state", "cls", "no_end", "rest", "word", "n"))):
            if s != state:
                if held >= AT_ONCE:
                    yield _pairs(states)
                    states, held = [], 0
                state, of = s, {}
                states.append((no_end, of))
            for col, x in zip(of.setdefault(cls, ([], [], [])), (rest, word, n)):
                col.append(x)
            held += 1
    if states:
        yield _pairs(states)


def near_pairs(vocab: DataFrame, most: int = MOST) -> DataFrame:
    """(word, n, near, near_n), in both directions: words that differ by one inserted, deleted or replaced code point."""
    s = initial_states(vocab, most).select("state", "cls", "no_end", "rest", "word", "n")
    return s.repartition("state").sortWithinPartitions("state", "cls", "rest").mapInArrow(_compose, "word string, n long, near string, near_n long")


# ------------------------------------------------------------ forms
def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of each row of *forms* (word, form): the end of its chain, found by doubled steps."""
    jump = stage(forms.select("word", F.col("form").alias("to")), "jump")
    while True:
        far = jump.select(F.col("word").alias("to"), F.col("to").alias("next"))
        jump = stage(jump.join(far, "to", "left").select("word", F.coalesce("next", "to").alias("to"), F.col("next").isNotNull().alias("moved")), "jump")
        if jump.where("moved").isEmpty():
            return jump.select("word", F.col("to").alias("root"))
        jump = jump.drop("moved")


def variants(vocab: DataFrame, ratio: int = RATIO, most: int = MOST) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of each word of *vocab* (word, n).

    ``form`` is the near word of largest n if that is at least *ratio* times
    the word's own, ``root`` where the forms lead to.
    """
    vocab = stage(vocab, "vocabulary")
    none = vocab.select("word", "n", F.lit(None).cast("string").alias("near"), F.lit(None).cast("long").alias("near_n"))
    best = F.min(F.when(F.col("near").isNotNull(), F.struct((-F.col("near_n")).alias("less"), "near"))).alias("best")
    w = near_pairs(vocab, most).unionByName(none).groupBy("word").agg(F.max("n").alias("n"), F.count("near").alias("n_near"), best)
    has = -F.col("best.less") >= ratio * F.col("n")
    w = stage(w.select("word", "n", "n_near", F.when(has, F.col("best.near")).alias("form"), F.when(has, -F.col("best.less")).alias("form_n")), "forms")
    found = roots(w.where("form is not null"))
    return w.join(found, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
