"""Benchmark decontamination with a generalised suffix automaton.

The normalised benchmark items (words as numbers) go into one suffix automaton. A document's words are streamed through it; at each word
the automaton gives the longest suffix of the stream that is somewhere in the items. From ``window``
matching words on, the words of the match are hit; an item of fewer words is hit where it occurs whole. The items of a
hit are read off the state that holds exactly the last ``window`` words.

The automaton is built from blocks of items of at most ``BLOCK_WORDS`` words: what is broadcast has that bound however many
items there are. More blocks mean more passes; every pass is written to the shared folder before the next one, and spans of all passes are united.

Most words are in no item: a dictionary turns words into numbers, and only runs of known words that are long enough
to hold a match are streamed.

Defined results: null and wordless texts have no words and no hits; items without words are never found; repeated items count by their item_id
once; an empty benchmark hits nothing; repeated documents get a row each; clashing extra columns are kept by ``clean``.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_schema, materialize, shield

WINDOW = 10
BLOCK_WORDS = 500_000
#: ASCII bytes that are no word characters become spaces; bytes of other characters stay.
_TO_SPACE = bytes(c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256))
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().translate(_TO_SPACE).split()


class Automaton:
    """Generalised suffix automaton over word numbers, with the items of every window and of every short item. States are rows of flat arrays (most have one
    way on; others are in ``more``), so a block of BLOCK_WORDS words takes some tens of megabytes."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int = WINDOW):
        self.window, self.vocab = window, {}
        self.word, self.to, self.link, self.length = array("i", [-1]), array("i", [0]), array("i", [-1]), array("i", [0])
        self.more: dict[int, dict[int, int]] = {}  # state -> further words and their states
        self.short: dict[int, dict[int, set[str]]] = {}  # state of a whole short item -> its length -> ids
        items = [(i, w) for i, w in items if w]
        coded = [(i, [self.vocab.setdefault(x, len(self.vocab)) for x in w]) for i, w in items]
        for _, w in coded:
            last = 0
            for c in w:
                last = self._extend(last, c)
        self.shortest = min((len(w) for _, w in coded if len(w) < window), default=window)
        self.names = [i for i, _ in coded]
        self.item = array("i", [-1]) * len(self.link)  # state of a window -> place of its first item's id
        self.others: dict[int, set[int]] = {}  # state of a window -> places of the others
        for k, (i, w) in enumerate(coded):
            state = length = 0
            for c in w:
                state, length = self._next(state, c), min(length + 1, window)
                while length <= self.length[self.link[state]]:
                    state = self.link[state]
                if length == window:
                    if self.item[state] < 0:
                        self.item[state] = k
                    elif self.item[state] != k:
                        self.others.setdefault(state, set()).add(k)
            if len(w) < window:
                self.short.setdefault(state, {}).setdefault(len(w), set()).add(i)
        # for each state the nearest one on its way along suffix links, itself included, in which a short item ends
        self.ends = array("i", [0]) * (len(self.link) if self.short else 0)
        if self.short:
            for s in sorted(range(1, len(self.link)), key=self.length.__getitem__):
                self.ends[s] = s if s in self.short else self.ends[self.link[s]]

    def _next(self, state: int, c: int) -> int:
        """The state after one more word, or -1."""
        if self.word[state] == c:
            return self.to[state]
        more = self.more.get(state)
        return more.get(c, -1) if more else -1

    def _put(self, state: int, c: int, to: int) -> None:
        if self.word[state] in (-1, c):
            self.word[state], self.to[state] = c, to
        else:
            self.more.setdefault(state, {})[c] = to

    def _extend(self, last: int, c: int) -> int:
        link, length = self.link, self.length
        q = self._next(last, c)
        if q >= 0:  # the string is there already
            return q if length[q] == length[last] + 1 else self._clone(last, c, q)
        cur = self._new(-1, 0, 0, length[last] + 1)
        p = last
        while p != -1 and self._next(p, c) < 0:
            self._put(p, c, cur)
            p = link[p]
        if p != -1:
            q = self._next(p, c)
            link[cur] = q if length[q] == length[p] + 1 else self._clone(p, c, q)
        return cur

    def _new(self, word: int, to: int, link: int, length: int) -> int:
        for column, x in zip((self.word, self.to, self.link, self.length), (word, to, link, length), strict=True):
            column.append(x)
        return len(self.link) - 1

    def _clone(self, p: int, c: int, q: int) -> int:
        clone = self._new(self.word[q], self.to[q], self.link[q], self.length[p] + 1)
        if q in self.more:
            self.more[clone] = dict(self.more[q])
        self.link[q] = clone
        while p != -1 and self._next(p, c) == q:
            self._put(p, c, clone)
            p = self.link[p]
        return clone

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Disjoint sorted spans [start, end) of hit words, and the items that occur."""
        get = self.vocab.get
        codes = np.fromiter(map(get, words, repeat(-1)), dtype=np.int64, count=len(words))
        spans: list[tuple[int, int]] = []
        found: set[str] = set()
        if not self.vocab:
            return spans, found
        known = np.concatenate([[0], (codes >= 0).astype(np.int8), [0]])
        edge = np.diff(known)
        starts, ends = np.nonzero(edge == 1)[0], np.nonzero(edge == -1)[0]
        long_enough = ends - starts >= self.shortest
        for a, b in zip(starts[long_enough].tolist(), ends[long_enough].tolist(), strict=True):
            self._stream(codes[a:b].tolist(), a, spans, found)
        return spans, found

    def _stream(self, codes: list[int], at: int, spans: list, found: set) -> None:
        word, to, more, link, length, window, ends = self.word, self.to, self.more, self.link, self.length, self.window, self.ends
        state = n = 0
        for i, c in enumerate(codes, at + 1):
            while True:
                if word[state] == c:
                    state, n = to[state], n + 1
                    break
                if state in more and c in more[state]:
                    state, n = more[state][c], n + 1
                    break
                if not state:
                    break
                state = link[state]
                n = length[state]
            best = 0
            if n >= window:
                best, s = n, state
                while length[link[s]] >= window:
                    s = link[s]
                if self.item[s] >= 0:
                    found.add(self.names[self.item[s]])
                    found.update(self.names[k] for k in self.others.get(s, ()))
            if ends:
                # the matched string is a suffix of the state's longest one, so entries up to its length end here
                s = ends[state]
                while s:
                    for m, ids in self.short[s].items():
                        if m <= n:
                            found |= ids
                            best = max(best, m)
                    s = ends[link[s]]
            if best:
                low = i - best
                while spans and spans[-1][1] >= low:
                    low = min(low, spans.pop()[0])
                spans.append((low, i))


def blocks_of(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", block_words: int = BLOCK_WORDS) -> Iterator[list[tuple[str, list[bytes]]]]:
    """Items in blocks of bounded size, streamed to the driver partition by partition."""
    block, n = [], 0
    rows = benchmark.where(F.col(text_col).isNotNull()).select(F.col(id_col).cast("string").alias("i"), F.col(text_col).cast("string").alias("t"))
    for r in rows.toLocalIterator():
        w = words_of(r["t"])
        if block and n + len(w) > block_words:
            yield block
            block, n = [], 0
        block.append((r["i"] if r["i"] is not None else "", w))
        n += len(w)
    yield block


def unite(a: list[tuple[int, int]], b: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s, e in sorted([*a, *b]):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


FOUND = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("starts", T.ArrayType(T.LongType())),
        T.StructField("ends", T.ArrayType(T.LongType())),
        T.StructField("items", T.ArrayType(T.StringType())),
    ]
)


def mark(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", window: int = WINDOW, column: str = "found", keep_text: bool = True, block_words: int = BLOCK_WORDS) -> DataFrame:
    """``docs`` with a struct ``column``: number of words, hit spans and items, over all blocks of the benchmark."""
    spark = docs.sparkSession
    marked, first = docs, True
    blocks = blocks_of(benchmark, block_words=block_words)
    block = next(blocks, [])
    while block is not None:
        after = next(blocks, None)
        last = after is None
        shared = spark.sparkContext.broadcast(Automaton(block, window))
        fields = [f for f in marked.schema.fields if f.name != column and (keep_text or not last or f.name != text_col)]
        out = T.StructType([*fields, T.StructField(column, FOUND)])
        marked = marked.mapInArrow(_pass(shared, marked.columns.index(text_col), [marked.columns.index(f.name) for f in fields], None if first else marked.columns.index(column), arrow_schema(out)), out)
        if not last:
            marked = materialize(marked, "decontaminate")
        block, first = after, False
    return marked


def _pass(shared, text_at: int, keep: list[int], found_at: int | None, wire: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = shared.value
        for b in batches:
            before = b.column(found_at).to_pylist() if found_at is not None else None
            rows = []
            for k, t in enumerate(b.column(text_at).to_pylist()):
                words = words_of(t)
                spans, items = automaton.scan(words)
                if before:
                    spans = unite(spans, list(zip(before[k]["starts"], before[k]["ends"], strict=True)))
                    items |= set(before[k]["items"])
                rows.append({"n_words": len(words), "starts": [s for s, _ in spans], "ends": [e for _, e in spans], "items": sorted(items)})
            cols = [b.column(i).cast(wire.field(k).type) for k, i in enumerate(keep)]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(rows, wire.field(len(keep)).type)], schema=wire)

    return run


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """(id_col, n_words, n_hit, n_items, items_sha256, contaminated): one row for each input row."""
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    f = mark(src, benchmark, "text", window, keep_text=False)
    total = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda a, x: a + x)
    n_hit = total(F.col("found.ends")) - total(F.col("found.starts"))
    return f.select(
        F.col("id").alias(id_col),
        F.col("found.n_words").alias("n_words"),
        n_hit.alias("n_hit"),
        F.size("found.items").cast("long").alias("n_items"),
        F.sha2(F.array_join("found.items", ","), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


def cut_spans(text: str | None, starts: list[int], ends: list[int]) -> str | None:
    """The text without the hit words, and without what stands between words of one hit."""
    if text is None or not starts:
        return text
    raw = text.encode("utf-8", "surrogatepass")
    where = [m.span() for m in _WORD.finditer(raw.lower())]
    out, at = [], 0
    for s, e in zip(starts, ends, strict=True):
        out.append(raw[at : where[s][0]])
        at = where[e - 1][1]
    out.append(raw[at:])
    return b"".join(out).decode("utf-8", "surrogatepass")


def clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", window: int = WINDOW, max_coverage: float = 0.5) -> DataFrame:
    """``docs`` with benchmark passages removed: hit spans are cut out of the text, and a document goes if they cover more
    than ``max_coverage`` of its words. Documents without a hit come back unchanged, empty ones too.

    A cut brings the words around it together, so texts that were cut are scanned again until nothing is hit, whatever the benchmark's size.
    """
    blocks = blocks_of(benchmark)
    block = next(blocks, [])
    if next(blocks, None) is None:
        return _clean_once(docs, Automaton(block, window), text_col, max_coverage)
    inner, place, restore = shield(docs)
    total = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda a, x: a + x)
    n_hit = total(F.col("found.ends")) - total(F.col("found.starts"))
    out = T.StructType(inner.schema.fields)
    wire, at = arrow_schema(out), docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = b.column(b.num_columns - 1)
            starts, ends = found.field("starts").to_pylist(), found.field("ends").to_pylist()
            cols = [c.cast(f.type) for c, f in zip(b.columns, wire, strict=False)]
            cols[at] = pa.array([cut_spans(t, s, e) for t, s, e in zip(b.column(at).to_pylist(), starts, ends, strict=True)], wire.field(at).type)
            yield pa.RecordBatch.from_arrays(cols, schema=wire)

    done, todo, most = None, inner, F.lit(max_coverage) * F.col("found.n_words")
    while todo is not None:  # every round takes words off each text it goes on with
        marked = materialize(mark(todo, benchmark, place(text_col), window), "decontaminate")
        free = marked.where(n_hit == 0).drop("found")
        hit = marked.where(n_hit > 0) if done is not None else marked.where((n_hit > 0) & (n_hit <= most))
        done = free if done is None else done.unionByName(free)
        todo = materialize(hit.mapInArrow(run, out), "decontaminate-cut") if hit.limit(1).count() else None
    return restore(done)


def _clean_once(docs: DataFrame, automaton: Automaton, text_col: str, max_coverage: float) -> DataFrame:
    """``clean`` with all items in one automaton, in one pass over the texts."""
    inner, _, restore = shield(docs)
    shared = docs.sparkSession.sparkContext.broadcast(automaton)
    out = T.StructType(inner.schema.fields)
    wire, at = arrow_schema(out), docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan = shared.value.scan
        for b in batches:
            texts, keep = b.column(at).to_pylist(), np.ones(b.num_rows, bool)
            for k, text in enumerate(texts):
                words = words_of(text)
                spans, _ = scan(words)
                keep[k] = sum(e - s for s, e in spans) <= max_coverage * len(words)
                while spans and keep[k]:
                    text = texts[k] = cut_spans(text, [s for s, _ in spans], [e for _, e in spans])
                    spans, _ = scan(words_of(text))
            cols = [c.cast(f.type) for c, f in zip(b.columns, wire, strict=True)]
            cols[at] = pa.array(texts, wire.field(at).type)
            yield pa.RecordBatch.from_arrays(cols, schema=wire).filter(pa.array(keep))

    return restore(inner.mapInArrow(run, out))
