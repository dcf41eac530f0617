"""Benchmark decontamination with a generalised suffix automaton.

The words of all normalised items go into one automaton whose states know the items
they occur in. Training words are streamed through it while the length of the
longest match is tracked; wherever that length reaches the window, the window's
words are hit. Words outside the items' vocabulary are ruled out for whole blocks by
array operations first, and only stretches of vocabulary words that are long enough
reach the automaton.

The items are a stated query set. They are taken in blocks of at most
``ITEM_BLOCK_WORDS`` words, so what is broadcast at once has a fixed size whatever
the number of items; documents meet the blocks one after the other within a task.

Edge cases: a null or empty text has no words and is never contaminated; an item
without words has no window and is never counted; equal items are each counted;
items with a null id hit like any other, are left out of ``items`` and count as one in
``n_items``; other columns are ignored; an empty table
of either kind gives no hits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import vectors as V

WINDOW = 13
#: A document is contaminated when hits cover at least one word in this many.
COVERAGE = 20
ITEM_BLOCK_WORDS = 500_000


def word_ids(text: str) -> list[int]:
    data = V.LOWER[np.frombuffer(text.encode(), dtype=np.uint8)]
    starts, ends = V.runs(V.ALNUM[data], np.array([0, len(data)]))
    return V.span_hash(V.prefix_hash(data), starts, ends).tolist()


class SuffixAutomaton:
    """Automaton of word sequences; ``windows`` maps a state to the items found there."""

    def __init__(self, items: list[tuple[str | None, list[int]]], window: int = WINDOW):
        self.next: list[dict[int, int]] = [{}]
        self.link = [-1]
        self.length = [0]
        self.items: dict[int, set[int]] = {}
        self.names = [name for name, _ in items]
        for _, words in items:
            last = 0
            for w in words:
                last = self._extend(last, w)
        # Where a window ends, note the item on the state that stands for it.
        for number, (_, words) in enumerate(items):
            size = min(window, len(words))
            state = matched = 0
            for i, w in enumerate(words):
                state, matched = self.step(state, matched, w)
                if i + 1 >= size:
                    at, n = self.cut(state, matched, size)
                    self.items.setdefault((at, size), set()).add(number)
        self.sizes = sorted({size for _, size in self.items})
        self.vocabulary = np.unique(np.array([w for _, words in items for w in words], dtype=np.uint64))

    def _extend(self, last: int, w: int) -> int:
        if w in self.next[last]:
            known = self.next[last][w]
            return known if self.length[known] == self.length[last] + 1 else self._clone(last, w, known)
        new = len(self.next)
        self.next.append({})
        self.length.append(self.length[last] + 1)
        self.link.append(0)
        at = last
        while at >= 0 and w not in self.next[at]:
            self.next[at][w] = new
            at = self.link[at]
        if at >= 0:
            known = self.next[at][w]
            self.link[new] = known if self.length[known] == self.length[at] + 1 else self._clone(at, w, known)
        return new

    def _clone(self, at: int, w: int, known: int) -> int:
        copy = len(self.next)
        self.next.append(dict(self.next[known]))
        self.length.append(self.length[at] + 1)
        self.link.append(self.link[known])
        self.link[known] = copy
        while at >= 0 and self.next[at].get(w) == known:
            self.next[at][w] = copy
            at = self.link[at]
        return copy

    def step(self, state: int, matched: int, w: int) -> tuple[int, int]:
        """Longest suffix of the stream that occurs in an item, after one more word."""
        while state and w not in self.next[state]:
            state = self.link[state]
            matched = self.length[state]
        if w in self.next[state]:
            return self.next[state][w], matched + 1
        return 0, 0

    def cut(self, state: int, matched: int, size: int) -> tuple[int, int]:
        """State of the last ``size`` words of a match at least as long."""
        while state and self.length[self.link[state]] >= size:
            state = self.link[state]
        return state, min(matched, size)

    def stream(self, words: list[int]) -> Iterator[tuple[int, int, set[int]]]:
        """``(end, size, items)`` for every window that ends at a word of the stream."""
        state = matched = 0
        smallest = self.sizes[0]
        for i, w in enumerate(words):
            state, matched = self.step(state, matched, w)
            if matched >= smallest:
                for size in self.sizes:
                    if size > matched:
                        break
                    found = self.items.get((self.cut(state, matched, size)[0], size))
                    if found:
                        yield i + 1, size, found


def item_blocks(items: DataFrame, id_column: str = "item_id", text: str = "text") -> Iterator[list[tuple[str | None, list[int]]]]:
    """Items with words, a bounded number of words at a time."""
    block, size = [], 0
    for row in items.select(F.col(f"`{id_column}`").cast("string"), F.col(f"`{text}`")).toLocalIterator():
        words = word_ids(row[1] or "")
        if words:
            block.append((row[0], words))
            size += len(words)
            if size >= ITEM_BLOCK_WORDS:
                yield block
                block, size = [], 0
    if block:
        yield block


def _search(block: V.Block, automata: list[SuffixAutomaton]):
    """Words per document, hit flags per word, and items per document, None for those without an id."""
    data = V.LOWER[block.data]
    starts, ends = V.runs(V.ALNUM[data], block.offsets)
    owner = block.owner(starts)
    words = V.span_hash(V.prefix_hash(data), starts, ends)
    delta = np.zeros(len(words) + 1, dtype=np.int64)
    pairs: list[set[str | None]] = [set() for _ in range(block.n)]
    first = np.searchsorted(owner, np.arange(block.n + 1))
    for automaton in automata:
        at = np.searchsorted(automaton.vocabulary, words)
        at[at == len(automaton.vocabulary)] = 0
        known = automaton.vocabulary[at] == words
        lo, hi = V.runs(known, first)
        long = np.flatnonzero(hi - lo >= automaton.sizes[0])
        for a, b in zip(lo[long].tolist(), hi[long].tolist()):
            for end, size, found in automaton.stream(words[a:b].tolist()):
                delta[a + end - size] += 1
                delta[a + end] -= 1
                pairs[owner[a]].update(automaton.names[i] for i in found)
    return starts, ends, owner, np.cumsum(delta[:-1]) > 0, pairs


def _automata(items: DataFrame) -> list:
    """Broadcast blocks of items; each task builds its automaton once."""
    sc = items.sparkSession.sparkContext
    return [sc.broadcast(block) for block in item_blocks(items)]


def contamination(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Per document: ``n_words, n_hit, items, contaminated, unnamed``: ``items`` sorted, ``unnamed`` if an item without id hits."""
    kind, shared = dict(docs.dtypes)["doc_id"], _automata(items)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automata = [SuffixAutomaton(b.value) for b in shared]
        for batch in batches:
            for block in V.blocks(batch.column(1)):
                _, _, owner, hit, pairs = _search(block, automata)
                n_words = np.bincount(owner, minlength=block.n)
                n_hit = np.bincount(owner[hit], minlength=block.n)
                yield V.output({
                    "doc_id": (batch.column(0).slice(block.lo, block.n), None),
                    "n_words": (n_words, pa.int64()), "n_hit": (n_hit, pa.int64()),
                    "items": ([sorted(p - {None}) for p in pairs], pa.list_(pa.string())),
                    "contaminated": ((n_hit > 0) & (COVERAGE * n_hit >= n_words), pa.bool_()),
                    "unnamed": ([None in p for p in pairs], pa.bool_()),
                })

    return docs.select("doc_id", "text").mapInArrow(
        search, f"doc_id {kind}, n_words bigint, n_hit bigint, items array<string>, contaminated boolean, unnamed boolean"
    )


def remove_spans(docs: DataFrame, items: DataFrame) -> DataFrame:
    """``docs`` without contaminated documents; hit spans of the others are cut out.

    A cut takes the bytes from the first to the last word of each run of hit words.
    ``n_chars`` follows the new text where the column exists.
    """
    shared, names = _automata(items), docs.columns
    at = names.index("text")

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automata = [SuffixAutomaton(b.value) for b in shared]
        for batch in batches:
            keep, texts = np.ones(batch.num_rows, dtype=bool), batch.column(at).to_pylist()
            for block in V.blocks(batch.column(at)):
                starts, ends, owner, hit, _ = _search(block, automata)
                n_words, n_hit = (np.bincount(o, minlength=block.n) for o in (owner, owner[hit]))
                keep[block.lo : block.hi] = ~((n_hit > 0) & (COVERAGE * n_hit >= n_words))
                lo, hi = V.runs(hit, np.searchsorted(owner, np.arange(block.n + 1)))
                cuts: dict[int, list[tuple[int, int]]] = {}
                for a, b in zip(lo, hi):
                    cuts.setdefault(int(owner[a]), []).append((int(starts[a]), int(ends[b - 1])))
                for doc, spans in cuts.items():
                    begin, stop = int(block.offsets[doc]), int(block.offsets[doc + 1])
                    parts, here = [], begin
                    for a, b in spans:
                        parts.append(block.data[here:a].tobytes())
                        here = b
                    parts.append(block.data[here:stop].tobytes())
                    texts[block.lo + doc] = b"".join(parts).decode()
            arrays = [pa.array(texts, pa.string()) if i == at else c for i, c in enumerate(batch.columns)]
            yield pa.RecordBatch.from_arrays(arrays, names=names).filter(pa.array(keep))

    out = docs.mapInArrow(clean, docs.schema)
    return out.withColumn("n_chars", F.length("text").cast(dict(docs.dtypes)["n_chars"])) if "n_chars" in names else out


def report(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Digest columns of :func:`contamination`."""
    return contamination(docs, items).select(
        "doc_id", "n_words", "n_hit", (F.size("items") + F.col("unnamed").cast("int")).cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), "contaminated",
    )

