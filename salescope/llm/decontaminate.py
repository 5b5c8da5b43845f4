"""Benchmark decontamination with a generalised suffix automaton of the test items.

Words are normalised (A-Z lower-cased, runs of letters, digits and characters
beyond ASCII). A window is WINDOW consecutive words of an item, or a whole item
of fewer words. The words of a document are streamed through the automaton,
which keeps the length of the longest suffix that occurs in any item; where it
reaches a window's length, the window's words are hit.

Cases: a null or empty text has no words; an item without words is no window;
an item whose id is null still hits words but is not counted or listed; items
with one id count once; repeated documents are scanned each; extra columns are
kept by ``remove_contamination`` and not read otherwise.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from salescope.llm.common import WORD, small_batches, word_list, written

WINDOW = 10
#: One automaton holds items of at most so many words (an item is never split);
#: more items make more automata, each one more pass over the documents' words.
MAX_AUTOMATON_WORDS = 200_000
#: A document that is hit in a larger share of its words goes as a whole.
MAX_COVERAGE = 0.8

_SPAN = np.dtype("<i8")


class SuffixAutomaton:
    """Generalised suffix automaton over word numbers, with the items behind each window."""

    def __init__(self, items: list[tuple[str | None, list[bytes]]], window: int = WINDOW) -> None:
        self.window = window
        self.words: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        coded = [(i, [self.words.setdefault(w, len(self.words)) for w in ws]) for i, ws in items if ws]
        self.shortest = min([window, *(len(ws) for _, ws in coded)])
        for _, ws in coded:
            last = 0
            for w in ws:
                last = self._extend(last, w)
        #: Items by the state and length of a window that occurs in them.
        self.windows: dict[int, dict[int, set[str]]] = {}
        for item, ws in coded:
            size = min(window, len(ws))
            state, matched = 0, 0
            for w in ws:
                state, matched = self.step(state, matched, w)
                if matched >= size:
                    found = self.windows.setdefault(self._at(state, size), {}).setdefault(size, set())
                    if item is not None:
                        found.add(item)
        self._chains: dict[int, tuple] = {}

    def _extend(self, last: int, w: int) -> int:
        if (q := self.next[last].get(w)) is not None:  # known from an item before
            return q if self.length[last] + 1 == self.length[q] else self._split(last, w, q)
        new = self._state({}, self.length[last] + 1, 0)
        p = last
        while p != -1 and w not in self.next[p]:
            self.next[p][w] = new
            p = self.link[p]
        if p != -1:
            q = self.next[p][w]
            self.link[new] = q if self.length[p] + 1 == self.length[q] else self._split(p, w, q)
        return new

    def _state(self, out: dict[int, int], length: int, link: int) -> int:
        self.next.append(out)
        self.length.append(length)
        self.link.append(link)
        return len(self.length) - 1

    def _split(self, p: int, w: int, q: int) -> int:
        """Part the strings of ``q`` that end a shorter context into a state of their own."""
        short = self._state(dict(self.next[q]), self.length[p] + 1, self.link[q])
        self.link[q] = short
        while p != -1 and self.next[p].get(w) == q:
            self.next[p][w] = short
            p = self.link[p]
        return short

    def _at(self, state: int, length: int) -> int:
        """The state of the suffix of ``length`` words."""
        while self.length[self.link[state]] >= length:
            state = self.link[state]
        return state

    def step(self, state: int, matched: int, w: int) -> tuple[int, int]:
        """The longest suffix that still occurs after the word ``w``."""
        while state and w not in self.next[state]:
            state = self.link[state]
            matched = self.length[state]
        to = self.next[state].get(w)
        return (to, matched + 1) if to is not None else (0, 0)

    def ending(self, state: int) -> tuple:
        """(length, items, own state?) of the windows that are suffixes of ``state``, longest first."""
        chain = self._chains.get(state)
        if chain is None:
            found, s = [], state
            while s > 0:
                found += [(n, ids, s == state) for n, ids in self.windows.get(s, {}).items()]
                s = self.link[s]
            chain = self._chains[state] = tuple(sorted(found, key=lambda x: -x[0]))
        return chain

    def scan(self, words: list[bytes]) -> tuple[np.ndarray, set[str]]:
        """Merged spans [start, end) of hit words, and the items whose windows occur."""
        spans: list[list[int]] = []
        items: set[str] = set()
        codes = np.fromiter(map(self.words.get, words, _NEGATIVE), np.int64, len(words))
        # A word that no item holds ends every match: only runs of known words matter.
        edges = np.flatnonzero(np.diff(np.concatenate(([0], (codes >= 0).view(np.int8), [0]))))
        for a, b in zip(edges[::2], edges[1::2], strict=True):
            if b - a < self.shortest:
                continue
            state, matched = 0, 0
            for at, w in enumerate(codes[a:b].tolist(), int(a)):
                state, matched = self.step(state, matched, w)
                if matched < self.shortest:
                    continue
                longest = 0
                for n, ids, own in self.ending(state):
                    if not own or n <= matched:
                        longest = max(longest, n)
                        items |= ids
                if longest:
                    start = at + 1 - longest
                    while spans and spans[-1][1] >= start:
                        start = min(start, spans.pop()[0])
                    spans.append([start, at + 1])
        return np.array(spans, _SPAN).reshape(-1, 2), items


class _Negative:
    def __iter__(self):
        return self

    def __next__(self):
        return -1


_NEGATIVE = _Negative()


def item_blocks(items: DataFrame) -> Iterator[list[tuple[str | None, list[bytes]]]]:
    """The items with words, in blocks that one automaton may hold; one block at a time is here."""
    block, size = [], 0
    for r in items.select(F.col("item_id").cast("string"), F.col("text")).toLocalIterator():
        words = word_list(r[1])
        if block and size + len(words) > MAX_AUTOMATON_WORDS:
            yield block
            block, size = [], 0
        if words:
            block.append((r[0], words))
            size += len(words)
    if block:
        yield block


def _merged(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Union of two lists of spans, sorted, overlapping and adjacent ones joined."""
    if not len(a) or not len(b):
        return b if not len(a) else a
    both = np.concatenate((a, b))
    both = both[np.argsort(both[:, 0], kind="stable")]
    ends = np.maximum.accumulate(both[:, 1])
    first = np.concatenate(([True], both[1:, 0] > ends[:-1]))
    last = np.append(np.flatnonzero(first)[1:] - 1, len(both) - 1)
    return np.column_stack((both[first, 0], ends[last]))


def with_hits(docs: DataFrame, items: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with _n_words, _spans (pairs of little-endian 64-bit word numbers) and _items.

    One pass for each block of items, without a shuffle: what earlier blocks
    found travels with the row. Passes are parted by a written table, or the
    workers of all would hold their automata at the same time.
    """
    spark = docs.sparkSession
    small_batches(spark)
    out = docs.selectExpr("*", "0L as _n_words", "cast('' as binary) as _spans", "array('') as _items")
    schema, out = out.schema, docs
    for k, block in enumerate(item_blocks(items)):
        out = written(out, "leak-pass") if k else out
        out = out.mapInArrow(_scanner(spark.sparkContext.broadcast(block), text, first=k == 0), schema)
    if out is docs:
        out = docs.mapInArrow(_scanner(spark.sparkContext.broadcast([]), text, first=True), schema)
    return out


def _scanner(block, text: str, first: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = SuffixAutomaton(block.value)
        for b in batches:
            names = b.schema.names if first else b.schema.names[:-3]
            counts, spans, found = [], [], []
            for i, t in enumerate(b.column(text).to_pylist()):
                words = word_list(t)
                own, ids = automaton.scan(words)
                if not first:
                    before = np.frombuffer(b.column("_spans")[i].as_py(), _SPAN).reshape(-1, 2)
                    own, ids = _merged(before, own), ids.union(b.column("_items")[i].as_py())
                counts.append(len(words))
                spans.append(own.tobytes())
                found.append(sorted(ids))
            yield pa.RecordBatch.from_arrays(
                [
                    *(b.column(n) for n in names),
                    pa.array(counts, pa.int64()),
                    pa.array(spans, pa.binary()),
                    pa.array(found, pa.list_(pa.string())),
                ],
                [*names, "_n_words", "_spans", "_items"],
            )

    return run


def contamination(docs: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated for every row of ``docs``."""
    hits = with_hits(docs.select("doc_id", "text"), items).drop("text")

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            spans = [np.frombuffer(s, _SPAN).reshape(-1, 2) for s in b.column("_spans").to_pylist()]
            n_hit = [int((s[:, 1] - s[:, 0]).sum()) for s in spans]
            found = b.column("_items").to_pylist()
            digests = [hashlib.sha256(",".join(x).encode()).hexdigest() for x in found]
            yield pa.RecordBatch.from_arrays(
                [
                    b.column("doc_id"),
                    b.column("_n_words"),
                    pa.array(n_hit, pa.int64()),
                    pa.array([len(x) for x in found], pa.int64()),
                    pa.array(digests, pa.string()),
                    pa.array([n > 0 for n in n_hit], pa.bool_()),
                ],
                ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return hits.mapInArrow(
        counted,
        f"doc_id {kind}, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean",
    )


def cut(text: str, spans: np.ndarray) -> str:
    """``text`` without the characters from the first to the last word of each span."""
    low = regex.sub("[A-Z]", lambda m: m[0].lower(), text)
    places = [m.span() for m in regex.finditer(WORD, low)]
    out, at = [], 0
    for a, b in spans:
        out.append(text[at : places[a][0]])
        at = places[b - 1][1]
    return "".join([*out, text[at:]])


def remove_contamination(docs: DataFrame, items: DataFrame, max_coverage: float = MAX_COVERAGE) -> DataFrame:
    """``docs`` without hit spans; a document hit in more than ``max_coverage`` of its words goes.

    Columns are those of ``docs``; n_chars, if there is one, follows the new text.
    Text around a cut does not grow together: the separators on both sides stay.
    Cutting is repeated until no window is left. Items that fit one automaton
    take one pass, in which a worker repeats the cut by itself; more of them take
    rounds over the hits of all automata, each round written.
    """
    spark, names = docs.sparkSession, docs.columns
    small_batches(spark)
    packed = docs.select(F.struct("*").alias("_row"), F.col("text").alias("_text"))
    blocks = item_blocks(items)
    only, more = next(blocks, []), next(blocks, None)
    if more is None:
        packed = packed.mapInArrow(_cutter(spark.sparkContext.broadcast(only), max_coverage), packed.schema)
    else:
        packed = _cut_in_rounds(packed, items, max_coverage)
    own = {
        "text": F.col("_text").alias("text"),
        "n_chars": F.length("_text").cast(docs.schema["n_chars"].dataType).alias("n_chars")
        if "n_chars" in names
        else None,
    }
    return packed.select(*(own.get(c) if own.get(c) is not None else F.col(f"_row.`{c}`") for c in names))


def _share(spans: np.ndarray, n_words: int) -> float:
    return int((spans[:, 1] - spans[:, 0]).sum()) / n_words if n_words else 0.0


def _cutter(block, max_coverage: float):
    """Cut one automaton's hits out of _text until none is left."""

    def clean(automaton: SuffixAutomaton, text: str | None) -> tuple[bool, str | None]:
        while True:
            words = word_list(text)
            spans, _ = automaton.scan(words)
            if not len(spans):
                return True, text
            if _share(spans, len(words)) > max_coverage:
                return False, text
            text = cut(text, spans)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = SuffixAutomaton(block.value)
        for b in batches:
            done = [clean(automaton, t) for t in b.column("_text").to_pylist()]
            rows = [b.column("_row"), pa.array([t for _, t in done], pa.string())]
            yield pa.RecordBatch.from_arrays(rows, ["_row", "_text"]).filter(pa.array([k for k, _ in done], pa.bool_()))

    return run


def _cut_in_rounds(packed: DataFrame, items: DataFrame, max_coverage: float) -> DataFrame:
    """Cut the hits of all automata out of _text, in rounds until none is left."""
    schema = packed.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep, texts = [], []
            cells = (b.column(c).to_pylist() for c in ("_text", "_spans", "_n_words"))
            for t, s, n in zip(*cells, strict=True):
                spans = np.frombuffer(s, _SPAN).reshape(-1, 2)
                keep.append(_share(spans, n) <= max_coverage)
                texts.append(cut(t, spans) if len(spans) else t)
            rows = [b.column("_row"), pa.array(texts, pa.string())]
            yield pa.RecordBatch.from_arrays(rows, ["_row", "_text"]).filter(pa.array(keep, pa.bool_()))

    while True:
        hit = written(with_hits(packed, items, "_text"), "leak-hits")
        if hit.filter(F.length("_spans") > 0).isEmpty():
            return hit.select("_row", "_text")
        packed = hit.mapInArrow(run, schema)
