"""Periodic runs: where a text repeats a stretch of words over and over.

A run is a stretch of words with smallest period q, at least twice as long as q
and at least MIN_WORDS long, that no word on either side extends.

Recompression turns the words into a run-length grammar: rounds replace blocks
of one symbol by (symbol, length) and then pairs of a left and a right symbol,
where a hash of the symbol says which it is. As each choice looks at neighbours
only, equal stretches are parsed alike but for their ends. How far two places
agree is then read off the grammar: climb while both stand at the beginning of
equal symbols, descend where they differ; a block's copies are passed at once.

A run of period p covers two neighbouring points of the grid 0, p, 2p, ..., so
only pairs of equal words p apart on that grid are extended, forwards and,
through the mirrored grammar, backwards. Of several periods with one extent the
smallest is the run's period. No suffix array is built.

Many texts share one grammar: each is closed by a symbol of its own, which ends
every match. All steps are array operations over the whole batch.

Scale: one pass without a shuffle. A task holds the words of CHUNK_WORDS or of
one longer text, some ten numbers a word; the grid is walked GRID pairs at a time.

Cases: a null or empty text has no words and no runs; texts shorter than
MIN_WORDS have none either; null ids are kept; repeated rows are answered each;
an empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from salescope.llm.common import mixed, small_batches

#: Shortest run, in words.
MIN_WORDS = 12
#: Words that share a grammar, and grid pairs compared at once.
CHUNK_WORDS = 1 << 17
GRID = 1 << 20
#: So many of a long text's longest runs spare it further comparisons inside them.
KNOWN = 8
_SPACES = r"[\x20\x09-\x0D]+"


@dataclass
class Level:
    """One string of the grammar: per symbol its id, its length in words, its parent and its parent's first child."""

    symbols: np.ndarray
    sizes: np.ndarray
    parents: np.ndarray | None = None  # in the next level
    firsts: np.ndarray | None = None  # per symbol of the next level, its first symbol here
    blocks: bool = False  # whether the next level's symbols are blocks of one symbol

    def mirrored(self) -> Level:
        n = len(self.symbols)
        parents = firsts = None
        if self.parents is not None:
            m = len(self.firsts)
            parents = (m - 1 - self.parents)[::-1]
            lasts = np.append(self.firsts[1:], n) - 1
            firsts = (n - 1 - lasts)[::-1]
        return Level(self.symbols[::-1], self.sizes[::-1], parents, firsts, self.blocks)


def _grouped(level: Level, starts: np.ndarray, blocks: bool) -> Level:
    """The next level, whose symbols begin at ``starts``; equal contents get equal ids."""
    n = len(level.symbols)
    begins = np.zeros(n, np.int64)
    begins[starts] = 1
    level.parents, level.firsts, level.blocks = np.cumsum(begins) - 1, starts, blocks
    counts = np.diff(np.append(starts, n))
    first = level.symbols[starts]
    if blocks:
        second = counts
    else:
        second = np.where(counts == 2, level.symbols[np.minimum(starts + 1, n - 1)] + 1, 0)
    # Symbols and counts stay below 2^31, as a chunk has fewer words.
    _, ids = np.unique((first << 32) | second, return_inverse=True)
    return Level(ids.astype(np.int64), np.add.reduceat(level.sizes, starts))


def grammar(words: np.ndarray, texts: int) -> list[Level]:
    """Levels from the words up, until hardly more symbols than ``texts`` are left."""
    levels = [Level(words.astype(np.int64), np.ones(len(words), np.int64))]
    turn = 0
    while len(levels[-1].symbols) > max(2 * texts, 2) and turn < 200:
        s = levels[-1].symbols
        starts = np.flatnonzero(np.append(True, s[1:] != s[:-1]))
        if len(starts) < len(s):
            levels.append(_grouped(levels[-1], starts, True))
            s = levels[-1].symbols
        left = (mixed(s.astype(np.uint64) + np.uint64((turn + 1) << 40)) & np.uint64(1)).astype(bool)
        one, other = left[:-1] & ~left[1:], ~left[:-1] & left[1:]
        pair = one if one.sum() >= other.sum() else other
        keep = np.append(True, ~pair)
        if not keep.all():
            levels.append(_grouped(levels[-1], np.flatnonzero(keep), False))
        turn += 1
    return levels


def agreement(levels: Sequence[Level], one: np.ndarray, other: np.ndarray) -> np.ndarray:
    """How many words from place ``one`` on equal those from place ``other`` on, for many pairs of places.

    Every text ends with a symbol of its own, so a match ends before it.
    """
    found = np.zeros(len(one), np.int64)
    a, b, live = one.astype(np.int64), other.astype(np.int64), np.arange(len(one))
    waiting: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # by level: places that differ there
    for h, level in enumerate(levels):
        stopped: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        ready: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        top = h == len(levels) - 1
        while len(live):
            if not top:
                up = (level.firsts[level.parents[a]] == a) & (level.firsts[level.parents[b]] == b)
                if up.any():
                    ready.append((level.parents[a[up]], level.parents[b[up]], live[up]))
                    a, b, live = a[~up], b[~up], live[~up]
            same = level.symbols[a] == level.symbols[b]
            stopped.append((a[~same], b[~same], live[~same]))
            a, b, live = _step(level, a[same], b[same], live[same], found, len(levels[0].symbols))
        waiting.append(_joined(stopped))
        if top:
            break
        a, b, live = _joined(ready)
    a, b, live = waiting[-1]
    for h in range(len(levels) - 2, -1, -1):
        level = levels[h]
        a, b = level.firsts[a], level.firsts[b]
        rest: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = [waiting[h]]
        while len(live):
            same = level.symbols[a] == level.symbols[b]
            rest.append((a[~same], b[~same], live[~same]))
            a, b, live = _step(level, a[same], b[same], live[same], found, len(levels[0].symbols))
        a, b, live = _joined(rest)
    return found


def _step(level: Level, a: np.ndarray, b: np.ndarray, live: np.ndarray, found: np.ndarray, n: int):
    """Pass a symbol, or as many copies as both blocks still have."""
    copies = 1
    if level.blocks and len(a):
        ends = np.append(level.firsts[1:], len(level.symbols))
        copies = np.minimum(ends[level.parents[a]] - a, ends[level.parents[b]] - b)
    found[live] += copies * level.sizes[a]
    return a + copies, b + copies, live


def _joined(parts: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    if not parts:
        return (np.zeros(0, np.int64),) * 3
    return tuple(np.concatenate(x) for x in zip(*parts))  # type: ignore[return-value]


def _grid(words: np.ndarray, begin: int, n: int, shortest: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places i and periods p of one text, i on the grid of p, with equal words at i and i + p.

    In a run at least half of ``shortest`` places in a row equal those p later,
    so half of these lie on one side of i; other pairs are left out.
    """
    side = -(-(-(-shortest // 2) - 1) // 2)
    last = len(words) - 1
    p = 1
    while p <= n // 2:
        # Periods p to q - 1 have about GRID points together.
        q = p + 1
        points = (n - 1) // p
        while q <= n // 2 and points + (n - 1) // q <= GRID:
            points += (n - 1) // q
            q += 1
        periods = np.arange(p, q)
        counts = (n - 1) // periods
        period = np.repeat(periods, counts)
        nth = np.arange(len(period)) - np.repeat(np.cumsum(counts) - counts, counts)
        at = begin + nth * period
        same = words[at] == words[at + period]
        at, period = at[same], period[same]
        after, before = np.ones(len(at), bool), np.ones(len(at), bool)
        for k in range(1, side + 1):
            after &= words[np.minimum(at + k, last)] == words[np.minimum(at + period + k, last)]
            before &= words[np.maximum(at - k, 0)] == words[np.maximum(at + period - k, 0)]
        yield at[after | before], period[after | before]
        p = q


def runs_of(texts: Sequence[np.ndarray], shortest: int = MIN_WORDS) -> list[list[tuple[int, int, int]]]:
    """All runs (start, length, period) of each text of word ids, by start, then period."""
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    long = [i for i, t in enumerate(texts) if len(t) >= shortest]
    if not long:
        return out
    top = max(int(texts[i].max()) for i in long) + 1
    # A closing symbol before the first and after every text.
    parts, begins, place = [np.array([top])], [], 1
    for k, i in enumerate(long):
        parts += [texts[i], np.array([top + 1 + k])]
        begins.append(place)
        place += len(texts[i]) + 1
    words = np.concatenate(parts)
    levels = grammar(words, len(long))
    mirror = [level.mirrored() for level in levels]
    last = len(words) - 1
    at, period, text = [], [], []
    rows: list[np.ndarray] = []

    def extend() -> None:
        if not at:
            return
        i, p, t = np.concatenate(at), np.concatenate(period), np.concatenate(text)
        at.clear(), period.clear(), text.clear()
        start = i - agreement(mirror, last - i + 1, last - i - p + 1)
        length = i + p + agreement(levels, i, i + p) - start
        good = length >= np.maximum(shortest, 2 * p)
        rows.append(np.unique(np.stack([t, start, length, p], axis=1)[good], axis=0))

    held = 0
    for k, (i, begin) in enumerate(zip(long, begins, strict=True)):
        known = np.zeros((0, 4), np.int64)
        for places, periods in _grid(words, begin, len(texts[i]), shortest):
            for _, start, length, p in known.tolist():  # pairs that would only find this run again
                new = (periods % p != 0) | (places < start) | (places + periods >= start + length)
                places, periods = places[new], periods[new]
            at.append(places)
            period.append(periods)
            text.append(np.full(len(places), k))
            held += len(places)
            if held > GRID // 4:
                extend()
                held = 0
                mine = rows[-1][rows[-1][:, 0] == k]
                known = mine[np.argsort(-mine[:, 1], kind="stable")[:KNOWN]]
    extend()
    found = np.unique(np.concatenate(rows), axis=0)
    # Sorted by text, start, length, period: the first of an extent has its smallest period.
    fresh = np.append(True, (found[1:, :3] != found[:-1, :3]).any(axis=1))[: len(found)]
    for k, start, length, p in found[fresh].tolist():
        out[long[k]].append((start - begins[k], length, p))
    for runs in out:
        runs.sort(key=lambda r: (r[0], r[2]))
    return out


def collapsed(words: Sequence[bytes], runs: Sequence[tuple[int, int, int]]) -> bytes:
    """The words that no run repeats, joined by blanks: of each run only its first period stays."""
    if not runs:
        return b" ".join(words)
    change = np.zeros(len(words) + 1, np.int64)
    for start, length, p in runs:
        change[start + p] += 1
        change[start + length] -= 1
    return b" ".join(words[i] for i in np.flatnonzero(np.cumsum(change)[:-1] == 0))


def _answers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    run_type = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
    for b in batches:
        texts = b.column("text").cast(pa.large_binary()).to_pylist()
        at = 0
        while at < len(texts):
            ids: dict[bytes, int] = {}
            lists, coded, held, begin = [], [], 0, at
            while at < len(texts) and (not held or held + len(texts[at] or b"") // 4 < CHUNK_WORDS):
                words = (texts[at] or b"").split()  # bytes split at exactly the six ASCII blanks
                lists.append(words)
                coded.append(np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, len(words)))
                held += len(words)
                at += 1
            runs = runs_of(coded)
            rows = [[{"start": s, "length": n, "period": p} for s, n, p in r] for r in runs]
            yield pa.RecordBatch.from_arrays(
                [
                    b.column("doc_id").slice(begin, at - begin),
                    pa.array(rows, run_type),
                    pa.array([collapsed(w, r).decode() for w, r in zip(lists, runs, strict=True)], pa.large_string()),
                ],
                ["doc_id", "runs", "collapsed"],
            )


def periodic_runs(docs: DataFrame) -> DataFrame:
    """doc_id, ``runs`` (start, length, period; by start, then period) and the ``collapsed`` text of every row."""
    small_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    run = "struct<start:bigint,length:bigint,period:bigint>"
    return docs.select("doc_id", "text").mapInArrow(_answers, f"doc_id {kind}, runs array<{run}>, collapsed string")


def planted(docs: DataFrame) -> DataFrame:
    """doc_id and text, where the hash of one id in ten says that the text's end repeats a stretch of its words."""
    h = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    words = F.array_remove(F.split(F.coalesce("text", F.lit("")), _SPACES), "")
    g, n = F.floor(F.col("_h") / 10), F.size("_words")
    first = g % n
    period = F.floor((n - F.col("_a")) / (g % 8 + 3)) + 1

    def word(i: Column) -> Column:
        source = F.when(i < F.col("_a"), i).otherwise(F.col("_a") + (i - F.col("_a")) % F.col("_p"))
        return F.get(F.col("_words"), source.cast("int"))

    rows = docs.select("doc_id", "text", h.alias("_h"))
    chosen = F.col("_h") % 10 == 0
    rows = rows.withColumn("_words", F.when(chosen, words)).withColumn("_a", F.when(n > 0, first))
    rows = rows.withColumn("_p", period)
    repeated = F.array_join(F.transform(F.sequence(F.lit(0), n - 1), word), " ")
    return rows.select("doc_id", F.when(chosen & (n > 0), repeated).otherwise(F.col("text")).alias("text"))


def run_report(docs: DataFrame) -> DataFrame:
    """The registered query: the runs of ``planted`` documents, their longest one and digests."""
    found = periodic_runs(planted(docs))
    longest = F.array_sort(
        F.transform("runs", lambda r: F.struct((-r["length"]).alias("l"), r["start"].alias("s"), r["period"].alias("p")))
    )
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    listed = F.concat(F.array_join(lines, "\n"), F.when(F.size("runs") > 0, "\n").otherwise(""))
    top = F.get(longest, F.lit(0))
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        top["s"].alias("start"),
        (-top["l"]).alias("length"),
        top["p"].alias("period"),
        F.floor(-top["l"] * 1000 / top["p"]).cast("long").alias("exponent_milli"),
        F.sha2(listed.cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
