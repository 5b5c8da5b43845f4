"""Toxicity: a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

Features are the distinct character n-grams of a text, hashed into a fixed
number of buckets. For each bucket the log ratio of its smoothed share among
toxic and among clean training documents scales the feature, and logistic
regression with L2 is fitted on the scaled features.

The training documents, whole, become features on the executors and are written
once. Their counts by bucket are summed in Spark; the driver gets those of the
buckets that have a ratio, then document by document the buckets that do, as
one flat array of 4 bytes each. So it holds neither texts nor other buckets.

Cases: a null or empty text has no feature and gets the score of the intercept;
rows that repeat are scored each, and in training an id has one row, that with
the smallest text hash; extra columns are not read; without training rows of both classes every score is the known share of class 1 (0 if unknown).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from salescope.llm.common import crc_remainder, mixed, small_batches, written

BUCKET_BITS = 20
SIZES = (3, 4, 5, 6, 7, 8)
#: The classifier is fitted on at most so many labelled documents of each class.
MAX_TRAIN_PER_CLASS = 2500
ITERATIONS = 50
#: Chosen by four folds of the training rows of sf0.1, without its held-out rows.
L2 = 1e-3
STEP = 0.3
BLOCK_CHARS = 1 << 20
BLOCK_IDS = 1 << 20
#: A bucket has a ratio if it is in more training documents than this.
RARE = 2


def _folded(text: str | None) -> np.ndarray:
    """Lower-case code points; everything but letters and digits becomes one blank each."""
    low = (text or "").lower()
    codes = np.frombuffer(f" {low} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    ascii_word = ((codes >= 48) & (codes <= 57)) | ((codes >= 97) & (codes <= 122))
    return np.where(ascii_word | (codes >= 0xAA), codes, np.uint32(32))


def ngram_buckets(text: str | None) -> Iterator[np.ndarray]:
    """Buckets of all n-grams, with repeats, in blocks of bounded size.

    An n-gram has no blank inside; a blank at its start or end marks a word's edge.
    """
    codes = _folded(text)
    longest = max(SIZES)
    for at in range(0, max(1, len(codes)), BLOCK_CHARS):
        part = codes[at : at + BLOCK_CHARS + longest - 1].astype(np.uint64)
        own = min(BLOCK_CHARS, len(codes) - at)
        blank = part == 32
        inner = np.cumsum(np.concatenate(([0], blank)))
        rolled = part.copy()
        for n in range(2, longest + 1):
            m = len(part) - n + 1
            if m <= 0:
                break
            rolled = rolled[:m] * np.uint64(0x100000001B3) + part[n - 1 :]
            if n in SIZES:
                whole = inner[n - 1 : n - 1 + m] == inner[1 : 1 + m] if n > 2 else ~(blank[:m] & blank[1:])
                whole[own:] = False
                yield (mixed(rolled[whole] + np.uint64(n)) >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)


class Distinct:
    """Distinct buckets of a text without sorting: a scratch table keeps who came last."""

    def __init__(self) -> None:
        self._last = np.zeros(1 << BUCKET_BITS, np.int64)
        self._next = 1

    def of(self, text: str | None) -> np.ndarray:
        first, found = self._next, []
        for ids in ngram_buckets(text):
            ids = ids[self._last[ids] < first]
            mine = np.arange(self._next, self._next + len(ids))
            self._last[ids] = mine
            found.append(ids[self._last[ids] == mine])
            self._next += len(ids)
        return np.concatenate(found) if found else np.empty(0, np.int64)


@dataclass(frozen=True)
class Model:
    weights: np.ndarray
    bias: float


def score(weights: np.ndarray, bias: float, buckets: np.ndarray) -> float:
    z = float(weights[buckets].sum(dtype=np.float64)) + bias
    return float(1 / (1 + np.exp(-np.clip(z, -500, 500))))


def ratios(toxic: np.ndarray, clean: np.ndarray, n_toxic: float, n_clean: float) -> np.ndarray:
    """Log-count ratios from the numbers of toxic and clean documents that hold each bucket; 0 where rare.

    A document counts as present or absent: shares are of documents, not of all n-grams.
    """
    ratio = np.log((toxic + 1.0) / (n_toxic + 2.0)) - np.log((clean + 1.0) / (n_clean + 2.0))
    return np.where(toxic + clean > RARE, ratio, 0.0)


def fit_rows(ids: np.ndarray, lengths: np.ndarray, labels: np.ndarray, ratio: np.ndarray) -> Model:
    """Logistic regression by accelerated gradient steps.

    ``ids`` are the buckets of all documents, one after the other, ``lengths``
    says how many each has; buckets without a ratio can't move a score and may
    be left out. Temporaries are as long as a block of documents.
    """
    size = len(ratio)
    share = float(labels.mean()) if len(labels) else 0.0
    if not 0 < share < 1:
        odds = np.clip(share, 1e-6, 1 - 1e-6)
        return Model(np.zeros(size, np.float32), float(np.log(odds / (1 - odds))))
    ends = np.cumsum(lengths)
    cuts = [0, *(np.flatnonzero(np.diff(ends // BLOCK_IDS)) + 1).tolist(), len(lengths)]
    w, bias = np.zeros(size), float(np.log(share / (1 - share)))
    # Adagrad: buckets that few documents hold get larger steps than common ones.
    seen, seen_bias = np.full(size, 1e-6), 1e-6
    for _ in range(ITERATIONS):
        scaled, pull, g = w * ratio, np.zeros(size), 0.0
        for first, last in zip(cuts[:-1], cuts[1:], strict=True):
            own = ids[ends[first] - lengths[first] : ends[last - 1]]
            row = np.repeat(np.arange(last - first), lengths[first:last])
            z = np.bincount(row, scaled[own], minlength=last - first) + bias
            miss = (1 / (1 + np.exp(-np.clip(z, -500, 500))) - labels[first:last]) / len(labels)
            pull += np.bincount(own, miss[row], minlength=size)
            g += miss.sum()
        grad = pull * ratio + L2 * w
        seen += grad * grad
        w -= STEP * grad / np.sqrt(seen)
        seen_bias += g * g
        bias -= STEP * g / np.sqrt(seen_bias)
    return Model((w * ratio).astype(np.float32), float(bias))


def training_rows(docs: DataFrame, labels: DataFrame, usable: Column, label: str) -> tuple[DataFrame, dict[int, int]]:
    """(doc_id, text, y) of the picked documents, one row per id, and the labelled rows of each class.

    Per class the ids with the smallest hash are picked. Labels other than 0 and 1 are
    left out; a document labelled twice counts with its largest label.
    """
    known = (
        labels.filter(usable & F.col(label).isin(0, 1) & F.col("doc_id").isNotNull())
        .groupBy("doc_id")
        .agg(F.max(label).cast("int").alias("y"))
    )
    order = F.xxhash64("doc_id")
    parts = [
        known.filter(F.col("y") == y).orderBy(order, "doc_id").limit(MAX_TRAIN_PER_CLASS) for y in (0, 1)
    ]
    picked = F.broadcast(parts[0].unionByName(parts[1]))  # bounded by the limits above
    texts = docs.select("doc_id", "text").join(picked, "doc_id")
    # Repeated rows of an id meet as hashes first; one text of each id is kept.
    one = texts.groupBy("doc_id").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text", "y")).alias("r"))
    counts = {r["y"]: r["count"] for r in known.groupBy("y").count().collect()}
    return one.select("doc_id", "r.text", "r.y"), counts


def fit(docs: DataFrame, labels: DataFrame, usable: Column, label: str = "toxic") -> Model:
    """Fit on the whole texts of a bounded number of documents. ``usable`` is a condition on ``doc_id``."""
    small_batches(docs.sparkSession)
    chosen, counts = training_rows(docs, labels, usable, label)
    features = written(chosen.mapInArrow(_features, "doc_id long, y int, ids binary"), "toxic-features")
    n = {r["y"]: r["count"] for r in features.groupBy("y").count().collect()}
    held = features.select("y", "ids").mapInArrow(_held, "bucket int, toxic long, clean long")
    held = held.groupBy("bucket").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    common = held.filter(F.col("toxic") + F.col("clean") > RARE).toArrow()  # at most 2**BUCKET_BITS rows
    toxic, clean = np.zeros(1 << BUCKET_BITS), np.zeros(1 << BUCKET_BITS)
    toxic[common["bucket"].to_numpy()] = common["toxic"].to_numpy()
    clean[common["bucket"].to_numpy()] = common["clean"].to_numpy()
    del common
    ratio = ratios(toxic, clean, n.get(1, 0), n.get(0, 0))
    usual = features.mapInArrow(_only(docs.sparkSession.sparkContext.broadcast(toxic + clean > RARE)), features.schema)
    ids, lengths, y = np.zeros(1 << 20, np.int32), [], []
    at = 0
    for r in usual.orderBy("doc_id").toLocalIterator():
        own = np.frombuffer(r["ids"], np.int32)
        if at + len(own) > len(ids):
            ids = np.append(ids, np.zeros(max(len(ids) // 2, len(own)), np.int32))
        ids[at : at + len(own)] = own
        at += len(own)
        lengths.append(len(own))
        y.append(r["y"])
    target = np.array(y, float)
    model = fit_rows(ids[:at], np.array(lengths, np.int64), target, ratio)
    return _calibrated(model, counts, target)


def _held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many of a task's toxic and clean documents hold each bucket."""
    counts = np.zeros((2, 1 << BUCKET_BITS), np.int64)
    for b in batches:
        for y, ids in zip(b.column("y").to_pylist(), b.column("ids").to_pylist(), strict=True):
            counts[y, np.frombuffer(ids, np.int32)] += 1  # a document's buckets are distinct
    some = np.flatnonzero(counts.any(axis=0)).astype(np.int32)
    if len(some):
        yield pa.RecordBatch.from_arrays(
            [pa.array(some), pa.array(counts[1, some]), pa.array(counts[0, some])], ["bucket", "toxic", "clean"]
        )


def _only(known):
    """Rows with their buckets cut to the ``known`` ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cut = [(x := np.frombuffer(ids, np.int32))[known.value[x]].tobytes() for ids in b.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("y"), pa.array(cut, pa.binary())], ["doc_id", "y", "ids"])

    return run


def _calibrated(model: Model, counts: dict[int, int], y: np.ndarray) -> Model:
    """Move the intercept from the sample's share of class 1 to that of all labelled rows."""
    n1, n0 = y.sum(), len(y) - y.sum()
    if not (n1 and n0 and counts.get(0) and counts.get(1)):
        return model
    shift = np.log(counts[1] / counts[0]) - np.log(n1 / n0)
    return Model(model.weights, model.bias + 0.5 * float(shift))


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    distinct = Distinct()
    for b in batches:
        ids = [distinct.of(t).astype(np.int32).tobytes() for t in b.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [b.column("doc_id").cast(pa.int64()), b.column("y"), pa.array(ids, pa.binary())],
            ["doc_id", "y", "ids"],
        )


def with_score(docs: DataFrame, model: Model, text: str = "text", name: str = "_toxic_score") -> DataFrame:
    """``docs`` with the score of every whole text; one pass, no shuffle."""
    small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast((model.weights, model.bias))  # 2**BUCKET_BITS weights
    out = docs.withColumn(name, F.lit(0.0)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        distinct = Distinct()
        for b in batches:
            scores = [score(*sent.value, distinct.of(t)) for t in b.column(text).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array(scores, pa.float64())], [*b.schema.names, name]
            )

    return docs.mapInArrow(run, out)


def not_held_out(divisor: int = 5) -> Column:
    return crc_remainder("doc_id", divisor) != 0


def toxicity_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs``."""
    model = fit(docs, labels, not_held_out())
    scored = with_score(docs.select("doc_id", "text"), model)
    return scored.select(
        "doc_id",
        (~not_held_out()).alias("held_out"),
        F.col("_toxic_score").alias("score"),
        (F.col("_toxic_score") >= 0.5).cast("int").alias("predicted"),
    )


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """``docs`` without the documents that score at least ``threshold``; all columns kept."""
    model = fit(docs, labels, not_held_out())
    kept = with_score(docs.select(F.struct("*").alias("_row"), F.col("text").alias("_text")), model, "_text")
    return kept.filter(F.col("_toxic_score") < threshold).select("_row.*")
