"""Quality: attention-based multiple-instance learning.

A document is a bag of passages of PASSAGE_WORDS words. Each passage is encoded
from its character classes, their bigrams and how its words repeat; a learned
layer turns that into a vector; gated attention weighs the passages; the
weighted mean is scored by a logistic unit. Only documents carry labels: the
attention learns which passages decide.

Cases: a null, empty or blank text is one passage without content; repeated
rows are scored each, and in training an id has one row, that with the smallest
text hash; extra columns are not read; without training rows of both classes every score is the known share of class 1 (0.5 if nothing is known).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from salescope.llm.common import crc_remainder, run_hashes, small_batches

PASSAGE_WORDS = 64
HIDDEN = 16
ATTENTION = 16
#: The model is fitted on all passages of at most so many labelled documents of each class.
MAX_TRAIN_PER_CLASS = 500
STEPS = 150
RATE = 0.02
L2 = 1e-5

#: Characters that have a class of their own.
OWN_CLASS = " \n.,!?|$%&*#"
_N = len(OWN_CLASS) + 5  # and: lower case, upper case, digit, other ASCII, beyond ASCII
N_FEATURES = _N * _N + _N + 5


def _class_table() -> np.ndarray:
    table = np.full(256, _N - 2, np.int64)
    table[ord("a") : ord("z") + 1] = len(OWN_CLASS)
    table[ord("A") : ord("Z") + 1] = len(OWN_CLASS) + 1
    table[ord("0") : ord("9") + 1] = len(OWN_CLASS) + 2
    table[128:] = _N - 1
    for i, c in enumerate(OWN_CLASS):
        table[ord(c)] = i
    return table


CLASS = _class_table()


def passages(text: str | None) -> np.ndarray:
    """One row of features per passage; at least one row."""
    data = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
    starts, ends, words = run_hashes(data, data > 32)
    count = max(1, -(-len(starts) // PASSAGE_WORDS))
    out = np.zeros((count, N_FEATURES), np.float32)
    if not len(starts):
        return out
    firsts = starts[::PASSAGE_WORDS].copy()
    firsts[0] = 0
    sizes = np.diff(np.append(firsts, len(data)))
    of_byte = np.repeat(np.arange(count), sizes)
    cls = CLASS[data]
    pairs = of_byte[1:] * (_N * _N) + cls[:-1] * _N + cls[1:]
    bigrams = np.bincount(pairs, minlength=count * _N * _N).reshape(count, -1)
    single = np.bincount(of_byte * _N + cls, minlength=count * _N).reshape(count, -1)
    n = np.maximum(sizes, 1)[:, None]
    out[:, : _N * _N] = np.sqrt(bigrams / n)
    out[:, _N * _N : _N * _N + _N] = np.sqrt(single / n)
    of_word = np.arange(len(words)) // PASSAGE_WORDS
    per = np.bincount(of_word, minlength=count)
    order = np.lexsort((words, of_word))
    again = (words[order][1:] == words[order][:-1]) & (of_word[order][1:] == of_word[order][:-1])
    repeats = np.bincount(of_word[order][1:][again], minlength=count)
    next_same = np.bincount(of_word[1:][words[1:] == words[:-1]], minlength=count)
    out[:, -5] = repeats / per
    out[:, -4] = next_same / per
    out[:, -3] = np.bincount(of_word, np.minimum(ends - starts, 60), minlength=count) / per / 20
    out[:, -2] = np.log1p(per) / np.log1p(PASSAGE_WORDS)
    out[:, -1] = 1
    return out


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


def _softmax(e: np.ndarray, offsets: np.ndarray, bag: np.ndarray) -> np.ndarray:
    e = np.exp(e - np.maximum.reduceat(e, offsets)[bag])
    return e / np.add.reduceat(e, offsets)[bag]


def _forward(p: dict, x: np.ndarray, offsets: np.ndarray, bag: np.ndarray) -> tuple:
    h = np.tanh(((x - p["mean"]) / p["scale"]) @ p["W"] + p["b"])
    t, s = np.tanh(h @ p["V"]), _sigmoid(h @ p["U"])
    a = _softmax((t * s) @ p["w"], offsets, bag)
    z = np.add.reduceat(a[:, None] * h, offsets)
    return h, t, s, a, z, _sigmoid(z @ p["c"] + p["d"])


def attention_score(p: dict, x: np.ndarray) -> tuple[float, np.ndarray]:
    """Score of one document and the attention weight of each of its passages."""
    out = _forward(p, x, np.zeros(1, np.int64), np.zeros(len(x), np.int64))
    return float(out[5][0]), out[3]


def gradients(p: dict, x: np.ndarray, offsets: np.ndarray, bag: np.ndarray, y: np.ndarray, weight: np.ndarray) -> dict:
    """Slopes of the weighted log loss by every parameter, for features scaled already."""
    h, t, s, a, z, out = _forward(p, x, offsets, bag)
    miss = ((out - y) * weight).astype(x.dtype)
    dz = miss[:, None] * p["c"]
    da = (h * dz[bag]).sum(1)
    de = a * (da - np.add.reduceat(a * da, offsets)[bag])
    dg = de[:, None] * p["w"]
    dt, ds = dg * s * (1 - t * t), dg * t * s * (1 - s)
    dh = (a[:, None] * dz[bag] + dt @ p["V"].T + ds @ p["U"].T) * (1 - h * h)
    return {
        "W": x.T @ dh, "b": dh.sum(0), "V": h.T @ dt, "U": h.T @ ds,
        "w": (t * s).T @ de, "c": z.T @ miss, "d": miss.sum(keepdims=True),
    }


def fit_bags(bags: list[np.ndarray], y: np.ndarray) -> dict:
    """Adam over all bags; the gradient by hand. Deterministic for the order given."""
    x = np.concatenate(bags) if bags else np.zeros((1, N_FEATURES), np.float32)
    rng = np.random.default_rng(7)
    p = {
        "W": rng.normal(0, 0.3 / np.sqrt(HIDDEN), (N_FEATURES, HIDDEN)),
        "b": np.zeros(HIDDEN),
        "V": rng.normal(0, 0.3, (HIDDEN, ATTENTION)),
        "U": rng.normal(0, 0.3, (HIDDEN, ATTENTION)),
        "w": rng.normal(0, 0.3, ATTENTION),
        "c": rng.normal(0, 0.3, HIDDEN),
        "d": np.zeros(1),
    }
    fixed = {"mean": x.mean(0), "scale": np.maximum(x.std(0), 0.02)}
    share = float(y.mean()) if len(y) else 0.5
    if not len(y) or not 0 < share < 1:
        share = min(max(share, 1e-6), 1 - 1e-6)
        return p | fixed | {"c": np.zeros(HIDDEN), "d": np.array([np.log(share / (1 - share))])}
    sizes = np.array([len(b) for b in bags])
    offsets, bag = np.concatenate(([0], np.cumsum(sizes)[:-1])), np.repeat(np.arange(len(bags)), sizes)
    scaled = ((x - fixed["mean"]) / fixed["scale"]).astype(np.float32)
    p = {k: a.astype(np.float32) for k, a in p.items()}
    same = {"mean": np.float32(0), "scale": np.float32(1)}
    weight = (np.where(y == 1, 0.5 / share, 0.5 / (1 - share)) / len(y)).astype(np.float32)
    m, v = {k: np.zeros_like(a) for k, a in p.items()}, {k: np.zeros_like(a) for k, a in p.items()}
    for step in range(1, STEPS + 1):
        grads = gradients(p | same, scaled, offsets, bag, y, weight)
        for k, g in grads.items():
            g = g + L2 * p[k]
            m[k] = 0.9 * m[k] + 0.1 * g
            v[k] = 0.999 * v[k] + 0.001 * g * g
            p[k] = p[k] - RATE * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    return p | fixed


def fit(docs: DataFrame, labels: DataFrame, usable: Column, label: str = "quality") -> dict:
    """Fit on a bounded sample: per class the ids with the smallest hash, one row of each.

    Labels other than 0 and 1 are left out; of several labels of a document the
    largest counts.
    """
    small_batches(docs.sparkSession)
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
    rows = docs.select("doc_id", "text").join(picked, "doc_id")
    # One text of each id; of repeated rows, a task sends one.
    one = rows.groupBy("doc_id").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text", "y")).alias("r"))
    rows = one.select("doc_id", "r.text", "r.y")
    got = rows.mapInArrow(_train_rows, "doc_id long, y int, bag binary").toArrow()
    got = got.sort_by([("doc_id", "ascending"), ("bag", "ascending")])
    bags = [np.frombuffer(b.as_py(), np.float32).reshape(-1, N_FEATURES) for b in got["bag"]]
    return fit_bags(bags, got["y"].to_numpy().astype(float))


def _train_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        bags = [passages(t).tobytes() for t in b.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [b.column("doc_id").cast(pa.int64()), b.column("y"), pa.array(bags, pa.binary())],
            ["doc_id", "y", "bag"],
        )


def with_score(docs: DataFrame, model: dict, name: str = "_quality_score") -> DataFrame:
    """``docs`` with the score of every whole text; one pass, no shuffle."""
    small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)  # some tens of kilobytes
    out = docs.withColumn(name, F.lit(0.0)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            scores = [attention_score(sent.value, passages(t))[0] for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array(scores, pa.float64())], [*b.schema.names, name]
            )

    return docs.mapInArrow(run, out)


def not_held_out(divisor: int = 3) -> Column:
    return crc_remainder("doc_id", divisor) != 1


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs``."""
    model = fit(docs, labels, not_held_out())
    return with_score(docs.select("doc_id", "text"), model).select(
        "doc_id",
        (~not_held_out()).alias("held_out"),
        F.col("_quality_score").alias("score"),
        (F.col("_quality_score") >= 0.5).cast("int").alias("predicted"),
    )
