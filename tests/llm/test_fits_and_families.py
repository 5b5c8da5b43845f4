"""The toxicity and quality fits against plain loops, and near-dedup on large families by alignment of all pairs."""

from __future__ import annotations

import random
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from salescope.llm import order_minhash, quality, toxicity
from salescope.llm.alignment import similar
from salescope.llm.common import word_hashes

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def rows_of(df):
    return [tuple(r) for r in df.collect()]


def docs_of(spark, rows):
    return spark.createDataFrame([(d, t, "en", "s", len(t or "")) for d, t in rows], DOCS)


def test_ratios_are_those_of_plain_counts():
    rng = np.random.default_rng(1)
    docs = [set(rng.choice(40, rng.integers(1, 20), replace=False).tolist()) for _ in range(30)]
    y = [int(rng.integers(0, 2)) for _ in docs]
    toxic = np.array([sum(b in d for d, v in zip(docs, y) if v) for b in range(40)])
    clean = np.array([sum(b in d for d, v in zip(docs, y) if not v) for b in range(40)])
    got = toxicity.ratios(toxic, clean, sum(y), len(y) - sum(y))
    for b in range(40):
        p, q = (toxic[b] + 1) / (sum(y) + 2), (clean[b] + 1) / (len(y) - sum(y) + 2)
        assert got[b] == pytest.approx(np.log(p / q) if toxic[b] + clean[b] > 2 else 0.0)


def loss(w, bias, docs, y, ratio):
    total = 0.0
    for d, label in zip(docs, y, strict=True):
        z = sum(w[b] * ratio[b] for b in d) + bias
        total += np.log1p(np.exp(-z if label else z))
    return total / len(docs) + toxicity.L2 / 2 * float(w @ w)


def test_fit_follows_the_gradient_of_the_loss(monkeypatch):
    """One step against finite differences, and many steps lower the loss; blocks change nothing."""
    rng = np.random.default_rng(2)
    docs = [rng.choice(12, rng.integers(0, 8), replace=False) for _ in range(20)]
    y = np.array([i % 3 == 0 for i in range(20)], float)
    ratio = rng.normal(size=12)
    flat = (np.concatenate(docs).astype(np.int32), np.array([len(d) for d in docs]), y, ratio)
    monkeypatch.setattr(toxicity, "ITERATIONS", 1)
    one = toxicity.fit_rows(*flat)
    start = float(np.log(y.mean() / (1 - y.mean())))
    zero, eps = np.zeros(12), 1e-6
    for b in range(12):
        step = np.eye(12)[b] * eps
        slope = (loss(step, start, docs, y, ratio) - loss(-step, start, docs, y, ratio)) / (2 * eps)
        moved = -toxicity.STEP * slope / np.sqrt(1e-6 + slope * slope) * ratio[b]
        assert one.weights[b] == pytest.approx(moved, abs=1e-4)
    monkeypatch.setattr(toxicity, "ITERATIONS", 50)
    many = toxicity.fit_rows(*flat)
    assert loss(many.weights / ratio, many.bias, docs, y, ratio) < loss(zero, start, docs, y, ratio)
    monkeypatch.setattr(toxicity, "BLOCK_IDS", 7)
    small = toxicity.fit_rows(*flat)
    assert np.allclose(small.weights, many.weights) and small.bias == pytest.approx(many.bias)


def attention_model(rng):
    h, n = quality.HIDDEN, quality.N_FEATURES
    p = {"W": rng.normal(size=(n, h)) / 8, "b": rng.normal(size=h), "c": rng.normal(size=h), "d": rng.normal(size=1)}
    p |= {k: rng.normal(size=(h, quality.ATTENTION)) for k in "VU"} | {"w": rng.normal(size=quality.ATTENTION)}
    return p | {"mean": rng.normal(size=n) / 8, "scale": 1 + rng.random(n)}


def plain_score(p, x):
    """One document, passage by passage."""
    hidden, energies = [], []
    for row in x:
        h = np.tanh((row - p["mean"]) / p["scale"] @ p["W"] + p["b"])
        hidden.append(h)
        energies.append(float((np.tanh(h @ p["V"]) / (1 + np.exp(-(h @ p["U"])))) @ p["w"]))
    weights = [np.exp(e) / sum(np.exp(f) for f in energies) for e in energies]
    z = sum(w * h for w, h in zip(weights, hidden, strict=True))
    return 1 / (1 + np.exp(-(z @ p["c"] + p["d"][0]))), weights


def test_attention_follows_plain_loops():
    rng = np.random.default_rng(5)
    p = attention_model(rng)
    for size in (1, 2, 9):
        x = rng.random((size, quality.N_FEATURES))
        score, weights = quality.attention_score(p, x)
        want, want_weights = plain_score(p, x)
        assert score == pytest.approx(want) and np.allclose(weights, want_weights)


def test_quality_gradients_are_slopes_of_the_loss():
    rng = np.random.default_rng(6)
    p = attention_model(rng) | {"mean": 0.0, "scale": 1.0}
    sizes, y, weight = [3, 1, 4], np.array([1.0, 0.0, 1.0]), np.array([0.2, 0.5, 0.3])
    bags = [rng.random((n, quality.N_FEATURES)) for n in sizes]

    def loss_of(p):
        scores = [plain_score(p, x)[0] for x in bags]
        return -sum(w * np.log(s if v else 1 - s) for s, v, w in zip(scores, y, weight, strict=True))

    offsets, bag = np.array([0, 3, 4]), np.repeat(np.arange(3), sizes)
    got = quality.gradients(p, np.concatenate(bags), offsets, bag, y, weight)
    for name, grad in got.items():
        for place in rng.integers(0, p[name].size, 5):
            step = np.zeros(p[name].size)
            step[place] = 1e-5
            step = step.reshape(p[name].shape)
            slope = (loss_of(p | {name: p[name] + step}) - loss_of(p | {name: p[name] - step})) / 2e-5
            assert grad.reshape(-1)[place] == pytest.approx(slope, rel=1e-4, abs=1e-8)


def test_quality_trains_on_all_passages_and_on_one_row_of_an_id(spark, monkeypatch):
    long = "good words here " * 2000
    rows = [(i, f"text {i} " * 30) for i in range(2, 40)] + [(1, long)] + [(1, "other")] * 60
    labels = [(i, i % 2, 0) for i in range(1, 40)]
    seen = []
    monkeypatch.setattr(quality, "fit_bags", lambda bags, y: seen.append((bags, y)))
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    quality.fit(docs_of(spark, rows), known, F.lit(True))
    texts = dict(rows[:38]) | {1: min((long, "other"), key=lambda t: spark.range(1).select(F.xxhash64(F.lit(t))).first()[0])}
    (bags, y), ids = seen[0], sorted(texts)
    assert [len(b) for b in bags] == [len(quality.passages(texts[i])) for i in ids]
    assert y.tolist() == [i % 2 for i in ids] and len(quality.passages(long)) == 94


def test_a_labelled_id_in_a_third_of_the_rows_trains_once(spark):
    rng = random.Random(3)
    vocabulary = [f"word{i}" for i in range(50)]
    rows, labels = [], []
    for i in range(1, 121):
        toxic = i % 4 == 0
        words = rng.sample(vocabulary, 12) + (["vilefilth"] if toxic else [])
        rows.append((i, " ".join(words)))
        labels.append((i, 1, int(toxic)))
    hot = [(2, f"other text number {i % 3} vilefilth") for i in range(60)]
    docs, known = docs_of(spark, rows + hot), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    chosen, counts = toxicity.training_rows(docs, known, F.lit(True), "toxic")
    got = rows_of(chosen)
    assert sorted(r[0] for r in got) == list(range(1, 121)) and counts == {0: 90, 1: 30}
    scored = rows_of(toxicity.toxicity_scores(docs, known))
    assert len(scored) == 180
    toxic = {d for d, _, t in labels if t}
    scores = {x: [s for d, _, s, _ in scored if d != 2 and (d in toxic) == x] for x in (True, False)}
    assert min(scores[True]) > max(scores[False])


def test_toxic_words_beyond_the_first_characters_are_learned(spark):
    filler = "plain words of no harm " * 1200  # 27,600 characters
    rows = [(i, filler + ("vilefilth foulrot" if i % 2 else "kind words")) for i in range(40)]
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(40)], "doc_id long, quality int, toxic int")
    got = rows_of(toxicity.toxicity_scores(docs_of(spark, rows), labels))
    assert min(s for d, _, s, _ in got if d % 2) > max(s for d, _, s, _ in got if not d % 2)


@pytest.mark.parametrize("words, edits", [(320, 0.02), (320, 0.05), (60, 0.05)])
def test_a_large_family_is_one_class(spark, words, edits):
    """Independent edits of one text, so that pairs differ in twice as many words; alike is alike by alignment."""
    rng = random.Random(words)
    base = [f"w{rng.randint(0, 5000)}" for _ in range(words)]
    texts = []
    for _ in range(400):
        copy = list(base)
        for at in rng.sample(range(words), int(edits * words)):
            copy[at] = f"n{rng.randint(0, 10**6)}"
        texts.append(" ".join(copy))
    hashes = [word_hashes(t).astype("<u4") for t in texts]
    alike = sum(similar(hashes[a], hashes[b], 0.8) for a, b in combinations(range(0, 400, 20), 2))
    assert alike == 190
    classes = [c for _, c in rows_of(order_minhash.near_duplicates(docs_of(spark, list(enumerate(texts)))))]
    assert classes.count(0) >= 0.99 * len(texts)


@pytest.mark.parametrize("words", [50, 100, 300])
def test_recall_by_share_of_words_edited(spark, words):
    """Lone pairs that differ in a share of their words; whether they are alike is not asked of the sketch."""
    rng = random.Random(words)
    texts, pairs = [], {}
    for share in (0.05, 0.10, 0.15, 0.19):
        for _ in range(150):
            base = [f"w{rng.randint(0, 5000)}" for _ in range(words)]
            copy = list(base)
            for at in rng.sample(range(words), int(share * words)):
                copy[at] = f"n{rng.randint(0, 10**6)}"
            pairs.setdefault(share, []).append((len(texts), len(texts) + 1))
            texts += [" ".join(base), " ".join(copy)]
    of = dict(rows_of(order_minhash.near_duplicates(docs_of(spark, list(enumerate(texts))))))
    for share, some in pairs.items():
        assert sum(of[a] == of[b] for a, b in some) >= (0.99 if share < 0.15 else 0.9) * len(some), share


def agreeing_and_similar(texts):
    """The least text of each class by plain loops: two are linked if a component agrees and the alignment is near."""
    hashes = [word_hashes(t) for t in texts]
    sketches = np.array([order_minhash.sketch(h) for h in hashes])
    of = list(range(len(texts)))
    for a, b in combinations(range(len(texts)), 2):
        if of[a] != of[b] and (sketches[a] == sketches[b]).any():
            if similar(hashes[a].astype("<u4"), hashes[b].astype("<u4"), 0.8):
                low, high = sorted((of[a], of[b]))
                of = [low if x == high else x for x in of]
    return of


@pytest.mark.parametrize("block", [2048, 16, 3])
def test_a_group_of_unlike_texts_is_searched_whole(spark, block, monkeypatch):
    """Pairs that agree only in a passage that 260 unlike texts of many lengths share."""
    monkeypatch.setattr(order_minhash, "GROUP_ROWS", block)
    rng = random.Random(8)
    word = lambda: f"w{rng.randint(0, 10**6)}"
    passage, texts = [word() for _ in range(60)], []
    for _ in range(200):
        texts.append([*(word() for _ in range(rng.randint(25, 90))), *passage])
    for _ in range(30):
        own = [word() for _ in range(rng.randint(30, 50))]
        texts += [[*own, *passage], [*(w if i % 3 else word() for i, w in enumerate(own)), *passage]]
    texts = [" ".join(t) for t in texts]
    want = agreeing_and_similar(texts)
    assert len(set(want)) == 230
    assert dict(rows_of(order_minhash.near_duplicates(docs_of(spark, list(enumerate(texts)))))) == dict(enumerate(want))


def test_word_counts_reject_no_pair_that_is_alike():
    rng = random.Random(3)
    for _ in range(300):
        a = np.array([rng.randint(0, 300) for _ in range(rng.randint(1, 90))], np.uint64)
        b = np.array([w for w in a for w in ([w] if rng.random() > 0.2 else [rng.randint(0, 300)] * rng.randint(0, 2))], np.uint64)
        longer, gap = max(len(a), len(b)), abs(len(a) - len(b))
        ca, cb = (order_minhash.bucket_counts(x).astype(int) for x in (a, b))
        if similar(a.astype("<u4"), b.astype("<u4"), 0.8):
            assert abs(ca - cb).sum() <= 2 * int(0.2 * longer + 1e-9) - gap
