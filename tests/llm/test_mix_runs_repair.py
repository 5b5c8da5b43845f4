"""Source mixing, periodic runs and conversation repair against brute force on small rows."""

from __future__ import annotations

import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from salescope.llm import conversation_repair as repair
from salescope.llm import mixing, periodic_runs, queries
from salescope.llm.common import table

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, source string"
BLANKS = " \t\n\x0b\x0c\r"


def rows_of(df):
    return [tuple(r) for r in df.collect()]


# Source mixing


def all_sums(lengths, counts):
    sums = {0}
    for x, c in zip(lengths, counts, strict=True):
        sums = {s + x * j for s in sums for j in range(c + 1)}
    return sums


def test_knapsack_is_as_near_as_any_subset():
    rng = np.random.default_rng(1)
    for _ in range(200):
        lengths = np.unique(rng.integers(1, 30, rng.integers(1, 6)))
        counts = rng.integers(0, 4, len(lengths))
        budget = int(rng.integers(0, 60))
        for span in (1 << 16, 8):
            take = mixing.fit(budget, lengths, counts, span)
            assert (take >= 0).all() and (take <= counts).all()
        take = mixing.knapsack(budget, lengths, counts)
        assert (take <= counts).all()
        best = min(abs(s - budget) for s in all_sums(lengths.tolist(), counts.tolist()))
        assert abs(int(take @ lengths) - budget) == best


def test_fit_spreads_over_the_lengths_and_meets_the_budget():
    lengths, counts = np.arange(1, 200), np.full(199, 50)
    total = int(lengths @ counts)
    take = mixing.fit(total // 3, lengths, counts, span=500)
    assert int(take @ lengths) == total // 3
    assert (np.abs(take - 50 / 3) <= 1).sum() >= 190


def test_small_sources_repeat_documents_to_meet_the_target():
    lengths, counts = np.array([785, 377, 252, 150, 144]), np.array([1, 1, 1, 2, 1])
    total = int(lengths @ counts)
    for target in (100.2, total / 2, total * 1.01, total * 1.7, total * 2.95, total * 3.0):
        got = mixing.copies(target, lengths, counts)
        assert (got >= 0).all() and (got <= 3 * counts).all()
        assert abs(int(got @ lengths) - target) <= min(lengths) / 2


def water_filling(sizes, weights, most=3):
    """Targets by exact fractions, capping every source above its limit until none is."""
    from fractions import Fraction

    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    full: set = set()
    total = sum(sizes.values())
    while True:
        left = total - sum(most * sizes[s] for s in full)
        open_weight = sum(weight[s] for s in order if s not in full)
        share = {s: Fraction(left * weight[s], open_weight) for s in order if s not in full}
        over = {s for s in share if share[s] > most * sizes[s]}
        if not over:
            return {s: float(share[s]) if s in share else float(most * sizes[s]) for s in order}
        full |= over


def mix_rows():
    rng = random.Random(4)
    rows = [(i, "w " * rng.randint(0, 40), rng.choice(["a", "b", "é", "Z", "big", "big", "big"])) for i in range(400)]
    rows += [(900 + i, "x y z", "tiny") for i in range(2)] + [(7, "same row of words", "big")] * 150
    return rows + [(None, None, None), (950, "no source here", None), (951, "", ""), (952, "\t  \n", "nb")]


def test_mix_meets_the_targets(spark):
    rows = mix_rows()
    docs = spark.createDataFrame(rows, DOCS).withColumns({"size": F.lit("own"), "target": F.lit(-1), "copies": F.lit(9)})
    got = rows_of(mixing.source_mix(docs))
    assert len(got) == len(rows)
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes: dict = {}
    for _, text, source in rows:
        sizes[source] = sizes.get(source, 0) + size(text)
    want = water_filling(sizes, (5, 2, 1))
    assert {(g[2], round(g[3], 6)) for g in got} == {(sizes[s], round(want[s], 6)) for s in sizes}
    assert all(t <= 3 * s and (s == 0 or t % s == 0) for _, s, _, _, t in got)
    kept = mixing.mix(docs, keep=("source",))
    taken = dict(rows_of(kept.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")))))
    for s, t in want.items():
        assert abs(taken[s] - t) <= (0.5 if sizes[s] > 100 else 3)
    assert sorted(got, key=repr) == sorted(rows_of(mixing.source_mix(docs.repartition(5))), key=repr)


def test_choice_descends_all_digits(spark):
    """One (source, length) with so many equal hashes that every digit is shared."""
    rows = spark.range(3000).select(
        F.lit("+s").alias("_s"), F.lit(4).cast("long").alias("size"), F.lit(5).cast("long").alias("_h"),
        F.col("id").alias("_row"),
    )
    fits = spark.createDataFrame([("+s", 4, 1, 1234)], "_s string, size long, whole int, more long")
    plan, numbered = mixing._chosen(rows, fits)
    chosen = numbered.join(plan, ["_s", "size"]).filter(mixing._first_of(plan.columns))
    assert sorted(r["_row"] for r in chosen.collect()) == list(range(1234))


@pytest.mark.parametrize("rows", [[], [(1, None, "a")], [(1, "", "a"), (2, " ", "b")]])
def test_mix_without_words(spark, rows):
    got = rows_of(mixing.source_mix(spark.createDataFrame(rows, DOCS)))
    assert sorted(got) == [(r[0], 0, 0, 0.0, 0) for r in rows]


def test_registered_mix(spark):
    docs = table(spark, SF, "documents")
    got = queries.all_queries()["op11_source_mix"](spark, SF)
    sums = got.join(docs.select("doc_id", "source"), "doc_id").groupBy("source").agg(F.sum("taken"), F.max("target"))
    assert all(abs(t - g) <= 0.01 * g + 1 for _, t, g in rows_of(sums))  # ten documents a source
    assert got.count() == docs.count()


# Periodic runs


def runs_by_force(words, shortest):
    """Every period compared along the whole text; the smallest period of an extent counts."""
    found = {}
    for p in range(1, len(words) // 2 + 1):
        i = 0
        while i + p < len(words):
            start = i
            while i + p < len(words) and words[i] == words[i + p]:
                i += 1
            if i > start and i + p - start >= max(2 * p, shortest):
                found.setdefault((start, i + p - start), p)
            i += i == start
    return sorted(((s, n, p) for (s, n), p in found.items()), key=lambda r: (r[0], r[2]))


def words_with_periods(rng):
    n, k = rng.randint(0, 90), rng.choice([1, 2, 2, 3, 9])
    words = [rng.randrange(k) for _ in range(n)]
    if n and rng.random() < 0.5:
        a = rng.randrange(n)
        p = rng.randint(1, max(1, (n - a) // 3))
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    return words


def test_runs_are_those_of_brute_force():
    rng = random.Random(2)
    for _ in range(150):
        texts = [words_with_periods(rng) for _ in range(rng.randint(1, 6))]
        shortest = rng.choice([2, 5, 12, 12])
        got = periodic_runs.runs_of([np.array(t, np.int64) for t in texts], shortest)
        assert got == [runs_by_force(t, shortest) for t in texts]


def test_agreement_is_the_common_stretch():
    rng = np.random.default_rng(5)
    words = np.append(np.concatenate([rng.integers(0, 2, 400), np.tile(rng.integers(0, 3, 7), 60)]), 99)
    levels = periodic_runs.grammar(words, 1)
    one, other = rng.integers(0, len(words), 3000), rng.integers(0, len(words), 3000)
    one, other = one[one != other], other[one != other]
    got = periodic_runs.agreement(levels, one, other)
    for i, j, n in zip(one, other, got, strict=True):
        m = 0
        while max(i, j) + m < len(words) and words[i + m] == words[j + m]:
            m += 1
        assert m == n
    assert len(levels) < 60


def run_row(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(words), zlib.crc32(str("" if doc_id is None else doc_id).encode())
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = runs_by_force(words, 12)
    dropped = {i for s, m, q in runs for i in range(s + q, s + m)}
    best = min(((-m, s, q) for s, m, q in runs), default=None)
    top = (None,) * 4 if best is None else (best[1], -best[0], best[2], 1000 * -best[0] // best[2])
    digest = hashlib.sha256("".join(f"{s},{m},{q}\n" for s, m, q in runs).encode()).hexdigest()
    kept = " ".join(w for i, w in enumerate(words) if i not in dropped)
    return (doc_id, len(runs), *top, digest, hashlib.sha256(kept.encode()).hexdigest())


RUN_TEXTS = [
    None, "", " \t\n ", "one", "a " * 11, "a " * 12, "a " * 5000, "a b c " * 4 + "a", "  x " * 8,
    "x y z w " * 3 + "x y z w q " + "q " * 30, "é " * 20 + "ü " * 20, "same same " * 9, "same same " * 9,
]


def test_run_report_on_odd_texts(spark):
    rows = [(i, t) for i, t in enumerate(RUN_TEXTS)] + [(None, "b c " * 9), (3, "one")]
    rows += [(i, " ".join(f"w{j % 37}" for j in range(i * 7))) for i in range(100, 140)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"start": F.lit("own"), "runs": F.lit(1)})
    got = rows_of(periodic_runs.run_report(docs))
    assert sorted(got, key=repr) == sorted((run_row(*r) for r in rows), key=repr)
    assert any(zlib.crc32(str(r[0]).encode()) % 10 == 0 and r[1] for r in rows)
    assert rows_of(periodic_runs.run_report(docs.limit(0))) == []


def test_known_runs_change_nothing(monkeypatch):
    monkeypatch.setattr(periodic_runs, "GRID", 16)
    rng = random.Random(12)
    for _ in range(60):
        texts = [words_with_periods(rng) for _ in range(3)]
        got = periodic_runs.runs_of([np.array(t, np.int64) for t in texts], 4)
        assert got == [runs_by_force(t, 4) for t in texts]


def test_very_long_text_of_runs(spark):
    text = " ".join(f"w{j % 1000}" for j in range(300_000))
    (row,) = rows_of(periodic_runs.periodic_runs(spark.createDataFrame([(1, text)], "doc_id long, text string")))
    assert [tuple(r) for r in row[1]] == [(0, 300_000, 1000)]
    assert row[2].split() == [f"w{j}" for j in range(1000)]


def test_registered_runs(spark):
    docs = rows_of(table(spark, SF, "documents").select("doc_id", "text"))
    short = {d for d, t in docs if len((t or "").split()) < 400}
    got = [r for r in rows_of(queries.all_queries()["op12_periodic_runs"](spark, SF))]
    assert len(got) == len(docs)
    assert {r for r in got if r[0] in short} == {run_row(*r) for r in docs if r[0] in short}


# Conversation repair


def cheapest_by_force(rows):
    """Every edit of every row and up to two inserts in every gap."""
    choices = []
    for initial, must_go, truncated in rows:
        options = [("D", "", 2)]
        if not must_go:
            extra = 5 * truncated
            options += [("K", initial, extra), ("R", "u", 1 + extra), ("R", "a", 1 + extra)]
        choices.append(options)
    inserts = ["", "u", "a", "uu", "ua", "au", "aa"]
    best = None
    for edits in itertools.product(*choices):
        for gaps in itertools.product(inserts, repeat=len(rows) + 1):
            cost = sum(c for _, _, c in edits) + 5 * sum(map(len, gaps))
            if best and cost > best[0]:
                continue
            roles, audit = gaps[0], "I" * len(gaps[0])
            for (edit, role, _), gap in zip(edits, gaps[1:], strict=True):
                roles += role + gap
                audit += edit + "I" * len(gap)
            if re.fullmatch("(s?(ua)+)?", roles) and (best is None or (cost, audit) < best):
                best = cost, audit
    return best


def whole(rows):
    ends = repair.solve(rows, repair.START)
    return min(ends[e] for e in (repair.START, repair.ASSISTANT) if e in ends)


def random_rows(rng, n):
    return [(rng.choice("suaxsu"), rng.random() < 0.2, rng.random() < 0.3) for _ in range(n)]


def in_blocks(rng, rows, most):
    blocks, at = [], 0
    while at < len(rows):
        n = rng.randint(1, most)
        blocks.append({s: repair.solve(rows[at : at + n], s) for s in range(4)})
        at += n
    return blocks


def test_edits_are_the_cheapest_and_least():
    rng = random.Random(6)
    for _ in range(120):
        rows = random_rows(rng, rng.randint(1, 3))
        want = cheapest_by_force(rows)
        assert whole(rows) == want
        assert repair.chain(iter(in_blocks(rng, rows, 2))) == want


def test_blocks_agree_with_the_whole():
    rng = random.Random(7)
    for _ in range(150):
        rows = random_rows(rng, rng.randint(1, 80))
        assert repair.chain(iter(in_blocks(rng, rows, 25))) == whole(rows)


@pytest.mark.parametrize("collide", [False, True])
def test_tree_compares_texts(monkeypatch, collide):
    if collide:  # every hash the same: the verification must settle it
        monkeypatch.setattr(repair, "_PRIME", 1)
    rng = random.Random(8)
    tree, nodes = repair.AuditTree(), [0]
    for _ in range(600):
        nodes.append(tree.grow(rng.choice(nodes[-40:]), rng.choice(["D", "I", "K", "KD", "R", "DD", "KKKK"])))
    texts = [tree.text(n) for n in nodes]
    for _ in range(4000):
        a, b = rng.randrange(len(nodes)), rng.randrange(len(nodes))
        assert tree.less(nodes[a], nodes[b]) == (texts[a] < texts[b])


def repaired_by_force(rows):
    """The query's rows from (conv_id, turn, role, text), by the rules in plain Python."""
    conversations: dict = {}
    for conv_id, turn, role, text in rows:
        kept = conversations.setdefault(conv_id, [])
        c, t = (" " if x is None else str(x) for x in (conv_id, turn))
        role, text = (" " if x is None else x for x in (role, text))
        fate = zlib.crc32(f"{c}:{t}".encode()) % 20
        if fate == 0:
            continue
        text = "" if fate == 1 else re.sub("[.!?]", "", text) if fate == 2 else text
        kept += [(turn, "user" if fate == 4 else role, text)] * (2 if fate == 3 else 1)
    out = []
    for conv_id, kept in conversations.items():
        kept.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        seen, flags = set(), []
        counts = dict(blank=0, duplicate=0, truncated=0)
        for _, role, text in kept:
            solid = text.strip(BLANKS)
            fault = "blank" if not solid else "duplicate" if (role, text) in seen else None
            fault = fault or ("truncated" if solid[-1] not in ".!?" else None)
            seen.add((role, text))
            if fault:
                counts[fault] += 1
            flags.append((role[:1], fault in ("blank", "duplicate"), fault == "truncated"))
        turns = [r[0] for r in kept if r[0] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in itertools.pairwise(flags))
        cost, audit = whole(flags)
        rest, said = iter(kept), []
        for edit in audit:
            role, text = (None, "") if edit == "I" else next(rest)[1:]
            if edit != "D":
                other = "assistant" if said and said[-1][0] == "u" else "user"
                said.append(f"{role if edit == 'K' else other}:{text}")
        digest = hashlib.sha256("\n".join(said).encode()).hexdigest()
        out.append((conv_id, gaps, *counts.values(), illegal, cost, audit, digest))
    return out


TURNS = "conv_id long, turn long, role string, text string"


def odd_turns():
    rng = random.Random(9)
    rows = [(c, t, rng.choice(["user", "assistant", "system"]), rng.choice(["Hi.", "Yes!", "no end", "", " \n", "Why?"]))
            for c in range(150) for t in range(rng.randint(1, 7))]
    rows += [(None, t, "user", "Null id.") for t in (None, 1, 2)] + [(500, None, None, None), (501, None, "user", "a.")]
    rows += [(502, t, "user", "Same.") for t in (4, 4, 4, 9)] + [(503, 1, "", "Empty role."), (504, 3, "x", "y" * 100_000)]
    rows += [(505, t // 3, "user" if t % 2 else "assistant", f"Line {t % 40}.") for t in range(300)]
    return rows


def test_repair_of_odd_turns(spark):
    rows = odd_turns()
    turns = spark.createDataFrame(rows, TURNS).withColumns({"gaps": F.lit("own"), "audit": F.lit(1), "_pos": F.lit(0)})
    got = rows_of(repair.conversation_repair(turns.repartition(7)))
    assert sorted(got, key=repr) == sorted(repaired_by_force(rows), key=repr)
    assert rows_of(repair.conversation_repair(turns.limit(0))) == []


def test_small_blocks_give_the_same_audits(spark):
    turns = repair.damaged(spark.createDataFrame(odd_turns(), TURNS).repartition(7))
    assert sorted(rows_of(repair.audits(turns, 3)), key=repr) == sorted(rows_of(repair.audits(turns)), key=repr)


def test_repaired_rows_have_their_form(spark):
    turns = spark.createDataFrame(odd_turns(), TURNS).withColumn("gone", F.lit(False))
    spoken: dict = {}
    for conv_id, place, _, role, _ in sorted(rows_of(repair.repaired(turns)), key=lambda r: (str(r[0]), r[1])):
        spoken[conv_id] = spoken.get(conv_id, "") + role[0]
        assert len(spoken[conv_id]) == place + 1
    assert spoken and all(re.fullmatch("s?(ua)+", s) for s in spoken.values())


def test_registered_repair(spark):
    turns = [tuple(r) for r in table(spark, SF, "conversations").select("conv_id", "turn", "role", "text").collect()]
    got = rows_of(queries.all_queries()["op13_conversation_repair"](spark, SF))
    assert sorted(got, key=repr) == sorted(repaired_by_force(turns), key=repr)
