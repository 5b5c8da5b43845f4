"""The training-data operators against brute force, exact round trips and held-out rows."""

from __future__ import annotations

import hashlib
import io
import random
import zlib
from itertools import combinations

import duckdb
import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from salescope.llm import decontaminate, license_scan, line_spread, nn_descent, order_minhash, packing
from salescope.llm import quality, queries, sql, token_frames, toxicity, warc
from salescope.llm.alignment import banded_distance, similar
from salescope.llm.common import table, word_hashes, word_list
from salescope.llm.tokens import PieceIds

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [None, "", "  \n ", "the cat", "a b c d", "x" * 5000, "Ünï çödé %% 12", "same text here", "same text here"]


def odd_docs(spark):
    rows = [(i, t, "en", f"s{i % 2}" if i else None, len(t or "")) for i, t in enumerate(ODD)]
    rows += [(None, "no id", None, None, None), (3, "the cat", "en", "s1", 7)]
    return spark.createDataFrame(rows, DOCS).withColumns({"score": F.lit("own"), "n_words": F.lit(-1)})


def empty_docs(spark):
    return spark.createDataFrame([], DOCS)


def items(spark, rows):
    return spark.createDataFrame(rows, "item_id long, text string")


def labels(spark, rows=()):
    return spark.createDataFrame(list(rows), "doc_id long, quality int, toxic int")


def rows_of(df):
    return [tuple(r) for r in df.collect()]


@pytest.mark.parametrize("name", sorted(sql.all_sql()))
def test_queries_match_their_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.execute(sql.all_sql()[name])
    names = sorted(c[0] for c in want.description)
    want = con.execute(f"SELECT {', '.join(names)} FROM ({sql.all_sql()[name]})").fetchall()
    got = queries.all_queries()[name](spark, SF).select(*names)
    assert sorted(rows_of(got), key=repr) == sorted(want, key=repr)


# WARC


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def test_warc_odd_pages(spark):
    big = "é" * 200_000
    rows = [(1, "u", big), (2, "u", big), (2, "u", big), (3, None, None), (4, "", ""), (None, "u", big), (5, "u", "x")]
    got = sorted(rows_of(warc.warc_round_trip(pages(spark, rows))), key=repr)
    digest = hashlib.sha1(big.encode()).hexdigest()
    empty = hashlib.sha1(b"").hexdigest()
    want = [
        (1, 400_000, digest, "revisit", 2),
        (2, 400_000, digest, "response", None),
        (2, 400_000, digest, "response", None),
        (3, 0, empty, "response", None),
        (4, 0, empty, "response", None),
        (None, 400_000, digest, "revisit", 2),
        (5, 1, hashlib.sha1(b"x").hexdigest(), "response", None),
    ]
    assert got == sorted(want, key=repr)
    assert rows_of(warc.warc_round_trip(pages(spark, []))) == []


def test_warc_chunks_join_to_the_payload():
    payload = bytes(random.Random(1).randbytes(300_000)) + b"\r\nWARC/1.1\r\n"
    digest = hashlib.sha1(payload).hexdigest()
    data = zlib.compressobj(3, zlib.DEFLATED, 31)
    record = b"".join(data.compress(p) for p in warc.record_parts(7, "http://a b", payload, digest, None)) + data.flush()
    chunks = list(warc.chunk_rows(io.BytesIO(record + record)))
    one = chunks[: len(chunks) // 2]
    assert b"".join(c[5] for c in one) == payload and [c[4] for c in one] == list(range(len(one)))
    assert all(len(c[5]) <= warc.CHUNK_BYTES for c in chunks)
    so_far = hashlib.sha1()
    for c in one:
        so_far.update(c[5])
        assert c[7] == so_far.hexdigest()
    assert [c[8] for c in one] == [False] * (len(one) - 1) + [True]
    with pytest.raises((ValueError, zlib.error)):
        list(warc.chunk_rows(io.BytesIO(record[: len(record) // 2])))


# Classifiers


@pytest.mark.parametrize("operator, label", [(quality.quality_scores, "quality"), (toxicity.toxicity_scores, "toxic")])
def test_classifier_on_held_out_rows(spark, operator, label):
    d = "/root/testdata/sf0.1"
    known = {r["doc_id"]: r[label] for r in table(spark, d, "labels").collect()}
    got = operator(table(spark, d, "documents"), table(spark, d, "labels")).collect()
    assert len(got) == table(spark, d, "documents").count()
    held = [(r["predicted"], known[r["doc_id"]]) for r in got if r["held_out"] and r["doc_id"] in known]
    assert sum(p == y for p, y in held) / len(held) > 0.93
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got)
    divisor, out = (3, 1) if label == "quality" else (5, 0)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % divisor == out) for r in got)


def test_toxic_held_out_rows_are_found(spark):
    d = "/root/testdata/sf0.1"
    got = toxicity.toxicity_scores(table(spark, d, "documents"), table(spark, d, "labels")).filter("held_out")
    known = table(spark, d, "labels").filter("toxic is not null").select("doc_id", "toxic")
    lang = table(spark, d, "documents").select("doc_id", "lang")
    rows = got.join(known, "doc_id").join(lang, "doc_id").collect()
    found = {x: [r["predicted"] for r in rows if r["toxic"] == 1 and r["lang"] == x] for x in ("en", "de", "es", "fr")}
    wrong = [r["predicted"] for r in rows if r["toxic"] == 0]
    print({x: (sum(v), len(v)) for x, v in found.items()}, sum(wrong), len(wrong))
    assert sum(map(sum, found.values())) / sum(map(len, found.values())) >= 0.7
    assert all(np.mean(found[x]) >= 0.4 for x in ("en", "de", "fr")) and np.mean(wrong) <= 0.01


@pytest.mark.parametrize("operator", [quality.quality_scores, toxicity.toxicity_scores])
def test_classifier_odd_rows(spark, operator):
    docs = odd_docs(spark)
    got = operator(docs, labels(spark, [(3, 0, 1), (4, 1, 0), (5, None, None), (None, 1, 1), (6, 1, 0)])).collect()
    assert len(got) == docs.count() and all(0 <= r["score"] <= 1 for r in got)
    assert operator(empty_docs(spark), labels(spark)).count() == 0
    assert operator(docs, labels(spark)).count() == docs.count()


def test_ngrams_are_found_in_blocks_alike(monkeypatch):
    text = "some words that go on " * 50
    whole = set(toxicity.Distinct().of(text).tolist())
    monkeypatch.setattr(toxicity, "BLOCK_CHARS", 64)
    found = toxicity.Distinct().of(text)
    assert set(found.tolist()) == whole and len(found) == len(whole)


# Near-duplicates


def test_banded_distance_against_full_table():
    rng = random.Random(3)
    for _ in range(2000):
        a = [rng.randint(0, 4) for _ in range(rng.randint(0, 18))]
        b = [x for x in a if rng.random() > 0.15] + [rng.randint(0, 4) for _ in range(rng.randint(0, 3))]
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        limit = rng.randint(0, 9)
        want = row[-1] if row[-1] <= limit else None
        assert banded_distance(np.array(a, np.uint32), np.array(b, np.uint32), limit) == want


def near_fixture(spark):
    rng = random.Random(5)
    base = [" ".join(f"w{rng.randint(0, 3000)}" for _ in range(200)) for _ in range(12)]
    rows, want = [], {}
    for i, text in enumerate(base):
        for c in range(4):
            words = text.split()
            for _ in range(c):
                words[rng.randrange(len(words))] = f"new{rng.randint(0, 99)}"
            rows.append((10 * i + c, " ".join(words)))
            want[10 * i + c] = 10 * i
    rows += [(500, rows[0][1]), (501, rows[0][1].upper()), (502, "short"), (503, "Short!"), (504, None), (505, ""), (506, "%")]
    want |= {500: 0, 501: 0, 502: 502, 503: 502, 504: 504, 505: 504, 506: 506}
    shuffled = rows[8][1].split()
    rng.shuffle(shuffled)
    rows.append((507, " ".join(shuffled)))  # the same words in another order are another text
    want[507] = 507
    docs = spark.createDataFrame([(d, t, "en", "s", len(t or "")) for d, t in rows], DOCS)
    return docs, want


def test_near_duplicates_against_planted_groups(spark):
    docs, want = near_fixture(spark)
    got = dict(rows_of(order_minhash.near_duplicates(docs)))
    assert got == want
    twice = docs.unionByName(docs).unionByName(docs.limit(1).withColumn("doc_id", F.lit(None).cast("long")))
    kept = order_minhash.one_of_each(twice)
    assert kept.columns == docs.columns
    assert sorted(r[0] for r in kept.filter("doc_id is not null").collect()) == sorted(set(want.values()))
    assert kept.filter("doc_id is null").count() == 1
    assert order_minhash.near_duplicates(empty_docs(spark)).count() == 0


def test_classes_of_a_family_are_those_of_all_pairs(spark):
    rng = random.Random(7)
    base, texts = [f"w{rng.randint(0, 3000)}" for _ in range(120)], []
    for _ in range(250):
        words = list(base)
        for at in rng.sample(range(120), 11):
            words[at] = f"n{rng.randint(0, 10**6)}"
        texts.append(" ".join(words))
    hashes = [word_hashes(t) for t in texts]
    sketches = np.array([order_minhash.sketch(h) for h in hashes])
    want = list(range(len(texts)))
    for a, b in combinations(range(len(texts)), 2):
        if want[a] != want[b] and (sketches[a] == sketches[b]).sum() >= order_minhash.MIN_SHARED:
            if similar(hashes[a].astype("<u4"), hashes[b].astype("<u4"), order_minhash.SIMILARITY):
                low, high = sorted((want[a], want[b]))
                want = [low if x == high else x for x in want]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], DOCS)
    assert dict(rows_of(order_minhash.near_duplicates(docs))) == dict(enumerate(want))


def test_one_doc_id_in_two_groups(spark):
    rng = random.Random(6)
    a, b = (" ".join(f"w{rng.randint(0, 3000)}" for _ in range(200)) for _ in range(2))
    rows = [(5, a), (9, a + " more"), (5, b), (11, b + " more"), (5, "alone"), (12, "quite other")]
    docs = spark.createDataFrame([(d, t, "en", "s", len(t)) for d, t in rows], DOCS)
    kept = sorted(r["text"] for r in order_minhash.one_of_each(docs).collect())
    assert kept == sorted([a, b, "alone", "quite other"])
    classes = order_minhash.near_duplicates(docs).collect()
    of = {d: {r["class_id"] for r in classes if r["doc_id"] == d} for d in (5, 9, 11, 12)}
    assert [len(of[d]) for d in (5, 9, 11, 12)] == [3, 1, 1, 1]
    assert of[9] < of[5] and of[11] < of[5] and of[9] != of[11] and 5 in of[5] and of[12] == {12}


# Nearest neighbours


def test_nearest_against_brute_force(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(900, 16)).astype(np.float32)
    x[100:140] = x[0]  # copies: ties go to smaller ids
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    rows += [(950, None), (1000, [0.0] * 16), (1050, [float("nan")] * 16), (1100, [None] + [1.0] * 15), (None, rows[3][1])]
    rows += [(1150, [1.0, 2.0]), (3, rows[3][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = {}
    for r in nn_descent.nearest(df).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    wide = x.astype(np.float64)
    unit = wide / np.linalg.norm(wide, axis=1, keepdims=True)
    hits = total = 0
    assert sorted(got) == list(range(0, 900, 50))  # 1150 has no candidate of its length
    for q, found in got.items():
        sims = unit @ unit[q]
        order = [i for i in np.lexsort((np.arange(900), -np.round(sims, 9))) if i != q][:5]
        assert len(found) == 5 and np.allclose([s for _, s in found], [sims[v] for v, _ in found])
        hits += len(set(order) & {v for v, _ in found})
        total += 5
    assert [v for v, _ in got[0]] == [100, 101, 102, 103, 104]
    assert hits / total >= 0.9


def test_nearest_few_and_none(spark):
    kind = "vec_id long, embedding array<float>"
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 1.0]), (2, [2.0, 0.0])], kind)
    got = [r[:3] for r in rows_of(nn_descent.nearest(few).orderBy("rank"))]
    assert got == [(0, 1, 2), (0, 2, 1)]
    assert nn_descent.nearest(spark.createDataFrame([], kind)).count() == 0


def test_nearest_of_several_lengths_and_repeated_ids(spark):
    kind = "vec_id long, embedding array<double>, node long, score string"
    rows = [(0, [1.0, 0.0]), (2, [1.0, 0.0]), (2, [0.3, 1.0]), (3, [1e-9, 1.0]), (3, [1e-9, 1.0])]
    rows += [(50, [1.0, 0.0, 0.0]), (51, [1.0, 1.0, 0.0]), (50, [1e300, 0.0, 1e300]), (100, [5.0]), (7, None)]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], kind)
    got = sorted(map(tuple, nn_descent.nearest(df).collect()))
    half = 1 / np.sqrt(2)
    want = [(0, 1, 2, 1.0), (0, 2, 2, 0.3 / np.sqrt(1.09)), (0, 3, 3, 1e-9), (0, 4, 3, 1e-9)]
    want += [(50, 1, 50, half), (50, 1, 50, half), (50, 2, 51, 0.5), (50, 2, 51, half)]
    assert [r[:3] for r in got] == [r[:3] for r in want]
    assert np.allclose([r[3] for r in got], [r[3] for r in want], rtol=1e-12, atol=0)


def test_copies_of_a_query_count_each(spark):
    rows = [(50, [1.0, 2.0])] * 3 + [(i, [1.0, 2.0]) for i in range(60, 70)] + [(1, [2.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted((r["query_id"], r["rank"], r["vec_id"]) for r in nn_descent.nearest(df).collect())
    assert got == sorted((50, i + 1, v) for v, i in [(50, 0), (50, 1), (60, 2), (61, 3), (62, 4)] * 3)


def test_nearest_where_the_search_cannot_see_the_table(spark, monkeypatch):
    monkeypatch.setattr(nn_descent, "BEAM", 32)
    monkeypatch.setattr(nn_descent, "LOOKED", 8)
    monkeypatch.setattr(nn_descent, "STEPS", 4)
    x = np.random.default_rng(4).normal(size=(6000, 12))
    assert (1 + 8 * 3) * 2 * nn_descent.DEGREE < 6000 / 3
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {}
    for r in nn_descent.nearest(df).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    hits = [len(got[q] & set(np.argsort(-(unit @ unit[q]))[1:6].tolist())) for q in range(0, 6000, 50)]
    assert len(got) == 120 and sum(hits) / 600 >= 0.9


# Line dedup


def test_lines_on_many_sites_go(spark):
    rows = [(i, f"own {i}\n  Menu \nrare {i % 3}", "en", f"site{i % 12}", 0) for i in range(60)]
    rows += [(100, None, "en", "site0", None), (101, "", "en", "site0", 0), (102, "Menu\n\nMenu", None, None, 0)]
    docs = spark.createDataFrame(rows, DOCS).withColumn("n_lines", F.lit("own"))
    got = {r["doc_id"]: tuple(r)[1:] for r in line_spread.line_dedup(docs).collect()}
    assert got[5] == (3, 1, "own 5\nrare 2") and got[102] == (3, 2, "")
    assert got[100] == (0, 0, None) and got[101] == (1, 0, "")
    cut = line_spread.without_boilerplate(docs)
    assert cut.columns == docs.columns and cut.count() == docs.count()
    assert cut.filter("doc_id = 5").select("text", "n_chars").first() == ("own 5\nrare 2", 12)
    assert line_spread.line_dedup(empty_docs(spark)).count() == 0


def test_no_python_on_native_paths(spark):
    for df in (line_spread.line_dedup(odd_docs(spark)), license_scan.license_scan(odd_docs(spark))):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert not any(x in plan for x in ("Python", "Arrow", "Pandas"))


# Decontamination


def brute_hits(texts, items_, window=10):
    wins = {}
    for i, t in items_:
        ws = word_list(t)
        k = min(window, len(ws))
        for a in range(len(ws) - k + 1 if k else 0):
            wins.setdefault(tuple(ws[a : a + k]), set()).add(str(i))
    out = []
    for t in texts:
        ws, hit, ids = word_list(t), set(), set()
        for k in {len(w) for w in wins}:
            for a in range(len(ws) - k + 1):
                if (found := wins.get(tuple(ws[a : a + k]))) is not None:
                    hit |= set(range(a, a + k))
                    ids |= found
        digest = hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest()
        out.append((len(ws), len(hit), len(ids), digest, bool(hit)))
    return out


@pytest.mark.parametrize("block_words", [200_000, 30])
def test_contamination_against_brute_force(spark, monkeypatch, block_words):
    monkeypatch.setattr(decontaminate, "MAX_AUTOMATON_WORDS", block_words)
    rng = random.Random(9)
    word = lambda: rng.choice("abc")
    its = [(i, " ".join(word() for _ in range(rng.choice([1, 3, 6, 9, 10, 14])))) for i in range(3, 14)]
    its = [x for x in its if len(x[1].split()) > 2] + [(50, None), (51, "%%"), (52, its[-1][1])]
    texts = [" ".join(word() for _ in range(rng.randint(0, 60))) for _ in range(80)] + [None, "", "A b, C"]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], DOCS)
    got = decontaminate.contamination(docs, items(spark, its)).orderBy("doc_id")
    assert [tuple(r)[1:] for r in got.collect()] == brute_hits(texts, its)


def test_cut_is_the_same_with_several_automata_and_leaves_no_window(spark, monkeypatch):
    one, two = (" ".join(f"{c}{i}" for i in range(12)) for c in "qr")
    filler = " ".join(f"f{i}" for i in range(60))
    # Cutting the inner passage joins the halves of an outer one.
    nested = f"{filler} {two[:20]} {one} {two[20:]} {filler}"
    docs = spark.createDataFrame([(1, nested, "en", "s", 0), (2, filler, "en", "s", 0), (3, two, "en", "s", 0)], DOCS)
    its = items(spark, [(1, one), (2, two)])
    got = [tuple(r) for r in decontaminate.remove_contamination(docs, its).orderBy("doc_id").collect()]
    assert [r[0] for r in got] == [1, 2] and "q0" not in got[0][1] and got[1][1] == filler
    kept = spark.createDataFrame(got, DOCS)
    assert decontaminate.contamination(kept, its).filter("contaminated").count() == 0
    monkeypatch.setattr(decontaminate, "MAX_AUTOMATON_WORDS", 12)
    parted = decontaminate.remove_contamination(docs, its).orderBy("doc_id")
    assert [tuple(r) for r in parted.collect()] == got


def test_cut_removes_only_the_passage(spark):
    item = " ".join(f"q{i}" for i in range(14))
    filler = " ".join(f"f{i}" for i in range(30))
    docs = spark.createDataFrame(
        [(1, f"Before. {item.upper()}! After {filler}", "en", "s", 9), (2, "clean", "en", "s", 5), (3, item, "en", "s", 1), (4, None, "en", "s", None)],
        DOCS,
    )
    got = {r["doc_id"]: r for r in decontaminate.remove_contamination(docs, items(spark, [(1, item)])).collect()}
    assert got[1]["text"] == f"Before. ! After {filler}" and got[1]["n_chars"] == len(got[1]["text"])
    assert got[2]["text"] == "clean" and got[4]["text"] is None and 3 not in got
    assert decontaminate.contamination(empty_docs(spark), items(spark, [])).count() == 0
    assert decontaminate.contamination(docs, items(spark, [])).filter("contaminated").count() == 0


# Tokens


def test_piecewise_ids_equal_whole_texts(spark):
    tokenizer = Tokenizer.from_file(queries.TOKENIZER)
    with open(queries.TOKENIZER, encoding="utf-8") as f:
        pieces = PieceIds(f.read())
    texts = [r["text"] for r in table(spark, SF, "documents").collect()]
    texts += [t for t in ODD if t] + ["a b  c\td", "don't  <|endoftext|>x <|EndOfText|>.", "y\x85z \x1c w", "İstanbul ΣΑΣ. Ǆ."]
    for t in texts:
        want = np.array(tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes()
        assert pieces.of(t) == want


def test_packing_is_whole(spark):
    docs = odd_docs(spark)
    got = packing.pack(docs, queries.TOKENIZER, 64).collect()
    assert len({r["sequence_id"] for r in got}) == len(got)
    assert all(r["length"] & (r["length"] - 1) == 0 and r["length"] <= 64 and len(r["ids"]) == 4 * r["length"] for r in got)
    tokenizer = Tokenizer.from_file(queries.TOKENIZER)
    whole = packing.unpacked([(r["doc_id"], r["start"], r["ids"]) for r in got if r["doc_id"] not in (None, 3)])
    for i, t in enumerate(ODD):
        if i != 3:
            assert whole[i].tolist() == [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2]
    assert packing.pack(empty_docs(spark), queries.TOKENIZER).count() == 0


def test_token_files_round_trip(spark, tmp_path):
    docs = odd_docs(spark)
    got = token_frames.token_files(docs, queries.TOKENIZER).orderBy("start").collect()
    tokenizer = Tokenizer.from_file(queries.TOKENIZER)
    texts = [("no id", None), *((t, i) for i, t in enumerate(ODD))]
    texts.insert(5, ("the cat", 3))
    at = 0
    for r, (t, doc_id) in zip(got, texts, strict=True):
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2]
        crc = zlib.crc32(np.array(ids, "<u4").tobytes())
        assert (r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) == (doc_id, at, len(ids), crc)
        at += len(ids)
    assert token_frames.token_files(empty_docs(spark), queries.TOKENIZER).count() == 0


def test_reader_unpacks_only_the_frames_asked_for(monkeypatch):
    monkeypatch.setattr(token_frames, "FRAME_BYTES", 64)
    sink, docs = io.BytesIO(), [(i, np.arange(i, 3 * i + 1, dtype="<u4").tobytes()) for i in range(40)]
    writer = token_frames.FrameWriter(sink)
    for d in docs:
        writer.add(*d)
    writer.finish()
    reader = token_frames.FrameReader(io.BytesIO(sink.getvalue()))
    assert list(reader.documents()) == docs
    opened = []
    own = reader.frame
    monkeypatch.setattr(reader, "frame", lambda k: opened.append(k) or own(k))
    assert list(reader.documents(np.array([5, 30]))) == [docs[5], docs[30]] and len(opened) == 2
    whole = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(sink.getvalue()), read_across_frames=True).read()
    assert whole == b"".join(ids for _, ids in docs)
    broken = bytearray(sink.getvalue())
    broken[-12] ^= 1
    with pytest.raises(ValueError, match="checksum"):
        list(token_frames.FrameReader(io.BytesIO(bytes(broken))).documents())


# Licenses


def test_license_scan(spark):
    mit = license_scan.TEMPLATES[1][1]
    words = mit.split()
    changed = " ".join(words[:20] + ["inserted"] + words[20:40] + words[41:])
    texts = [None, "", "MIT License; mit-license", "GNU General Public License", f"x {mit}.", f"x y {changed}", "cc by", "mit x license"]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], DOCS)
    got = {r["doc_id"]: tuple(r)[1:] for r in license_scan.license_scan(docs.unionByName(docs)).collect()}
    assert got[0] == got[1] == (0, 0, None, None, "", "", 0.0)
    assert got[2] == (4, 2, 0, 2, "mit", "mit", 1.0)
    assert got[3] == (4, 1, 0, 0, "gpl", "gpl", 1.0)
    assert got[4] == (len(words) + 1, 0, None, None, "", "mit", 1.0)
    assert got[5][5] == "mit" and 0.8 <= got[5][6] < 1
    assert got[6][4] == "cc-by" and got[7][1] == 0
    assert license_scan.license_scan(empty_docs(spark)).count() == 0
    spans = license_scan.verified_spans(docs).filter("_id = '5'").collect()
    assert [(s["start"], s["label"]) for s in spans] == [(2, "mit")]
