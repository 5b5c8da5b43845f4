"""Near-duplicates by Order MinHash, verified by banded alignment.

A document's K-word shingles get an occurrence number, so that repeats count.
Each of M hash functions picks the L labelled shingles with the smallest values
and keeps them in text order; their hash is one component of the sketch. Two
texts agree in a component where they share shingles in the same order, so the
sketch follows edit similarity and not only the sets.

Documents with the same words form an exact class, and only its smallest
document goes on. Two documents are candidates if one component is equal and
their lengths and counts of words by bucket allow the similarity; candidates are
aligned. M is chosen so that texts of which nearly a fifth of the words differ
still agree in a component.

Links come from stars first, in turns over the components. In every group of
documents that agree in a component of the turn, the smallest id is compared with
the members of other parts. Few components make most links, so that later turns
and the rest have little left.

The rest is compared whole: all pairs that agree in a component, are of near
length and still in different parts. Tasks compare blocks of GROUP_ROWS members at
most by their counts of words, a pair in the first component in which it agrees,
and only pairs that the counts allow become rows and are aligned. So no two
documents that agree in a component and are similar end in different classes. The
comparisons of counts in a task grow with the pairs left in a group.

Cases: a text without words is like texts with the same characters only (null
counts as empty); texts shorter than K words are one shingle; ties go to the
smaller id; repeated rows are in one class; a row whose doc_id is null gets a
null class and stays; extra columns are kept by ``one_of_each``.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from salescope.llm.alignment import similar
from salescope.llm.common import mixed, small_batches, word_hashes, written
from salescope.operators.joins import splittable_join

K = 5
L = 2
M = 80
SIMILARITY = 0.8
#: Components that candidates must share.
MIN_SHARED = 1
#: Components at which a turn of stars ends and the next begins.
TURNS = (0, 4, 16, M)
#: Members of a group, or of a cut of it, that a task compares with as many others at most.
GROUP_ROWS = 2048
#: Near lengths are in the same or the next class; a little over 1 / SIMILARITY, for rounding.
LENGTH_CLASS = 1.01 / SIMILARITY
#: Buckets by which a document's words are counted, and those compared first.
BUCKETS = 512
FEW_BUCKETS = 64
#: The least value of a component, and what is no key of a group.
LEAST_PART = -(1 << 31)
NO_KEY = np.int64(1 << 62)
#: Rows of a task in the rounds on links and groups left, which are far smaller than the documents.
TASK_ROWS = 100_000
#: Values hashed at a time while sketching a long text.
BLOCK = 1 << 21

_SEEDS = mixed(np.arange(1, M + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_FACTORS = mixed(_SEEDS) | np.uint64(1)


def labelled_shingles(words: np.ndarray) -> np.ndarray:
    """Hashes of all K-word shingles with their occurrence numbers, in text order."""
    size = min(K, len(words))
    count = len(words) - size + 1
    rolled = np.zeros(count, np.uint64)
    for j in range(size):
        rolled = rolled * np.uint64(0x100000001B3) + words[j : j + count]
    rolled = mixed(rolled)
    order = np.argsort(rolled, kind="stable")
    ranked = rolled[order]
    first = np.concatenate(([True], ranked[1:] != ranked[:-1]))
    at = np.arange(count)
    occurrence = np.empty(count, np.uint64)
    occurrence[order] = (at - np.maximum.accumulate(np.where(first, at, 0))).astype(np.uint64)
    return mixed(rolled + occurrence * np.uint64(0xD6E8FEB86659FD93))


def sketch(words: np.ndarray) -> np.ndarray:
    """M components as signed 32-bit numbers; ``words`` holds at least one hash."""
    shingles = labelled_shingles(words)
    picks = min(L, len(shingles))
    step = max(1, BLOCK // len(shingles))
    out = np.zeros(M, np.uint64)
    for at in range(0, M, step):
        values = (shingles ^ _SEEDS[at : at + step, None]) * _FACTORS[at : at + step, None]
        rows = np.arange(len(values))
        picked = np.empty((len(values), picks), np.int64)
        for i in range(picks):
            picked[:, i] = values.argmin(1)
            values[rows, picked[:, i]] = np.uint64(0xFFFFFFFFFFFFFFFF)
        for column in np.sort(picked, axis=1).T:
            out[at : at + step] = out[at : at + step] * np.uint64(0x100000001B3) + shingles[column]
    return mixed(out).astype(np.uint32).view(np.int32)


def bucket_counts(words: np.ndarray) -> np.ndarray:
    """Words by bucket, 255 at most in each."""
    buckets = (words & np.uint64(BUCKETS - 1)).astype(np.int64)
    return np.minimum(np.bincount(buckets, minlength=BUCKETS), 255).astype(np.uint8)


def _with_text_key(docs: DataFrame, text: str = "text") -> DataFrame:
    return docs.withColumns({"_t1": F.xxhash64(text), "_t2": F.xxhash64(F.lit(1), text)})


def sketches(docs: DataFrame) -> DataFrame:
    """doc_id, _t1, _t2 (hashes of the text), node (digest of the words), n_words, parts (the components), counts."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            nodes, sizes, parts, counts = [], [], [], []
            for text in b.column("text").to_pylist():
                words = word_hashes(text)
                data = words.tobytes() if len(words) else b"text" + (text or "").encode("utf-8", "surrogatepass")
                nodes.append(hashlib.blake2b(data, digest_size=16).digest())
                sizes.append(len(words))
                parts.append(sketch(words) if len(words) else np.zeros(M, np.int32))
                counts.append(bucket_counts(words).tobytes())
            ends = pa.array(np.arange(0, M * len(parts) + 1, M, dtype=np.int32))
            flat = pa.array(np.array(parts, np.int32).reshape(-1))
            yield pa.RecordBatch.from_arrays(
                [
                    b.column("doc_id"),
                    b.column("_t1"),
                    b.column("_t2"),
                    pa.array(nodes, pa.binary()),
                    pa.array(sizes, pa.int64()),
                    pa.ListArray.from_arrays(ends, flat),
                    pa.array(counts, pa.binary()),
                ],
                ["doc_id", "_t1", "_t2", "node", "n_words", "parts", "counts"],
            )

    rows = _with_text_key(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    kinds = "doc_id long, _t1 long, _t2 long, node binary, n_words long, parts array<int>, counts binary"
    return rows.mapInArrow(run, kinds)


def _members(reps: DataFrame) -> DataFrame:
    """key, j, id, n_words: a row per component (its number is j) of a document that others agree in."""
    keys = reps.select("id", F.col("n_words").cast("int").alias("n_words"), F.posexplode("parts").alias("j", "part"))
    # The number of the component and its 32 bits: no two share a key.
    key = F.shiftleft(F.col("j").cast("long"), 32) + F.col("part")
    keys = keys.select(key.alias("key"), "j", "id", "n_words")
    groups = keys.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("key")
    return splittable_join(keys, groups, ["key"])


def _open_members(members: DataFrame, labels: DataFrame | None) -> DataFrame:
    """``members`` (key, j, id, n_words) with their components, of the groups that hold several."""
    if labels is None:
        return members.withColumn("component", F.col("id"))
    placed = splittable_join(members, labels, ["id"], "left")
    placed = placed.select("key", "j", "id", "n_words", F.coalesce("component", "id").alias("component"))
    placed = written(placed.coalesce(1 + members.count() // TASK_ROWS), "near-placed")
    groups = placed.groupBy("key").agg(F.min("component").alias("least"), F.max("component").alias("most"))
    return splittable_join(placed, groups.filter("least < most").select("key"), ["key"])


def _stars(members: DataFrame, centres: DataFrame) -> DataFrame:
    """key, a, b: the centres with all later members of other components whose length is near."""
    hub = centres.select(
        "key", F.col("id").alias("a"), F.col("n_words").alias("na"), F.col("component").alias("own")
    )
    near = F.least("n_words", "na") >= SIMILARITY * F.greatest("n_words", "na")
    pairs = splittable_join(members, hub, ["key"]).filter(near & (F.col("id") > F.col("a")))
    return pairs.filter("component <> own").select("key", "a", F.col("id").alias("b"))


def _limits(na: np.ndarray, nb: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edits that the similarity asked for allows to texts of so many words, and the largest difference of counts.

    An edit changes the counts by 2 at most, and where it makes up for a difference in length by 1.
    """
    limit = ((1 - SIMILARITY) * np.maximum(na, nb) + 1e-9).astype(np.int64)
    return limit, 2 * limit - np.abs(na - nb)


def _plausible(pairs: DataFrame, reps: DataFrame, tasks: int) -> DataFrame:
    """The pairs (a, b), compared in ``tasks`` tasks at most, whose lengths and counts of words allow the similarity asked for."""
    left = reps.select(F.col("id").alias("a"), F.col("n_words").alias("na"), F.col("counts").alias("ca"))
    right = reps.select(F.col("id").alias("b"), F.col("n_words").alias("nb"), F.col("counts").alias("cb"))
    both = splittable_join(splittable_join(pairs, left, ["a"]), right, ["b"]).select("a", "b", "na", "nb", "ca", "cb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            na, nb = (b.column(c).to_numpy() for c in ("na", "nb"))
            ca, cb = (
                np.frombuffer(b"".join(b.column(c).to_pylist()), np.uint8).reshape(-1, BUCKETS).astype(np.int16)
                for c in ("ca", "cb")
            )
            limit, most = _limits(na, nb)
            fine = (np.abs(na - nb) <= limit) & (np.abs(ca - cb).sum(1) <= most)
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b")], ["a", "b"]).filter(pa.array(fine))

    return both.coalesce(tasks).mapInArrow(run, "a long, b long")


def _in_blocks(members: DataFrame) -> DataFrame:
    """task, side, j, id, n_words, component: ``members`` of groups, dealt to tasks in which every two of near length meet once.

    Sides: 0 meets all of its task, 1 meets 2. A group of more than GROUP_ROWS is cut by
    length, and each length by the ids' hashes; every two cuts meet in a task of their own.
    """
    sizes = members.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    length = F.floor(F.log("n_words") / math.log(LENGTH_CLASS)).cast("int")
    placed = splittable_join(members, sizes, ["key"])
    placed = placed.withColumn("length", F.when(F.col("n") > GROUP_ROWS, length).otherwise(0)).drop("n")
    cuts = placed.groupBy("key", "length").agg(F.ceil(F.count(F.lit(1)) / GROUP_ROWS).cast("int").alias("cuts"))
    lengths = cuts.groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct("length", "cuts"))).alias("cuts"))
    placed = splittable_join(placed, lengths, ["key"])
    mine = F.col("length")
    placed = placed.withColumn("cut", F.pmod(F.xxhash64("id"), F.try_element_at("cuts", mine)).cast("int"))
    cut = F.col("cut")

    def task(low: Column, i: Column, k: Column, step: int, side: Column) -> Column:
        return F.struct(F.xxhash64("key", low, i, k, F.lit(step)).alias("task"), side.alias("side"))

    def meeting(step: int, of: Callable[[Column], Column]) -> Column:
        """A task for each cut of the length class ``step`` further."""
        many = F.coalesce(F.try_element_at("cuts", mine + step), F.lit(0))
        return F.transform(F.filter(F.sequence(F.lit(0), many), lambda x: x < many), of)

    dealt = F.concat(
        meeting(0, lambda x: task(mine, F.least(cut, x), F.greatest(cut, x), 0, F.when(x == cut, 0).when(cut < x, 1).otherwise(2))),
        meeting(1, lambda x: task(mine, cut, x, 1, F.lit(1))),
        meeting(-1, lambda x: task(mine - 1, x, cut, 1, F.lit(2))),
    )
    return placed.withColumn("t", F.explode(dealt)).select("t.*", "j", "id", "n_words", "component")


def _compared(
    side: np.ndarray, j: int, n: np.ndarray, component: np.ndarray, keys: np.ndarray, counts: np.ndarray
) -> tuple[list[int], list[int]]:
    """The pairs of rows of a task, sorted by n, that agree first in component j and pass the filter by counts."""
    keys = keys[:, :j]
    few = counts.reshape(len(n), -1, FEW_BUCKETS).sum(1, dtype=np.int32)
    ends = np.searchsorted(n, n / SIMILARITY + 1, "right")
    left, right = [], []
    for i in range(len(n) - 1):
        before = np.flatnonzero(keys[i] != NO_KEY)
        at = np.arange(i + 1, ends[i])
        at = at[(component[at] != component[i]) & ((side[at] != side[i]) | (side[at] == 0))]
        limit, most = _limits(n[at], n[i])
        fine = n[at] - n[i] <= limit
        at, most = at[fine], most[fine]
        for some in np.array_split(np.arange(len(at)), 1 + len(at) // 4096):
            rows, bound = at[some], most[some]
            fine = ~(keys[rows[:, None], before] == keys[i, before]).any(1)
            rows, bound = rows[fine], bound[fine]
            fine = np.abs(few[rows] - few[i]).sum(1) <= bound
            rows, bound = rows[fine], bound[fine]
            rows = rows[np.abs(counts[rows].astype(np.int16) - counts[i]).sum(1) <= bound]
            left += [i] * len(rows)
            right += rows.tolist()
    return left, right


def _rest(members: DataFrame, reps: DataFrame) -> DataFrame:
    """All pairs (a, b) of members of one group that are in different components and pass the filter by counts."""
    profiles = members.groupBy("id").agg(F.collect_list("key").alias("keys"))
    profiles = splittable_join(reps.select("id", "counts"), profiles, ["id"])
    dealt = splittable_join(_in_blocks(members), profiles, ["id"])
    dealt = dealt.repartition("task").sortWithinPartitions("task", "n_words")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pairs(held: list[pa.RecordBatch]) -> pa.RecordBatch:
            rows = pa.Table.from_batches(held).combine_chunks()
            task, side, j, ids, n, component = (
                rows[c].to_numpy() for c in ("task", "side", "j", "id", "n_words", "component")
            )
            held_keys = rows["keys"].combine_chunks()
            values = held_keys.flatten().to_numpy()
            keys = np.full((len(ids), M), NO_KEY)
            keys[np.repeat(np.arange(len(ids)), held_keys.value_lengths().to_numpy()), (values - LEAST_PART) >> 32] = values
            counts = np.frombuffer(b"".join(rows["counts"].to_pylist()), np.uint8).reshape(-1, BUCKETS)
            starts = np.flatnonzero(np.concatenate(([True], task[1:] != task[:-1], [True])))
            a, b = [], []
            for s, e in pairwise(starts):
                found = _compared(side[s:e], int(j[s]), n[s:e], component[s:e], keys[s:e], counts[s:e])
                for out, at in zip((a, b), found, strict=True):
                    out.append(ids[s:e][at])
            a, b = np.concatenate(a), np.concatenate(b)
            return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

        held = []
        for batch in batches:
            if not batch.num_rows:
                continue
            # Rows of the last task may go on in the next batch.
            task = batch.column("task").to_numpy()
            if held and held[-1].column("task")[-1].as_py() != task[0]:
                yield pairs(held)
                held = []
            last = int(np.searchsorted(task, task[-1]))
            if last:
                yield pairs([*held, batch.slice(0, last)])
                held = []
            held.append(batch.slice(last))
        if held:
            yield pairs(held)

    return dealt.mapInArrow(run, "a long, b long")


def _verified(pairs: DataFrame, docs: DataFrame, reps: DataFrame) -> DataFrame:
    """The pairs (a, b) whose alignment reaches SIMILARITY. Only texts in pairs are fetched."""
    involved = pairs.select(F.col("a").alias("id")).distinct()
    involved = involved.unionByName(pairs.select(F.col("b").alias("id")).distinct()).distinct()
    wanted = splittable_join(involved, reps.select("id", "rep", "_t1", "_t2"), ["id"])
    wanted = wanted.withColumnRenamed("rep", "doc_id")
    texts = _with_text_key(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    texts = splittable_join(texts, wanted, ["doc_id", "_t1", "_t2"]).select("id", "text")

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words = [word_hashes(t).astype("<u4").tobytes() for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(words, pa.binary())], ["id", "words"])

    words = written(texts.mapInArrow(hashed, "id long, words binary").dropDuplicates(["id"]), "near-words")
    left = words.select(F.col("id").alias("a"), F.col("words").alias("wa"))
    right = words.select(F.col("id").alias("b"), F.col("words").alias("wb"))
    both = splittable_join(splittable_join(pairs, right, ["b"]), left, ["a"])

    def aligned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words = zip(b.column("wa").to_pylist(), b.column("wb").to_pylist(), strict=True)
            keep = [similar(np.frombuffer(x, "<u4"), np.frombuffer(y, "<u4"), SIMILARITY) for x, y in words]
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b")], ["a", "b"]).filter(pa.array(keep))

    return written(both.select("a", "b", "wa", "wb").mapInArrow(aligned, "a long, b long"), "near-links")


def components(links: DataFrame) -> DataFrame:
    """id, component (its smallest id) of every id in ``links`` (a, b).

    Rounds of smallest label among neighbours, then a jump to the label's own
    label; a round is one written table, and only whether one changed is known
    to the driver.
    """
    edges = links.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))))
    edges = written(edges.select("col.a", "col.b").distinct(), "near-edges")
    tasks = 1 + edges.count() // TASK_ROWS
    edges = edges.coalesce(tasks)
    labels = edges.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("m"))
    labels = written(labels.select("id", F.least("id", "m").alias("component")).coalesce(tasks), "near-labels")
    while True:
        of_b = labels.select(F.col("id").alias("b"), "component")
        best = splittable_join(edges, of_b, ["b"]).groupBy(F.col("a").alias("id")).agg(F.min("component").alias("m"))
        stepped = splittable_join(labels, best, ["id"], "left").select(
            "id", F.col("component").alias("before"), F.least("component", "m").alias("near")
        )
        stepped = written(stepped.coalesce(tasks), "near-step")
        of_near = labels.select(F.col("id").alias("near"), F.col("component").alias("far"))
        jumped = splittable_join(stepped, of_near, ["near"], "left")
        jumped = jumped.select("id", "before", F.least("near", F.coalesce("far", "near")).alias("component"))
        jumped = written(jumped.coalesce(tasks), "near-labels")
        labels = jumped.select("id", "component")
        if jumped.filter("component <> before").isEmpty():
            return labels


def _merged(labels: DataFrame | None, links: DataFrame) -> DataFrame:
    """``labels`` (id, component) after ``links``, by the components of the linked components."""
    if labels is None:
        return components(links)
    ends = links
    for side in ("a", "b"):
        of_side = labels.select(F.col("id").alias(side), F.col("component").alias("to"))
        ends = splittable_join(ends, of_side, [side], "left").withColumn(side, F.coalesce("to", side)).drop("to")
    joined = components(ends.distinct()).select("id", F.col("component").alias("to"))
    # A component's own id may be new among the labels: an id that had no link before.
    both = joined.select("id", F.col("id").alias("component")).join(labels.select("id"), "id", "left_anti")
    both = labels.select("id", "component").unionByName(both)
    moved = splittable_join(both, joined.withColumnRenamed("id", "component"), ["component"], "left")
    return written(moved.select("id", F.coalesce("to", "component").alias("component")), "near-merged")


def near_classes(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, reps). rows: doc_id, _t1, _t2, node of every document. reps: one row per
    exact class with its id, node, rep (smallest doc_id), that row's _t1 and _t2, and
    component (null if it has no link)."""
    rows = written(sketches(docs), "near-sketches")
    known = rows.filter("doc_id is not null")
    grouped = known.groupBy("node").agg(
        F.min(F.struct("doc_id", "_t1", "_t2")).alias("r"),
        *(F.any_value(c).alias(c) for c in ("n_words", "parts", "counts")),
    )
    reps = grouped.select(
        F.monotonically_increasing_id().alias("id"),
        "node",
        F.col("r.doc_id").alias("rep"),
        "r._t1",
        "r._t2",
        "n_words",
        "parts",
        "counts",
    )
    reps = written(reps, "near-reps")
    worded = reps.filter("n_words > 0")
    members, labels, tried = written(_members(worded), "near-members"), None, None
    for first, end in pairwise([*TURNS, None]):
        of_turn = members if end is None else members.filter((F.col("j") >= first) & (F.col("j") < end))
        of_turn = written(_open_members(of_turn, labels), "near-open")
        if end is None:
            pairs = _rest(of_turn, worded)
        else:
            centres = of_turn.groupBy("key").agg(F.min(F.struct("id", "n_words", "component")).alias("c"))
            stars = written(_stars(of_turn, centres.select("key", "c.*")), "near-stars")
            pairs = _plausible(stars.select("a", "b").distinct(), worded, 1 + stars.count() // TASK_ROWS)
        if tried is not None:
            pairs = splittable_join(pairs, tried, ["a", "b"], "left_anti")
        pairs = written(pairs, "near-pairs")
        links = _verified(pairs, docs, reps)
        tried = pairs if tried is None else tried.unionByName(pairs)
        if labels is None or not links.isEmpty():
            labels = _merged(labels, links)
    return rows, splittable_join(reps, labels, ["id"], "left").drop("n_words", "parts", "counts")


def _class_ids(reps: DataFrame) -> DataFrame:
    """reps with class_id, the smallest doc_id of all documents linked.

    Where a doc_id with several texts is the smallest of several groups, the one with
    the smallest digest has it as class_id and each other one a negative hash of its own.
    """
    placed = reps.withColumn("_group", F.coalesce("component", "id"))
    groups = placed.groupBy("_group").agg(F.min(F.struct("rep", "node")).alias("r"))
    groups = groups.select("_group", F.col("r.rep").alias("class_id"), F.col("r.node").alias("_least"))
    shared = groups.groupBy("class_id").agg(F.min("_least").alias("_own"), F.count(F.lit(1)).alias("n"))
    shared = shared.filter("n > 1").select("class_id", "_own")
    groups = splittable_join(groups, shared, ["class_id"], "left")
    further = -F.shiftrightunsigned(F.xxhash64("class_id", "_least"), 1) - 1
    own = F.when(F.col("_least") != F.col("_own"), further).otherwise(F.col("class_id"))
    return splittable_join(placed, groups.select("_group", own.alias("class_id")), ["_group"], "left").drop("_group")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id and class_id (of its group, see ``_class_ids``) of every row of ``docs``."""
    rows, reps = near_classes(docs)
    ids = _class_ids(reps).select("node", "class_id")
    joined = splittable_join(rows.select("doc_id", "node"), ids, ["node"], "left")
    return joined.select("doc_id", F.when(F.col("doc_id").isNotNull(), F.col("class_id")).alias("class_id"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """``docs`` with one document of each group, that with the smallest doc_id."""
    _, reps = near_classes(docs)
    # By component: rows of one doc_id may have different texts in different groups.
    row = F.struct("rep", "node", "_t1", "_t2")
    firsts = reps.filter("component is not null").groupBy("component").agg(F.min(row).alias("r")).select("r.*")
    kept = firsts.unionByName(reps.filter("component is null").select("rep", "node", "_t1", "_t2"))
    kept = written(kept.select(F.col("rep").alias("_id"), "_t1", "_t2"), "near-kept")
    packed = _with_text_key(
        docs.select(F.struct("*").alias("_row"), F.col("doc_id").cast("long").alias("_id"), F.col("text").alias("_text")),
        "_text",
    ).drop("_text")
    found = splittable_join(packed, kept, ["_id", "_t1", "_t2"]).dropDuplicates(["_id", "_t1", "_t2"])
    return found.select("_row.*").unionByName(docs.filter("doc_id is null"))
