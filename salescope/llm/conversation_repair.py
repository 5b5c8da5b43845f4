"""Conversation structure repair: the cheapest edits that give a conversation its form.

A conversation has its form if its role initials read ``s?(ua)+`` or it is
empty. A row is kept (K, costs 0), given the role user or assistant (R, 1) or
deleted (D, 2); an empty turn of the user or assistant may be inserted anywhere
(I, 5). Blank rows and repeats of an earlier row must go; a row that ends
without ``.``, ``!`` or ``?`` costs 5 more unless it goes. Of the cheapest edit
lists the one with the ASCII-least initials is taken. It also says what each R
and I becomes, as the form leaves one choice only.

The lists are kept by a persistent dynamic programme (``AuditTree``): four
states, and in each the best list so far as a node that shares its beginning
with the others. Two lists of equal cost are compared at the first place where
they part, found by binary lifting over rolling hashes; equal hashes are
verified on the letters. Equal costs never make one list the beginning of the
other, since a longer list over the same rows has more inserts.

Scale: the rows are range-sorted by conversation and turn, so a conversation
with a third of all rows spreads over many tasks. A task cuts its conversations
into blocks of at most BLOCK rows. A block that is not a whole conversation is
solved from each of the four states; the blocks of a conversation, 16 short
lists each, are then joined by the same programme with blocks in place of rows.
The last pass streams the rows of a conversation in order beside its edits.

Cases: null conversation ids are one conversation; rows with null turns come
first; rows of one turn are taken by role, then text; null roles and texts
count as one space; a role without a character is never kept; an empty table
gives an empty result; extra columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from salescope.llm.common import small_batches, written
from salescope.operators.joins import splittable_join

#: Costs of the edits, fixed values.
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
#: Rows of a block; a task holds the lists of one block, or of the blocks of one conversation.
BLOCK = 4096

START, SYSTEM, USER, ASSISTANT = range(4)
_NEXT = {START: USER, SYSTEM: USER, ASSISTANT: USER, USER: ASSISTANT}
_ROLE = {USER: "user", ASSISTANT: "assistant"}
_ENDS = (START, ASSISTANT)

_PRIME, _BASE = 1_000_000_000_000_000_009, 1_000_003


class AuditTree:
    """Texts that grow at the end and share their beginnings.

    Node 0 is the empty text. A node is its parent's text and one more piece,
    with the hash of the whole text and its ancestors 1, 2, 4 ... pieces up.
    """

    def __init__(self):
        self.up, self.piece, self.depth = [()], [""], [0]
        self.size, self.hash = [0], [0]

    def grow(self, node: int, piece: str) -> int:
        up, at, k = [node], node, 0
        while k < len(self.up[at]):
            at = self.up[at][k]
            up.append(at)
            k += 1
        value = self.hash[node]
        for c in piece.encode():
            value = (value * _BASE + c + 1) % _PRIME
        self.up.append(tuple(up))
        self.piece.append(piece)
        self.depth.append(self.depth[node] + 1)
        self.size.append(self.size[node] + len(piece))
        self.hash.append(value)
        return len(self.up) - 1

    def ancestor(self, node: int, depth: int) -> int:
        steps, k = self.depth[node] - depth, 0
        while steps:
            if steps & 1:
                node = self.up[node][k]
            steps, k = steps >> 1, k + 1
        return node

    def text(self, node: int) -> str:
        pieces = []
        while node:
            pieces.append(self.piece[node])
            node = self.up[node][0]
        return "".join(reversed(pieces))

    def _alike(self, a: int, b: int) -> bool:
        return a == b or (self.size[a], self.hash[a]) == (self.size[b], self.hash[b])

    def _surely(self, a: int, b: int) -> bool:
        """Whether two texts of one length are the same, read back to the node that both share."""
        left, right = [], []
        while a != b:
            if self.size[a] >= self.size[b]:
                left.append(self.piece[a])
                a = self.up[a][0]
            else:
                right.append(self.piece[b])
                b = self.up[b][0]
        return "".join(reversed(left)) == "".join(reversed(right))

    def less(self, a: int, b: int) -> bool:
        """Whether the text of ``a`` is ASCII-less than that of ``b``."""
        depth = min(self.depth[a], self.depth[b])
        x, y = self.ancestor(a, depth), self.ancestor(b, depth)
        if not self._alike(x, y):
            for k in range(len(self.up[x]) - 1, -1, -1):
                if k < len(self.up[x]) and not self._alike(self.up[x][k], self.up[y][k]):
                    x, y = self.up[x][k], self.up[y][k]
            x, y = self.up[x][0], self.up[y][0]
        if x != y and not self._surely(x, y):
            return self.text(a) < self.text(b)  # a collision
        # From here the texts go on differently, mostly within a piece.
        left = right = ""
        i, j = self.depth[x], self.depth[y]
        while True:
            while not left and i < self.depth[a]:
                i += 1
                left = self.piece[self.ancestor(a, i)]
            while not right and j < self.depth[b]:
                j += 1
                right = self.piece[self.ancestor(b, j)]
            n = min(len(left), len(right))
            if not n or left[:n] != right[:n]:
                return left < right
            left, right = left[n:], right[n:]


Best = dict[int, tuple[int, int]]  # state: cost and node


def _offer(tree: AuditTree, best: Best, state: int, cost: int, parent: int, piece: str) -> None:
    have = best.get(state)
    if have is not None and have[0] < cost:
        return
    node = tree.grow(parent, piece)
    if have is None or cost < have[0] or tree.less(node, have[1]):
        best[state] = cost, node


def _with_inserts(tree: AuditTree, best: Best) -> Best:
    """Empty turns put in here: first a user's, then an assistant's; a third never pays."""
    for after in ((START, SYSTEM, ASSISTANT), (USER,)):
        for state, (cost, node) in [(s, best[s]) for s in after if s in best]:
            _offer(tree, best, _NEXT[state], cost + INSERT, node, "I")
    return best


def solve(rows: list[tuple[str, bool, bool]], start: int) -> dict[int, tuple[int, str]]:
    """Cheapest cost and its least edits to each end state; rows are (role initial, must go, truncated)."""
    tree = AuditTree()
    best = _with_inserts(tree, {start: (0, 0)})
    keeps = {("s", START): SYSTEM, ("a", USER): ASSISTANT}
    keeps |= {("u", s): USER for s in (START, SYSTEM, ASSISTANT)}
    for initial, must_go, truncated in rows:
        after: Best = {}
        extra = TRUNCATED if truncated else 0
        for state, (cost, node) in best.items():
            _offer(tree, after, state, cost + DELETE, node, "D")
            if not must_go:
                kept = keeps.get((initial, state))
                if kept is not None:
                    _offer(tree, after, kept, cost + extra, node, "K")
                _offer(tree, after, _NEXT[state], cost + REROLE + extra, node, "R")
        best = _with_inserts(tree, after)
    return {s: (cost, tree.text(node)) for s, (cost, node) in best.items()}


def chain(blocks: Iterator[dict[int, dict[int, tuple[int, str]]]]) -> tuple[int, str]:
    """Cost and edits of a whole conversation from the solutions of its blocks, by start and end state."""
    tree = AuditTree()
    best: Best = {START: (0, 0)}
    for block in blocks:
        after: Best = {}
        for state, (cost, node) in best.items():
            for end, (more, edits) in block[state].items():
                _offer(tree, after, end, cost + more, node, edits)
        best = after
    cost, node = _least(tree, [best[s] for s in _ENDS if s in best])
    return cost, tree.text(node)


def _least(tree: AuditTree, ends: list[tuple[int, int]]) -> tuple[int, int]:
    least = ends[0]
    for cost, node in ends[1:]:
        if cost < least[0] or (cost == least[0] and tree.less(node, least[1])):
            least = cost, node
    return least


# Spark


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text and ``gone`` of the rows as a fixed rule damages them; a dropped row stays, as gone."""
    space = F.lit(" ")
    key = F.concat(
        F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space)
    )
    rows = conversations.select(
        "conv_id",
        "turn",
        F.coalesce("role", space).alias("role"),
        F.coalesce("text", space).alias("text"),
        (F.crc32(key.cast("binary")) % 20).alias("_fate"),
    )
    fate, text = F.col("_fate"), F.col("text")
    copies = F.array_repeat(F.lit(0), F.when(fate == 3, 2).otherwise(1))
    return rows.withColumn("_copy", F.explode(copies)).select(
        "conv_id",
        "turn",
        F.when(fate == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(fate == 1, "").when(fate == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        (fate == 0).alias("gone"),
    )


_KEY = ("_n", "_c")  # whether the id is null, and the id as text


def _faults(rows: DataFrame) -> DataFrame:
    """Key, place, turn, role initial and faults of each row, in no order; written as ``rows`` were sorted."""
    solid, at = F.col("_solid"), F.col("_pos")
    firsts = (
        rows.filter(solid & ~F.col("gone"))
        .groupBy(*_KEY, "_digest")
        .agg(F.min(at).alias("_first"), F.count(F.lit(1)).alias("_copies"))
        .filter("_copies > 1")
        .drop("_copies")
    )
    narrow = rows.select(*_KEY, "_pos", "conv_id", "turn", "gone", "_initial", "_solid", "_open", "_digest")
    joined = splittable_join(narrow, firsts, [*_KEY, "_digest"], "left")
    repeat = solid & F.coalesce(F.col("_first") < at, F.lit(False))
    return joined.select(
        *_KEY,
        "_pos",
        "conv_id",
        "turn",
        "gone",
        F.col("_initial").alias("initial"),
        (~solid).alias("blank"),
        repeat.alias("repeat"),
        (solid & ~repeat & F.col("_open")).alias("truncated"),
    )


_LIST = pa.list_(
    pa.struct([("start", pa.int8()), ("end", pa.int8()), ("cost", pa.int64()), ("edits", pa.large_string())])
)
_BLOCK_DDL = (
    "_n boolean, _c string, _pos long, whole boolean, first_turn long, last_turn long, turns long, blank long, "
    "repeated long, truncated long, illegal long, first string, last string, rows long, "
    "solved array<struct<start:tinyint,end:tinyint,cost:bigint,edits:string>>"
)
_NAMES = [part.split()[0] for part in _BLOCK_DDL.split(", ")]
_LEGAL = {"su", "ua", "au"}


class _Block:
    """Counts and rows of consecutive rows of one conversation."""

    def __init__(self, n: bool, c: str, pos: int):
        self.key, self.pos, self.rows = (n, c), pos, []
        self.first_turn = self.last_turn = None
        self.turns = self.blank = self.repeated = self.truncated = self.illegal = 0
        self.first = self.last = None

    def add(self, turn, gone, initial, blank, repeat, truncated) -> None:
        if gone:
            return
        if turn is not None:
            self.first_turn = turn if self.first_turn is None else self.first_turn
            self.turns += turn != self.last_turn
            self.last_turn = turn
        if self.rows:
            self.illegal += self.last + initial not in _LEGAL
        else:
            self.first = initial
        self.last = initial
        self.blank += blank
        self.repeated += repeat
        self.truncated += truncated
        self.rows.append((initial, blank or repeat, truncated))

    def result(self, whole: bool) -> tuple:
        starts = (START,) if whole else range(4)
        solved = []
        for start in starts:
            ends = solve(self.rows, start)
            solved += [{"start": start, "end": e, "cost": c, "edits": t} for e, (c, t) in ends.items()]
        return (
            *self.key, self.pos, whole, self.first_turn, self.last_turn, self.turns, self.blank, self.repeated,
            self.truncated, self.illegal, self.first, self.last, len(self.rows), solved,
        )


def _blocks(limit: int):
    """Blocks of a sorted stream of rows. Only a conversation that begins and ends inside it is known to be whole."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, cut, out = None, True, []
        for b in batches:
            columns = [b.column(c).to_pylist() for c in ("_n", "_c", "_pos", "turn", "gone", "initial", "blank", "repeat", "truncated")]
            for n, c, pos, *row in zip(*columns, strict=True):
                same = block is not None and block.key == (n, c)
                if block is None or not same or len(block.rows) == limit:
                    if block is not None:
                        out.append(block.result(whole=not (cut or same)))
                        cut = same
                    block = _Block(n, c, pos)
                block.add(*row)
            if len(out) >= 500:
                yield _record_batch(out, _BLOCK_SCHEMA)
                out = []
        if block is not None:
            out.append(block.result(whole=False))
        if out:
            yield _record_batch(out, _BLOCK_SCHEMA)

    return run


_BLOCK_TYPES = [
    pa.bool_(), pa.string(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), *[pa.int64()] * 5,
    pa.string(), pa.string(), pa.int64(), _LIST,
]
_BLOCK_SCHEMA = pa.schema(list(zip(_NAMES, _BLOCK_TYPES, strict=True)))


_AUDIT_DDL = (
    "_n boolean, _c string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
)


def _joined(group: pd.DataFrame) -> pd.DataFrame:
    """One conversation from its blocks."""
    group = group.sort_values("_pos")
    full = group[group["rows"] > 0]
    blocks = []
    for solved in full["solved"]:
        by_start: dict[int, dict[int, tuple[int, str]]] = {s: {} for s in range(4)}
        for x in solved:
            by_start[x["start"]][x["end"]] = (x["cost"], x["edits"])
        blocks.append(by_start)
    cost, audit = chain(blocks) if blocks else (0, "")
    illegal, turns = int(full["illegal"].sum()), int(full["turns"].sum())
    pairs = list(zip(full["first"], full["last"], strict=True))
    illegal += sum(a[1] + b[0] not in _LEGAL for a, b in zip(pairs, pairs[1:]))
    timed = full[full["turns"] > 0]
    spans = list(zip(timed["first_turn"], timed["last_turn"], strict=True))
    turns -= sum(a[1] == b[0] for a, b in zip(spans, spans[1:]))
    gaps = int(spans[-1][1] - spans[0][0] + 1 - turns) if spans else 0
    sums = [int(full[c].sum()) for c in ("blank", "repeated", "truncated")]
    row = (group["_n"].iloc[0], group["_c"].iloc[0], gaps, *sums, illegal, cost, audit)
    return pd.DataFrame([row], columns=[part.split()[0] for part in _AUDIT_DDL.split(", ")])


def _sorted(rows: DataFrame) -> DataFrame:
    """The rows in order of conversation and turn, written with their place; equal rows may spread over tasks."""
    text = F.col("text")
    solid = text.rlike(r"[^\x20\x09-\x0D]")
    ordered = rows.select(
        F.col("conv_id").isNull().alias("_n"),
        F.coalesce(F.col("conv_id").cast("string"), F.lit("")).alias("_c"),
        "conv_id",
        F.col("turn").cast("long").alias("turn"),
        "role",
        "text",
        "gone",
        F.substring("role", 1, 1).alias("_initial"),
        solid.alias("_solid"),
        (~text.rlike(r"[.!?][\x20\x09-\x0D]*\z")).alias("_open"),
        F.sha2(F.concat_ws("\n", F.sha2("role", 256), text), 256).alias("_digest"),
        F.monotonically_increasing_id().alias("_row"),
    )
    keys = [*_KEY, F.col("turn").asc_nulls_first(), "role", "text", "_row"]
    return written(ordered.orderBy(*keys).drop("_row").withColumn("_pos", F.monotonically_increasing_id()), "turns")


def _audits(rows: DataFrame, limit: int) -> DataFrame:
    faults = _faults(rows)
    small_batches(rows.sparkSession)
    ordered = faults.repartitionByRange(*_KEY, "_pos").sortWithinPartitions(*_KEY, "_pos")
    blocks = written(ordered.mapInArrow(_blocks(limit), _BLOCK_DDL), "audit-blocks")
    only = F.array_sort(
        F.transform(
            F.filter("solved", lambda x: x["end"].isin(*_ENDS)),
            lambda x: F.struct(x["cost"].alias("cost"), x["edits"].alias("edits")),
        )
    )[0]
    gaps = F.coalesce(F.col("last_turn") - F.col("first_turn") + 1 - F.col("turns"), F.lit(0))
    whole = blocks.filter("whole").select(
        *_KEY, gaps.alias("gaps"), "blank", F.col("repeated").alias("duplicate"), "truncated", "illegal",
        only["cost"].alias("cost"), only["edits"].alias("audit"),
    )
    turns = {c: F.coalesce(c, F.lit(0)) for c in ("first_turn", "last_turn")}  # no null, so they stay integers
    return whole.unionByName(blocks.filter("not whole").withColumns(turns).groupBy(*_KEY).applyInPandas(_joined, _AUDIT_DDL))


_COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
_WALK_DDL = "place long, edit string, role string, text string, " + ", ".join(f"{c} long" for c in _COUNTS) + ", audit string"
_WALK_TYPES = [pa.int64(), pa.string(), pa.string(), pa.large_string(), *[pa.int64()] * len(_COUNTS), pa.large_string()]
#: Rows and characters of an output batch.
_OUT_ROWS, _OUT_CHARS = 500, 1 << 24


class _Walker:
    """Follows the edits of one conversation after another while their rows pass."""

    def __init__(self):
        self.head = None

    def open(self, counts: tuple, edits: str) -> None:
        self.head, self.edits, self.at, self.place, self.state = (counts, edits), edits, 0, 0, START

    def rows(self, gone: bool, role: str, text: str) -> Iterator[tuple]:
        if self.head is not None:  # the audit itself, and what stands before the first row
            counts, edits = self.head
            self.head = None
            yield (-1, None, None, None, *counts, edits)
            yield from self._inserts()
        if gone:
            return
        edit = self.edits[self.at]
        self.at += 1
        if edit != "D":
            self.state = SYSTEM if edit == "K" and self.state == START and role[:1] == "s" else _NEXT[self.state]
            yield self._row(edit, role if edit == "K" else _ROLE[self.state], text)
        yield from self._inserts()

    def _inserts(self) -> Iterator[tuple]:
        while self.at < len(self.edits) and self.edits[self.at] == "I":
            self.at += 1
            self.state = _NEXT[self.state]
            yield self._row("I", _ROLE[self.state], "")

    def _row(self, edit: str, role: str, text: str) -> tuple:
        self.place += 1
        return (self.place - 1, edit, role, text, *(None,) * len(_COUNTS), None)


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a conversation, its audit first, to the audit (place -1) and the repaired rows in order."""
    walker, out, chars = _Walker(), [], 0
    for b in batches:
        schema = pa.schema([b.schema.field("conv_id"), *map(pa.field, [p.split()[0] for p in _WALK_DDL.split(", ")], _WALK_TYPES)])
        columns = [b.column(c).to_pylist() for c in ("conv_id", "_head", "gone", "role", "text", *_COUNTS, "audit")]
        for conv_id, head, gone, role, text, *audit in zip(*columns, strict=True):
            if head:
                walker.open(tuple(audit[:-1]), audit[-1])
                continue
            for row in walker.rows(gone, role, text):
                out.append((conv_id, *row))
                chars += len(row[3] or "")
            if len(out) >= _OUT_ROWS or chars > _OUT_CHARS:
                yield _record_batch(out, schema)
                out, chars = [], 0
    if out:
        yield _record_batch(out, schema)


def _record_batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema, strict=True)], schema=schema)


def _walked(rows: DataFrame, limit: int) -> DataFrame:
    """The stream of ``_walk``; a conversation's rows pass one task, in order and never held."""
    ordered = _sorted(rows)
    kind = ordered.schema["conv_id"].dataType.simpleString()

    def null(kind: str) -> Column:
        return F.lit(None).cast(kind)

    heads = _audits(ordered, limit).select(
        *_KEY, null(kind).alias("conv_id"), F.lit(-1).cast("long").alias("_pos"), F.lit(True).alias("_head"),
        F.lit(False).alias("gone"), null("string").alias("role"), null("string").alias("text"), *_COUNTS, "audit",
    )
    turns = ordered.select(
        *_KEY, "conv_id", "_pos", F.lit(False).alias("_head"), "gone", "role",
        F.when(F.col("_solid"), F.col("text")).alias("text"), *(null("long").alias(c) for c in _COUNTS),
        null("string").alias("audit"),
    )
    stream = heads.unionByName(turns).repartition(*_KEY).sortWithinPartitions(*_KEY, "_pos")
    return stream.mapInArrow(_walk, f"conv_id {kind}, {_WALK_DDL}")


def repaired(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """conv_id, place, edit, role, text of every row of the repaired conversations.

    ``rows`` have conv_id, turn, role and text, and ``gone`` where a row only
    says that its conversation exists.
    """
    return _walked(_with_gone(rows), block).filter("place >= 0").select("conv_id", "place", "edit", "role", "text")


def audits(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """conv_id, the counts of faults, the cost and the edits of every conversation."""
    return _walked(_with_gone(rows), block).filter("place = -1").select("conv_id", *_COUNTS, "audit")


def _with_gone(rows: DataFrame) -> DataFrame:
    space = F.lit(" ")
    gone: Column = F.col("gone") if "gone" in rows.columns else F.lit(False)
    return rows.select(
        "conv_id", "turn", F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text"), gone.alias("gone")
    )


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The audit of each conversation with the hash of its repaired rows, from the stream of ``_walk``."""
    head, digest, out = None, None, []
    kinds = [*map(pa.field, _COUNTS, [pa.int64()] * len(_COUNTS)), pa.field("audit", pa.large_string())]
    for b in batches:
        schema = pa.schema([b.schema.field("conv_id"), *kinds, pa.field("repaired_sha256", pa.string())])
        columns = [b.column(c).to_pylist() for c in ("conv_id", "place", "role", "text", *_COUNTS, "audit")]
        for conv_id, place, role, text, *audit in zip(*columns, strict=True):
            if place < 0:
                if head is not None:
                    out.append((*head, digest.hexdigest()))
                head, digest = (conv_id, *audit), hashlib.sha256()
            else:
                digest.update(("\n" if place else "").encode() + f"{role}:{text}".encode())
        if len(out) >= _OUT_ROWS:
            yield _record_batch(out, schema)
            out = []
    if head is not None:
        out.append((*head, digest.hexdigest()))
        yield _record_batch(out, schema)


def conversation_repair(conversations: DataFrame) -> DataFrame:
    """The registered query: ``conversations`` damaged by the fixed rule and repaired, a row per conv_id."""
    walked = _walked(damaged(conversations), BLOCK)
    kind = walked.schema["conv_id"].dataType.simpleString()
    counts = ", ".join(f"{c} long" for c in _COUNTS)
    return walked.mapInArrow(_digests, f"conv_id {kind}, {counts}, audit string, repaired_sha256 string")
