"""Approximate nearest neighbours by NN-descent and greedy graph search.

Equal vectors are one node with its smallest ids, so that a vector shared by
many rows costs no more than one. A first graph comes from blocks of nodes that
lie side by side along random directions. Then, in rounds, each node introduces
its neighbours, and those that have it as neighbour, to each other: a Spark join
brings neighbours together, pairs better than a node's worst neighbour are kept,
and the best DEGREE of each node make the next graph. A round whose new edges
are few ends the descent.

A query starts at its own node. In each step it looks at the links of the best
LOOKED nodes of its beam that it has not looked at, until there are none or STEPS
are done. Its beam is one row of BEAM nodes, and it sees at most
(1 + LOOKED * (STEPS - 1)) * 2 * DEGREE nodes, however large the table is. The
beam is scored by cosines in double precision on the original vectors; the graph
and the search use 16-bit floats.

Cases: null, zero and empty vectors and such with null or non-finite components
take no part, nor do rows without an id; vectors of several lengths are searched
each among their own length; every row of a repeated id is a query and a
candidate of its own; ties go to the smaller id; extra columns are not read;
fewer candidates than asked for are all returned; an empty table gives no row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from salescope.llm.common import small_batches, written
from salescope.operators.joins import splittable_join

DEGREE = 32
#: Orders along random directions for the first graph, and nodes of a block in them.
ORDERS = 4
BLOCK = 128
#: Hyperplanes whose sides sort before the last direction's value.
SIDES = 5
#: The descent ends when a round brings less than this share of new edges.
SETTLED = 0.03
MAX_ROUNDS = 12
#: In one meeting a node takes up at most so many new neighbours; it has more meetings.
TAKEN = 5
#: Best nodes that a query keeps, how many of them it looks at in a step, and steps.
BEAM = 128
LOOKED = 32
STEPS = 6
#: Of a block, each node takes so many neighbours into the first graph.
FIRST = 12
NEAREST = 5


def clean_vectors(vectors: DataFrame) -> DataFrame:
    """vec_id, vec: the rows that take part."""
    fine = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    rows = vectors.select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("vec")
    )
    rows = rows.filter(F.col("vec_id").isNotNull() & F.col("vec").isNotNull() & fine)
    return rows.filter(F.exists("vec", lambda x: x != 0))


def _by_length(column: pa.ListArray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each length of the vectors in ``column``, their rows and a matrix of them.

    Each vector is scaled by a power of two, which changes no cosine and keeps
    squares of very large and very small components finite.
    """
    ends = column.offsets.to_numpy() - column.offsets[0].as_py()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    sizes = np.diff(ends)
    for n in np.unique(sizes):
        rows = np.flatnonzero(sizes == n)
        x = flat[ends[rows][:, None] + np.arange(n)]
        yield rows, np.ldexp(x, -np.frexp(np.abs(x).max(1, keepdims=True))[1])


def graph_nodes(vectors: DataFrame, count: int = NEAREST) -> DataFrame:
    """node, dim, vec, members (its count + 1 smallest ids), unit (16-bit floats) and the orders o0, o1, ..."""
    place = F.row_number().over(Window.partitionBy("vec").orderBy("vec_id"))
    # The limit on the place is applied before the shuffle: a hot vector sends few rows.
    few = vectors.withColumn("place", place).filter(F.col("place") <= count + 1)
    nodes = few.groupBy("vec").agg(F.array_sort(F.collect_list("vec_id")).alias("members"))
    nodes = nodes.withColumns({"node": F.monotonically_increasing_id(), "dim": F.size("vec")})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            units, orders = np.empty(len(b), object), np.zeros((ORDERS, len(b)))
            for rows, x in _by_length(b.column("vec")):
                x = x / np.sqrt((x * x).sum(1, keepdims=True))
                rng = np.random.default_rng(11)
                for order in orders:
                    along = x @ rng.normal(size=(x.shape[1], SIDES + 1))
                    order[rows] = (along[:, :SIDES] > 0) @ (1 << np.arange(SIDES)) * 1000.0 + along[:, SIDES]
                for row, unit in zip(rows, x.astype(np.float16), strict=True):
                    units[row] = unit.tobytes()
            columns = [*b.columns, pa.array(units, pa.binary()), *map(pa.array, orders)]
            yield pa.RecordBatch.from_arrays(columns, [*b.schema.names, "unit", *(f"o{i}" for i in range(ORDERS))])

    orders = ", ".join(f"o{i} double" for i in range(ORDERS))
    schema = f"node long, dim int, vec array<double>, members array<long>, unit binary, {orders}"
    return written(nodes.select("node", "dim", "vec", "members").mapInArrow(run, schema), "nn-nodes")


_EDGES = "node long, near long, sim float, fresh int"


def _edge_batch(node, near, sim) -> pa.RecordBatch:
    fresh = np.ones(len(node), np.int32)
    return pa.RecordBatch.from_arrays(
        [pa.array(node), pa.array(near), pa.array(sim.astype(np.float32)), pa.array(fresh)],
        ["node", "near", "sim", "fresh"],
    )


def _halves(rows: list[bytes]) -> np.ndarray:
    """A matrix of 32-bit floats from rows of 16-bit floats, all of one length."""
    return np.frombuffer(b"".join(rows), np.float16).reshape(len(rows), -1).astype(np.float32)


def _placed(nodes: DataFrame) -> DataFrame:
    """node, dim, unit, tie and the orders; the nodes of a rare length lie all in one place."""
    rare = nodes.groupBy("dim").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") < 2 * BLOCK)
    placed = splittable_join(nodes.drop("vec", "members"), rare, ["dim"], "left")
    orders = {f"o{i}": F.when(F.col("n").isNull(), F.col(f"o{i}")).otherwise(0.0) for i in range(ORDERS)}
    tie = F.when(F.col("n").isNull(), F.col("node")).otherwise(0)
    return written(placed.withColumns(orders | {"tie": tie}).drop("n"), "nn-placed")


def _first_edges(placed: DataFrame, order: str) -> DataFrame:
    """For each node, its best neighbours within its block along one order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for b in batches:
            for row in zip(*(b.column(c).to_pylist() for c in ("dim", "node", "unit")), strict=True):
                if held and row[0] != held[0][0]:
                    yield from block(held)
                    held = []
                held.append(row)
                if len(held) == 2 * BLOCK:  # the rest of a length stays at least a block
                    yield from block(held[:BLOCK])
                    held = held[BLOCK:]
        yield from block(held)

    def block(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        if len(rows) < 2:
            return
        ids = np.array([r[1] for r in rows])
        x = _halves([r[2] for r in rows])
        sims = x @ x.T
        np.fill_diagonal(sims, -np.inf)
        best = np.argsort(-sims, axis=1, kind="stable")[:, : min(FIRST, len(rows) - 1)]
        yield _edge_batch(
            np.repeat(ids, best.shape[1]), ids[best].ravel(), np.take_along_axis(sims, best, 1).ravel()
        )

    side_by_side = placed.select("dim", "node", "unit", "tie", order).repartitionByRange("dim", order, "tie")
    side_by_side = side_by_side.sortWithinPartitions("dim", order, "tie", "node")
    return side_by_side.select("dim", "node", "unit").mapInArrow(run, _EDGES)


def _best(edges: DataFrame) -> DataFrame:
    """The DEGREE best neighbours of each node; an edge found again is no longer fresh."""
    once = edges.repartition("node").groupBy("node", "near").agg(F.max("sim").alias("sim"), F.min("fresh").alias("fresh"))
    place = F.row_number().over(Window.partitionBy("node").orderBy(F.desc("sim"), "near"))
    best = once.withColumn("place", place).filter(F.col("place") <= DEGREE).drop("place")
    return written(best, "nn-graph")


def _meetings(graph: DataFrame, nodes: DataFrame) -> DataFrame:
    """Better edges from each node's neighbours, and those it is a neighbour of, meeting."""
    place = F.row_number().over(Window.partitionBy("near").orderBy(F.desc("fresh"), F.desc("sim"), "node"))
    back = graph.withColumn("place", place).filter(F.col("place") <= DEGREE)
    guests = graph.select(F.col("node").alias("host"), F.col("near").alias("node"), "fresh").unionByName(
        back.select(F.col("near").alias("host"), "node", "fresh")
    )
    worst = graph.groupBy("node").agg(F.min("sim").alias("worst"), F.count(F.lit(1)).alias("n"))
    worst = worst.select("node", F.when(F.col("n") >= DEGREE, F.col("worst")).otherwise(-2.0).cast("float").alias("worst"))
    known = nodes.select("node", "unit").join(worst, "node", "left").na.fill(-2.0, ["worst"])
    invited = splittable_join(guests, written(known, "nn-known"), ["node"])
    tables = invited.groupBy("host").agg(
        F.collect_list("node").alias("node"),
        F.collect_list("fresh").alias("fresh"),
        F.collect_list("unit").alias("unit"),
        F.collect_list("worst").alias("worst"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ends = b.column("node").offsets.to_numpy()
            ends = ends - ends[0]
            ids = b.column("node").flatten().to_numpy()
            fresh = b.column("fresh").flatten().to_numpy() > 0
            worst = b.column("worst").flatten().to_numpy()
            units = b.column("unit").flatten().to_pylist()
            found = []
            for i, j in zip(ends[:-1], ends[1:], strict=True):
                if not fresh[i:j].any():
                    continue
                guests, f = ids[i:j], fresh[i:j]
                x = _halves(units[i:j])
                sims = x @ x.T
                fine = (f[:, None] | f) & (guests[:, None] != guests) & (sims > worst[i:j, None])
                sims[~fine] = -np.inf
                best = np.argsort(-sims, axis=1)[:, :TAKEN]
                sim = np.take_along_axis(sims, best, 1)
                row, column = np.nonzero(sim > -np.inf)
                found.append((guests[row], guests[best[row, column]], sim[row, column]))
            if found:
                yield _edge_batch(*(np.concatenate(c) for c in zip(*found, strict=True)))

    return tables.mapInArrow(run, _EDGES)


def neighbour_graph(nodes: DataFrame) -> DataFrame:
    """node, near, sim, fresh: DEGREE neighbours of every node."""
    placed = _placed(nodes)
    first = _first_edges(placed, "o0")
    for i in range(1, ORDERS):
        first = first.unionByName(_first_edges(placed, f"o{i}"))
    graph = _best(first)
    for _ in range(MAX_ROUNDS):
        found = _meetings(graph, nodes)
        graph = _best(graph.withColumn("fresh", F.lit(0)).unionByName(found))
        edges = graph.agg(F.count(F.lit(1)).alias("n"), F.sum("fresh").alias("fresh")).first()
        if (edges["fresh"] or 0) <= SETTLED * edges["n"]:
            break
    return graph


def _links(graph: DataFrame) -> DataFrame:
    """node, near: the neighbours of a node and the best DEGREE of those that it is a neighbour of."""
    back = graph.select(F.col("near").alias("node"), F.col("node").alias("near"), "sim")
    place = F.row_number().over(Window.partitionBy("node").orderBy(F.desc("sim"), "near"))
    back = back.withColumn("place", place).filter(F.col("place") <= DEGREE).select("node", "near")
    both = graph.select("node", "near").unionByName(back)
    return written(both.groupBy("node").agg(F.collect_set("near").alias("near")), "nn-links")


_BEAMS = "query long, own binary, ids array<long>, firsts array<long>, sims array<float>, looked array<int>, due array<long>"


def _met(near: DataFrame) -> DataFrame:
    """query, met, met_first, met_sim from rows of query, own, node, first and unit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own, units = b.column("own").to_pylist(), b.column("unit").to_pylist()
            sizes, sims = np.array([len(u) for u in units]), np.zeros(len(b), np.float32)
            for n in np.unique(sizes):
                rows = np.flatnonzero(sizes == n)
                x, y = _halves([own[i] for i in rows]), _halves([units[i] for i in rows])
                sims[rows] = (x * y).sum(1)
            yield pa.RecordBatch.from_arrays(
                [b.column("query"), b.column("node"), b.column("first"), pa.array(sims)],
                ["query", "node", "first", "sim"],
            )

    rows = near.select("query", "own", "node", "first", "unit")
    rows = rows.mapInArrow(run, "query long, node long, first long, sim float")
    return rows.groupBy("query").agg(
        F.collect_list("node").alias("met"),
        F.collect_list("first").alias("met_first"),
        F.collect_list("sim").alias("met_sim"),
    )


def _widened(beams: DataFrame) -> DataFrame:
    """The beams after the nodes met (met, met_first, met_sim), with the nodes to look at next as ``due``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for i in range(len(b)):
                lists = (b.column(c)[i].values for c in ("ids", "firsts", "sims", "looked"))
                ids, firsts, sims, looked = (a.to_numpy() for a in lists)
                if b.column("met")[i].is_valid:
                    met, met_first, met_sim = (b.column(c)[i].values.to_numpy() for c in ("met", "met_first", "met_sim"))
                    new = ~np.isin(met, ids)
                    ids, firsts = np.append(ids, met[new]), np.append(firsts, met_first[new])
                    sims, looked = np.append(sims, met_sim[new]), np.append(looked, np.zeros(new.sum(), np.int32))
                best = np.lexsort((firsts, -sims))[:BEAM]
                ids, firsts, sims, looked = ids[best], firsts[best], sims[best], looked[best]
                due = np.flatnonzero(looked == 0)[:LOOKED]
                looked[due] = 1
                out.append((ids, firsts, sims, looked, ids[due]))
            if out:
                lists = [pa.array(c, pa.list_(k)) for c, k in zip(zip(*out, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([b.column("query"), b.column("own"), *lists], names)

    kinds = [pa.int64(), pa.int64(), pa.float32(), pa.int32(), pa.int64()]
    names = ["query", "own", "ids", "firsts", "sims", "looked", "due"]
    return beams.mapInArrow(run, _BEAMS)


def greedy_search(queries: DataFrame, graph: DataFrame, nodes: DataFrame) -> DataFrame:
    """query, node: the beam of every query. ``queries``: query (a node that is searched for)."""
    links = _links(graph)
    known = nodes.select("node", "unit", F.col("members")[0].alias("first"))
    own = known.withColumnsRenamed({"node": "query", "unit": "own"})
    beams = splittable_join(queries, own, ["query"]).select(
        "query",
        "own",
        F.array("query").alias("ids"),
        F.array("first").alias("firsts"),
        F.array(F.lit(2.0).cast("float")).alias("sims"),  # a query's own node stays at its head
        F.array(F.lit(1)).alias("looked"),
        F.array("query").alias("due"),
    )
    beams = written(beams, "nn-beams")
    for _ in range(STEPS):
        due = beams.select("query", F.explode("due").alias("node"))
        near = splittable_join(due, links, ["node"]).select("query", F.explode("near").alias("node")).distinct()
        near = splittable_join(near, beams.select("query", "own"), ["query"])
        met = _met(splittable_join(near, known, ["node"]))
        beams = written(_widened(splittable_join(beams.drop("due"), met, ["query"], "left")), "nn-beams")
        if beams.filter(F.size("due") > 0).isEmpty():
            break
    return beams.select("query", F.explode("ids").alias("node"))


def _scored(pairs: DataFrame) -> DataFrame:
    """query, vec_id, own, score: the cosines of pairs (query, node) that bring both vectors as a and b."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            score = np.zeros(len(b))
            for (rows, x), (_, y) in zip(_by_length(b.column("a")), _by_length(b.column("b")), strict=True):
                score[rows] = (x * y).sum(1) / (np.sqrt((x * x).sum(1)) * np.sqrt((y * y).sum(1)))
            own = pa.array(b.column("query").to_numpy() == b.column("node").to_numpy())
            yield pa.RecordBatch.from_arrays(
                [b.column("query"), b.column("members"), own, pa.array(score)], ["query", "members", "own", "score"]
            )

    scored = pairs.select("query", "node", "members", "a", "b").mapInArrow(
        run, "query long, members array<long>, own boolean, score double"
    )
    return scored.select("query", F.explode("members").alias("vec_id"), "own", "score")


def nearest(vectors: DataFrame, every: int = 50, count: int = NEAREST) -> DataFrame:
    """query_id, rank, vec_id, score: the ``count`` nearest of each row whose id is divisible by ``every``."""
    small_batches(vectors.sparkSession)
    clean = clean_vectors(vectors)
    nodes = graph_nodes(clean, count)
    graph = neighbour_graph(nodes)
    asked = clean.filter(F.col("vec_id") % every == 0)
    asked = splittable_join(asked, nodes.select("vec", F.col("node").alias("query")), ["vec"])
    asked = written(asked.select(F.col("vec_id").alias("query_id"), "query"), "nn-queries")
    pairs = greedy_search(asked.select("query").distinct(), graph, nodes)
    pairs = splittable_join(pairs, nodes.select("node", "members", F.col("vec").alias("b")), ["node"])
    pairs = splittable_join(pairs, nodes.select(F.col("node").alias("query"), F.col("vec").alias("a")), ["query"])
    # One more than asked for, as the query's own row is among them.
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "vec_id", F.desc("own")))
    top = _scored(pairs).withColumn("place", place).filter(F.col("place") <= count + 1)
    top = top.groupBy("query").agg(F.array_sort(F.collect_list(F.struct("place", "vec_id", "score", "own"))).alias("top"))
    found = splittable_join(asked, top, ["query"])
    mine = F.array_position(F.transform("top", lambda t: t["own"] & (t["vec_id"] == F.col("query_id"))), True)
    found = found.withColumn("mine", mine)
    others = F.filter("top", lambda t, i: i + 1 != F.col("mine"))
    found = found.select("query_id", F.posexplode(F.slice(others, 1, count)).alias("place", "t"))
    return found.select(
        "query_id",
        (F.col("place") + 1).cast("int").alias("rank"),
        F.col("t.vec_id").alias("vec_id"),
        F.col("t.score").alias("score"),
    )
