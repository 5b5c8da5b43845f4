"""Mixing sources to target weights by subset-sum budget fitting.

Every source gets a target in words: its weight's share of all words, at most
``max_copies`` times what it holds; what a full source cannot use is shared out
again by weight. A source is then taken whole as often as its target allows,
and the rest of the target is fitted: documents are counted by their exact
length, the rest is spread over the lengths in proportion, and a bounded
knapsack over the lengths closes the remaining budget. Last, of each length so
many documents are chosen as the fit says, smallest seeded hash first.

Scale: documents meet only aggregates by (source, length), so a source with a
third of all rows is counted before it is shuffled, and the fit of a source
sees one row per distinct length. The smallest hashes of a length are found
digit by digit (counts of 2^16 hash ranges, then of the next 16 bits, then of
the input's partitions), so that no task holds all documents of one length.
The driver gets sums over sources and row counts of partitions.

Cases: a null or empty text has size 0 and takes no words; a null source is a
source of its own, sorted last; a null doc_id is kept; repeated rows are
documents each, and which of them are chosen makes no difference; an empty
table gives an empty result; extra columns are not read unless kept; a source
without words has target 0. Where no subset meets a target exactly, the nearest
one counts.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from salescope.llm.common import written
from salescope.operators.joins import splittable_join

#: A document's size: how many of these its text has.
TOKEN = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
MAX_COPIES = 3
SEED = 20
#: The knapsack closes about so many words; the budget before is spread in proportion.
SPAN = 1 << 16
_DIGIT = 16
_ROW_BITS = 33  # of monotonically_increasing_id: row number in the partition


def fit(budget: int, lengths: Sequence[int], counts: Sequence[int], span: int = SPAN, spare: int = 0) -> np.ndarray:
    """How many documents of each length to take so that their lengths sum to ``budget``, or nearly so.

    ``lengths`` are positive and distinct, ``counts`` say how many there are.
    ``spare`` words are kept from the proportional part for the knapsack.
    """
    lengths, counts = np.asarray(lengths, np.int64), np.asarray(counts, np.int64)
    held = [int(x) * int(c) for x, c in zip(lengths, counts, strict=True)]
    total = sum(held)
    if budget >= total:
        return counts.copy()
    take = np.array([int(c) * max(budget - spare, 0) // total for c in counts], np.int64)
    rest = budget - sum(int(x) * int(t) for x, t in zip(lengths, take, strict=True))
    # Longest first down to the span, which the knapsack then closes.
    for i in np.argsort(-lengths):
        if rest <= span:
            break
        x = int(lengths[i])
        more = min(int(counts[i] - take[i]), -(-(rest - span) // x), rest // x)
        take[i] += more
        rest -= more * x
    return take + knapsack(rest, lengths, counts - take)


def knapsack(budget: int, lengths: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Bounded subset sum: counts per length whose sum is nearest to ``budget``, the smaller sum on ties.

    Sums reached are the bits of an integer. A length, longest first, extends
    them by one copy at a time, as often as it has documents; for every sum the
    first length that reached it is remembered, which leads back to the subset.
    """
    take = np.zeros(len(lengths), np.int64)
    usable = [i for i in np.argsort(-lengths) if counts[i] > 0]
    if budget <= 0 or not usable:
        return take
    top = min(2 * budget, budget + int(lengths[usable[0]]))  # a nearer sum may lie above the budget
    mask, goal = (1 << (top + 1)) - 1, 1 << budget
    first = np.full(top + 1, -1, np.int64)
    reached = 1
    for i in usable:
        x, frontier = int(lengths[i]), reached
        if reached & goal:
            break
        for _ in range(int(counts[i])):
            frontier = (frontier << x) & mask & ~reached
            if not frontier:
                break
            first[_bits(frontier, top)] = i
            reached |= frontier
    sums = _bits(reached, top)
    best = int(sums[np.lexsort((sums, np.abs(sums - budget)))[0]])
    while best:
        take[first[best]] += 1
        best -= int(lengths[first[best]])
    return take


def _bits(value: int, top: int) -> np.ndarray:
    raw = np.frombuffer(value.to_bytes(top // 8 + 1, "little"), np.uint8)
    return np.flatnonzero(np.unpackbits(raw, bitorder="little"))


def copies(target: float, lengths: np.ndarray, counts: np.ndarray, max_copies: int = MAX_COPIES) -> np.ndarray:
    """How often documents of each length are taken in all, at most ``max_copies`` times their number.

    All documents as often as the target allows, and some once more. If no such
    choice meets the target, as in a source of few documents, one copy of all
    is given back and spent again on any documents, some of them repeatedly.
    """
    held = sum(int(x) * int(c) for x, c in zip(lengths, counts, strict=True))
    whole = min(int(target // held), max_copies) if held else 0
    if not held or whole == max_copies:
        return whole * counts

    def missed(take: np.ndarray) -> float:
        return abs(sum(int(x) * int(c) for x, c in zip(lengths, take, strict=True)) - target)

    take = whole * counts + fit(round(target - whole * held), lengths, counts)
    if missed(take) <= 0.5:
        return take
    base = max(whole - 1, 0)
    other = base * counts + fit(round(target - base * held), lengths, (max_copies - base) * counts, spare=SPAN)
    return min(take, other, key=missed)


def _numbered(df: DataFrame, order: list, name: str) -> DataFrame:
    """``df`` with its place in ``order``: range-sorted and written once; row counts of partitions reach the driver."""
    rows = written(df.orderBy(*order).withColumn("_pos", F.monotonically_increasing_id()), "mix-sources")
    part = F.shiftright("_pos", _ROW_BITS)
    counts = sorted(map(tuple, rows.groupBy(part.alias("_part")).count().collect()))
    before = np.cumsum([0] + [n for _, n in counts])
    starts = [(p, int(b)) for (p, _), b in zip(counts, before[:-1], strict=True)]
    offsets = df.sparkSession.createDataFrame(starts, "_part long, _start long")
    rows = rows.withColumn("_part", part).join(offsets, "_part")
    place = F.col("_start") + F.col("_pos").bitwiseAND(F.lit((1 << _ROW_BITS) - 1))
    return rows.withColumn(name, place).drop("_pos", "_part", "_start")


def source_targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, max_copies: int = MAX_COPIES) -> DataFrame:
    """``_s``, source_size, target for each source of ``sizes`` (``_s``, source, n words, docs).

    Each round shares what is left among the sources that are not full yet; it
    ends when a round fills none. The driver holds sums only.
    """
    sources = sizes.groupBy("_s", "source").agg(F.sum(F.col("size") * F.col("docs")).alias("source_size"))
    rows = _numbered(sources, [F.col("source").isNull(), F.col("source")], "place")
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights) + 1).cast("int"))
    rows = rows.withColumn("weight", weight).withColumn("most", F.col("source_size") * max_copies)
    total, all_weights = rows.agg(F.sum("source_size"), F.sum("weight")).first()
    left, open_weights = total or 0, all_weights or 1
    share, full = F.lit(0.0), None
    while True:
        share = F.lit(float(left)) * F.col("weight") / F.lit(float(open_weights))
        over = share > F.col("most")
        held, weight_full, n = rows.filter(over).agg(F.sum("most"), F.sum("weight"), F.count(F.lit(1))).first()
        if n == full or not n or weight_full == all_weights:
            break
        left, open_weights, full = total - held, all_weights - weight_full, n
    target = F.when(share > F.col("most"), F.col("most").cast("double")).otherwise(share)
    return rows.select("_s", "source_size", target.alias("target"))


def _fits(max_copies: int):
    """Rows of one source, one per length: with the copies of each and the number that gets one more."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        lengths, counts = group["size"].to_numpy(), group["docs"].to_numpy()
        some = lengths > 0
        total = np.zeros(len(group), np.int64)
        total[some] = copies(float(group["target"].iloc[0]), lengths[some], counts[some], max_copies)
        return group.assign(whole=total // counts, more=total % counts)

    return run


def mix(
    docs: DataFrame,
    weights: Sequence[int] = WEIGHTS,
    max_copies: int = MAX_COPIES,
    seed: int = SEED,
    keep: Iterable[str] = ("doc_id",),
) -> DataFrame:
    """The ``keep`` columns of each document, with size, source_size, target and copies.

    A document stands ``copies`` times in the mix, at most ``max_copies``.
    ``weights`` go to the sources in their order, again from the first after the last.
    """
    size = F.coalesce(F.regexp_count("text", F.lit(TOKEN)), F.lit(0)).cast("long")
    seeded = F.xxhash64(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "text")
    source = F.col("source").cast("string")
    rows = written(
        docs.select(
            *(F.col(c).alias(f"_keep{i}") for i, c in enumerate(keep)),
            source.alias("source"),
            F.concat(F.when(source.isNull(), "-").otherwise("+"), F.coalesce(source, F.lit(""))).alias("_s"),
            size.alias("size"),
            seeded.alias("_h"),
            F.monotonically_increasing_id().alias("_row"),
        ),
        "mix-sizes",
    )
    sizes = written(rows.groupBy("_s", "source", "size").agg(F.count(F.lit(1)).alias("docs")), "mix-lengths")
    targets = source_targets(sizes, weights, max_copies)
    kinds = "_s string, size long, docs long, source_size long, target double, whole int, more long"
    fitted = (
        sizes.drop("source").join(targets, "_s").groupBy("_s").applyInPandas(_fits(max_copies), kinds)
    )
    plan, rows = _chosen(rows, written(fitted.drop("docs"), "mix-fits"))
    taken = splittable_join(rows, plan, ["_s", "size"])
    return taken.select(
        *(F.col(f"_keep{i}").alias(c) for i, c in enumerate(keep)),
        "size",
        "source_size",
        "target",
        (F.col("whole") + _first_of(plan.columns).cast("int")).cast("int").alias("copies"),
    )


#: The digits of a document's place among those of its length: hash, hash, partition, row in it.
def _digits() -> list:
    bits = F.col("_h").bitwiseXOR(F.lit(-(1 << 63)))  # unsigned order
    return [
        F.shiftrightunsigned(bits, 64 - _DIGIT),
        F.shiftrightunsigned(bits, 64 - 2 * _DIGIT).bitwiseAND(F.lit((1 << _DIGIT) - 1)),
        F.shiftright("_row", _ROW_BITS),
    ]


def _chosen(rows: DataFrame, fits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``fits`` with the cut of each (source, length), and ``rows`` with their digits.

    A level counts the rows by the next digit and finds the digit within which
    the wanted number is passed; only rows with that digit go to the next level.
    """
    key, digits = ["_s", "size"], _digits()
    rows = rows.withColumns({f"_d{i}": d for i, d in enumerate(digits)})
    plan = fits.withColumn("_left", F.col("more"))
    for i in range(len(digits)):
        cuts = plan.filter(F.col("_left") > 0).select(*key, "_left", *(f"_cut{j}" for j in range(i)))
        here = splittable_join(rows, cuts, key).filter(_equal(i))
        counts = here.groupBy(*key, "_left", f"_d{i}").agg(F.count(F.lit(1)).alias("n"))
        by_digit = Window.partitionBy(*key).orderBy(f"_d{i}")  # at most 2^16 rows, or one per partition
        passed = counts.withColumn("upto", F.sum("n").over(by_digit))
        cut = passed.filter((F.col("upto") >= F.col("_left")) & (F.col("upto") - F.col("n") < F.col("_left")))
        cut = cut.select(*key, F.col(f"_d{i}").alias(f"_cut{i}"), (F.col("_left") - F.col("upto") + F.col("n")).alias("_rest"))
        plan = plan.join(written(cut, "mix-cut"), key, "left").withColumn("_left", F.coalesce("_rest", F.lit(0))).drop("_rest")
    n = len(digits)
    last = plan.filter(F.col("_left") > 0).select(*key, "_left", *(f"_cut{j}" for j in range(n)))
    here = splittable_join(rows, last, key).filter(_equal(n))
    order = Window.partitionBy(*key).orderBy("_h", "_row")  # of one length, two hash digits and one partition
    ends = here.withColumn("_at", F.row_number().over(order)).filter(F.col("_at") == F.col("_left"))
    ends = ends.select(*key, F.col("_h").alias("_end_h"), F.col("_row").alias("_end_row"))
    return plan.join(ends, key, "left").drop("_left"), rows


def _equal(n: int):
    same = F.lit(True)
    for j in range(n):
        same = same & (F.col(f"_d{j}") == F.col(f"_cut{j}"))
    return same


def _first_of(columns: Iterable[str]):
    """Whether a row lies before the cut: smaller in the first digit that differs, or up to the last row."""
    n = sum(c.startswith("_cut") for c in columns)
    before = _equal(n) & (F.struct("_h", "_row") <= F.struct(F.col("_end_h").alias("_h"), F.col("_end_row").alias("_row")))
    for j in range(n):
        before = before | (_equal(j) & (F.col(f"_d{j}") < F.col(f"_cut{j}")))
    return F.coalesce(before & (F.col("more") > 0), F.lit(False))


def source_mix(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target and ``taken``, the words that the mix takes of the document."""
    return mix(docs).select(
        "doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken")
    )
