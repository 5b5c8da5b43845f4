"""NTILE over a whole table without moving it into one partition."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

#: At most so many ranges, a power of two; a range is what one task sorts.
RANGES = 256
_KEY, _RANGE = "_ntile_key", "_ntile_range"


def with_ntile(
    df: DataFrame, k: int, order: Sequence[Column], name: str, ranges: int = RANGES
) -> DataFrame:
    """Add ``name`` = NTILE(k) over ``order``: ascending, NULL first, and a total order.

    Lazy: building it starts no job. The rows are shuffled once; two scalar
    subqueries read that shuffle again. They give the keys of up to ``ranges``
    rows picked by a hash, sorted, as bounds, and the number of rows below each
    range. A row's place is that number and its own number within its range,
    and place and total give the bucket.

    Exact whatever the bounds are; the pick depends on the rows alone, so the
    subqueries agree with each other. As the key holds the tie-breaking columns,
    rows that share one value still spread over many ranges.
    """
    hashed = F.xxhash64(*df.columns)
    # Hashing every column keeps the shuffle the same for all that read it.
    rows = df.repartition(hashed).withColumns(
        {_KEY: F.struct(*[c.alias(f"c{i}") for i, c in enumerate(order)]), "_ntile_hash": hashed}
    )
    least = F.min(F.struct("_ntile_hash", _KEY))
    picked = rows.groupBy(F.pmod("_ntile_hash", F.lit(ranges)).alias("part")).agg(least.alias("least"))
    bounds = picked.agg(F.array_sort(F.collect_list(f"least.{_KEY}"))).scalar()
    rows = _with_range(rows.drop("_ntile_hash").withColumn("_ntile_bounds", bounds), ranges)
    counts = rows.groupBy(_RANGE).agg(F.count(F.lit(1)).alias("n"))
    listed = F.array_sort(F.collect_list(F.struct(_RANGE, "n")))
    before = counts.agg(listed.alias("counts")).select(_running(F.col("counts"))).scalar()

    within = F.row_number().over(Window.partitionBy(_RANGE).orderBy(_KEY))
    # Columns of their own, so that each is one expression however often it is used.
    rows = rows.withColumn("_ntile_row", within).withColumn("_ntile_before", before)
    total = F.element_at("_ntile_before", -1)
    place = F.get("_ntile_before", F.col(_RANGE)) + F.col("_ntile_row") - 1
    size, extra = F.floor(total / F.lit(k)).cast("long"), total % k
    large = extra * (size + 1)  # rows of the first buckets, which hold one more
    bucket = F.when(place < large, F.floor(place / (size + 1))).otherwise(
        extra + F.floor(F.try_divide(place - large, size))
    )
    return rows.withColumn(name, (bucket + 1).cast("int")).drop(
        _KEY, _RANGE, "_ntile_row", "_ntile_before"
    )


def _with_range(rows: DataFrame, ranges: int) -> DataFrame:
    """Add how many of the sorted bounds are less than the key, by halving steps.

    A step is a projection, so that all of them run in generated code on the one
    array; a place behind the last bound is NULL and counts as not less.
    """
    rows, step = rows.withColumn(_RANGE, F.lit(0)), 1 << (ranges.bit_length() - 1)
    while step:
        less = F.get("_ntile_bounds", F.col(_RANGE) + F.lit(step - 1)) < F.col(_KEY)
        rows = rows.withColumn(_RANGE, F.col(_RANGE) + F.when(less, F.lit(step)).otherwise(F.lit(0)))
        step >>= 1
    return rows.drop("_ntile_bounds")


def _running(counts: Column) -> Column:
    """Rows below each range, at the range's index, and last all rows; from (range, rows) in order."""

    def add(state: Column, c: Column) -> Column:
        held = state["before"]
        # Ranges without rows get an entry too, so that the index is the range.
        entries = F.array_repeat(state["n"], c[_RANGE] + 1 - F.size(held))
        return F.struct((state["n"] + c["n"]).alias("n"), F.concat(held, entries).alias("before"))

    start = F.struct(F.lit(0).cast("long").alias("n"), F.array().cast("array<bigint>").alias("before"))
    return F.aggregate(counts, start, add, lambda s: F.concat(s["before"], F.array(s["n"])))
