"""Joins of large tables that survive a hot key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

_HASH = "_key_hash"


def splittable_join(
    left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner"
) -> DataFrame:
    """Equi-join in the one form in which adaptive execution splits a hot key.

    Spark splits a skewed partition only where both inputs come straight out of
    a shuffle made for this join. If one input is already partitioned by the
    keys, from a join or aggregate before, that shuffle is left out and with it
    the split. A hash of the keys as one more key brings it back: it changes no
    result and costs one more shuffle of the input that needed none, which
    should be the narrow one.

    Inner joins split on both sides, left and anti joins on the left side.
    """
    key = F.xxhash64(*on)
    joined = left.withColumn(_HASH, key).join(right.withColumn(_HASH, key), [*on, _HASH], how)
    return joined.drop(_HASH)
