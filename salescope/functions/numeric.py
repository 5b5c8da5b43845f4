"""Exact money arithmetic.

Sums stay in decimals, so a total does not depend on the order in which
partitions arrive. A value becomes a double only in the last projection.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: Amounts, costs and quantities as read, and averages that are rounded to cents.
AMOUNT = "decimal(18,6)"
MONEY = "decimal(18,2)"
FACTOR = "decimal(18,8)"


def ratio(num: Column, den: Column) -> Column:
    """``num / den`` as decimal(38,10); NULL where ``den`` is 0 or NULL.

    The two casts pick operand types for which Spark's result type keeps ten
    decimals; wider operands would silently fall back to six.
    """
    return F.try_divide(num.cast("decimal(28,8)"), den.cast("decimal(24,8)"))


def money_ratio(num: Column, den: Column) -> Column:
    return F.round(ratio(num, den), 2)


def exact_money_ratio(num: Column, den: Column) -> Column:
    """``num / den`` in cents, with 12 decimals of ``num`` and 14 of ``den`` kept up to the division."""
    return F.round(F.try_divide(num.cast("decimal(26,12)"), den.cast("decimal(26,14)")), 2)


def double_ratio(num: Column, den: Column) -> Column:
    """Unrounded ratio for percentages and averages, NULL on a zero base."""
    return F.try_divide(num.cast("double"), den.cast("double"))


def markup_pct(net: Column, cost: Column) -> Column:
    """Margin over cost in percent; 0 where there is no positive cost."""
    n, c = net.cast("double"), cost.cast("double")
    return F.when(c > 0, F.try_divide(n - c, c) * F.lit(100.0)).otherwise(F.lit(0.0))


def as_double(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.col(n).cast("double") for n in names})
