"""Month arithmetic on DATE columns and on plain Python dates."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def month_of(d: Column) -> Column:
    return F.trunc(d, "MM")


def first_day(d: date) -> date:
    return d.replace(day=1)


def shift_months(d: date, n: int) -> date:
    """First day of the month ``n`` months after the month of ``d``."""
    k = d.year * 12 + d.month - 1 + n
    return date(k // 12, k % 12 + 1, 1)


def month_starts(lo: Column, hi: Column) -> Column:
    """Array of month starts from ``lo`` to ``hi``; empty if ``lo > hi``."""
    none = F.array().cast("array<date>")
    return F.when(lo <= hi, F.sequence(lo, hi, F.expr("INTERVAL 1 MONTH"))).otherwise(none)


def calendar_between(spark: SparkSession, lo: date, hi: date, name: str = "mes") -> DataFrame:
    """One row per month start in ``[lo, hi]``; both are first days of a month."""
    return spark.range(1).select(F.explode(month_starts(F.lit(lo), F.lit(hi))).alias(name))


def month_calendar(spark: SparkSession, anchor: date, n_months: int = 16) -> DataFrame:
    """The ``n_months`` month starts that end with the month of ``anchor``."""
    return calendar_between(spark, shift_months(anchor, 1 - n_months), first_day(anchor))
