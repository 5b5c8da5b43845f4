"""Client status per month: counts and shares of the active base."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from salescope.functions.numeric import double_ratio
from salescope.operators.filters import SalesFilter
from salescope.operators.visits import (
    BASE,
    CHURN,
    NEW,
    REACTIVATED,
    RECOVERED,
    RETAINED,
    STATUSES,
    StatusCalendar,
    client_events,
    client_purchase_dates,
)
from salescope.sources.mart import SalesMart


def client_status(mart: SalesMart, flt: SalesFilter, cal: StatusCalendar) -> DataFrame:
    """Clients per month and status, for the reported months, by month and status."""
    events = client_events(client_purchase_dates(mart, flt), cal)
    return _counted(events, flt, cal).orderBy("mes", "status")


def _counted(events: DataFrame, flt: SalesFilter, cal: StatusCalendar) -> DataFrame:
    lo, hi = cal.reported(flt)
    reported = events.filter(F.col("mes").between(F.lit(lo), F.lit(hi)))
    return reported.groupBy("mes", "status").agg(F.count(F.lit(1)).alias("qtd"))


def _one_status(status: str):
    def counts(mart: SalesMart, flt: SalesFilter, cal: StatusCalendar) -> DataFrame:
        events = client_events(client_purchase_dates(mart, flt), cal)
        return _counted(events.filter(F.col("status") == status), flt, cal).orderBy("mes")

    counts.__doc__ = f"Clients per month with status {status}."
    return counts


new_clients = _one_status(NEW)
churned_clients = _one_status(CHURN)
recovered_clients = _one_status(RECOVERED)
reactivated_clients = _one_status(REACTIVATED)
retained_clients = _one_status(RETAINED)
client_base = _one_status(BASE)


def client_status_shares(status: DataFrame) -> DataFrame:
    """One row per month: the base and each other status in percent of it.

    A missing status counts 0; a month without base has NULL shares. Without
    any base at all the result is empty. The window sees one row per month.
    """
    wide = status.groupBy("mes").pivot("status", list(STATUSES)).agg(F.sum("qtd")).na.fill(0)
    base = F.col(BASE)
    shares = [(double_ratio(F.col(s), base) * 100).alias(s) for s in STATUSES if s != BASE]
    return (
        wide.withColumn("top", F.max(base).over(Window.partitionBy()))
        .filter(F.col("top") > 0)
        .select("mes", base, *shares)
        .orderBy("mes")
    )
