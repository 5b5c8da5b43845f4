"""Purchase dates of each client and the life-cycle events they imply.

One window pass per client replaces joins between clients and the calendar:

* the first visit of a month decides what the client is that month: new,
  recovered, reactivated or retained (a gap over 90 days always ends in the
  first visit of a month);
* the last visit of all gives the churn month in closed form;
* each visit carries the client in the active base for the month starts up to
  the next visit, at most 180 days, so no (client, month) comes twice.

So every event row is one distinct client, and plain counts suffice.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date

from pyspark.sql import Column, DataFrame, Window, functions as F

from salescope.functions.dates import first_day, month_of, month_starts, shift_months
from salescope.operators.filters import SalesFilter, valid_sale
from salescope.operators.lines import filtered_headers
from salescope.sources.mart import SalesMart

# Status names, in the order of the shares table.
BASE = "Base"
NEW = "novas_aberturas"
CHURN = "churn"
RECOVERED = "Recuperado"
REACTIVATED = "Reativado"
RETAINED = "Positivado"
STATUSES = (BASE, NEW, CHURN, RECOVERED, REACTIVATED, RETAINED)

# Days.
REACTIVATED_AFTER = 90
INACTIVE_AFTER = 180


@dataclass(frozen=True)
class StatusCalendar:
    """Months the client status knows and the day it is asked for.

    Recovered, reactivated, retained and base are only reported for months that
    begin on ``status_floor`` or later.
    """

    anchor: date
    as_of: date
    status_floor: date
    n_months: int = 16

    @property
    def first(self) -> date:
        return shift_months(self.anchor, 1 - self.n_months)

    @property
    def floor(self) -> date:
        """The first month start that is not before ``status_floor`` nor the calendar."""
        day = self.status_floor
        return max(day if day.day == 1 else shift_months(day, 1), self.first)

    def reported(self, flt: SalesFilter) -> tuple[date, date]:
        lo, hi = flt.months
        return max(lo, self.first), min(hi, first_day(self.anchor), first_day(self.as_of))


def client_purchase_dates(mart: SalesMart, flt: SalesFilter) -> DataFrame:
    """Distinct (client, date) of valid sales. The period of ``flt`` plays no role.

    A seller code takes precedence over seller names. Duplicates vanish before
    the shuffle, so a client has at most one row per calendar day afterwards.
    """
    flt = flt.but(seller_names=()) if flt.seller_code else flt
    headers = filtered_headers(mart, mart.pedidos.filter(valid_sale()), flt, company_columns=False)
    return (
        headers
        .select(F.col("cpfcnpj").alias("cod_cliente"), "dt_faturamento")
        .filter(F.col("cod_cliente").isNotNull() & F.col("dt_faturamento").isNotNull())
        .distinct()
    )


def last_purchase(dates: DataFrame) -> DataFrame:
    return dates.groupBy("cod_cliente").agg(F.max("dt_faturamento").alias("ultima_data_compra"))


def client_events(dates: DataFrame, cal: StatusCalendar) -> DataFrame:
    """One row (client, month, status) per life-cycle event in the calendar's months."""
    by_client = Window.partitionBy("cod_cliente").orderBy("dt_faturamento")
    day = F.col("dt_faturamento")
    visits = dates.select(
        "cod_cliente",
        day,
        F.lag(day).over(by_client).alias("previous"),
        F.lead(day).over(by_client).alias("next"),
    )
    floor = F.lit(cal.floor)
    # Months of the visit's own event, of churn and of the base, told apart by position.
    months = F.concat(F.array(_activity_month(floor), _churn_month(cal)), _base_months(cal, floor))
    status = F.when(F.col("pos") == 0, F.col("activity")).when(F.col("pos") == 1, CHURN)
    lo, hi = F.lit(cal.first), F.lit(first_day(cal.anchor))
    return (
        visits.select("cod_cliente", _activity().alias("activity"), F.posexplode(months))
        .filter(F.col("col").between(lo, hi))
        .select("cod_cliente", F.col("col").alias("mes"), status.otherwise(BASE).alias("status"))
    )


def _activity() -> Column:
    gap = F.datediff("dt_faturamento", "previous")
    return (
        F.when(gap.isNull(), NEW)
        .when(gap > INACTIVE_AFTER, RECOVERED)
        .when(gap > REACTIVATED_AFTER, REACTIVATED)
        .otherwise(RETAINED)
    )


def _activity_month(floor: Column) -> Column:
    """The visit's month, if the visit is the client's first in it."""
    previous, month = F.col("previous"), month_of(F.col("dt_faturamento"))
    first_of_month = month_of(previous) < month
    return F.when(previous.isNull() | (first_of_month & (month >= floor)), month)


def _churn_month(cal: StatusCalendar) -> Column:
    """First month start more than 180 days after the last visit of all."""
    after = F.add_months(month_of(F.date_add("dt_faturamento", INACTIVE_AFTER)), 1)
    return F.when(F.col("next").isNull(), F.greatest(F.lit(cal.first), after))


def _base_months(cal: StatusCalendar, floor: Column) -> Column:
    """Month starts from this visit to the day before the next, within 180 days."""
    day = F.col("dt_faturamento")
    start = F.greatest(floor, F.add_months(month_of(F.date_sub(day, 1)), 1))
    until = F.least(F.date_add(day, INACTIVE_AFTER - 1), F.date_sub(F.col("next"), 1))
    return month_starts(start, F.least(F.lit(first_day(cal.anchor)), month_of(until)))
