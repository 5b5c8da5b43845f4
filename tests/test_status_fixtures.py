"""Edge rows and brute force for the client status."""

from __future__ import annotations

import random
from collections import Counter
from datetime import date, timedelta

import pytest
from fixtures import PERIOD, company, d, mart_of, order, rows

from salescope.operators.filters import SalesFilter
from salescope.operators.visits import (
    BASE, CHURN, NEW, REACTIVATED, RECOVERED, RETAINED, StatusCalendar, client_events,
    client_purchase_dates,
)
from salescope.plans import status

# 16 months: 2023-09 to 2024-12
CAL = StatusCalendar(anchor=d("2024-12-01"), as_of=d("2024-12-31"), status_floor=d("2024-01-01"))
YEAR = SalesFilter(d("2023-09-01"), d("2024-12-31"))


def events(spark, visits):
    """{(month, status)} of one client that bought on the given days."""
    df = spark.createDataFrame([(1, d(v)) for v in visits], "cod_cliente bigint, dt_faturamento date")
    got = rows(client_events(df, CAL), "mes", "status")
    assert len(got) == len(set(got)), "a client may carry a status once a month"
    return set(got)


def having(got, wanted):
    return sorted(m for m, s in got if s == wanted)


@pytest.mark.parametrize(
    ("days", "expected"),
    [(90, RETAINED), (91, REACTIVATED), (180, REACTIVATED), (181, RECOVERED)],
)
def test_gap_bands(spark, days, expected):
    first = date(2024, 1, 1)
    second = first + timedelta(days=days)
    got = events(spark, [first.isoformat(), second.isoformat()])
    month = second.replace(day=1)
    assert [s for m, s in got if m == month and s not in (BASE, CHURN)] == [expected]


def test_same_day_and_same_month_repeats(spark):
    m = mart_of(spark, pedidos=[order(1), order(2), order(3, day="2024-01-20")],
                empresa_pedido=[company(1)])
    dates = client_purchase_dates(m, PERIOD)
    assert sorted(rows(dates)) == [(1, d("2024-01-10")), (1, d("2024-01-20"))]
    got = rows(client_events(dates, CAL).filter("mes = '2024-01-01'"), "status")
    assert got == [(NEW,)]


def test_churn_exactly_180_days_before_a_month_start_waits(spark):
    start = date(2024, 8, 1)
    edge = start - timedelta(days=180)
    assert having(events(spark, [edge.isoformat()]), CHURN) == [d("2024-09-01")]
    earlier = edge - timedelta(days=1)
    assert having(events(spark, [earlier.isoformat()]), CHURN) == [start]


def test_churn_before_the_calendar_lands_in_its_first_month(spark):
    assert events(spark, ["2015-05-05"]) == {(d("2023-09-01"), CHURN)}


def test_churn_after_the_calendar_is_not_reported(spark):
    assert having(events(spark, ["2024-11-30"]), CHURN) == []


def test_base_edges(spark):
    start = date(2024, 8, 1)
    on_start = having(events(spark, [start.isoformat()]), BASE)
    assert on_start[0] == start
    old = start - timedelta(days=180)
    assert start not in having(events(spark, [old.isoformat()]), BASE)
    assert start in having(events(spark, [(old + timedelta(days=1)).isoformat()]), BASE)


def test_floor_within_a_month_leaves_that_month_out():
    first = d("2024-02-01")
    assert StatusCalendar(d("2024-12-01"), d("2024-12-31"), d("2024-01-15")).floor == first
    assert StatusCalendar(d("2024-12-01"), d("2024-12-31"), first).floor == first
    assert StatusCalendar(d("2024-12-01"), d("2024-12-31"), d("2020-01-01")).floor == d("2023-09-01")


def test_floor_hides_all_but_new_and_churn(spark):
    got = events(spark, ["2023-09-10", "2023-10-10", "2023-12-20", "2024-01-05"])
    assert {(m, s) for m, s in got if m < d("2024-01-01")} == {(d("2023-09-01"), NEW)}
    assert (d("2024-01-01"), RETAINED) in got


def test_unknown_client_or_date_is_ignored(spark):
    m = mart_of(spark, pedidos=[order(1, client=None), order(2, day=None), order(3)])
    assert rows(client_purchase_dates(m, PERIOD)) == [(1, d("2024-01-10"))]


def test_seller_code_wins_over_names(spark):
    m = mart_of(spark, pedidos=[order(1), order(2, client=2)],
                empresa_pedido=[company(1), company(2, seller="2", name="Bia")])
    flt = PERIOD.but(seller_code="1", seller_names=("Bia",))
    assert rows(client_purchase_dates(m, flt), "cod_cliente") == [(1,)]
    assert rows(client_purchase_dates(m, PERIOD.but(seller_names=("Bia",))), "cod_cliente") == [(2,)]


def test_reported_months_are_cut_by_period_calendar_and_day(spark):
    assert CAL.reported(YEAR) == (d("2023-09-01"), d("2024-12-01"))
    assert CAL.reported(SalesFilter(d("2020-05-05"), d("2030-01-01"))) == (
        d("2023-09-01"), d("2024-12-01"))
    assert CAL.reported(SalesFilter(d("2024-02-20"), d("2024-03-02"))) == (
        d("2024-02-01"), d("2024-03-01"))
    today = StatusCalendar(d("2024-12-01"), d("2024-06-15"), d("2024-01-01"))
    assert today.reported(YEAR) == (d("2023-09-01"), d("2024-06-01"))


def brute_force(purchases: dict[int, list[date]]) -> Counter:
    months = [date(2023 + (8 + i) // 12, (8 + i) % 12 + 1, 1) for i in range(16)]
    floor, counts = date(2024, 1, 1), Counter()
    for days in purchases.values():
        days = sorted(days)
        named = {days[0].replace(day=1): NEW}
        for before, day in zip(days, days[1:], strict=False):
            gap, month = (day - before).days, day.replace(day=1)
            if month >= floor and gap > 90:
                named[month] = RECOVERED if gap > 180 else REACTIVATED
        for day in days:
            if day.replace(day=1) >= floor:
                named.setdefault(day.replace(day=1), RETAINED)
        for month in months:
            if month in named:
                counts[month, named[month]] += 1
            since = month - timedelta(days=180)
            if month >= floor and any(since < day <= month for day in days):
                counts[month, BASE] += 1
        lost = [m for m in months if days[-1] < m - timedelta(days=180)]
        if lost:
            counts[lost[0], CHURN] += 1
    return counts


@pytest.fixture(scope="module")
def random_clients():
    rng = random.Random(7)
    days = [date(2022, 1, 1) + timedelta(days=i) for i in range(1095)]
    return {c: [rng.choice(days) for _ in range(rng.randint(1, 14))] for c in range(400)}


def test_counts_equal_brute_force(spark, random_clients):
    orders = [order(i, c, day.isoformat()) for i, (c, day) in
              enumerate((c, day) for c, days in random_clients.items() for day in days)]
    m = mart_of(spark, pedidos=orders)
    got = {(a, b): n for a, b, n in rows(status.client_status(m, YEAR, CAL))}
    assert got == dict(brute_force(random_clients))


def test_statuses_partition_the_active_clients(random_clients):
    counts = brute_force(random_clients)
    for month in {m for m, _ in counts if m >= date(2024, 1, 1)}:
        active = sum(any(x.replace(day=1) == month for x in days) for days in random_clients.values())
        assert active == sum(counts[month, s] for s in (NEW, RECOVERED, REACTIVATED, RETAINED))


STATUS = "mes date, status string, qtd bigint"


def test_shares(spark):
    df = spark.createDataFrame(
        [(d("2024-01-01"), BASE, 8), (d("2024-01-01"), CHURN, 2), (d("2024-02-01"), CHURN, 1)], STATUS)
    assert [tuple(r) for r in status.client_status_shares(df).collect()] == [
        (d("2024-01-01"), 8, 0.0, 25.0, 0.0, 0.0, 0.0),
        (d("2024-02-01"), 0, None, None, None, None, None),
    ]


def test_no_base_at_all_gives_nothing(spark):
    df = spark.createDataFrame([(d("2024-01-01"), CHURN, 2)], STATUS)
    assert status.client_status_shares(df).count() == 0
