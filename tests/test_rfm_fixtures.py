"""Edge rows of scores, segments, NTILE, summary and heat map."""

from __future__ import annotations

import os
from collections import Counter

import pytest
from fixtures import PERIOD, d, dec, item, mart_of, order, rows
from pyspark.sql import functions as F

from salescope.operators.ntile import with_ntile
from salescope.operators.profile import client_profile
from salescope.operators.scores import (
    FREQUENCY_BANDS, FREQUENCY_BANDS_ELEVEN, RECENCY_BANDS, RECENCY_BANDS_ELEVEN, band_score, segment,
)
from salescope.plans import rfm


def profile(client, recency=0, months=1, money=10, uf="SP", channel="A"):
    ticket = None if money is None else round(money / months, 2)
    return (client, f"C{client}", uf, channel, recency, months, money, ticket, d("2024-01-01"), 0)


def test_bands(spark):
    df = spark.createDataFrame(
        [(0, 1), (1, 2), (2, 3), (3, 6), (4, 7), (6, 9), (7, 10), (None, None)], "r int, f int")
    got = rows(df.select(band_score(F.col("r"), RECENCY_BANDS).alias("a"),
                         band_score(F.col("f"), FREQUENCY_BANDS).alias("b")))
    assert got == [(5, 1), (5, 2), (4, 3), (3, 3), (2, 4), (2, 4), (1, 5), (1, 1)]
    df = spark.createDataFrame([(1, 3), (3, 4), (5, 7), (6, 12), (7, 13), (None, None)], "r int, f int")
    got = rows(df.select(band_score(F.col("r"), RECENCY_BANDS_ELEVEN).alias("a"),
                         band_score(F.col("f"), FREQUENCY_BANDS_ELEVEN).alias("b")))
    assert got == [(5, 1), (4, 2), (3, 3), (2, 4), (1, 5), (1, 1)]


def labels(spark, rules, scores):
    df = spark.createDataFrame(scores, "R_Score int, F_Score int, M_Score int")
    return [r[0] for r in rows(df.select(segment(rules)))]


def test_live_segments(spark):
    pairs = [(5, 5), (4, 4), (3, 3), (5, 2), (2, 3), (1, 1), (3, 1), (4, 1)]
    scores = [(r, f, 1) for r, f in pairs]
    want = ["Campeões", "Clientes fiéis", "Outros", "Novos clientes", "Em risco", "Em risco",
            "Atenção", "Outros"]
    assert labels(spark, "summary", scores) == want
    want[2] = "Clientes fiéis"
    assert labels(spark, "drilldown", scores) == want


@pytest.mark.parametrize("rules", ["summary", "drilldown"])
def test_lost_clients_are_never_labelled(spark, rules):
    every = [(r, f, m) for r in range(1, 6) for f in range(1, 6) for m in range(1, 6)]
    assert "Perdidos" not in labels(spark, rules, every)


def test_eleven_segments(spark):
    scores = [(5, 5, 5), (5, 3, 3), (4, 3, 3), (5, 2, 1), (5, 4, 2), (3, 3, 3), (2, 2, 2), (2, 3, 3),
              (1, 4, 4), (1, 2, 3), (3, 2, 1), (1, 3, 3)]
    assert labels(spark, "eleven", scores) == [
        "Campeões", "Clientes fiéis", "Fiéis em potencial", "Novos clientes", "Promessas",
        "Clientes precisando de atenção", "Quase dormentes", "Em risco", "Não pode perder",
        "Hibernando", "Perdidos", "Perdidos"]


def expected_ntile(n, k):
    size, extra = divmod(n, k)
    return [b + 1 for b in range(k) for _ in range(size + (b < extra))]


@pytest.mark.parametrize("n", [0, 1, 3, 5, 7, 11, 100])
def test_bucket_sizes(spark, n):
    df = spark.range(n).select("id", (F.col("id") * 7 % 11).alias("v"))
    for k, ranges in ((1, 4), (2, 1), (5, 4), (5, 1024)):
        got = with_ntile(df, k, [F.col("v"), F.col("id")], "b", ranges).collect()
        assert [r["b"] for r in sorted(got, key=lambda r: (r["v"], r["id"]))] == expected_ntile(n, k)


def test_ntile_ties_and_direction(spark):
    clients = [(1, 50), (2, 70), (3, 50), (4, 10), (5, 90), (6, 20), (7, None)]
    m = mart_of(spark, perfil_cliente=[profile(c, money=v) for c, v in clients])
    got = dict(rows(rfm.rfm_scores(m, PERIOD), "Cod_Cliente", "M_Score"))
    assert got == {5: 1, 2: 1, 1: 2, 3: 2, 6: 3, 4: 4, 7: 5}


def test_ntile_fewer_rows_than_buckets(spark):
    m = mart_of(spark, perfil_cliente=[profile(c, money=c) for c in (1, 2, 3)])
    assert dict(rows(rfm.rfm_scores(m, PERIOD), "Cod_Cliente", "M_Score")) == {3: 1, 2: 2, 1: 3}
    assert rfm.rfm_scores(mart_of(spark), PERIOD).count() == 0


def test_ntile_of_one_hot_value_is_exact_and_spread(spark):
    """A third of all rows share one value: every bucket size is exact, no range gets them all."""
    n = 30_000
    hot = F.when(F.col("id") % 3 == 0, F.lit(7.0)).otherwise((F.col("id") * 37 % 1000) / 50.0)
    df = spark.range(n).select("id", hot.alias("v"), F.lit(None).cast("string").alias("s"))
    got = with_ntile(df, 5, [-F.col("v"), F.col("id"), F.col("s")], "b", ranges=64)
    pdf = got.toPandas().sort_values(["v", "id"], ascending=[False, True])
    assert pdf["b"].tolist() == expected_ntile(n, 5)
    name = "spark.sql.adaptive.coalescePartitions.enabled"
    old = spark.conf.get(name)
    spark.conf.set(name, "false")
    try:
        parts = got.withColumn("part", F.spark_partition_id()).filter("v = 7.0").select("part").collect()
    finally:
        spark.conf.set(name, old)
    sizes = Counter(r["part"] for r in parts).values()
    assert len(sizes) > 1 and max(sizes) < n / 3


def test_scored_clients_are_computed_once_and_removed(spark):
    m = mart_of(spark, perfil_cliente=[profile(c, c % 7, c % 12 + 1, c * 3) for c in range(1, 60)])
    with rfm.scored_clients(m, PERIOD) as scores:
        (path,) = {f.rsplit("/", 1)[0] for f in scores.inputFiles()}
        for df in (rfm.rfm_summary(scores), rfm.rfm_heatmap(rfm.rfm_summary(scores)),
                   rfm.rfm_segment_clients(scores, "Em risco"), rfm.rfm_segments(scores)):
            plan = df._jdf.queryExecution().executedPlan().toString()
            assert path.rsplit("/", 1)[1] in plan and "LocalTableScan" not in plan
        assert sorted(rows(scores)) == sorted(rows(rfm.rfm_scores(m, PERIOD)))
        folder = path.removeprefix("file:").replace("//", "/")
        assert os.path.isdir(folder)
    assert not os.path.exists(folder)


def test_scored_clients_are_removed_after_a_failure(spark):
    m = mart_of(spark, perfil_cliente=[profile(1)])
    with pytest.raises(RuntimeError), rfm.scored_clients(m, PERIOD) as scores:
        folder = scores.inputFiles()[0].rsplit("/", 1)[0].removeprefix("file:").replace("//", "/")
        raise RuntimeError
    assert not os.path.exists(folder)


def test_client_with_two_sellers_counts_twice(spark):
    m = mart_of(spark, perfil_cliente=[profile(1, money=40), profile(2, money=10)],
                cliente_vendedor=[(1, "1"), (1, "2")])
    (row,) = rfm.rfm_summary(rfm.rfm_scores(m, PERIOD)).collect()
    assert (row["Numero_Clientes"], row["Valor_Total"], row["Valor_Medio"]) == (3, 90, 30)
    only = rfm.rfm_scores(m, PERIOD.but(seller_code="2"))
    assert rows(only, "Cod_Cliente", "M_Score") == [(1, 1)]


def test_filters_precede_the_ntile(spark):
    m = mart_of(spark, perfil_cliente=[profile(c, money=c, channel="AB"[c % 2], uf="SPRJ"[c % 2 * 2:][:2])
                                       for c in range(1, 11)])
    got = rows(rfm.rfm_scores(m, PERIOD.but(channels=("A",), ufs=("SP",))), "Cod_Cliente", "M_Score")
    assert sorted(got) == [(2, 5), (4, 4), (6, 3), (8, 2), (10, 1)]


def test_money_of_null_is_left_out_of_the_mean(spark):
    m = mart_of(spark, perfil_cliente=[profile(1, money=40), profile(2, money=None)])
    (row,) = rfm.rfm_summary(rfm.rfm_scores(m, PERIOD)).collect()
    assert (row["Numero_Clientes"], row["Valor_Medio"]) == (2, 40)


SUMMARY = "R_Score_Medio double, F_Score_Medio double, Numero_Clientes bigint"


def test_heatmap_rounds_half_to_even_and_has_every_cell(spark):
    df = spark.createDataFrame([(2.5, 3.5, 4), (1.6, 4.4, 3), (0.2, 5.9, 1)], SUMMARY)
    cells = {(r, f): n for r, f, n in rows(rfm.rfm_heatmap(df))}
    assert len(cells) == 25 and {k: v for k, v in cells.items() if v} == {(2, 4): 7, (1, 5): 1}


def test_heatmap_of_nothing(spark):
    got = rows(rfm.rfm_heatmap(spark.createDataFrame([], SUMMARY)))
    assert len(got) == 25 and Counter(n for _, _, n in got) == {0: 25}


def test_drilldown_and_view(spark):
    m = mart_of(spark, perfil_cliente=[profile(1, 0, 12, 40), profile(2, 3, 3, 60), profile(3, 9, 1, 5)])
    scores = rfm.rfm_scores(m, PERIOD)
    clients = rfm.rfm_segment_clients(scores, "Clientes fiéis")
    assert rows(clients, "Cod_Cliente", "R_Score", "F_Score") == [(2, 3, 3)]
    view = rfm.rfm_segment_view(clients)
    assert view.columns[-2:] == ["ticket_medio", "Mes_Ultima_Compra"]
    assert rows(view, "Monetario", "ticket_medio") == [(60.0, 20.0)]
    listed = rows(rfm.rfm_segment_list(rfm.rfm_summary(scores)))
    assert sorted(listed) == [("Campeões",), ("Em risco",), ("Outros",)]


def test_profile(spark):
    m = mart_of(
        spark,
        pedidos=[order(1, 1, "2023-11-30"), order(2, 1, "2024-02-01"), order(3, 1, "2024-02-20"),
                 order(4, 2, "2024-03-01"), order(5, None)],
        item_pedidos=[item(1, net=10), item(2, net=5), item(2, 2, net=5.5), item(5, net=99)],
    )
    got = {r["Cod_Cliente"]: tuple(r)[1:] for r in
           client_profile(m.pedidos, m.item_pedidos, d("2024-03-31")).collect()}
    assert got == {
        1: (1, 2, dec("20.50"), dec("10.25"), d("2024-02-01"), 3),
        2: (0, 1, dec("0.00"), dec("0.00"), d("2024-03-01"), 0),
    }
