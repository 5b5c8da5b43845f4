"""Purchase profile per client, the input of the RFM queries."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, functions as F

from salescope.functions.dates import month_of
from salescope.functions.numeric import AMOUNT, MONEY, money_ratio


def client_profile(orders: DataFrame, items: DataFrame, as_of: date) -> DataFrame:
    """Recency, purchase months, money, ticket, last month and life span per client.

    Dates come from the orders alone and money from the matched items, so no
    outer join of the two large tables is needed. Both parts are combined
    before their shuffle, which keeps a client with very many orders small.
    """
    known = orders.filter(F.col("cpfcnpj").isNotNull()).withColumnRenamed("cpfcnpj", "Cod_Cliente")
    months = known.select("Cod_Cliente", month_of(F.col("dt_faturamento")).alias("m")).distinct()
    money = (
        items.select("cod_pedido", "preco_desconto_rateado")
        .join(known.select("cod_pedido", "Cod_Cliente"), "cod_pedido")
        .groupBy("Cod_Cliente")
        .agg(F.sum("preco_desconto_rateado").alias("total"))
    )
    spans = months.groupBy("Cod_Cliente").agg(
        F.count("m").alias("n"), F.min("m").alias("first"), F.max("m").alias("last")
    )
    total = F.coalesce(F.col("total"), F.lit(0)).cast(AMOUNT)
    return spans.join(money, "Cod_Cliente", "left").select(
        "Cod_Cliente",
        _months_between(F.col("last"), F.lit(as_of)).alias("Recencia"),
        F.col("n").cast("int").alias("Positivacao"),
        total.alias("Monetario"),
        money_ratio(total, F.col("n")).cast(MONEY).alias("ticket_medio_posit"),
        F.col("last").alias("Maior_Mes"),
        _months_between(F.col("first"), F.col("last")).alias("Ciclo_Vida"),
    )


def _months_between(earlier, later):
    """Whole calendar months from one date's month to the other's."""

    def index(d):
        return F.year(d) * 12 + F.month(d)

    return (index(later) - index(earlier)).cast("int")
