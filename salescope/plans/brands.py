"""Performance per brand."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from salescope.functions.dates import month_of
from salescope.functions.numeric import MONEY, as_double, double_ratio, markup_pct, money_ratio
from salescope.operators.cost import cmv_legacy, cmv_unit_cost, with_unit_cost
from salescope.operators.filters import SalesFilter, narrows_orders, sales_filter
from salescope.operators.lines import filtered_headers, of_orders, sold_lines
from salescope.sources.mart import SalesMart


def _headers(mart: SalesMart, flt: SalesFilter, check_origin: bool) -> DataFrame:
    orders = sales_filter(mart.pedidos, flt.start, flt.end, check_origin)
    headers = filtered_headers(mart, orders, flt, company_columns=False)
    return headers.withColumn("mes_ref", month_of(F.col("dt_faturamento")))


def brand_performance(mart: SalesMart, flt: SalesFilter) -> DataFrame:
    """Per brand: revenue, clients, orders, quantity, products, tickets and markup.

    Costs are keyed by brand but meet the lines without it, so a line counts
    once per brand found in its costs. The costs are reduced to (sum, number of
    brands) first: the join stays one to one and the number becomes a weight.
    """
    headers = _headers(mart, flt, check_origin=True)
    retail, salon = mart.varejo_cmv, mart.pedidos_salao
    if narrows_orders(flt):
        retail, salon = of_orders(retail, headers), of_orders(salon, headers)
    costs = cmv_unit_cost(retail, salon, mart.bonificacao, mart.varejo_marca, flt.months)
    per_product = costs.groupBy("cod_pedido", "cod_produto", "mes_ref").agg(
        F.sum("custo_medio").cast(MONEY).alias("custo_medio"),
        F.count(F.lit(1)).alias("copies"),
    )
    lines = with_unit_cost(_sold(headers, mart), per_product)
    copies = F.coalesce(F.col("copies"), F.lit(1))
    rows = _by_brand(
        _brand_counts(headers, mart),
        lines,
        net=F.col("preco_desconto_rateado") * copies,
        quantity=F.col("qtd") * copies,
    )
    return _with_ratios(
        rows.withColumn("faturamento", F.round("net", 2)),
        ["faturamento", "clientes_unicos", "qtd_pedido", "qtd_itens", "qtd_sku"],
    )


def brand_performance_legacy(mart: SalesMart, flt: SalesFilter) -> DataFrame:
    """Older rule: cost without factor or month, any order system, fewer columns."""
    flt = flt.but(seller_names=())
    headers = _headers(mart, flt, check_origin=False)
    # These costs have no date: without the orders of the period all history would be read.
    costs = cmv_legacy(of_orders(mart.varejo_cmv, headers))
    rows = _by_brand(
        _brand_counts(headers, mart),
        with_unit_cost(_sold(headers, mart), costs),
        net=F.col("preco_desconto_rateado"),
        quantity=F.col("qtd"),
    )
    measures = ["clientes_unicos", "faturamento", "qtd_pedido", "qtd_sku"]
    return _with_ratios(rows.withColumn("faturamento", F.col("net")), measures).drop("Ticket_Medio_Pedidos")


def _sold(headers: DataFrame, mart: SalesMart) -> DataFrame:
    return sold_lines(headers.select("cod_pedido", "mes_ref"), mart.item_pedidos)


def _brand_counts(headers: DataFrame, mart: SalesMart) -> DataFrame:
    """Distinct clients and orders per brand, an order without items under the brand NULL.

    Counted on (order, brand) pairs: the items are reduced to these before they
    meet the orders, so an order joins at most one row per brand, and the join
    keeps the orders without items too.
    """
    pairs = mart.item_pedidos.select("cod_pedido", "marca").distinct()
    sold = headers.select("cod_pedido", "cpfcnpj").join(pairs, "cod_pedido", "left")
    return sold.groupBy("marca").agg(
        F.countDistinct("cpfcnpj").alias("clientes_unicos"),
        F.countDistinct("cod_pedido").alias("qtd_pedido"),
    )


def _by_brand(counts: DataFrame, lines: DataFrame, net: Column, quantity: Column) -> DataFrame:
    """One row per brand. Lines are summed by product first, so that products are counted as rows."""
    cost = F.coalesce(F.col("custo_medio"), F.lit(0).cast(MONEY)) * F.col("qtd")
    products = lines.groupBy("marca", "cod_produto").agg(
        F.sum(net).alias("net"), F.sum(quantity).alias("qtd_itens"), F.sum(cost).alias("cost")
    )
    sums = products.groupBy("marca").agg(
        F.sum("net").alias("net"),
        F.sum("qtd_itens").alias("qtd_itens"),
        F.sum("cost").alias("cost"),
        F.count("cod_produto").alias("qtd_sku"),
    )
    parts = counts.unionByName(sums, allowMissingColumns=True)
    # A measure comes from one of the two parts; every brand of the sums is also counted.
    merged = parts.groupBy("marca").agg(*[F.max(c).alias(c) for c in parts.columns if c != "marca"])
    return merged.na.fill(0, ["qtd_sku"])


def _with_ratios(rows: DataFrame, measures: list[str]) -> DataFrame:
    result = rows.select(
        "marca",
        *measures,
        money_ratio(F.col("net"), F.col("clientes_unicos")).alias("Ticket_Medio_Positivacao"),
        money_ratio(F.col("net"), F.col("qtd_pedido")).alias("Ticket_Medio_Pedidos"),
        markup_pct(F.col("net"), F.col("cost")).alias("markup_percentual"),
    )
    money = ["faturamento", "Ticket_Medio_Positivacao", "Ticket_Medio_Pedidos"]
    money += [c for c in ("qtd_itens",) if c in measures]
    return as_double(result, *money).orderBy(F.col("faturamento").desc_nulls_last(), "marca")


def brand_table(brands: DataFrame, selected: Sequence[str] = ()) -> DataFrame:
    """Share of the total and markup multiplier of each (selected) brand.

    The selection precedes the total, which is a scalar subquery: brands are
    not gathered. A brand has one row, so ``distinct`` changes nothing; it needs
    every column, which keeps the two uses of ``brands`` alike below it, and
    Spark then runs their common part once.
    """
    if selected:
        brands = brands.filter(F.col("marca").isin(*selected))
    brands = brands.distinct()
    total = brands.agg(F.sum(F.col("faturamento").cast("decimal(28,2)"))).scalar()
    multiplier = F.col("markup_percentual").cast("decimal(38,10)") / 100 + 1
    return brands.select(
        "marca",
        "faturamento",
        double_ratio(F.col("faturamento"), total).alias("share"),
        "clientes_unicos",
        "qtd_pedido",
        "qtd_sku",
        "Ticket_Medio_Positivacao",
        F.round(multiplier, 2).cast("double").alias("markup"),
    ).orderBy(F.col("faturamento").desc_nulls_last(), "marca")
