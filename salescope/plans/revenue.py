"""Monthly revenue, its dense series and the figures of the latest month."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, Window, functions as F

from salescope.functions.dates import calendar_between, first_day, month_of, shift_months
from salescope.functions.numeric import MONEY, as_double, double_ratio, markup_pct, money_ratio
from salescope.operators.bonus import adjusted, bonus_order, factor_counts, repeated
from salescope.operators.cost import cmv_unit_cost, with_unit_cost
from salescope.operators.filters import (
    Months,
    SalesFilter,
    dimension_filter,
    in_months,
    in_period,
    narrows_orders,
    sales_filter,
    valid_sale,
)
from salescope.operators.joins import splittable_join
from salescope.operators.lines import (
    filtered_headers,
    of_orders,
    order_headers,
    orders_with_items,
    sold_lines,
)
from salescope.sources.mart import SalesMart

MEASURES = [
    "faturamento_bruto",
    "faturamento_liquido",
    "desconto",
    "valor_bonificacao",
    "custo_total",
    "positivacao",
    "qtd_pedido",
    "qtd_itens",
    "qtd_sku",
    "qtd_marcas",
    "Ticket_Medio_Positivacao",
    "Ticket_Medio_Pedidos",
    "markup_percentual",
]
_COUNTS = ("positivacao", "qtd_pedido", "qtd_sku", "qtd_marcas")


def monthly_revenue(mart: SalesMart, flt: SalesFilter) -> DataFrame:
    """Revenue, bonus, cost, distinct counts, tickets and markup per month.

    With ``flt.seller_code`` the rows are keyed by month, seller name and code.
    """
    return _monthly(mart, flt)


def monthly_revenue_legacy(mart: SalesMart, flt: SalesFilter) -> DataFrame:
    """Older rule: any order system, any bonus description, no seller-name filter."""
    return _monthly(mart, flt.but(seller_names=()), legacy=True)


def _monthly(
    mart: SalesMart, flt: SalesFilter, legacy: bool = False, months: Months = None
) -> DataFrame:
    """Sales and bonus lines in one pass over the items; ``months`` narrow the period further.

    The items are the largest table and carry no date, so they are joined once,
    to the orders of both kinds. The kinds never overlap: no bonus description
    is a sale description.
    """
    by_seller = bool(flt.seller_code)
    seller = ["vendedor", "cod_colaborador"] if by_seller else []
    keys = ["mes_ref", *seller]

    sale = in_period("dt_faturamento", flt.start, flt.end) & valid_sale(check_origin=not legacy)
    bonus = bonus_order(any_text=legacy)
    orders = mart.pedidos.filter(in_months("dt_faturamento", flt.months) & (sale | bonus))
    retail, salon, factors = mart.varejo_cmv, mart.pedidos_salao, mart.bonificacao
    if months is not None:
        orders = orders.filter(in_months("dt_faturamento", months))
        retail = retail.filter(in_months("dt_faturamento", months))
        salon = salon.filter(in_months("dtvenda", months))
        factors = factors.filter(in_months("mes_ref", months))
    orders = orders.withColumn("is_sale", F.coalesce(sale, F.lit(False)))
    headers = dimension_filter(order_headers(orders, mart.empresa_pedido), flt).select(
        "cod_pedido",
        "cpfcnpj",
        "is_sale",
        month_of(F.col("dt_faturamento")).alias("mes_ref"),
        F.when(~F.col("is_sale"), F.col("cod_empresa_faturamento")).alias("cod_empresa"),
        F.col("nome_colaborador_atual").alias("vendedor"),
        F.col("cod_colaborador_atual").alias("cod_colaborador"),
    )
    items = dimension_filter(mart.item_pedidos, flt)
    if narrows_orders(flt):  # costs meet lines on the order: those of others play no role
        retail, salon = of_orders(retail, headers), of_orders(salon, headers)
    costs = cmv_unit_cost(retail, salon, factors, months=flt.months)
    lines = with_unit_cost(sold_lines(headers.drop("cpfcnpj"), items), costs)

    heads = _order_counts(orders_with_items(headers, items) if flt.brands else headers, keys)
    sums = _line_sums(lines, factors.filter(in_months("mes_ref", flt.months)), keys)
    parts = heads.unionByName(sums, allowMissingColumns=True)
    # A measure comes from one part, the bonus from one row per factor.
    measures = [F.max(c).alias(c) for c in parts.columns if c not in (*keys, "bonus")]
    merged = parts.groupBy(*keys).agg(*measures, F.round(F.sum("bonus"), 2).alias("bonus"))
    return _with_ratios(_bonus_by_code(merged) if by_seller else merged, keys)


def _order_counts(headers: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct clients and orders of sales, and whether there is a bonus order.

    Both come from the orders, so a bonus order without items shows up as well.

    Products and brands are counted on reduced line sums. Counting all four on
    the lines would copy every line once per distinct count.
    """
    is_sale = F.col("is_sale")
    return headers.groupBy(*keys).agg(
        F.countDistinct(F.when(is_sale, F.col("cpfcnpj"))).alias("positivacao"),
        F.countDistinct(F.when(is_sale, F.col("cod_pedido"))).alias("qtd_pedido"),
        F.max(~is_sale).alias("has_bonus"),
    )


def _line_sums(lines: DataFrame, factors: DataFrame, keys: list[str]) -> DataFrame:
    """Sums of the sale lines per key, and bonus values per key and factor.

    Sale lines are first reduced to (key, product, brand) and bonus lines to
    (key, company). Only the few reduced bonus rows meet the factors.
    """
    is_sale, qty = F.col("is_sale"), F.col("qtd")
    cost = F.coalesce(F.col("custo_medio"), F.lit(0).cast(MONEY)) * qty
    reduced = lines.groupBy(
        *keys,
        "is_sale",
        "cod_empresa",
        F.when(is_sale, F.col("cod_produto")).alias("cod_produto"),
        F.when(is_sale, F.col("marca")).alias("marca"),
    ).agg(
        F.sum("preco_total").alias("bruto"),
        F.sum("preco_desconto_rateado").alias("liquido"),
        F.sum(cost).alias("custo"),
        F.sum(qty).alias("itens"),
    )
    per_factor = (
        splittable_join(reduced, factor_counts(factors), ["cod_empresa", "mes_ref"], "left")
        .groupBy(*keys, "is_sale", "fator")
        .agg(
            F.sum(repeated(F.col("bruto"))).alias("bruto"),
            F.sum("liquido").alias("liquido"),
            F.sum("custo").alias("custo"),
            F.sum("itens").alias("itens"),
            F.countDistinct("cod_produto").alias("produtos"),
            F.countDistinct("marca").alias("marcas"),
        )
    )

    def of_sales(measure: str) -> Column:
        return F.when(is_sale, F.col(measure))

    return per_factor.select(
        *keys,
        F.round(of_sales("bruto"), 2).alias("faturamento_bruto"),
        F.round(of_sales("liquido"), 2).alias("faturamento_liquido"),
        F.round(of_sales("custo"), 2).alias("custo_total"),
        of_sales("itens").alias("qtd_itens"),
        of_sales("produtos").alias("qtd_sku"),
        of_sales("marcas").alias("qtd_marcas"),
        F.when(~is_sale, adjusted(F.col("bruto"))).alias("bonus"),
    )


def _bonus_by_code(merged: DataFrame) -> DataFrame:
    """Give each seller row the bonus of every name its code has in that month.

    Bonus meets revenue on month and code without the name, so two names of one
    code see each other's bonus. A bonus without a value, from an order without
    items, still makes a row. A window holds the names of one code only.
    """
    same_code = Window.partitionBy("mes_ref", "cod_colaborador")
    found = F.collect_list(F.when(F.col("has_bonus"), F.struct("bonus"))).over(same_code)
    return merged.withColumn("found", found).select(
        *[c for c in merged.columns if c != "bonus"], F.explode_outer("found").alias("of_name")
    ).withColumn("bonus", F.col("of_name.bonus"))


def _with_ratios(merged: DataFrame, keys: list[str]) -> DataFrame:
    net, cost = F.col("faturamento_liquido"), F.col("custo_total")
    # Without a sale order there is no revenue row, whatever the bonus.
    full = (
        merged.filter(F.col("qtd_pedido") > 0)
        .na.fill(0, list(_COUNTS))
        .withColumns(
            {
                "desconto": F.round(F.col("faturamento_bruto") - net, 2),
                "valor_bonificacao": F.coalesce("bonus", F.lit(0)),
                "Ticket_Medio_Positivacao": money_ratio(net, F.col("positivacao")),
                "Ticket_Medio_Pedidos": money_ratio(net, F.col("qtd_pedido")),
                "markup_percentual": markup_pct(net, cost),
            }
        )
        .select(*keys, *MEASURES)
    )
    money = [c for c in MEASURES if c not in _COUNTS]
    order = [F.col(c).asc_nulls_last() for c in keys[:2]]
    return as_double(full, *money).orderBy(*order)


def monthly_series(revenue: DataFrame, start: date, end: date) -> DataFrame:
    """Net revenue and clients for every month start within the period, 0 where none."""
    lo = start if start.day == 1 else shift_months(start, 1)
    months = calendar_between(revenue.sparkSession, lo, first_day(end), "mes_ref")
    sums = revenue.groupBy("mes_ref").agg(
        F.sum("faturamento_liquido").alias("faturamento_liquido"),
        F.sum("positivacao").alias("positivacao"),
    )
    return months.join(sums, "mes_ref", "left").na.fill(0).orderBy("mes_ref")


def latest_month(mart: SalesMart, flt: SalesFilter) -> Column:
    """First day of the latest month that has revenue, as a scalar subquery on the filtered orders.

    Company and items are read only where a filter needs them.
    """
    orders = sales_filter(mart.pedidos, flt.start, flt.end)
    headers = filtered_headers(mart, orders, flt, company_columns=False)
    if flt.brands:
        headers = orders_with_items(headers, dimension_filter(mart.item_pedidos, flt))
    return headers.agg(month_of(F.max("dt_faturamento"))).scalar()


def latest_month_kpis(mart: SalesMart, flt: SalesFilter) -> DataFrame:
    """``month_kpis`` of the latest month; orders, costs and factors of earlier months are not read."""
    latest = latest_month(mart, flt)
    return month_kpis(_monthly(mart, flt, months=(latest, latest)))


def month_kpis(revenue: DataFrame) -> DataFrame:
    """The latest month's sums with discount and bonus percentages and the markup multiplier.

    The result has one row, or none for an empty input.
    """
    sums = revenue.groupBy("mes_ref").agg(*[F.sum(c).alias(c) for c in MEASURES])
    latest = sums.agg(F.max(F.struct("mes_ref", *MEASURES)).alias("r")).select("r.*")

    def share(part: str, base: str):
        pct = double_ratio(F.col(part), F.col(base)) * 100
        return F.when(F.col(base) != 0, pct).otherwise(F.lit(0.0))

    return latest.filter(F.col("mes_ref").isNotNull()).withColumns(
        {
            "desconto_percentual": share("desconto", "faturamento_bruto"),
            "bonificacao_percentual": share("valor_bonificacao", "faturamento_liquido"),
            "markup_value": F.col("markup_percentual") / 100 + 1,
        }
    )
