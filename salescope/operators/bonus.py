"""Monthly value of bonus goods."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from salescope.functions.dates import month_of
from salescope.functions.numeric import money_ratio
from salescope.functions.text import brand_key
from salescope.operators.filters import SalesFilter, dimension_filter
from salescope.operators.lines import order_headers, order_lines, sold_lines
from salescope.sources.mart import SalesMart


def bonus_order(any_text: bool = False) -> Column:
    """Orders of bonus goods; ``any_text`` accepts every description with BONIFICA."""
    cfop = F.upper("desc_abrev_cfop")
    described = cfop.like("%BONIFICA%") if any_text else cfop == "BONIFICADO"
    return described & (F.col("operacoes_internas") == "N")


def bonus_lines(
    mart: SalesMart, flt: SalesFilter | None = None, any_text: bool = False
) -> DataFrame:
    """Bonus orders LEFT their items. The period and the order system play no role here."""
    orders = mart.pedidos.filter(bonus_order(any_text))
    return order_lines(orders, mart.item_pedidos, mart.empresa_pedido, flt)


def monthly_bonus(
    mart: SalesMart,
    flt: SalesFilter | None = None,
    any_text: bool = False,
    by_seller: bool = False,
    match_brand: bool = False,
) -> DataFrame:
    """``bonus_value`` of the mart's bonus orders, with one pass over the items.

    An order without items has no value but shows its month. That months exist
    is read off the orders, which are joined to no item for it: every key of an
    order is united with the line sums, with no value of its own.
    """
    headers = order_headers(mart.pedidos.filter(bonus_order(any_text)), mart.empresa_pedido)
    items = mart.item_pedidos
    if flt is not None:
        headers, items = dimension_filter(headers, flt), dimension_filter(items, flt)
    headers = _keyed(headers)
    keys = ["cod_empresa", "mes_ref", *_SELLER]
    sums = _line_sums(sold_lines(headers, items), by_seller, match_brand)
    if flt is None or not flt.brands:  # a brand filter leaves no order without lines
        seen = headers.select(*[k for k in keys if k in sums.columns]).distinct()
        sums = sums.unionByName(seen, allowMissingColumns=True)
    return _valued(sums, mart.bonificacao, mart.varejo_marca, by_seller, match_brand)


def factor_counts(factors: DataFrame, *extra: str) -> DataFrame:
    """Number ``n`` of equal factor rows per company, month and ``extra`` column."""
    company = F.col("cod_empresa").cast("string").alias("cod_empresa")
    return factors.groupBy(company, "mes_ref", *extra, "fator").agg(F.count(F.lit(1)).alias("n"))


def repeated(total: Column) -> Column:
    """A total as often as its company and month have the factor, once without factor."""
    return total * F.coalesce(F.col("n"), F.lit(1))


def adjusted(total: Column) -> Column:
    """A total divided by its factor, rounded; NULL for a factor of 0."""
    factor = F.col("fator")
    return F.when(factor.isNull(), F.round(total, 2)).otherwise(money_ratio(total, factor))


def bonus_value(
    lines: DataFrame,
    factors: DataFrame,
    brands: DataFrame,
    by_seller: bool = False,
    match_brand: bool = False,
) -> DataFrame:
    """Bonus value per month (and seller).

    Every line counts once per factor row of its company and month, divided by
    that factor, whatever the row's brand. ``match_brand`` keeps only factor
    rows of the line's own brand.

    Lines are summed per company and month before they meet the factors, and
    equal factors are counted, so the repetition never happens at line level.
    """
    return _valued(_line_sums(_keyed(lines), by_seller, match_brand), factors, brands, by_seller, match_brand)


_SELLER = ("vendedor", "cod_colaborador")


def _keyed(rows: DataFrame) -> DataFrame:
    return rows.withColumns(
        {
            "mes_ref": month_of(F.col("dt_faturamento")),
            "cod_empresa": F.col("cod_empresa_faturamento"),
            "vendedor": F.col("nome_colaborador_atual"),
            "cod_colaborador": F.col("cod_colaborador_atual"),
        }
    )


def _line_sums(lines: DataFrame, by_seller: bool, match_brand: bool) -> DataFrame:
    keys = ["cod_empresa", "mes_ref", *(_SELLER if by_seller else ())]
    brand = [brand_key(F.col("marca")).alias("brand")] if match_brand else []
    return lines.groupBy(*keys, *brand).agg(F.sum("preco_total").alias("total"))


def _valued(
    sums: DataFrame, factors: DataFrame, brands: DataFrame, by_seller: bool, match_brand: bool
) -> DataFrame:
    brand = ["brand"] if match_brand else []
    if match_brand:
        names = brands.select("cod_marca", brand_key(F.col("desc_abrev")).alias("brand"))
        factors = factors.join(names, "cod_marca")
    keys = ["mes_ref", *(_SELLER if by_seller else ())]
    per_factor = (
        sums.join(factor_counts(factors, *brand), ["cod_empresa", "mes_ref", *brand], "left")
        .groupBy(*keys, "fator")
        .agg(F.sum(repeated(F.col("total"))).alias("total"))
    )
    value = F.round(F.sum(adjusted(F.col("total"))), 2)
    return per_factor.groupBy(*keys).agg(value.alias("valor_bonificacao"))
