"""Average unit cost of goods per order, product and month.

Costs come from two sources, retail and salon. Each is divided by the bonus
factor that applies; a product that meets several factors gets one average per
factor, and those averages add up.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from salescope.functions.dates import month_of
from salescope.functions.numeric import FACTOR, MONEY, exact_money_ratio
from salescope.functions.text import brand_key, category_prefix
from salescope.operators.filters import Months, in_months
from salescope.operators.joins import splittable_join

def _weighted(rows: DataFrame, keys: list[str], qty: str, cost: str) -> DataFrame:
    """Quantity-weighted average of ``cost`` per key and factor.

    ``n`` tells how many equal factor rows a cost row met; it enters as a
    weight, so the join itself need not repeat the row.
    """
    factor = F.coalesce(F.col("fator"), F.lit(1)).cast(FACTOR)
    sums = rows.groupBy(*keys, "fator").agg(
        F.sum(weighted_product(qty, cost)).alias("value"), F.sum(_weight(qty)).alias("weight")
    )
    average = exact_money_ratio(F.col("value"), F.col("weight").cast("decimal(19,6)") * factor)
    return sums.select(*keys, average.cast(MONEY).alias("custo_medio"))


def _weight(qty: str) -> Column:
    n = F.coalesce(F.col("n"), F.lit(1)).cast("decimal(6,0)")
    return (F.col(qty) * n).cast("decimal(19,6)")


def weighted_product(qty: str, cost: str) -> Column:
    """Quantity times ``n`` times cost with all twelve decimals.

    A product of three decimals as they come has a result type of six decimals;
    the weight's own type leaves room for all.
    """
    return _weight(qty) * F.col(cost)


def cmv_retail(
    cmv: DataFrame, factors: DataFrame, brands: DataFrame | None = None, months: Months = None
) -> DataFrame:
    """Retail average cost; with ``brands``, also keyed by the brand's name."""
    on = ["cod_marca", "cod_empresa", "mes_ref"]
    by_company = factors.filter(in_months("mes_ref", months)).groupBy(
        "cod_marca", F.col("cod_empresa").cast("string").alias("cod_empresa"), "mes_ref", "fator"
    )
    rows = (
        cmv.filter(in_months("dt_faturamento", months))
        .withColumn("mes_ref", month_of(F.col("dt_faturamento")))
    )
    rows = splittable_join(rows, by_company.agg(F.count(F.lit(1)).alias("n")), on, "left")
    keys = ["cod_pedido", "cod_produto"]
    if brands is not None:
        names = brands.select("cod_marca", F.upper("desc_abrev").alias("marca"))
        rows = rows.join(names, "cod_marca", "left")
        keys.append("marca")
    return _weighted(rows, keys + ["mes_ref"], "qtd", "custo_unitario")


def cmv_salon(
    salon: DataFrame, factors: DataFrame, by_brand: bool = False, months: Months = None
) -> DataFrame:
    """Salon average cost; rows whose category meets no factor are left out.

    A category meets a factor row by its full name or by its first four
    characters. The OR is one equi-join on (month, kind of match, text): each
    side lists both texts, and a pair that already agrees by name is not
    counted again by prefix.
    """
    dim = (
        factors.filter(F.col("fator").isNotNull() & in_months("mes_ref", months))
        .groupBy("mes_ref", "marca", "fator")
        .agg(F.count(F.lit(1)).alias("n"))
        .withColumn("name", brand_key(F.col("marca")))
        .select("mes_ref", "fator", "n", "name", _texts(F.col("name"), F.upper("marca")))
    )
    category = F.col("categoria")
    rows = (
        salon.filter(in_months("dtvenda", months))
        .select(
            "cod_pedido",
            F.col("codprod").alias("cod_produto"),
            F.upper(category).alias("marca"),
            month_of(F.col("dtvenda")).alias("mes_ref"),
            "quant",
            "custo",
            brand_key(category).alias("own_name"),
            _texts(brand_key(category), category_prefix(category)),
        )
    )
    rows = splittable_join(rows, dim, ["mes_ref", "kind", "text"]).filter(
        (F.col("kind") == "name") | (F.col("own_name") != F.col("name"))
    )
    keys = ["cod_pedido", "cod_produto"] + (["marca"] if by_brand else []) + ["mes_ref"]
    return _weighted(rows, keys, "quant", "custo")


def _texts(name: Column, prefix: Column) -> Column:
    def entry(kind: str, text: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), text.alias("text"))

    return F.inline(F.array(entry("name", name), entry("prefix", prefix)))


def cmv_unit_cost(
    cmv: DataFrame,
    salon: DataFrame,
    factors: DataFrame,
    brands: DataFrame | None = None,
    months: Months = None,
) -> DataFrame:
    """Sum of the per-factor averages of both sources by order, product and month.

    With ``brands`` the brand name is a further key.
    """
    both = cmv_retail(cmv, factors, brands, months).unionByName(
        cmv_salon(salon, factors, brands is not None, months)
    )
    keys = [c for c in both.columns if c != "custo_medio"]
    return both.groupBy(*keys).agg(F.sum("custo_medio").cast(MONEY).alias("custo_medio"))


def cmv_legacy(cmv: DataFrame) -> DataFrame:
    """Older rule: retail only, no factor, no month."""
    average = exact_money_ratio(F.sum(F.col("qtd") * F.col("custo_unitario")), F.sum("qtd"))
    return cmv.groupBy("cod_pedido", "cod_produto").agg(average.cast(MONEY).alias("custo_medio"))


def with_unit_cost(lines: DataFrame, costs: DataFrame) -> DataFrame:
    """Lines LEFT costs on order, product code and, where the costs have one, month."""
    keyed = costs.withColumnRenamed("cod_produto", "sku")
    on = [c for c in ("cod_pedido", "sku", "mes_ref") if c in keyed.columns]
    return splittable_join(lines, keyed, on, "left")
