"""Derive the sales mart from a TPC-H-like star schema.

The mart's own tables are private to their owner, so tests and benchmarks use
this mapping. Every table is a lazy DataFrame over the star files.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from salescope.functions.dates import month_of, month_starts
from salescope.functions.numeric import FACTOR
from salescope.operators.joins import splittable_join
from salescope.operators.profile import client_profile
from salescope.sources.mart import SalesMart

# Fixed value of the mapping: it holds at every scale factor.
PROFILE_AS_OF = date(2001, 8, 1)

# The star columns in use. Declared, so that opening a table reads no file.
STAR = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string",
    "part": "p_partkey bigint, p_brand string, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, "
    "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_quantity double, l_extendedprice double, "
    "l_discount double, l_returnflag string, l_linestatus string",
}


def mart_from_star(spark: SparkSession, sf_dir: str, as_of: date = PROFILE_AS_OF) -> SalesMart:
    def table(name: str) -> DataFrame:
        return spark.read.schema(STAR[name]).parquet(f"{sf_dir}/{name}.parquet")

    def order_items() -> DataFrame:
        return _items(table("lineitem"), table("part"))

    def pedidos() -> DataFrame:
        return _orders(table("orders"), table("customer"))

    def place() -> DataFrame:
        return _client_place(table("customer"), table("nation"))

    return SalesMart(
        {
            "pedidos": pedidos,
            "item_pedidos": order_items,
            "empresa_pedido": lambda: _companies(
                table("orders"), place(), table("region"), table("supplier")
            ),
            "bonificacao": lambda: _factors(
                table("part"), table("region"), table("orders")
            ),
            "varejo_marca": lambda: _brand_names(table("part")),
            "varejo_cmv": lambda: _retail_costs(
                table("lineitem"), table("part"), table("orders"), place()
            ),
            "pedidos_salao": lambda: _salon_costs(
                table("lineitem"), table("part"), table("orders")
            ),
            "perfil_cliente": lambda: _profile(pedidos(), order_items(), place(), as_of),
            "cliente_vendedor": lambda: _client_sellers(table("customer"), table("supplier")),
        },
        # _companies() makes one row per row of orders.
        one_company_per_order=True,
    )


def _client_place(customer: DataFrame, nation: DataFrame) -> DataFrame:
    return customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey"), "left")


def _seller_of(key: str, supplier: DataFrame) -> Column:
    """Suppliers are numbered from 0; a key belongs to the one of its remainder."""
    n = supplier.agg(F.count(F.lit(1))).scalar()
    return F.col(key) % F.nullif(n, F.lit(0))


def _client_sellers(customer: DataFrame, supplier: DataFrame) -> DataFrame:
    return customer.select(
        F.col("c_custkey").alias("cod_cliente"),
        _seller_of("c_custkey", supplier).cast("string").alias("cod_colaborador_atual"),
    )


def _brand_names(part: DataFrame) -> DataFrame:
    padded = F.concat(F.lit(" "), F.upper("p_brand"), F.lit(" "))
    return _brands(part).select("cod_marca", padded.alias("desc_abrev"))


def _hundredths(x: Column) -> Column:
    """A double that holds at most two decimals, as a whole number of hundredths."""
    return F.rint(x * 100).cast("bigint")


def _money(hundredths: Column) -> Column:
    """Exact decimal(18,2) by long arithmetic; casting the double would go through text."""
    return hundredths.cast("decimal(15,0)") * F.lit("0.01").cast("decimal(2,2)")


def _percent(hundredths: Column, percent: Column | int) -> Column:
    """``percent`` of a non-negative amount, rounded half up."""
    return F.floor((hundredths * percent + 50) / 100)


def _brand_code(brand: Column) -> Column:
    return F.substring_index(brand, "#", -1).cast("int")


def _orders(orders: DataFrame, customer: DataFrame) -> DataFrame:
    prio, key = F.col("o_orderpriority"), F.col("o_orderkey")
    cfop = (
        F.when(prio == "5-LOW", "BONIFICADO")
        .when(prio == "4-NOT SPECIFIED", "VENDA DO CONSIGNADO")
        .when(prio == "3-MEDIUM", "VENDA DE MERC.SUJEITA ST")
        .otherwise("VENDA")
    )
    internal = F.when((F.col("o_orderstatus") == "P") & (key % 10 == 0), "S").otherwise("N")
    origin = F.when(key % 3 == 0, "uno").when(key % 3 == 1, "egestor").otherwise("anymarket")
    return orders.join(customer, F.col("o_custkey") == F.col("c_custkey"), "left").select(
        key.alias("cod_pedido"),
        F.col("o_custkey").alias("cpfcnpj"),
        F.col("o_orderdate").cast("date").alias("dt_faturamento"),
        cfop.alias("desc_abrev_cfop"),
        internal.alias("operacoes_internas"),
        origin.alias("origem"),
        F.col("c_mktsegment").alias("canal_venda"),
    )


def _items(lineitem: DataFrame, part: DataFrame) -> DataFrame:
    price = _hundredths(F.col("l_extendedprice"))
    keep = F.lit(100) - _hundredths(F.col("l_discount"))
    return lineitem.join(part, F.col("l_partkey") == F.col("p_partkey")).select(
        F.col("l_orderkey").alias("cod_pedido"),
        F.col("l_partkey").alias("cod_produto"),
        F.col("l_partkey").cast("string").alias("sku"),
        F.col("p_brand").alias("marca"),
        _money(_hundredths(F.col("l_quantity"))).alias("qtd"),
        _money(price).alias("preco_total"),
        _money(_percent(price, keep)).alias("preco_desconto_rateado"),
    )


def _companies(
    orders: DataFrame, client_place: DataFrame, region: DataFrame, supplier: DataFrame
) -> DataFrame:
    sellers = supplier.select("s_suppkey", "s_name")
    seller = F.col("seller")
    return (
        orders.select("o_orderkey", "o_custkey", _seller_of("o_orderkey", supplier).alias("seller"))
        .join(client_place, F.col("o_custkey") == F.col("c_custkey"), "left")
        .join(region, F.col("n_regionkey") == F.col("r_regionkey"), "left")
        .join(sellers, seller == F.col("s_suppkey"), "left")
        .select(
            F.col("o_orderkey").alias("cod_pedido"),
            F.col("n_regionkey").cast("string").alias("cod_empresa_faturamento"),
            F.col("r_name").alias("nome_empresa_faturamento"),
            F.col("n_name").alias("uf_empresa_faturamento"),
            seller.cast("string").alias("cod_colaborador_atual"),
            F.col("s_name").alias("nome_colaborador_atual"),
            F.col("s_name").alias("nome_colaborador_pedido"),
            F.col("c_mktsegment").alias("equipes"),
        )
    )


def _brands(part: DataFrame) -> DataFrame:
    return part.select("p_brand").distinct().withColumn("cod_marca", _brand_code(F.col("p_brand")))


def _factors(part: DataFrame, region: DataFrame, orders: DataFrame) -> DataFrame:
    code = F.col("cod_marca")
    name = F.upper("p_brand")
    factor = F.when(code % 7 != 0, F.lit(1) + (code % 4) * F.lit(0.25).cast("decimal(3,2)"))
    day = F.col("o_orderdate").cast("date")
    first, last = month_of(F.min(day)), month_of(F.max(day))
    months = orders.agg(month_starts(first, last).alias("months")).scalar()
    return (
        _brands(part)
        .join(region, code % 5 == F.col("r_regionkey"))
        .select(
            F.col("r_regionkey").alias("cod_empresa"),
            F.explode(months).alias("mes_ref"),
            "cod_marca",
            F.when(code % 3 == 0, F.substring(name, 1, 4)).otherwise(name).alias("marca"),
            factor.cast(FACTOR).alias("fator"),
        )
    )


def _priced_lines(lineitem: DataFrame, part: DataFrame, percent: int) -> DataFrame:
    cost = _money(_percent(_hundredths(F.col("p_retailprice")), percent))
    return lineitem.join(part, F.col("l_partkey") == F.col("p_partkey")).select(
        F.col("l_orderkey").alias("cod_pedido"),
        F.col("l_partkey").cast("string").alias("produto"),
        _money(_hundredths(F.col("l_quantity"))).alias("qtd"),
        cost.alias("custo"),
        "p_brand",
    )


def _retail_costs(
    lineitem: DataFrame, part: DataFrame, orders: DataFrame, client_place: DataFrame
) -> DataFrame:
    lines = _priced_lines(lineitem.filter(F.col("l_linestatus") == "F"), part, 60)
    companies = orders.join(client_place, F.col("o_custkey") == F.col("c_custkey"), "left").select(
        F.col("o_orderkey").alias("cod_pedido"),
        F.col("o_orderdate").cast("date").alias("dt_faturamento"),
        F.col("n_regionkey").cast("string").alias("cod_empresa"),
    )
    return splittable_join(lines, companies, ["cod_pedido"]).select(
        "cod_pedido",
        F.col("produto").alias("cod_produto"),
        "dt_faturamento",
        "qtd",
        F.col("custo").alias("custo_unitario"),
        _brand_code(F.col("p_brand")).alias("cod_marca"),
        "cod_empresa",
    )


def _salon_costs(lineitem: DataFrame, part: DataFrame, orders: DataFrame) -> DataFrame:
    rows = lineitem.filter((F.col("l_linestatus") == "O") & (F.col("l_returnflag") == "R"))
    brand = F.col("p_brand")
    hyphened = F.concat(F.substring(brand, 1, 2), F.lit("-"), F.expr("substring(p_brand, 3)"))
    category = F.when(_brand_code(brand) % 2 == 1, hyphened).otherwise(brand)
    order_dates = orders.select(
        F.col("o_orderkey").alias("cod_pedido"), F.col("o_orderdate").cast("date").alias("dt")
    )
    return _priced_lines(rows, part, 50).join(order_dates, "cod_pedido").select(
        "cod_pedido",
        F.col("produto").alias("codprod"),
        F.col("dt").alias("dtvenda"),
        F.col("qtd").alias("quant"),
        "custo",
        category.alias("categoria"),
    )


def _profile(
    pedidos: DataFrame, items: DataFrame, client_place: DataFrame, as_of: date
) -> DataFrame:
    names = client_place.select(
        F.col("c_custkey").alias("Cod_Cliente"),
        F.col("c_name").alias("Nome_Cliente"),
        F.col("n_name").alias("uf_empresa"),
        F.col("c_mktsegment").alias("Canal_Venda"),
    )
    return client_profile(pedidos, items, as_of).join(names, "Cod_Cliente", "left")
