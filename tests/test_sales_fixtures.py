"""Edge rows of bonus, cost, revenue, brand and catalogue queries."""

from __future__ import annotations

import pytest
from fixtures import PERIOD, company, d, dec, item, mart_of, order, rows, table

from pyspark.sql import functions as F

from salescope.operators import cost
from salescope.operators.bonus import bonus_lines, bonus_value, monthly_bonus
from salescope.operators.filters import SalesFilter, sales_filter
from salescope.operators.lines import order_lines
from salescope.plans import brands, catalog, revenue
from salescope.sources.mart import SalesMart, SchemaError, check_values, conform, load_mart, mart_from_catalog
from salescope.sources.schemas import SCHEMAS

JAN = d("2024-01-01")


def factor(company_code=0, month=JAN, brand_code=1, name="X", value=None):
    return (company_code, month, brand_code, name, value)


def bonus(spark, factors, items=None, companies=None, orders=None, **kw):
    m = mart_of(
        spark,
        pedidos=orders or [order(1, cfop="Bonificado")],
        item_pedidos=[item(1, gross=100)] if items is None else items,
        empresa_pedido=companies or [company(1)],
        bonificacao=factors,
        varejo_marca=[(1, " x "), (2, "Y")],
    )
    got = rows(monthly_bonus(m, **kw))
    assert sorted(got, key=repr) == sorted(rows(bonus_value(bonus_lines(m), m.bonificacao, m.varejo_marca, **kw)), key=repr)
    return got


def test_bonus_line_counts_once_per_factor_row(spark):
    both = [factor(value=2), factor(brand_code=2, value=4)]
    assert bonus(spark, both) == [(JAN, dec("75.00"))]
    assert bonus(spark, both, match_brand=True) == [(JAN, dec("50.00"))]


def test_bonus_equal_factors_count_each(spark):
    assert bonus(spark, [factor(value=2), factor(brand_code=2, value=2)]) == [(JAN, dec("100.00"))]


def test_bonus_without_factor_keeps_the_value(spark):
    assert bonus(spark, [factor(value=None)]) == [(JAN, dec("100.00"))]
    assert bonus(spark, [factor(company_code=7, value=2)]) == [(JAN, dec("100.00"))]


def test_bonus_zero_factor_gives_null(spark):
    assert bonus(spark, [factor(value=0)]) == [(JAN, None)]


def test_bonus_rounds_the_sum_not_the_lines(spark):
    items = [item(1, gross=10), item(1, product=2, gross=10)]
    assert bonus(spark, [factor(value=3)], items) == [(JAN, dec("6.67"))]


def test_bonus_order_without_items_gives_a_null_month(spark):
    assert bonus(spark, [], items=[]) == [(JAN, None)]


def test_bonus_by_seller(spark):
    got = bonus(
        spark,
        [factor(value=2)],
        [item(1, gross=100), item(2, gross=10)],
        [company(1), company(2, seller="2", name="Bia")],
        [order(1, cfop="BONIFICADO"), order(2, cfop="BONIFICADO")],
        by_seller=True,
    )
    assert sorted(got) == [(JAN, "Ana", "1", dec("50.00")), (JAN, "Bia", "2", dec("5.00"))]


def test_bonus_text_rule_of_the_older_version(spark):
    m = mart_of(
        spark,
        pedidos=[order(1, cfop="Remessa em bonificacao"), order(2, cfop="BONIFICADO")],
        item_pedidos=[item(1, gross=5), item(2, gross=7)],
        empresa_pedido=[company(1), company(2)],
    )
    def total(**kw):
        return rows(bonus_value(bonus_lines(m, **kw), m.bonificacao, m.varejo_marca))

    assert total() == [(JAN, dec("7.00"))]
    assert total(any_text=True) == [(JAN, dec("12.00"))]


RETAIL = [(1, "1", d("2024-01-10"), 2, 3, 1, "0")]


def unit_costs(spark, retail=(), salon=(), factors=(), names=((1, " x "), (2, "Y")), **kw):
    t = {
        n: table(spark, n, r)
        for n, r in [
            ("varejo_cmv", retail),
            ("pedidos_salao", salon),
            ("bonificacao", factors),
            ("varejo_marca", names),
        ]
    }
    by_brand = t["varejo_marca"] if kw.pop("by_brand", False) else None
    df = cost.cmv_unit_cost(t["varejo_cmv"], t["pedidos_salao"], t["bonificacao"], by_brand, **kw)
    return sorted(rows(df), key=str)


def test_costs_of_both_sources_add_up(spark):
    salon = [(1, "1", d("2024-01-20"), 1, 4, "Z")]
    got = unit_costs(spark, RETAIL, salon, [factor(brand_code=9, name="Z", value=2)])
    assert got == [(1, "1", JAN, dec("5.00"))]


def test_per_factor_averages_add_up(spark):
    # 3/2 and 3/4 rounded on their own, then added
    got = unit_costs(spark, RETAIL, factors=[factor(value=2), factor(value=4)])
    assert got == [(1, "1", JAN, dec("2.25"))]
    # equal factors form one group, whose average the repetition leaves alone
    assert unit_costs(spark, RETAIL, factors=[factor(value=2), factor(value=2)]) == [
        (1, "1", JAN, dec("1.50"))
    ]


def test_factor_rows_weigh_the_average_by_their_number(spark):
    # Brand 1 meets two rows with factor 2, brand 2 one: (2*2*3/2 + 2*9/2) / (2*2 + 2) = 2.5
    retail = [*RETAIL, (1, "1", d("2024-01-11"), 2, 9, 2, "0")]
    factors = [factor(value=2), factor(value=2), factor(brand_code=2, value=2)]
    assert unit_costs(spark, retail, factors=factors) == [(1, "1", JAN, dec("2.50"))]


def test_products_of_six_decimals_are_exact(spark):
    exact = [(1, "1", d("2024-01-10"), "1.000001", "1.000001", 1, "0")]
    factors = table(spark, "bonificacao", [factor(value=1), factor(value=1)])
    keys = ["cod_pedido", "cod_produto"]
    cmv = table(spark, "varejo_cmv", exact).withColumn("fator", F.lit(1).cast("decimal(18,8)")).withColumn("n", F.lit(2))
    products = cmv.select(cost.weighted_product("qtd", "custo_unitario").alias("p"))
    assert rows(products) == [(dec("2.000004000002"),)]
    assert products.schema["p"].dataType.scale == 12
    # A half cent that only the twelfth decimal lifts or misses: 0.005 and a little less.
    for price, want in (("0.005000", "0.01"), ("0.004999", "0.00")):
        row = [(1, "1", d("2024-01-10"), "0.000001", price, 1, "0")]
        got = cost.cmv_retail(table(spark, "varejo_cmv", row), factors)
        assert rows(got, "custo_medio") == [(dec(want),)]
        assert rows(cost.cmv_legacy(table(spark, "varejo_cmv", row)), "custo_medio") == [(dec(want),)]
    assert keys == got.columns[:2]


def test_cost_without_quantity_is_null(spark):
    assert unit_costs(spark, [(1, "1", d("2024-01-10"), 0, 3, 1, "0")]) == [(1, "1", JAN, None)]


def salon_of(category, *names):
    return {
        "salon": [(1, "1", d("2024-01-20"), 1, 6, category)],
        "factors": [factor(name=n, value=2) for n in names],
    }


@pytest.mark.parametrize(
    ("category", "name", "match"),
    [
        ("ab-cde", "ABCD", True),
        (" Abc ", "aBC", True),
        ("ab-cde", "ABC", False),
        ("abcd", "abcd", True),
        ("abcdef", "ABCDEF", True),
    ],
)
def test_salon_category_match(spark, category, name, match):
    want = [(1, "1", JAN, dec("3.00"))] if match else []
    assert unit_costs(spark, **salon_of(category, name)) == want


def test_salon_name_and_prefix_match_count_once(spark):
    # ABCD meets by name and by prefix, but is one factor row; ABCDEF meets only by name.
    salon = [(1, "1", d("2024-01-20"), 1, 6, "abcd"), (1, "1", d("2024-01-21"), 1, 10, "abcdef")]
    factors = [factor(name="ABCD", value=2), factor(name="ABCDEF", value=2)]
    # abcd meets ABCD (1 row); abcdef meets ABCDEF by name and ABCD by prefix (2 rows)
    want = (6 / 2 + 2 * 10 / 2) / 3
    assert unit_costs(spark, salon=salon, factors=factors) == [(1, "1", JAN, dec(round(want, 2)))]


def test_salon_without_factor_is_absent(spark):
    assert unit_costs(spark, salon=[(1, "1", d("2024-01-20"), 1, 6, "abc")]) == []
    assert unit_costs(
        spark, salon=[(1, "1", d("2024-01-20"), 1, 6, "abc")], factors=[factor(name="ABC")]
    ) == []


def test_costs_by_brand(spark):
    retail = [*RETAIL, (1, "1", d("2024-01-11"), 1, 5, 2, "0")]
    got = unit_costs(spark, retail, by_brand=True)
    assert got == [(1, "1", " X ", JAN, dec("3.00")), (1, "1", "Y", JAN, dec("5.00"))]


def test_costs_restricted_to_months(spark):
    retail = [*RETAIL, (1, "1", d("2024-02-01"), 1, 5, 1, "0")]
    assert unit_costs(spark, retail, months=(JAN, JAN)) == [(1, "1", JAN, dec("3.00"))]


def sales(spark, **extra):
    base = dict(
        pedidos=[order(1), order(2, client=2, day="2024-02-05")],
        item_pedidos=[item(1, 1, "X", 2, 50, 40), item(1, 2, "Y", 1, 10, 10), item(2, 1, "X", 1, 25)],
        empresa_pedido=[company(1), company(2, seller="2", name="Bia", uf="RJ")],
    )
    return mart_of(spark, **{**base, **extra})


def test_monthly_revenue_figures(spark):
    m = sales(spark, varejo_cmv=[(1, "1", d("2024-01-10"), 2, 10, 1, "0")])
    got = [r.asDict() for r in revenue.monthly_revenue(m, PERIOD).collect()]
    assert [r["mes_ref"] for r in got] == [JAN, d("2024-02-01")]
    jan = got[0]
    assert (jan["faturamento_bruto"], jan["faturamento_liquido"], jan["desconto"]) == (60, 50, 10)
    assert (jan["custo_total"], jan["markup_percentual"]) == (20, 150)
    assert (jan["positivacao"], jan["qtd_pedido"], jan["qtd_sku"], jan["qtd_marcas"]) == (1, 1, 2, 2)
    assert (jan["Ticket_Medio_Positivacao"], jan["qtd_itens"]) == (50, 3)
    assert (got[1]["custo_total"], got[1]["markup_percentual"]) == (0, 0)


def test_order_without_items_counts_and_has_no_money(spark):
    m = sales(spark, item_pedidos=[item(2)])
    jan = revenue.monthly_revenue(m, PERIOD).first().asDict()
    assert (jan["qtd_pedido"], jan["positivacao"], jan["qtd_sku"]) == (1, 1, 0)
    assert jan["faturamento_liquido"] is None and jan["markup_percentual"] == 0
    by_brand = dict(rows(brands.brand_performance(m, PERIOD), "marca", "qtd_pedido"))
    assert by_brand == {"X": 1, None: 1}


def test_brand_filter_leaves_only_orders_with_the_brand(spark):
    got = rows(
        revenue.monthly_revenue(sales(spark), PERIOD.but(brands=("Y",))),
        "mes_ref", "qtd_pedido", "faturamento_liquido",
    )
    assert got == [(JAN, 1, 10.0)]


def test_repeated_company_rows_repeat_the_lines(spark):
    twice = [company(1), company(1, name="Ana B."), company(2)]
    m = sales(spark, empresa_pedido=twice)
    got = revenue.monthly_revenue(m, PERIOD).first()
    assert (got["faturamento_liquido"], got["qtd_pedido"]) == (100, 1)

    def of_x(mart):
        x = brands.brand_performance(mart, PERIOD).filter("marca = 'X'").first()
        return x["faturamento"], x["qtd_pedido"]

    assert of_x(m) == (2 * 40 + 25, 2)
    assert of_x(SalesMart(m._sources, one_company_per_order=True)) == (40 + 25, 2)


def test_revenue_by_seller_keeps_unnamed_sellers(spark):
    m = sales(spark, empresa_pedido=[company(1, name=None), company(2, name="Ana")])
    got = rows(
        revenue.monthly_revenue(m, PERIOD.but(seller_code="1")),
        "vendedor", "cod_colaborador", "faturamento_liquido", "qtd_pedido",
    )
    assert got == [(None, "1", 50.0, 1), ("Ana", "1", 25.0, 1)]


def test_bonus_meets_revenue_by_code_whatever_the_name(spark):
    m = sales(
        spark,
        pedidos=[order(1), order(2, cfop="BONIFICADO"), order(3, cfop="BONIFICADO")],
        item_pedidos=[item(1, gross=50), item(2, gross=8), item(3, gross=6)],
        empresa_pedido=[company(1), company(2, name="Ana B."), company(3, name=None)],
        bonificacao=[factor(value=2), factor(brand_code=2)],
    )
    got = rows(
        revenue.monthly_revenue(m, PERIOD.but(seller_code="1")),
        "vendedor", "faturamento_bruto", "valor_bonificacao",
    )
    # 8/2 + 8 and 6/2 + 6: one revenue row for each bonus row of the code
    assert sorted(got) == [("Ana", 50.0, 9.0), ("Ana", 50.0, 12.0)]
    assert rows(revenue.monthly_revenue(m, PERIOD), "valor_bonificacao") == [(21.0,)]


def test_bonus_order_without_items_repeats_the_revenue_of_its_code(spark):
    m = sales(
        spark,
        pedidos=[
            order(1), order(2), order(3, cfop="BONIFICADO"), order(4, cfop="BONIFICADO")
        ],
        item_pedidos=[item(1, gross=50), item(2, gross=20), item(3, gross=7)],
        empresa_pedido=[company(1), company(2, name="Bia"), company(3), company(4, name="Bia")],
        bonificacao=[],
    )
    got = rows(
        revenue.monthly_revenue(m, PERIOD.but(seller_code="1")),
        "vendedor", "faturamento_bruto", "valor_bonificacao",
    )
    assert sorted(got) == [
        ("Ana", 50.0, 0.0), ("Ana", 50.0, 7.0), ("Bia", 20.0, 0.0), ("Bia", 20.0, 7.0)
    ]


def test_amounts_keep_their_decimals_until_the_sum(spark):
    lines = [item(1, product=p, gross="0.004") for p in range(10)]
    m = sales(spark, pedidos=[order(1)], item_pedidos=lines, empresa_pedido=[company(1)])
    assert rows(revenue.monthly_revenue(m, PERIOD), "faturamento_bruto") == [(0.04,)]


def test_factor_keeps_its_decimals(spark):
    got = bonus(spark, [factor(value="1.23456789")], items=[item(1, gross=1000000)])
    assert got == [(JAN, dec("810000.01"))]


def test_decimals_beyond_the_declared_ones_are_refused(spark):
    df = spark.sql(
        "select 1 as cod_empresa, date'2024-01-01' as mes_ref, 1 as cod_marca, 'X' as marca, "
        "cast(1.2 as decimal(20,9)) as fator"
    )
    with pytest.raises(SchemaError, match="fator"):
        conform(df, "bonificacao")


def test_text_codes_with_leading_zeros_are_different_clients(spark):
    m = sales(spark, pedidos=[order(1), order(2)], empresa_pedido=[company(1), company(2)])
    orders = m.pedidos.withColumn(
        "cpfcnpj", F.when(F.col("cod_pedido") == 1, "00012345678901").otherwise("12.345.678/901")
    )
    m = SalesMart({**m._sources, "pedidos": lambda: orders})
    assert rows(revenue.monthly_revenue(m, PERIOD), "positivacao")[0] == (2,)


def test_bonus_without_any_sale_gives_no_revenue_row(spark):
    m = sales(spark, pedidos=[order(1, cfop="BONIFICADO")])
    assert rows(revenue.monthly_revenue(m, PERIOD)) == []


def test_bonus_counts_for_whole_months(spark):
    m = sales(
        spark,
        pedidos=[order(1), order(2, cfop="BONIFICADO", day="2024-01-31", origin=None)],
        item_pedidos=[item(1, gross=50), item(2, gross=8)],
        empresa_pedido=[],
    )
    flt = SalesFilter(d("2024-01-05"), d("2024-01-20"))
    assert rows(revenue.monthly_revenue(m, flt), "faturamento_bruto", "valor_bonificacao") == [
        (50.0, 8.0)
    ]


def test_code_and_names_both_apply_to_revenue(spark):
    flt = PERIOD.but(seller_code="1", seller_names=("Bia",))
    assert rows(revenue.monthly_revenue(sales(spark), flt)) == []


def test_two_cost_brands_double_the_line_in_the_brand_query_only(spark):
    retail = [(1, "1", d("2024-01-10"), 1, 3, 1, "0"), (1, "1", d("2024-01-10"), 1, 5, 2, "0")]
    m = sales(spark, varejo_cmv=retail, varejo_marca=[(1, "X"), (2, "Y")])
    x = brands.brand_performance(m, PERIOD).filter("marca = 'X'").first()
    assert (x["faturamento"], x["qtd_itens"], x["qtd_pedido"]) == (2 * 40 + 25, 2 * 2 + 1, 2)
    # cost of the doubled line: 3 * 2 + 5 * 2
    assert x["markup_percentual"] == (105 - 16) / 16 * 100
    jan = revenue.monthly_revenue(m, PERIOD).first()
    assert jan["faturamento_liquido"] == 50 and jan["custo_total"] == 4 * 2


def test_sales_filter_case_and_bounds(spark):
    orders = table(spark, "pedidos", [
        order(1, cfop="venda"),
        order(2, cfop="Venda de mercadoria sujeita ao regime de substituição tributária"),
        order(3, day="2024-01-01"),
        order(4, day="2024-03-31"),
        order(5, day="2024-04-01"),
        order(6, internal="S"),
        order(7, origin="anymarket"),
        order(8, day=None),
    ])
    assert sorted(rows(sales_filter(orders, PERIOD.start, PERIOD.end), "cod_pedido")) == [
        (2,), (3,), (4,)
    ]
    loose = sales_filter(orders, PERIOD.start, PERIOD.end, check_origin=False)
    assert sorted(rows(loose, "cod_pedido")) == [(2,), (3,), (4,), (7,)]


def test_order_lines_is_a_left_join(spark):
    m = sales(spark, item_pedidos=[item(1), item(1, 2), item(9)], empresa_pedido=[company(1)])
    got = rows(
        order_lines(m.pedidos, m.item_pedidos, m.empresa_pedido),
        "cod_pedido", "cod_produto", "cod_colaborador_atual",
    )
    assert sorted(got, key=str) == [(1, 1, "1"), (1, 2, "1"), (2, None, None)]


def test_catalogue(spark):
    m = sales(spark, empresa_pedido=[company(1, name=None), company(3)],
              pedidos=[order(1), order(2, channel="B"), order(3, cfop="any", day="2024-03-31")])
    pairs = catalog.channels_ufs(m, PERIOD.start, PERIOD.end)
    assert sorted(rows(pairs), key=str) == [("A", "SP"), ("B", None)]
    assert rows(catalog.channels_ufs(m, PERIOD.start, PERIOD.end, "1")) == [("A", "SP")]
    assert sorted(rows(catalog.channel_list(pairs))) == [("A",), ("B",)]
    assert rows(catalog.uf_list(pairs).filter("uf_empresa_faturamento IS NULL")) == [(None,)]
    # unnamed sellers come last; order 2 has none at all
    got = rows(catalog.sellers(m, PERIOD.start, PERIOD.end))
    assert got[0] == ("Ana", "1") and {r[0] for r in got[1:]} == {None} and len(got) == 3


REVENUE = "mes_ref date, " + ", ".join(
    f"{c} {'bigint' if c in ('positivacao', 'qtd_pedido', 'qtd_sku', 'qtd_marcas') else 'double'}"
    for c in revenue.MEASURES
)


def revenue_row(month, **values):
    return (d(month), *[values.get(c, 0 if c in ("positivacao", "qtd_pedido", "qtd_sku",
                                                 "qtd_marcas") else 0.0) for c in revenue.MEASURES])


def test_dense_series_drops_a_month_entered_late(spark):
    df = spark.createDataFrame(
        [revenue_row("2024-01-01", faturamento_liquido=9.0),
         revenue_row("2024-02-01", faturamento_liquido=5.0, positivacao=3)], REVENUE)
    got = rows(revenue.monthly_series(df, d("2024-01-15"), d("2024-03-31")))
    assert got == [(d("2024-02-01"), 5.0, 3), (d("2024-03-01"), 0.0, 0)]
    assert rows(revenue.monthly_series(df, d("2024-01-15"), d("2024-01-31"))) == []


def test_kpis_of_the_latest_month(spark):
    df = spark.createDataFrame(
        [revenue_row("2024-01-01", faturamento_bruto=99.0),
         revenue_row("2024-02-01", faturamento_bruto=80.0, desconto=20.0, faturamento_liquido=60.0,
                     valor_bonificacao=6.0, markup_percentual=50.0),
         revenue_row("2024-02-01", faturamento_bruto=20.0, markup_percentual=10.0)], REVENUE)
    (got,) = [r.asDict() for r in revenue.month_kpis(df).collect()]
    assert got["mes_ref"] == d("2024-02-01") and got["faturamento_bruto"] == 100
    assert (got["desconto_percentual"], got["bonificacao_percentual"]) == (20, 10)
    assert got["markup_value"] == pytest.approx(1.6)


@pytest.mark.parametrize("flt", [
    PERIOD, PERIOD.but(brands=("X",)), PERIOD.but(ufs=("RJ",)), PERIOD.but(seller_code="1"),
    PERIOD.but(channels=("none",)), SalesFilter(d("2024-01-05"), d("2024-02-15")),
])
def test_latest_month_equals_the_latest_of_all_months(spark, flt):
    m = mart_of(
        spark,
        pedidos=[order(1, 1, "2024-01-10"), order(2, 2, "2024-02-11"), order(3, 1, "2024-02-20"),
                 order(4, 3, "2024-03-05"), order(5, 4, "2024-03-06", cfop="BONIFICADO"),
                 order(6, 5, "2024-02-12", cfop="BONIFICADO")],
        item_pedidos=[item(1, 1, "X", 2, 10, 8), item(2, 2, "X", 1, 20), item(3, 1, "Y", 1, 5),
                      item(4, 3, "Y", 3, 7), item(5, 1, "X", 1, 4), item(6, 2, "X", 1, 6)],
        empresa_pedido=[company(i, uf="RJ" if i < 3 else "SP", seller=str(i % 2)) for i in range(1, 7)],
        varejo_cmv=[(2, "2", d("2024-02-11"), 1, 3, 1, "0"), (4, "3", d("2024-03-05"), 3, 2, 1, "0"),
                    (1, "1", d("2024-01-10"), 2, 4, 1, "0")],
        pedidos_salao=[(3, "1", d("2024-02-20"), 1, 2, "X")],
        bonificacao=[factor(value=2), factor(month=d("2024-02-01"), value=4), factor(month=d("2024-03-01"), value=2)],
    )
    want = rows(revenue.month_kpis(revenue.monthly_revenue(m, flt)))
    assert rows(revenue.latest_month_kpis(m, flt)) == want
    assert bool(want) == (flt.channels == ())


def test_kpi_guards(spark):
    df = spark.createDataFrame([revenue_row("2024-02-01", desconto=5.0)], REVENUE)
    got = revenue.month_kpis(df).first()
    assert (got["desconto_percentual"], got["bonificacao_percentual"]) == (0, 0)
    assert revenue.month_kpis(df.limit(0)).count() == 0


def test_brand_share_is_of_the_selection(spark):
    df = spark.createDataFrame(
        [("A", 60.0, 1, 1, 1, 1.0, 50.0), ("B", 30.0, 1, 1, 1, 1.0, 0.0), ("C", 10.0, 1, 1, 1, 1.0, 0.0)],
        "marca string, faturamento double, clientes_unicos bigint, qtd_pedido bigint, "
        "qtd_sku bigint, Ticket_Medio_Positivacao double, markup_percentual double")
    got = rows(brands.brand_table(df, ["A", "B"]), "marca", "share", "markup")
    assert got == [("A", pytest.approx(2 / 3), 1.5), ("B", pytest.approx(1 / 3), 1.0)]
    assert sum(r[1] for r in rows(brands.brand_table(df), "marca", "share")) == pytest.approx(1)


def test_schema_is_checked(spark):
    with pytest.raises(SchemaError, match="varejo_marca: columns missing: desc_abrev"):
        conform(spark.createDataFrame([(1,)], "cod_marca int"), "varejo_marca")
    with pytest.raises(SchemaError, match="mart tables missing"):
        SalesMart.of(varejo_marca=table(spark, "varejo_marca", []))
    mixed = conform(spark.createDataFrame([(1, "a", 2)], "COD_MARCA int, Desc_Abrev string, z int"),
                    "varejo_marca")
    assert mixed.columns == ["cod_marca", "desc_abrev"]


ITEM = "cod_pedido {0}, cod_produto int, sku string, marca string, qtd {1}, preco_total {1}, preco_desconto_rateado {1}"


def stored_items(spark, tmp_path, fmt, value, whole="1"):
    """One item row as text (csv) or as doubles (parquet), loaded as a mart's items."""
    text = spark.createDataFrame([(whole, 1, "1", "X", "2", value, "3")], ITEM.format("string", "string"))
    path = f"{tmp_path}/item_pedidos"
    if fmt == "csv":
        text.write.option("header", True).csv(path)
    else:
        kinds = {c: F.col(c).cast("double") for c in ("cod_pedido", "qtd", "preco_total", "preco_desconto_rateado")}
        text.withColumns(kinds).write.parquet(path)
    return load_mart(spark, str(tmp_path), fmt)


@pytest.mark.parametrize("fmt", ["parquet", "csv"])
@pytest.mark.parametrize("value", ["0.0000004", "0.1234564", "1e-9", "1234567890123.5", "NaN"])
def test_values_are_not_rounded_in_silence(spark, tmp_path, fmt, value):
    stored = stored_items(spark, tmp_path, fmt, value)
    with pytest.raises(SchemaError, match="preco_total \\(1 values"):
        check_values(stored._sources["item_pedidos"](), "item_pedidos")
    with pytest.raises(Exception, match="SchemaError: item_pedidos.preco_total"):
        stored.item_pedidos.collect()
    assert rows(stored.item_pedidos, "qtd") == [(dec(2),)]  # only queries that read the column fail


@pytest.mark.parametrize("fmt", ["parquet", "csv"])
@pytest.mark.parametrize("value", ["0.1", "0.123456", "-7", "1234567.25", "1e3", "0.12345600", "123456789012.5"])
def test_values_that_fit_are_kept(spark, tmp_path, fmt, value):
    stored = stored_items(spark, tmp_path, fmt, value)
    check_values(stored._sources["item_pedidos"](), "item_pedidos")
    assert rows(stored.item_pedidos, "cod_pedido", "preco_total") == [(1, dec(value))]


@pytest.mark.parametrize("fmt", ["parquet", "csv"])
def test_keys_are_not_cut_in_silence(spark, tmp_path, fmt):
    stored = stored_items(spark, tmp_path, fmt, "1", whole="1.5")
    with pytest.raises(Exception, match="SchemaError: item_pedidos.cod_pedido"):
        stored.item_pedidos.collect()


def test_nulls_and_bad_dates_of_text_tables(spark):
    text = spark.createDataFrame(
        [("1", None, None, "", "1", "X"), ("1", "2024-02-30", "0", "", "1", "X")],
        "cod_pedido string, dtvenda string, quant string, codprod string, custo string, categoria string",
    )
    got = conform(text, "pedidos_salao")
    assert rows(got.filter("quant is null"), "dtvenda", "custo") == [(None, dec(1))]
    with pytest.raises(Exception, match="SchemaError: pedidos_salao.dtvenda"):
        got.collect()


@pytest.mark.parametrize("fmt", ["parquet", "csv", "orc"])
def test_stored_mart_gives_the_same_revenue(spark, tmp_path, fmt):
    m = sales(spark, varejo_cmv=RETAIL)
    for name in SCHEMAS:
        writer = getattr(m, name).coalesce(1).write.option("header", True)
        writer.format(fmt).save(f"{tmp_path}/{name}")
    stored = load_mart(spark, str(tmp_path), fmt)
    assert rows(revenue.monthly_revenue(stored, PERIOD)) == rows(revenue.monthly_revenue(m, PERIOD))


def test_mart_from_views(spark):
    m = sales(spark)
    for name in SCHEMAS:
        getattr(m, name).createOrReplaceTempView(f"v_{name}")
    views = mart_from_catalog(spark, {n: f"v_{n}" for n in SCHEMAS}).check()
    flt = SalesFilter(d("2024-01-01"), d("2024-01-31"))
    assert rows(revenue.monthly_revenue(views, flt)) == rows(revenue.monthly_revenue(m, flt))
