"""What the physical plans must and must not contain."""

from __future__ import annotations

import os
import re
from contextlib import contextmanager

import pytest
from fixtures import PERIOD, company, item, mart_of, order
from pyspark.sql import functions as F

import __spark_entry__ as registry
from salescope.operators import cost, lines
from salescope.operators.bonus import monthly_bonus
from salescope.operators.joins import splittable_join
from salescope.plans import brands, revenue, rfm, status
from salescope.sources.mart import load_mart
from salescope.sources.schemas import SCHEMAS

SF_DIR = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test data")


@contextmanager
def conf(spark, **settings):
    names = {k.replace("__", "."): v for k, v in settings.items()}
    old = {k: spark.conf.get(k, None) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def plan_of(df) -> str:
    """The physical plan with untruncated scan locations."""
    return df._jdf.queryExecution().executedPlan().toString()


def final_plan(df) -> str:
    df.collect()
    return plan_of(df)


# Rows that may meet in one task: one per brand, month or result.
ONE_TASK = {
    "brand_table", "brand_table_selected", "client_status_shares", "latest_month_kpis",
    "rfm_segment_size",
}


@needs_data
@pytest.mark.parametrize("name", sorted(registry._registry()))
def test_no_cross_join_and_no_gathering(spark, name):
    """No cross or nested-loop join; what meets in one partition is aggregated before.

    Any query may gather a keyless partial aggregate, one row per partition, as
    scalar subqueries do.
    """
    with conf(spark, spark__sql__autoBroadcastJoinThreshold="-1"):
        plan = plan_of(registry.queries()[name](spark, SF_DIR))
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    lines_of_plan = plan.splitlines()
    gathered = [i for i, line in enumerate(lines_of_plan) if "SinglePartition" in line]
    passed = r"Project|Filter|Sort \[|Exchange rangepartitioning"
    for i in gathered:
        below = next(x for x in lines_of_plan[i + 1:] if not re.search(passed, x))
        assert "Aggregate(keys=[]," in below or (name in ONE_TASK and "Aggregate(" in below)


@needs_data
def test_status_needs_one_window_and_no_calendar_join(spark):
    with conf(spark, spark__sql__autoBroadcastJoinThreshold="-1"):
        plan = plan_of(registry.queries()["client_status"](spark, SF_DIR))
    assert len(re.findall(r"\bWindow \[", plan)) == 1
    assert "Join" not in plan and plan.count("FileScan") == 1


@pytest.fixture
def stored(spark, tmp_path):
    orders = [order(i, i % 50, f"2024-0{i % 3 + 1}-10") for i in range(600)]
    m = mart_of(
        spark,
        pedidos=orders,
        item_pedidos=[item(i, i % 7, "XY"[i % 2]) for i in range(600)],
        empresa_pedido=[company(i) for i in range(600)],
    )
    for name in SCHEMAS:
        getattr(m, name).write.parquet(f"{tmp_path}/{name}")
    return str(tmp_path)


def scans(plan: str) -> list[str]:
    return [line for line in plan.splitlines() if "FileScan" in line]


def test_period_and_columns_reach_the_scan(spark, stored):
    plan = plan_of(revenue.monthly_revenue(load_mart(spark, stored), PERIOD))
    sales = [s for s in scans(plan) if "/pedidos]" in s]
    assert sales
    for scan in sales:
        assert re.search(r"GreaterThanOrEqual\(dt_faturamento,2024-01-01\)", scan)
        assert "canal_venda" not in scan.split("ReadSchema")[1]
    for name, column in (("varejo_cmv", "dt_faturamento"), ("pedidos_salao", "dtvenda"),
                         ("bonificacao", "mes_ref")):
        found = [s for s in scans(plan) if f"/{name}]" in s]
        assert found and any(f"GreaterThanOrEqual({column},2024-01-01)" in s for s in found)


def test_unused_company_join_is_skipped_when_vouched_for(spark, stored):
    def companies(vouched):
        m = load_mart(spark, stored, one_company_per_order=vouched)
        return len([s for s in scans(plan_of(status.client_status(m, PERIOD, registry.CALENDAR)))
                    if "/empresa_pedido]" in s])

    assert companies(True) == 0
    m = load_mart(spark, stored, one_company_per_order=True)
    by_uf = status.client_status(m, PERIOD.but(ufs=("SP",)), registry.CALENDAR)
    assert "/empresa_pedido]" in plan_of(by_uf)


SKEW = {
    "spark__sql__autoBroadcastJoinThreshold": "-1",
    "spark__sql__adaptive__autoBroadcastJoinThreshold": "-1",
    "spark__sql__adaptive__skewJoin__skewedPartitionThresholdInBytes": "20k",
    "spark__sql__adaptive__skewJoin__skewedPartitionFactor": "2",
    "spark__sql__adaptive__advisoryPartitionSizeInBytes": "20k",
}


def hot_items(spark, n=60_000, hot=3):
    """A third of all lines belong to one order."""
    key = F.when(F.col("id") % 3 == 0, F.lit(hot)).otherwise(F.col("id") % 20_000)
    return spark.range(0, n, 1, 8).select(
        key.alias("cod_pedido"),
        F.col("id").alias("cod_produto"),
        F.col("id").cast("string").alias("sku"),
        F.lit("X").alias("marca"),
        F.lit(1).cast("decimal(18,2)").alias("qtd"),
        F.lit(2).cast("decimal(18,2)").alias("preco_total"),
        F.lit(2).cast("decimal(18,2)").alias("preco_desconto_rateado"),
    )


def hot_headers(spark):
    orders = spark.range(20_000).select(F.col("id").alias("cod_pedido"), F.lit(1).alias("client"))
    company_rows = spark.range(20_000).select(F.col("id").alias("cod_pedido"), F.lit("SP").alias("uf"))
    return lines.order_headers(orders, company_rows)


def test_hot_order_is_split(spark):
    with conf(spark, **SKEW):
        joined = lines.sold_lines(hot_headers(spark), hot_items(spark))
        assert joined.filter("cod_pedido = 3").count() == 20_000 + 2
        out = joined.groupBy("cod_produto").agg(F.sum("qtd").alias("q"))
        plan = final_plan(out)
        assert out.count() == 60_000
    assert "skew=true" in plan


def test_plain_join_on_a_reused_partitioning_would_not_be_split(spark):
    """The reason for splittable_join."""
    with conf(spark, **SKEW):
        joined = hot_headers(spark).join(hot_items(spark), "cod_pedido")
        plan = final_plan(joined.groupBy("cod_produto").agg(F.sum("qtd")))
    assert "skew=true" not in plan


def test_hot_order_and_product_is_split_in_the_cost_join(spark):
    same = hot_items(spark).withColumns(
        {"sku": F.when(F.col("cod_pedido") == 3, "7").otherwise(F.col("sku")),
         "mes_ref": F.lit("2024-01-01").cast("date")})
    costs = (
        spark.range(20_000)
        .select(F.col("id").alias("cod_pedido"), F.lit("7").alias("cod_produto"),
                F.lit("2024-01-01").cast("date").alias("mes_ref"))
        .groupBy("cod_pedido", "cod_produto", "mes_ref")
        .agg(F.sum(F.lit(5).cast("decimal(18,2)")).alias("custo_medio"))
    )
    with conf(spark, **SKEW):
        out = cost.with_unit_cost(same, costs).groupBy("marca", "cod_produto").agg(
            F.sum(F.col("custo_medio") * F.col("qtd")).alias("c"))
        plan = final_plan(out)
        total = out.agg(F.sum("c")).first()[0]
    assert "skew=true" in plan
    # order 3 with product 7: 20_002 lines; order 7 with product 7: one
    assert total == 5 * 20_003


def test_order_without_items_survives_the_split(spark):
    with conf(spark, **SKEW):
        items = hot_items(spark).filter("cod_pedido <> 11")
        whole = lines.lines_of(hot_headers(spark), items)
        assert whole.filter("cod_produto IS NULL").select("cod_pedido").collect()[0][0] == 11
        assert whole.count() == items.count() + 1


def test_splittable_join_keeps_columns_and_nulls_apart(spark):
    a = spark.createDataFrame([(1, "a"), (None, "b")], "k int, x string")
    b = spark.createDataFrame([(1, "c"), (None, "d")], "k int, y string")
    got = splittable_join(a, b, ["k"], "left")
    assert got.columns == ["k", "x", "y"]
    assert sorted(map(tuple, got.collect()), key=str) == [(1, "a", "c"), (None, "b", None)]


def jobs(spark) -> int:
    return spark.sparkContext._jsc.sc().dagScheduler().numTotalJobs()


@needs_data
def test_ntile_is_lazy_and_gathers_nothing(spark):
    folder = spark.conf.get("spark.checkpoint.dir")
    files = sorted(os.listdir(folder))
    m = registry.mart_from_star(spark, SF_DIR)
    before = jobs(spark)
    scores = rfm.rfm_scores(m, registry.PERIOD)
    assert jobs(spark) == before
    scores.collect()
    assert jobs(spark) > before and sorted(os.listdir(folder)) == files
    windows = re.findall(r"Window \[.*", plan_of(scores))
    assert windows and all("[_ntile_range" in w for w in windows)


def below(plan: str, operator: str) -> list[str]:
    """The text of the subtree under each line that names ``operator``."""
    lines_of_plan = plan.splitlines()
    depth = [len(re.match(r"[\s:|+\-*]*", line).group()) for line in lines_of_plan]
    found = []
    for i, line in enumerate(lines_of_plan):
        if re.search(rf"\b{operator}\b", line):
            end = next((j for j in range(i + 1, len(lines_of_plan)) if depth[j] <= depth[i]), len(lines_of_plan))
            found.append("\n".join(lines_of_plan[i:end]))
    return found


def test_brands_are_counted_without_copying_lines(spark, stored):
    m = load_mart(spark, stored)
    for query in (brands.brand_performance, brands.brand_performance_legacy):
        copied = below(plan_of(query(m, PERIOD)), "Expand")
        assert copied
        for part in copied:
            assert "preco_" not in part and "qtd" not in part and "cod_produto" not in part


def test_bonus_reads_the_items_once(spark, stored):
    m = load_mart(spark, stored)
    for kw in ({}, {"by_seller": True}, {"match_brand": True}, {"any_text": True}):
        plan = plan_of(monthly_bonus(m, **kw))
        assert len([s for s in scans(plan) if "/item_pedidos]" in s]) == 1


def test_latest_month_reaches_orders_and_costs(spark, stored):
    plan = plan_of(revenue.latest_month_kpis(load_mart(spark, stored), PERIOD))
    for name, column in (("pedidos", "dt_faturamento"), ("varejo_cmv", "dt_faturamento"),
                         ("pedidos_salao", "dtvenda"), ("bonificacao", "mes_ref")):
        of_table = [s for s in scans(plan) if f"/{name}]" in s]
        limited = [s for s in of_table if re.search(rf"{column}#\d+ >= \w*[sS]ubquery", s)]
        assert limited, of_table


def test_brand_total_needs_no_window(spark, stored):
    m = load_mart(spark, stored)
    plan = plan_of(brands.brand_table(brands.brand_performance(m, PERIOD)))
    assert "Window" not in plan and "ubquery" in plan
