"""The order of the rows of those queries that state one."""

from __future__ import annotations

import os

import pytest

import __spark_entry__ as registry

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test data")

# Columns by which the rows come, "-" for descending; NULL last, as the queries state.
ORDERS = {
    "monthly_revenue": ["mes_ref"],
    "monthly_revenue_by_seller": ["mes_ref", "vendedor"],
    "monthly_series": ["mes_ref"],
    "brand_performance": ["-faturamento", "marca"],
    "brand_performance_legacy": ["-faturamento", "marca"],
    "brand_table": ["-faturamento", "marca"],
    "client_status": ["mes", "status"],
    "client_status_shares": ["mes"],
    "rfm_summary": ["-Valor_Total", "Canal_Venda"],
    "rfm_segment_clients": ["-Monetario", "Canal_Venda"],
    "rfm_eleven_segments": ["Segmento", "-Monetario", "Cod_Cliente"],
    "rfm_heatmap": ["r_score", "f_score"],
}


def compared(a, b, column: str) -> int:
    name = column.removeprefix("-")
    x, y = a[name], b[name]
    if x is None or y is None:
        return (x is None) - (y is None)
    sign = -1 if column.startswith("-") else 1
    return sign * ((x > y) - (x < y))


@pytest.mark.parametrize("name", sorted(ORDERS))
def test_rows_come_in_order(spark, name):
    got = registry.queries()[name](spark, SF_DIR).collect()
    assert len(got) > 1
    for a, b in zip(got, got[1:]):
        first = next((c for c in (compared(a, b, k) for k in ORDERS[name]) if c), 0)
        assert first <= 0, (a, b)
