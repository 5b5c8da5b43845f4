"""Values to choose from: channels, states and sellers active in a period."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import DataFrame, functions as F

from salescope.operators.filters import SalesFilter, dimension_filter, in_period
from salescope.operators.lines import order_headers
from salescope.sources.mart import SalesMart


def _headers(mart: SalesMart, flt: SalesFilter) -> DataFrame:
    orders = mart.pedidos.filter(in_period("dt_faturamento", flt.start, flt.end))
    return dimension_filter(order_headers(orders, mart.empresa_pedido), flt)


def channels_ufs(
    mart: SalesMart, start: date, end: date, seller_code: str | None = None
) -> DataFrame:
    """Distinct (channel, state) pairs; an order without company gives a NULL state."""
    headers = _headers(mart, SalesFilter(start, end, seller_code=seller_code))
    return headers.select("canal_venda", "uf_empresa_faturamento").distinct()


def channel_list(pairs: DataFrame) -> DataFrame:
    return pairs.select("canal_venda").distinct()


def uf_list(pairs: DataFrame) -> DataFrame:
    return pairs.select("uf_empresa_faturamento").distinct()


def sellers(
    mart: SalesMart,
    start: date,
    end: date,
    channels: Sequence[str] = (),
    ufs: Sequence[str] = (),
) -> DataFrame:
    """Distinct sellers by name, unnamed ones last."""
    headers = _headers(mart, SalesFilter(start, end, channels=tuple(channels), ufs=tuple(ufs)))
    return (
        headers.select(
            F.col("nome_colaborador_atual").alias("nome_colaborador"),
            F.col("cod_colaborador_atual").alias("cod_colaborador"),
        )
        .distinct()
        .orderBy(F.col("nome_colaborador").asc_nulls_last())
    )
