"""Orders joined to their company/seller and to their items."""

from __future__ import annotations

from pyspark.sql import DataFrame

from salescope.operators.filters import SalesFilter, dimension_filter
from salescope.operators.joins import splittable_join
from salescope.sources.mart import SalesMart


def order_headers(orders: DataFrame, company: DataFrame) -> DataFrame:
    """One row per order with its company and seller (orders without one keep NULLs)."""
    return orders.join(company, "cod_pedido", "left")


def filtered_headers(
    mart: SalesMart, orders: DataFrame, flt: SalesFilter, company_columns: bool
) -> DataFrame:
    """Order headers under the filters.

    Without use for a company column the join could only repeat orders, so it is
    left out where the mart vouches for one company row per order.
    """
    needed = company_columns or flt.ufs or flt.seller_code or flt.seller_names
    if needed or not mart.one_company_per_order:
        orders = order_headers(orders, mart.empresa_pedido)
    return dimension_filter(orders, flt)


def sold_lines(headers: DataFrame, items: DataFrame) -> DataFrame:
    """Item lines of the given orders.

    The items come first: a merge join streams its left input and buffers the
    right rows of a key, which should be the one header and not a hot order's lines.
    """
    return splittable_join(items, headers, ["cod_pedido"])


def orders_without_items(headers: DataFrame, items: DataFrame) -> DataFrame:
    """Orders that have no item line; item keys are deduplicated before the shuffle."""
    keys = items.select("cod_pedido").distinct()
    return splittable_join(headers, keys, ["cod_pedido"], "left_anti")


def orders_with_items(headers: DataFrame, items: DataFrame) -> DataFrame:
    keys = items.select("cod_pedido").distinct()
    return splittable_join(headers, keys, ["cod_pedido"], "left_semi")


def of_orders(rows: DataFrame, headers: DataFrame) -> DataFrame:
    """The rows whose order is among ``headers``."""
    return splittable_join(rows, headers.select("cod_pedido"), ["cod_pedido"], "left_semi")


def lines_of(headers: DataFrame, items: DataFrame) -> DataFrame:
    """Headers LEFT items: one row per line, one for an order without lines.

    Spark can split a hot key only on the preserved side of an outer join, and
    here the large side is the other one. The outer join is therefore written
    as inner join plus the orders that match nothing.
    """
    empty = orders_without_items(headers, items)
    return sold_lines(headers, items).unionByName(empty, allowMissingColumns=True)


def order_lines(
    orders: DataFrame, items: DataFrame, company: DataFrame, flt: SalesFilter | None = None
) -> DataFrame:
    """Orders LEFT items LEFT company, with the filters that are set.

    A brand filter leaves no order without lines.
    """
    headers = order_headers(orders, company)
    if flt is None:
        return lines_of(headers, items)
    headers, items = dimension_filter(headers, flt), dimension_filter(items, flt)
    return sold_lines(headers, items) if flt.brands else lines_of(headers, items)
