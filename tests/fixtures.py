"""Small hand-made marts: rows are given in the declared column order."""

from __future__ import annotations

from datetime import date
from decimal import Decimal

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from salescope.functions.numeric import AMOUNT, FACTOR
from salescope.operators.filters import SalesFilter
from salescope.sources.mart import SalesMart
from salescope.sources.schemas import IDENTIFIER, SCHEMAS

PERIOD = SalesFilter(date(2024, 1, 1), date(2024, 3, 31))


def d(text: str) -> date:
    return date.fromisoformat(text)


def dec(x) -> Decimal | None:
    return None if x is None else Decimal(str(x))


ARROW = {
    "bigint": pa.int64(),
    "int": pa.int32(),
    "date": pa.date32(),
    "string": pa.string(),
    AMOUNT: pa.decimal128(18, 6),
    FACTOR: pa.decimal128(18, 8),
    IDENTIFIER: pa.int64(),
}


def table(spark: SparkSession, name: str, rows) -> DataFrame:
    """Arrow input becomes a local relation, which needs no Python worker."""
    columns = SCHEMAS[name]
    cells = list(zip(*rows, strict=True)) if rows else [()] * len(columns)
    arrays = [
        pa.array([dec(v) if kind.startswith("decimal") else v for v in values], ARROW[kind])
        for values, kind in zip(cells, columns.values(), strict=True)
    ]
    return spark.createDataFrame(pa.Table.from_arrays(arrays, names=list(columns)))


def mart_of(spark: SparkSession, **rows) -> SalesMart:
    return SalesMart.of(**{name: table(spark, name, rows.get(name, [])) for name in SCHEMAS})


def order(key, client=1, day="2024-01-10", cfop="VENDA", internal="N", origin="uno", channel="A"):
    return (key, client, d(day) if day else None, cfop, internal, origin, channel)


def item(key, product=1, brand="X", qty=1, gross=10, net=None):
    return (key, product, str(product), brand, qty, gross, gross if net is None else net)


def company(key, code="0", uf="SP", seller="1", name="Ana"):
    return (key, code, f"E{code}", uf, seller, name, name, "T")


def rows(df: DataFrame, *names: str) -> list[tuple]:
    return [tuple(r) for r in df.select(*(names or df.columns)).collect()]
