"""The sales mart: nine DataFrames with checked schemas."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import DecimalType, DoubleType, FloatType, StringType, StructField

from salescope.sources.schemas import IDENTIFIER, SCHEMAS


class SchemaError(ValueError):
    """A mart table or a declared column is missing, or a column holds values that its declared type does not."""


class SalesMart:
    """The nine tables by name, as attributes.

    A table is opened, checked and cast when it is first used, so a query pays
    only for the tables it reads. ``check()`` opens all of them at once.

    ``one_company_per_order`` vouches that ``empresa_pedido`` has at most one row
    per order. Queries that read none of its columns then skip that join.
    """

    pedidos: DataFrame
    item_pedidos: DataFrame
    empresa_pedido: DataFrame
    bonificacao: DataFrame
    varejo_marca: DataFrame
    varejo_cmv: DataFrame
    pedidos_salao: DataFrame
    perfil_cliente: DataFrame
    cliente_vendedor: DataFrame

    def __init__(
        self,
        sources: Mapping[str, Callable[[], DataFrame]],
        one_company_per_order: bool = False,
    ):
        absent = [name for name in SCHEMAS if name not in sources]
        if absent:
            raise SchemaError(f"mart tables missing: {', '.join(absent)}")
        self._sources = dict(sources)
        self.one_company_per_order = one_company_per_order

    def __getattr__(self, name: str) -> DataFrame:
        if name not in SCHEMAS:
            raise AttributeError(name)
        table = conform(self._sources[name](), name)
        setattr(self, name, table)
        return table

    def check(self, values: bool = False) -> SalesMart:
        """Open every table; with ``values`` also read those whose types alone do not tell that all values fit."""
        for name in SCHEMAS:
            getattr(self, name)
            if values:
                check_values(self._sources[name](), name)
        return self

    @classmethod
    def of(cls, one_company_per_order: bool = False, **tables: DataFrame) -> SalesMart:
        sources = {name: (lambda df=df: df) for name, df in tables.items()}
        return cls(sources, one_company_per_order).check()


def conform(df: DataFrame, table: str) -> DataFrame:
    """Project ``df`` to the declared columns and types of ``table``.

    Names match without regard to case. Identifiers keep their type. No value
    changes in silence: a decimal column with more decimals than declared is
    refused here, and a text or floating-point value that the declared type
    cannot hold fails the query that reads it. All other casts are plain column
    casts, so comparisons on them still reach the scan as pushed filters.
    """
    return df.select(*[_declared(table, f, name, kind) for name, kind, f in _matched(df, table)])


def check_values(df: DataFrame, table: str) -> None:
    """Raise SchemaError if a value of ``df`` does not fit its declared type; one pass over such columns."""
    guarded = [(n, k, f) for n, k, f in _matched(df, table) if _changes_values(f, k)]
    if not guarded:
        return
    counts = [F.count_if(~_kept(f, kind)).alias(name) for name, kind, f in guarded]
    lost = df.agg(*counts).first()
    found = [f"{n} ({lost[n]} values, not all {kind})" for n, kind, _ in guarded if lost[n]]
    if found:
        raise SchemaError(f"{table}: values would change: {', '.join(found)}")


def _matched(df: DataFrame, table: str) -> list[tuple[str, str, StructField]]:
    have = {f.name.lower(): f for f in df.schema.fields}
    declared = SCHEMAS[table]
    absent = [name for name in declared if name.lower() not in have]
    if absent:
        raise SchemaError(f"{table}: columns missing: {', '.join(absent)}")
    return [(name, kind, have[name.lower()]) for name, kind in declared.items()]


def _declared(table: str, field: StructField, name: str, kind: str) -> Column:
    column = F.col(f"`{field.name}`")
    if kind == IDENTIFIER:
        return column.alias(name)
    if kind.startswith("decimal") and isinstance(field.dataType, DecimalType):
        if field.dataType.scale > DecimalType.fromDDL(kind).scale:
            raise SchemaError(f"{table}.{name}: {field.dataType.simpleString()} would be rounded to {kind}")
    if not _changes_values(field, kind):
        return column.cast(kind).alias(name)
    refusal = F.raise_error(
        F.concat(F.lit(f"SchemaError: {table}.{name}: not a {kind}: "), column.cast("string"))
    ).cast(kind)
    return F.when(column.isNull() | _kept(field, kind), column.try_cast(kind)).otherwise(refusal).alias(name)


def _changes_values(field: StructField, kind: str) -> bool:
    """Whether a cast from the column's type could change or lose a value without an error."""
    inexact = isinstance(field.dataType, (FloatType, DoubleType, StringType))
    return inexact and kind not in (IDENTIFIER, "string")


def _kept(field: StructField, kind: str) -> Column:
    """Whether the value survives the cast; true for NULL.

    A floating-point number must come back from the declared type. A text must
    be a value of that type, and a decimal text have no digit beyond its scale.
    """
    column = F.col(f"`{field.name}`")
    value = column.try_cast(kind)
    if not isinstance(field.dataType, StringType):
        kept = value.cast(field.dataType) == column
    elif kind.startswith("decimal"):
        scale = DecimalType.fromDDL(kind).scale
        beyond = column.rlike(rf"\.\d{{{scale}}}\d*[1-9]\d*\s*$")
        kept = (value == column.try_cast("decimal(38,18)")) & ~beyond
    else:
        kept = value.isNotNull()
    return column.isNull() | F.coalesce(kept, F.lit(False))


def load_mart(
    spark: SparkSession, root: str, fmt: str = "parquet", one_company_per_order: bool = False
) -> SalesMart:
    """Mart stored as one directory per table below ``root`` (parquet, orc or csv)."""

    def opener(name: str) -> Callable[[], DataFrame]:
        path = f"{root.rstrip('/')}/{name}"
        if fmt == "csv":
            # Text by header name; conform() casts.
            return lambda: spark.read.option("header", True).csv(path)
        return lambda: spark.read.format(fmt).load(path)

    return SalesMart({name: opener(name) for name in SCHEMAS}, one_company_per_order)


def mart_from_catalog(
    spark: SparkSession, names: Mapping[str, str], one_company_per_order: bool = False
) -> SalesMart:
    """Mart held as catalog tables or views; ``names`` maps short name to table."""
    sources = {short: (lambda t=t: spark.table(t)) for short, t in names.items()}
    return SalesMart(sources, one_company_per_order)
