"""Row filters shared by the sales queries."""

from __future__ import annotations

from dataclasses import dataclass, replace
from datetime import date

from pyspark.sql import Column, DataFrame, functions as F

from salescope.functions.dates import first_day, shift_months

# The fiscal operation descriptions that count as a sale, compared with case.
SALE_CFOPS = (
    "VENDA",
    "VENDA DE MERC.SUJEITA ST",
    "VENDA DE MERCADORIA P/ NÃO CONTRIBUINTE",
    "VENDA DO CONSIGNADO",
    "VENDA MERC. REC. TERCEIROS DESTINADA A ZONA FRANCA DE MANAUS",
    "VENDA MERC.ADQ. BRASIL FORA ESTADO",
    "VENDA MERCADORIA DENTRO DO ESTADO",
    "Venda de mercadoria sujeita ao regime de substituição tributária",
    "VENDA MERCADORIA FORA ESTADO",
    "VENDA MERC. SUJEITA AO REGIME DE ST",
)
# The order systems whose orders count.
SALE_ORIGINS = ("egestor", "uno")


@dataclass(frozen=True)
class SalesFilter:
    """What to select. An empty list, or no code, selects everything."""

    start: date
    end: date
    channels: tuple[str, ...] = ()
    ufs: tuple[str, ...] = ()
    brands: tuple[str, ...] = ()
    seller_code: str | None = None
    seller_names: tuple[str, ...] = ()

    def but(self, **changes) -> SalesFilter:
        return replace(self, **changes)

    @property
    def months(self) -> tuple[date, date]:
        """First days of the first and the last month touched."""
        return first_day(self.start), first_day(self.end)


def valid_sale(check_origin: bool = True) -> Column:
    cond = F.col("desc_abrev_cfop").isin(*SALE_CFOPS) & (F.col("operacoes_internas") == "N")
    return cond & F.col("origem").isin(*SALE_ORIGINS) if check_origin else cond


def sales_filter(
    orders: DataFrame, start: date, end: date, check_origin: bool = True
) -> DataFrame:
    """Orders that are valid sales, dated from ``start`` to ``end`` inclusive."""
    return orders.filter(in_period("dt_faturamento", start, end) & valid_sale(check_origin))


def in_period(column: str, start: date, end: date) -> Column:
    return F.col(column).between(F.lit(start), F.lit(end))


#: First days of the first and the last month; columns where they are known at run time only.
Months = tuple[date | Column, date | Column] | None


def in_months(column: str, months: Months) -> Column:
    """Dates within whole months, as a plain range so that it reaches the scan."""
    if months is None:
        return F.lit(True)
    lo, hi = months
    after = F.add_months(hi, 1) if isinstance(hi, Column) else F.lit(shift_months(hi, 1))
    return (F.col(column) >= (lo if isinstance(lo, Column) else F.lit(lo))) & (F.col(column) < after)


_DIMENSIONS = {
    "channels": "canal_venda",
    "ufs": "uf_empresa_faturamento",
    "brands": "marca",
    "seller_names": "nome_colaborador_atual",
}


def narrows_orders(flt: SalesFilter) -> bool:
    """Whether a filter on channel, state or seller leaves only a part of the orders."""
    return bool(flt.channels or flt.ufs or flt.seller_code or flt.seller_names)


def dimension_filter(df: DataFrame, flt: SalesFilter) -> DataFrame:
    """Apply the filters that are set and whose column ``df`` has."""
    for field, column in _DIMENSIONS.items():
        wanted = getattr(flt, field)
        if wanted and column in df.columns:
            df = df.filter(F.col(column).isin(*wanted))
    if flt.seller_code and "cod_colaborador_atual" in df.columns:
        df = df.filter(F.col("cod_colaborador_atual") == flt.seller_code)
    return df
