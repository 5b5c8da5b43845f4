"""Recency, frequency, monetary: scores, segments, summary, drill-down and heat map."""

from __future__ import annotations

from contextlib import AbstractContextManager

from pyspark.sql import DataFrame, functions as F

from salescope.functions.numeric import as_double, double_ratio
from salescope.operators.filters import SalesFilter
from salescope.operators.ntile import with_ntile
from salescope.operators.scores import (
    FREQUENCY_BANDS,
    FREQUENCY_BANDS_ELEVEN,
    RECENCY_BANDS,
    RECENCY_BANDS_ELEVEN,
    band_score,
    segment,
)
from salescope.sources.mart import SalesMart
from salescope.sources.shared import held


def rfm_base(mart: SalesMart, flt: SalesFilter) -> DataFrame:
    """Client profiles LEFT sellers; a client with two sellers appears twice."""
    profile = mart.perfil_cliente
    if flt.channels:
        profile = profile.filter(F.col("Canal_Venda").isin(*flt.channels))
    if flt.ufs:
        profile = profile.filter(F.col("uf_empresa").isin(*flt.ufs))
    sellers = mart.cliente_vendedor.withColumnRenamed("cod_cliente", "Cod_Cliente")
    if profile.schema["Cod_Cliente"].dataType != sellers.schema["Cod_Cliente"].dataType:
        # Sources that disagree on the code's type meet as text.
        text = F.col("Cod_Cliente").cast("string")
        profile, sellers = profile.withColumn("Cod_Cliente", text), sellers.withColumn("Cod_Cliente", text)
    base = profile.join(sellers, "Cod_Cliente", "left")
    if flt.seller_code:
        base = base.filter(F.col("cod_colaborador_atual") == flt.seller_code)
    return base.select(
        "Cod_Cliente",
        "Nome_Cliente",
        "uf_empresa",
        "Canal_Venda",
        "Recencia",
        F.col("Positivacao").alias("Frequencia"),
        "Monetario",
        "ticket_medio_posit",
        F.col("Maior_Mes").alias("Mes_Ultima_Compra"),
        F.col("Ciclo_Vida").alias("Life_time"),
        "cod_colaborador_atual",
    )


def rfm_scores(mart: SalesMart, flt: SalesFilter) -> DataFrame:
    """R and F by fixed bands, M as NTILE(5) by money after the filters.

    M_Score 1 is the highest spender. Ties go by client, then seller.
    """
    return _scored(rfm_base(mart, flt), RECENCY_BANDS, FREQUENCY_BANDS)


def scored_clients(mart: SalesMart, flt: SalesFilter) -> AbstractContextManager[DataFrame]:
    """``rfm_scores`` computed once for several queries on them.

        with scored_clients(mart, flt) as scores:
            summary = rfm_summary(scores).collect()
            clients = rfm_segment_clients(scores, "Em risco").collect()

    The scored table lies in the shared folder until the block ends.
    """
    return held(rfm_scores(mart, flt), "rfm-scores")


def _scored(base: DataFrame, recency, frequency) -> DataFrame:
    money = F.col("Monetario")  # descending, NULL last
    by_money = [money.isNull(), -money, F.col("Cod_Cliente"), F.col("cod_colaborador_atual")]
    banded = base.withColumns(
        {
            "R_Score": band_score(F.col("Recencia"), recency),
            "F_Score": band_score(F.col("Frequencia"), frequency),
        }
    )
    return with_ntile(banded, 5, by_money, "M_Score")


def rfm_segments(scores: DataFrame, rules: str = "summary") -> DataFrame:
    """Add the segment; ``rules`` is ``summary``, ``drilldown`` or ``eleven``."""
    return scores.withColumn("Segmento", segment(rules))


def rfm_summary(scores: DataFrame) -> DataFrame:
    """Clients, money and mean scores per segment, channel and state."""
    n = F.col("Numero_Clientes")
    sums = (
        rfm_segments(scores, "summary")
        .groupBy("Segmento", "Canal_Venda", F.col("uf_empresa").alias("Regiao"))
        .agg(
            F.count(F.lit(1)).alias("Numero_Clientes"),
            F.sum("Monetario").alias("Valor_Total"),
            F.count("Monetario").alias("paying"),
            F.avg("R_Score").alias("R_Score_Medio"),
            F.avg("F_Score").alias("F_Score_Medio"),
            F.avg("M_Score").alias("M_Score_Medio"),
        )
    )
    total = F.col("Valor_Total")
    return sums.select(
        "Segmento",
        "Canal_Venda",
        "Regiao",
        n,
        total.cast("double").alias("Valor_Total"),
        double_ratio(total, F.col("paying")).alias("Valor_Medio"),
        "R_Score_Medio",
        "F_Score_Medio",
        "M_Score_Medio",
    ).orderBy(F.col("Valor_Total").desc_nulls_last(), F.col("Canal_Venda").asc_nulls_last())


def rfm_segment_list(summary: DataFrame) -> DataFrame:
    return summary.select("Segmento").distinct()


def rfm_segment_clients(scores: DataFrame, wanted: str) -> DataFrame:
    """Clients of one segment under the drill-down rules, by money."""
    clients = rfm_segments(scores, "drilldown").filter(F.col("Segmento") == wanted)
    ordered = clients.orderBy(
        F.col("Monetario").desc_nulls_last(), F.col("Canal_Venda").asc_nulls_last(), "Cod_Cliente"
    )
    return as_double(ordered, "Monetario", "ticket_medio_posit").select(
        "Cod_Cliente",
        "Nome_Cliente",
        "uf_empresa",
        "Canal_Venda",
        "Recencia",
        "Frequencia",
        "Monetario",
        "ticket_medio_posit",
        "R_Score",
        "F_Score",
        "M_Score",
        "Mes_Ultima_Compra",
        "Life_time",
        "Segmento",
    )


def rfm_segment_view(clients: DataFrame) -> DataFrame:
    """The columns shown for a segment's clients; its row count is the segment's size."""
    return clients.select(
        "Cod_Cliente",
        "Nome_Cliente",
        "Recencia",
        "Frequencia",
        "Monetario",
        F.col("ticket_medio_posit").alias("ticket_medio"),
        "Mes_Ultima_Compra",
    )


def rfm_heatmap(summary: DataFrame) -> DataFrame:
    """Clients per cell of the 5 x 5 grid of rounded mean R and F, all 25 cells.

    A mean of exactly one half rounds to the even neighbour.
    """

    def cell(mean: str):
        return F.least(F.greatest(F.bround(mean).cast("int"), F.lit(1)), F.lit(5))

    counts = summary.groupBy(
        cell("R_Score_Medio").alias("r_score"), cell("F_Score_Medio").alias("f_score")
    ).agg(F.sum("Numero_Clientes").alias("clientes"))
    scores = F.sequence(F.lit(1), F.lit(5))
    grid = (
        summary.sparkSession.range(1)
        .select(F.explode(scores).alias("r_score"))
        .select("r_score", F.explode(scores).alias("f_score"))
    )
    return grid.join(counts, ["r_score", "f_score"], "left").na.fill(0).orderBy("r_score", "f_score")


def rfm_eleven_segments(mart: SalesMart, flt: SalesFilter) -> DataFrame:
    """Older rule: other bands, money is the mean ticket, eleven segments, all clients."""
    base = rfm_base(mart, SalesFilter(flt.start, flt.end, seller_code=flt.seller_code))
    scores = _scored(
        base.withColumn("Monetario", F.col("ticket_medio_posit")),
        RECENCY_BANDS_ELEVEN,
        FREQUENCY_BANDS_ELEVEN,
    )
    digits = [F.col(c).cast("string") for c in ("R_Score", "F_Score", "M_Score")]
    ordered = (
        rfm_segments(scores, "eleven")
        .withColumn("RFM_Score", F.concat(*digits))
        .orderBy("Segmento", F.col("Monetario").desc_nulls_last(), "Cod_Cliente")
    )
    return as_double(ordered, "Monetario", "ticket_medio_posit").select(
        "Cod_Cliente",
        "Nome_Cliente",
        "Recencia",
        "Frequencia",
        "Monetario",
        "ticket_medio_posit",
        "R_Score",
        "F_Score",
        "M_Score",
        "RFM_Score",
        "Segmento",
        "cod_colaborador_atual",
    )
