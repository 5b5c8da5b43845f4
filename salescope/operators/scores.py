"""RFM scores and segments as ordered rule tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

# Fixed values: (lowest, highest, score), both ends inclusive; anything else scores 1.
RECENCY_BANDS = ((0, 1, 5), (2, 2, 4), (3, 3, 3), (4, 6, 2))
FREQUENCY_BANDS = ((10, None, 5), (7, 9, 4), (3, 6, 3), (2, 2, 2))
RECENCY_BANDS_ELEVEN = ((0, 1, 5), (2, 3, 4), (4, 5, 3), (6, 6, 2))
FREQUENCY_BANDS_ELEVEN = ((13, None, 5), (10, 12, 4), (7, 9, 3), (4, 6, 2))

ANY = (1, 5)

# Fixed values: (recency, frequency, monetary) score ranges and the segment, first match wins.
SUMMARY_RULES = (
    ((5, 5), (5, 5), ANY, "Campeões"),
    ((4, 5), (4, 5), ANY, "Clientes fiéis"),
    ((5, 5), (1, 2), ANY, "Novos clientes"),
    ((1, 2), (1, 3), ANY, "Em risco"),
    ((1, 1), (1, 1), ANY, "Perdidos"),
    ((3, 3), (1, 1), ANY, "Atenção"),
    (ANY, ANY, ANY, "Outros"),
)
DRILLDOWN_RULES = (
    ((5, 5), (5, 5), ANY, "Campeões"),
    ((3, 5), (3, 5), ANY, "Clientes fiéis"),
    ((5, 5), (1, 2), ANY, "Novos clientes"),
    ((1, 2), (1, 3), ANY, "Em risco"),
    ((1, 1), (1, 1), ANY, "Perdidos"),
    ((3, 3), (1, 1), ANY, "Atenção"),
    (ANY, ANY, ANY, "Outros"),
)
ELEVEN_RULES = (
    ((5, 5), (5, 5), (5, 5), "Campeões"),
    ((5, 5), (3, 5), (3, 5), "Clientes fiéis"),
    ((4, 4), (3, 5), (3, 5), "Fiéis em potencial"),
    ((5, 5), (1, 2), ANY, "Novos clientes"),
    ((5, 5), ANY, (1, 2), "Promessas"),
    ((3, 3), (3, 5), (3, 5), "Clientes precisando de atenção"),
    ((1, 2), (1, 2), (1, 2), "Quase dormentes"),
    ((2, 2), (3, 5), (3, 5), "Em risco"),
    ((1, 1), (4, 5), (4, 5), "Não pode perder"),
    ((1, 2), (1, 2), (3, 5), "Hibernando"),
    (ANY, ANY, ANY, "Perdidos"),
)
RULE_SETS = {"summary": SUMMARY_RULES, "drilldown": DRILLDOWN_RULES, "eleven": ELEVEN_RULES}


def band_score(value: Column, bands: Sequence[tuple]) -> Column:
    cases = [
        (value >= lo if hi is None else value.between(lo, hi), score) for lo, hi, score in bands
    ]
    expr = F.when(cases[0][0], cases[0][1])
    for cond, score in cases[1:]:
        expr = expr.when(cond, score)
    return expr.otherwise(1)


def segment(rules: str) -> Column:
    """Segment label from the columns R_Score, F_Score and M_Score."""
    *ruled, (_, _, _, default) = RULE_SETS[rules]
    expr = None
    for r, f, m, label in ruled:
        cond = F.lit(True)
        for name, span in (("R_Score", r), ("F_Score", f), ("M_Score", m)):
            if span != ANY:
                cond = cond & F.col(name).between(*span)
        expr = F.when(cond, label) if expr is None else expr.when(cond, label)
    return expr.otherwise(default)
