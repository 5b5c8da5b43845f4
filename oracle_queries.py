"""DuckDB SQL for every registered query, written independently of the Spark code.

Each text starts with hand-written CTEs that derive the mart from the star
tables, then states the query in its plain relational form: joins against the
calendar, LAG, NTILE, line-level repetition. The Spark side uses other forms.
"""

from __future__ import annotations

MART = """
WITH pedidos AS (
  SELECT o.o_orderkey AS cod_pedido, o.o_custkey AS cpfcnpj,
         CAST(o.o_orderdate AS DATE) AS dt_faturamento,
         CASE o.o_orderpriority WHEN '5-LOW' THEN 'BONIFICADO'
              WHEN '4-NOT SPECIFIED' THEN 'VENDA DO CONSIGNADO'
              WHEN '3-MEDIUM' THEN 'VENDA DE MERC.SUJEITA ST' ELSE 'VENDA' END AS desc_abrev_cfop,
         CASE WHEN o.o_orderstatus = 'P' AND o.o_orderkey % 10 = 0 THEN 'S' ELSE 'N' END
           AS operacoes_internas,
         CASE o.o_orderkey % 3 WHEN 0 THEN 'uno' WHEN 1 THEN 'egestor' ELSE 'anymarket' END AS origem,
         c.c_mktsegment AS canal_venda
  FROM orders o LEFT JOIN customer c ON c.c_custkey = o.o_custkey
),
item_pedidos AS (
  SELECT l_orderkey AS cod_pedido, l_partkey AS cod_produto, CAST(l_partkey AS VARCHAR) AS sku,
         p_brand AS marca, CAST(l_quantity AS DECIMAL(18,2)) AS qtd,
         CAST(l_extendedprice AS DECIMAL(18,2)) AS preco_total,
         CAST(round(CAST(l_extendedprice AS DECIMAL(12,2)) * (1 - CAST(l_discount AS DECIMAL(4,2))), 2)
              AS DECIMAL(18,2)) AS preco_desconto_rateado
  FROM lineitem JOIN part ON p_partkey = l_partkey
),
place AS (
  SELECT c_custkey, c_name, c_mktsegment, n_name, n_regionkey
  FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey
),
empresa_pedido AS (
  SELECT o_orderkey AS cod_pedido, CAST(n_regionkey AS VARCHAR) AS cod_empresa_faturamento,
         r_name AS nome_empresa_faturamento, n_name AS uf_empresa_faturamento,
         CAST(o_orderkey % (SELECT count(*) FROM supplier) AS VARCHAR) AS cod_colaborador_atual,
         s_name AS nome_colaborador_atual, s_name AS nome_colaborador_pedido,
         c_mktsegment AS equipes
  FROM orders LEFT JOIN place ON c_custkey = o_custkey
  LEFT JOIN region ON r_regionkey = n_regionkey
  LEFT JOIN supplier ON s_suppkey = o_orderkey % (SELECT count(*) FROM supplier)
),
brand_codes AS (
  SELECT DISTINCT p_brand, CAST(split_part(p_brand, '#', 2) AS INTEGER) AS cod_marca FROM part
),
varejo_marca AS (SELECT cod_marca, ' ' || upper(p_brand) || ' ' AS desc_abrev FROM brand_codes),
factor_months AS (
  SELECT CAST(unnest(generate_series(lo, hi, INTERVAL 1 MONTH)) AS DATE) AS mes_ref
  FROM (SELECT date_trunc('month', CAST(min(o_orderdate) AS TIMESTAMP)) AS lo,
               date_trunc('month', CAST(max(o_orderdate) AS TIMESTAMP)) AS hi FROM orders)
),
bonificacao AS (
  SELECT r_regionkey AS cod_empresa, mes_ref, cod_marca,
         CASE WHEN cod_marca % 3 = 0 THEN left(upper(p_brand), 4) ELSE upper(p_brand) END AS marca,
         CASE WHEN cod_marca % 7 <> 0
              THEN CAST(1 + (cod_marca % 4) * 0.25 AS DECIMAL(9,4)) END AS fator
  FROM brand_codes JOIN region ON r_regionkey = cod_marca % 5, factor_months
),
varejo_cmv AS (
  SELECT l_orderkey AS cod_pedido, CAST(l_partkey AS VARCHAR) AS cod_produto,
         CAST(o_orderdate AS DATE) AS dt_faturamento, CAST(l_quantity AS DECIMAL(18,2)) AS qtd,
         CAST(round(CAST(p_retailprice AS DECIMAL(12,2)) * 0.60, 2) AS DECIMAL(18,2)) AS custo_unitario,
         CAST(split_part(p_brand, '#', 2) AS INTEGER) AS cod_marca,
         CAST(n_regionkey AS VARCHAR) AS cod_empresa
  FROM lineitem JOIN part ON p_partkey = l_partkey JOIN orders ON o_orderkey = l_orderkey
  LEFT JOIN place ON c_custkey = o_custkey
  WHERE l_linestatus = 'F'
),
pedidos_salao AS (
  SELECT l_orderkey AS cod_pedido, CAST(l_partkey AS VARCHAR) AS codprod,
         CAST(o_orderdate AS DATE) AS dtvenda, CAST(l_quantity AS DECIMAL(18,2)) AS quant,
         CAST(round(CAST(p_retailprice AS DECIMAL(12,2)) * 0.50, 2) AS DECIMAL(18,2)) AS custo,
         CASE WHEN CAST(split_part(p_brand, '#', 2) AS INTEGER) % 2 = 1
              THEN left(p_brand, 2) || '-' || substr(p_brand, 3) ELSE p_brand END AS categoria
  FROM lineitem JOIN part ON p_partkey = l_partkey JOIN orders ON o_orderkey = l_orderkey
  WHERE l_linestatus = 'O' AND l_returnflag = 'R'
),
order_money AS (
  SELECT p.cpfcnpj, date_trunc('month', p.dt_faturamento) AS m, i.preco_desconto_rateado AS v
  FROM pedidos p LEFT JOIN item_pedidos i USING (cod_pedido)
),
perfil_cliente AS (
  SELECT cpfcnpj AS Cod_Cliente, any_value(c_name) AS Nome_Cliente, any_value(n_name) AS uf_empresa,
         any_value(c_mktsegment) AS Canal_Venda,
         CAST(datediff('month', max(m), DATE '2001-08-01') AS INTEGER) AS Recencia,
         CAST(count(DISTINCT m) AS INTEGER) AS Positivacao,
         CAST(coalesce(sum(v), 0) AS DECIMAL(18,2)) AS Monetario,
         CAST(round(CAST(coalesce(sum(v), 0) / count(DISTINCT m) AS DECIMAL(38,10)), 2)
              AS DECIMAL(18,2)) AS ticket_medio_posit,
         CAST(max(m) AS DATE) AS Maior_Mes,
         CAST(datediff('month', min(m), max(m)) AS INTEGER) AS Ciclo_Vida
  FROM order_money LEFT JOIN place ON c_custkey = cpfcnpj GROUP BY cpfcnpj
),
cliente_vendedor AS (
  SELECT c_custkey AS cod_cliente, CAST(c_custkey % (SELECT count(*) FROM supplier) AS VARCHAR) AS cod_colaborador_atual FROM customer
)"""

START, END = "DATE '2000-09-01'", "DATE '2001-08-01'"
AS_OF = ANCHOR = "DATE '2001-08-01'"
FLOOR = "DATE '2000-09-01'"

# Fiscal operation descriptions that count as a sale.
SALE_IN = """(
  'VENDA', 'VENDA DE MERC.SUJEITA ST', 'VENDA DE MERCADORIA P/ NÃO CONTRIBUINTE', 'VENDA DO CONSIGNADO',
  'VENDA MERC. REC. TERCEIROS DESTINADA A ZONA FRANCA DE MANAUS', 'VENDA MERC.ADQ. BRASIL FORA ESTADO',
  'VENDA MERCADORIA DENTRO DO ESTADO',
  'Venda de mercadoria sujeita ao regime de substituição tributária',
  'VENDA MERCADORIA FORA ESTADO', 'VENDA MERC. SUJEITA AO REGIME DE ST')"""
VALID = f"p.desc_abrev_cfop IN {SALE_IN} AND p.operacoes_internas = 'N'"
ORIGIN = "p.origem IN ('egestor', 'uno')"
PERIOD = f"p.dt_faturamento >= {START} AND p.dt_faturamento <= {END}"
MONTH = "CAST(date_trunc('month', p.dt_faturamento) AS DATE)"

LINES = """pedidos p
  LEFT JOIN item_pedidos i ON i.cod_pedido = p.cod_pedido
  LEFT JOIN empresa_pedido e ON e.cod_pedido = p.cod_pedido"""


def r2(x: str) -> str:
    return f"round(CAST({x} AS DECIMAL(38,10)), 2)"


def dbl(x: str) -> str:
    return f"CAST({x} AS DOUBLE)"


def in_list(column: str, values) -> str:
    return f"{column} IN (" + ", ".join(f"'{v}'" for v in values) + ")"


def dims(channels=(), ufs=(), brands=(), seller=None, names=()) -> str:
    parts = []
    if channels:
        parts.append(in_list("p.canal_venda", channels))
    if ufs:
        parts.append(in_list("e.uf_empresa_faturamento", ufs))
    if brands:
        parts.append(in_list("i.marca", brands))
    if names:
        parts.append(in_list("e.nome_colaborador_atual", names))
    if seller:
        parts.append(f"e.cod_colaborador_atual = '{seller}'")
    return "".join(f" AND {p}" for p in parts)


# ---------------------------------------------------------------- bonus and cost

def bonus_body(by_seller=False, legacy=False, match_brand=False, where="") -> str:
    cols = ", e.nome_colaborador_atual AS vendedor, e.cod_colaborador_atual AS cod_colaborador"
    cols = cols if by_seller else ""
    names = ", vendedor, cod_colaborador" if by_seller else ""
    cfop = "contains(upper(p.desc_abrev_cfop), 'BONIFICA')" if legacy else \
        "upper(p.desc_abrev_cfop) = 'BONIFICADO'"
    if match_brand:
        factor = """LEFT JOIN (SELECT b.*, upper(trim(m.desc_abrev)) AS brand FROM bonificacao b
             JOIN varejo_marca m ON m.cod_marca = b.cod_marca) b
           ON b.brand = upper(trim(i.marca))"""
    else:
        factor = "LEFT JOIN bonificacao b ON TRUE"
    factor += f" AND CAST(b.cod_empresa AS VARCHAR) = e.cod_empresa_faturamento AND b.mes_ref = {MONTH}"
    return f"""
    SELECT mes_ref{names}, round(sum(adjusted), 2) AS valor_bonificacao FROM (
      SELECT mes_ref{names},
             CASE WHEN fator IS NULL THEN round(sum(preco_total), 2)
                  ELSE {r2("sum(preco_total) / nullif(fator, 0)")} END AS adjusted
      FROM (SELECT {MONTH} AS mes_ref{cols}, i.preco_total, b.fator
            FROM {LINES} {factor}
            WHERE {cfop} AND p.operacoes_internas = 'N'{where})
      GROUP BY ALL, fator) GROUP BY ALL""".replace("GROUP BY ALL, fator", f"GROUP BY mes_ref{names}, fator")


def bonus_sql(**kw) -> str:
    by_seller = kw.get("by_seller", False)
    names = "vendedor, cod_colaborador, " if by_seller else ""
    return f"{MART} SELECT mes_ref, {names}{dbl('valor_bonificacao')} AS valor_bonificacao " \
           f"FROM ({bonus_body(**kw)})"


def retail_body(by_brand=False) -> str:
    brand = ", upper(m.desc_abrev) AS marca" if by_brand else ""
    join = "LEFT JOIN varejo_marca m ON m.cod_marca = k.cod_marca" if by_brand else ""
    return f"""
    SELECT k.cod_pedido, k.cod_produto{brand},
           CAST(date_trunc('month', k.dt_faturamento) AS DATE) AS mes_ref,
           {r2("sum(k.qtd * (k.custo_unitario / coalesce(b.fator, 1))) / nullif(sum(k.qtd), 0)")} AS custo_medio
    FROM varejo_cmv k LEFT JOIN bonificacao b ON b.cod_marca = k.cod_marca
     AND CAST(b.cod_empresa AS VARCHAR) = k.cod_empresa
     AND b.mes_ref = CAST(date_trunc('month', k.dt_faturamento) AS DATE) {join}
    GROUP BY k.cod_pedido, k.cod_produto, {"upper(m.desc_abrev)," if by_brand else ""}
             date_trunc('month', k.dt_faturamento), b.fator"""


def salon_body(by_brand=False) -> str:
    brand = ", upper(s.categoria) AS marca" if by_brand else ""
    return f"""
    SELECT s.cod_pedido, s.codprod AS cod_produto{brand},
           CAST(date_trunc('month', s.dtvenda) AS DATE) AS mes_ref,
           {r2("sum(s.quant * (s.custo / b.fator)) / nullif(sum(s.quant), 0)")} AS custo_medio
    FROM pedidos_salao s JOIN bonificacao b ON b.mes_ref = CAST(date_trunc('month', s.dtvenda) AS DATE)
     AND (upper(trim(s.categoria)) = upper(trim(b.marca))
          OR left(replace(upper(s.categoria), '-', ''), 4) = upper(b.marca))
    WHERE b.fator IS NOT NULL
    GROUP BY s.cod_pedido, s.codprod, {"upper(s.categoria)," if by_brand else ""}
             date_trunc('month', s.dtvenda), b.fator"""


def unit_cost_body(by_brand=False) -> str:
    brand = "marca, " if by_brand else ""
    return f"""
    SELECT cod_pedido, cod_produto, {brand}mes_ref, sum(custo_medio) AS custo_medio
    FROM ({retail_body(by_brand)} UNION ALL {salon_body(by_brand)}) both_sources
    GROUP BY cod_pedido, cod_produto, {brand}mes_ref"""


LEGACY_COST = f"""
    SELECT cod_pedido, cod_produto,
           {r2("sum(qtd * custo_unitario) / nullif(sum(qtd), 0)")} AS custo_medio
    FROM varejo_cmv GROUP BY cod_pedido, cod_produto"""


def cost_sql(body: str, columns: str) -> str:
    return f"{MART} SELECT {columns}, {dbl('custo_medio')} AS custo_medio FROM ({body})"


# ---------------------------------------------------------------- revenue and brands

def revenue_sql(legacy=False, **kw) -> str:
    return f"{MART} {revenue_body(legacy, **kw)}"


def revenue_body(legacy=False, **kw) -> str:
    seller = bool(kw.get("seller"))
    where = dims(**kw)
    keys = ", e.nome_colaborador_atual AS vendedor, e.cod_colaborador_atual AS cod_colaborador"
    keys = keys if seller else ""
    names = "vendedor, cod_colaborador, " if seller else ""
    f_names = "f.vendedor, f.cod_colaborador, " if seller else ""
    origin = "" if legacy else f" AND {ORIGIN}"
    return f"""
    SELECT f.mes_ref, {f_names}{dbl('bruto')} AS faturamento_bruto, {dbl('liquido')} AS faturamento_liquido,
           {dbl('bruto - liquido')} AS desconto,
           {dbl('coalesce(b.valor_bonificacao, 0)')} AS valor_bonificacao, {dbl('custo')} AS custo_total,
           clientes AS positivacao, n_pedidos AS qtd_pedido, {dbl('itens')} AS qtd_itens,
           produtos AS qtd_sku, marcas AS qtd_marcas,
           {dbl(r2('liquido / nullif(clientes, 0)'))} AS Ticket_Medio_Positivacao,
           {dbl(r2('liquido / nullif(n_pedidos, 0)'))} AS Ticket_Medio_Pedidos,
           CASE WHEN custo > 0 THEN ({dbl('liquido')} - {dbl('custo')}) / {dbl('custo')} * 100
                ELSE CAST(0 AS DOUBLE) END AS markup_percentual
    FROM (
      SELECT mes_ref, {names}round(sum(preco_total), 2) AS bruto,
             round(sum(preco_desconto_rateado), 2) AS liquido,
             round(sum(coalesce(custo_medio, 0) * qtd), 2) AS custo, sum(qtd) AS itens,
             count(DISTINCT cpfcnpj) AS clientes, count(DISTINCT cod_pedido) AS n_pedidos,
             count(DISTINCT cod_produto) AS produtos, count(DISTINCT marca) AS marcas
      FROM (SELECT {MONTH} AS mes_ref{keys}, p.cpfcnpj, p.cod_pedido, i.cod_produto, i.marca, i.qtd,
                   i.preco_total, i.preco_desconto_rateado, k.custo_medio
            FROM {LINES}
            LEFT JOIN ({unit_cost_body()}) k ON k.cod_pedido = p.cod_pedido AND k.cod_produto = i.sku
              AND k.mes_ref = {MONTH}
            WHERE {VALID}{origin} AND {PERIOD}{where})
      GROUP BY mes_ref{', vendedor, cod_colaborador' if seller else ''}) f
    LEFT JOIN ({bonus_body(seller, legacy, where=where)}) b
      ON b.mes_ref = f.mes_ref{' AND b.cod_colaborador = f.cod_colaborador' if seller else ''}"""


def brand_body(**kw) -> str:
    return f"""
    SELECT i.marca, {dbl('round(sum(i.preco_desconto_rateado), 2)')} AS faturamento,
           count(DISTINCT p.cpfcnpj) AS clientes_unicos, count(DISTINCT p.cod_pedido) AS qtd_pedido,
           {dbl('sum(i.qtd)')} AS qtd_itens, count(DISTINCT i.cod_produto) AS qtd_sku,
           {dbl(r2('sum(i.preco_desconto_rateado) / nullif(count(DISTINCT p.cpfcnpj), 0)'))}
             AS Ticket_Medio_Positivacao,
           {dbl(r2('sum(i.preco_desconto_rateado) / nullif(count(DISTINCT p.cod_pedido), 0)'))}
             AS Ticket_Medio_Pedidos,
           {brand_markup()} AS markup_percentual
    FROM {LINES}
    LEFT JOIN ({unit_cost_body(True)}) k ON k.cod_pedido = p.cod_pedido AND k.cod_produto = i.sku
      AND k.mes_ref = {MONTH}
    WHERE {VALID} AND {ORIGIN} AND {PERIOD}{dims(**kw)} GROUP BY i.marca"""


def brand_markup() -> str:
    cost = "sum(coalesce(k.custo_medio, 0) * i.qtd)"
    net = "sum(i.preco_desconto_rateado)"
    return f"""CASE WHEN {cost} > 0 THEN ({dbl(net)} - {dbl(cost)}) / {dbl(cost)} * 100
                ELSE CAST(0 AS DOUBLE) END"""


BRAND_LEGACY = f"""{MART}
    SELECT i.marca, count(DISTINCT p.cpfcnpj) AS clientes_unicos,
           {dbl('sum(i.preco_desconto_rateado)')} AS faturamento,
           count(DISTINCT p.cod_pedido) AS qtd_pedido, count(DISTINCT i.cod_produto) AS qtd_sku,
           {dbl(r2('sum(i.preco_desconto_rateado) / nullif(count(DISTINCT p.cpfcnpj), 0)'))}
             AS Ticket_Medio_Positivacao,
           {brand_markup()} AS markup_percentual
    FROM {LINES} LEFT JOIN ({LEGACY_COST}) k ON k.cod_pedido = p.cod_pedido AND k.cod_produto = i.sku
    WHERE {VALID} AND {PERIOD} GROUP BY i.marca"""


def brand_table_sql(selected=()) -> str:
    where = f"WHERE {in_list('marca', selected)}" if selected else ""
    return f"""{MART}, brands AS ({brand_body()})
    SELECT marca, faturamento, faturamento / {dbl(f'(SELECT sum(CAST(faturamento AS DECIMAL(28,2))) FROM brands {where})')} AS share,
           clientes_unicos, qtd_pedido, qtd_sku, Ticket_Medio_Positivacao,
           {dbl("round(CAST(markup_percentual AS DECIMAL(38,10)) / 100 + 1, 2)")} AS markup
    FROM brands {where}"""


MONTHLY_SERIES = f"""{MART}, revenue AS ({revenue_body()}),
  months AS (SELECT CAST(unnest(generate_series({START}, {END}, INTERVAL 1 MONTH)) AS DATE) AS mes_ref)
  SELECT mes_ref, coalesce(sum(faturamento_liquido), 0) AS faturamento_liquido,
         CAST(coalesce(sum(positivacao), 0) AS BIGINT) AS positivacao
  FROM months LEFT JOIN revenue USING (mes_ref) GROUP BY mes_ref"""

LATEST_KPIS = f"""{MART}, revenue AS ({revenue_body()})
  SELECT *, CASE WHEN faturamento_bruto <> 0 THEN desconto / faturamento_bruto * 100 ELSE 0 END
           AS desconto_percentual,
         CASE WHEN faturamento_liquido <> 0 THEN valor_bonificacao / faturamento_liquido * 100 ELSE 0 END
           AS bonificacao_percentual,
         markup_percentual / 100 + 1 AS markup_value
  FROM revenue WHERE mes_ref = (SELECT max(mes_ref) FROM revenue)"""

# ---------------------------------------------------------------- catalogue


def pairs_body(seller=None) -> str:
    return f"""SELECT DISTINCT p.canal_venda, e.uf_empresa_faturamento
    FROM pedidos p LEFT JOIN empresa_pedido e ON e.cod_pedido = p.cod_pedido
    WHERE {PERIOD}{dims(seller=seller)}"""


def sellers_sql(**kw) -> str:
    return f"""{MART} SELECT DISTINCT e.nome_colaborador_atual AS nome_colaborador,
      e.cod_colaborador_atual AS cod_colaborador
    FROM pedidos p LEFT JOIN empresa_pedido e ON e.cod_pedido = p.cod_pedido
    WHERE {PERIOD}{dims(**kw)}"""


# ---------------------------------------------------------------- client status


def status_ctes(**kw) -> str:
    """Line-level purchases, calendar joins, LAG and ROW_NUMBER."""
    return f""", months AS (
      SELECT CAST({ANCHOR} - to_months(CAST(g AS INTEGER)) AS DATE) AS mes FROM range(16) t(g)),
    bought AS (
      SELECT p.cpfcnpj AS client, p.dt_faturamento AS d FROM {LINES}
      WHERE {VALID} AND {ORIGIN}{dims(**kw)}),
    first_month AS (
      SELECT client, CAST(date_trunc('month', min(d)) AS DATE) AS mes FROM bought GROUP BY client),
    last_day AS (SELECT client, max(d) AS d FROM bought GROUP BY client),
    lost AS (
      SELECT mes, client FROM months JOIN last_day ON d < mes - 180
      QUALIFY row_number() OVER (PARTITION BY client ORDER BY mes) = 1),
    gaps AS (
      SELECT client, d, d - lag(d) OVER (PARTITION BY client ORDER BY d) AS days FROM bought),
    back AS (
      SELECT DISTINCT client, CAST(date_trunc('month', d) AS DATE) AS mes,
             CASE WHEN days > 180 THEN 'Recuperado' ELSE 'Reativado' END AS status
      FROM gaps WHERE days > 90 AND date_trunc('month', d) >= {FLOOR}),
    active AS (
      SELECT DISTINCT client, CAST(date_trunc('month', d) AS DATE) AS mes FROM bought
      WHERE date_trunc('month', d) >= {FLOOR}),
    events AS (
      SELECT mes, 'novas_aberturas' AS status, client FROM first_month
      UNION ALL SELECT mes, 'churn', client FROM lost
      UNION ALL SELECT mes, status, client FROM back
      UNION ALL
      SELECT a.mes, 'Positivado', a.client FROM active a
      WHERE NOT EXISTS (FROM first_month f WHERE f.client = a.client AND f.mes = a.mes)
        AND NOT EXISTS (FROM lost l WHERE l.client = a.client AND l.mes = a.mes)
        AND NOT EXISTS (FROM back b WHERE b.client = a.client AND b.mes = a.mes)
      UNION ALL
      SELECT m.mes, 'Base', b.client FROM months m JOIN bought b ON b.d <= m.mes AND b.d > m.mes - 180
      WHERE m.mes >= {FLOOR}),
    status_rows AS (
      SELECT mes, status, count(DISTINCT client) AS qtd FROM events
      WHERE mes IN (SELECT mes FROM months) AND mes <= date_trunc('month', {AS_OF})
        AND mes BETWEEN date_trunc('month', {START}) AND date_trunc('month', {END})
      GROUP BY mes, status HAVING count(DISTINCT client) > 0)"""


def status_sql(only=None, **kw) -> str:
    where = f" WHERE status = '{only}'" if only else ""
    return f"{MART}{status_ctes(**kw)} SELECT mes, status, qtd FROM status_rows{where}"


def _pct(status: str) -> str:
    q = f"coalesce(sum(qtd) FILTER (status = '{status}'), 0)"
    base = "sum(qtd) FILTER (status = 'Base')"
    return f"{dbl(q)} / nullif({base}, 0) * 100 AS {status}"


STATUS_SHARES = f"""{MART}{status_ctes()}
  SELECT mes, CAST(coalesce(sum(qtd) FILTER (status = 'Base'), 0) AS BIGINT) AS Base,
         {_pct('novas_aberturas')}, {_pct('churn')}, {_pct('Recuperado')}, {_pct('Reativado')},
         {_pct('Positivado')}
  FROM status_rows WHERE EXISTS (FROM status_rows WHERE status = 'Base') GROUP BY mes"""

# ---------------------------------------------------------------- RFM


# Score bands, each with both bounds.
RECENCY_CASE = """CASE
      WHEN Recencia BETWEEN 0 AND 1 THEN 5
      WHEN Recencia = 2 THEN 4
      WHEN Recencia = 3 THEN 3
      WHEN Recencia BETWEEN 4 AND 6 THEN 2
      ELSE 1 END"""
FREQUENCY_CASE = """CASE
      WHEN Positivacao >= 10 THEN 5
      WHEN Positivacao BETWEEN 7 AND 9 THEN 4
      WHEN Positivacao BETWEEN 3 AND 6 THEN 3
      WHEN Positivacao = 2 THEN 2
      ELSE 1 END"""
RECENCY_CASE_ELEVEN = """CASE
      WHEN Recencia BETWEEN 0 AND 1 THEN 5
      WHEN Recencia BETWEEN 2 AND 3 THEN 4
      WHEN Recencia BETWEEN 4 AND 5 THEN 3
      WHEN Recencia = 6 THEN 2
      ELSE 1 END"""
FREQUENCY_CASE_ELEVEN = """CASE
      WHEN Positivacao >= 13 THEN 5
      WHEN Positivacao BETWEEN 10 AND 12 THEN 4
      WHEN Positivacao BETWEEN 7 AND 9 THEN 3
      WHEN Positivacao BETWEEN 4 AND 6 THEN 2
      ELSE 1 END"""


def scores_body(where="TRUE", money="Monetario", eleven=False) -> str:
    r, f = (RECENCY_CASE_ELEVEN, FREQUENCY_CASE_ELEVEN) if eleven else (RECENCY_CASE, FREQUENCY_CASE)
    return f"""
    SELECT Cod_Cliente, Nome_Cliente, uf_empresa, Canal_Venda, Recencia, Positivacao AS Frequencia,
           {money} AS Monetario, ticket_medio_posit, Maior_Mes AS Mes_Ultima_Compra,
           Ciclo_Vida AS Life_time, cod_colaborador_atual,
           {r} AS R_Score, {f} AS F_Score,
           CAST(ntile(5) OVER (ORDER BY {money} DESC NULLS LAST, Cod_Cliente, cod_colaborador_atual)
                AS INTEGER) AS M_Score
    FROM perfil_cliente LEFT JOIN cliente_vendedor s USING (Cod_Cliente)
    WHERE {where}"""


# Segments, first match wins.
def segment_case(loyal: int) -> str:
    return f"""CASE
      WHEN R_Score = 5 AND F_Score = 5 THEN 'Campeões'
      WHEN R_Score >= {loyal} AND F_Score >= {loyal} THEN 'Clientes fiéis'
      WHEN R_Score = 5 AND F_Score <= 2 THEN 'Novos clientes'
      WHEN R_Score <= 2 AND F_Score <= 3 THEN 'Em risco'
      WHEN R_Score = 1 AND F_Score = 1 THEN 'Perdidos'
      WHEN R_Score = 3 AND F_Score = 1 THEN 'Atenção' ELSE 'Outros' END"""


# The eleven segments, first match wins.
ELEVEN_CASE = """CASE
      WHEN R_Score = 5 AND F_Score = 5 AND M_Score = 5 THEN 'Campeões'
      WHEN R_Score = 5 AND F_Score >= 3 AND M_Score >= 3 THEN 'Clientes fiéis'
      WHEN R_Score = 4 AND F_Score >= 3 AND M_Score >= 3 THEN 'Fiéis em potencial'
      WHEN R_Score = 5 AND F_Score <= 2 THEN 'Novos clientes'
      WHEN R_Score = 5 AND M_Score <= 2 THEN 'Promessas'
      WHEN R_Score = 3 AND F_Score >= 3 AND M_Score >= 3 THEN 'Clientes precisando de atenção'
      WHEN R_Score <= 2 AND F_Score <= 2 AND M_Score <= 2 THEN 'Quase dormentes'
      WHEN R_Score = 2 AND F_Score >= 3 AND M_Score >= 3 THEN 'Em risco'
      WHEN R_Score = 1 AND F_Score >= 4 AND M_Score >= 4 THEN 'Não pode perder'
      WHEN R_Score <= 2 AND F_Score <= 2 AND M_Score >= 3 THEN 'Hibernando' ELSE 'Perdidos' END"""

MONEY_OUT = f"REPLACE ({dbl('Monetario')} AS Monetario, {dbl('ticket_medio_posit')} AS ticket_medio_posit)"


def scores_sql(where="TRUE") -> str:
    return f"{MART} SELECT * {MONEY_OUT} FROM ({scores_body(where)})"


def segments_sql(loyal: int) -> str:
    return f"{MART} SELECT * {MONEY_OUT}, {segment_case(loyal)} AS Segmento FROM ({scores_body()})"


def summary_body(where="TRUE") -> str:
    return f"""
    SELECT Segmento, Canal_Venda, uf_empresa AS Regiao, count(*) AS Numero_Clientes,
           {dbl('sum(Monetario)')} AS Valor_Total, {dbl('sum(Monetario)')} / count(Monetario) AS Valor_Medio,
           avg(R_Score) AS R_Score_Medio, avg(F_Score) AS F_Score_Medio, avg(M_Score) AS M_Score_Medio
    FROM (SELECT *, {segment_case(4)} AS Segmento FROM ({scores_body(where)}))
    GROUP BY Segmento, Canal_Venda, uf_empresa"""


def clients_body(wanted: str) -> str:
    return f"""
    SELECT Cod_Cliente, Nome_Cliente, uf_empresa, Canal_Venda, Recencia, Frequencia,
           {dbl('Monetario')} AS Monetario, {dbl('ticket_medio_posit')} AS ticket_medio_posit,
           R_Score, F_Score, M_Score, Mes_Ultima_Compra, Life_time, Segmento
    FROM (SELECT *, {segment_case(3)} AS Segmento FROM ({scores_body()})) WHERE Segmento = '{wanted}'"""


HEATMAP = f"""{MART}, summary AS ({summary_body()}),
  cells AS (
    SELECT CAST(greatest(least(round_even(R_Score_Medio, 0), 5), 1) AS INTEGER) AS r_score,
           CAST(greatest(least(round_even(F_Score_Medio, 0), 5), 1) AS INTEGER) AS f_score,
           Numero_Clientes FROM summary)
  SELECT CAST(a.r AS INTEGER) AS r_score, CAST(b.f AS INTEGER) AS f_score,
         CAST(coalesce(sum(Numero_Clientes), 0) AS BIGINT) AS clientes
  FROM range(1, 6) a(r) CROSS JOIN range(1, 6) b(f)
  LEFT JOIN cells ON r_score = a.r AND f_score = b.f GROUP BY a.r, b.f"""

ELEVEN = f"""{MART}
  SELECT Cod_Cliente, Nome_Cliente, Recencia, Frequencia, {dbl('Monetario')} AS Monetario,
         {dbl('ticket_medio_posit')} AS ticket_medio_posit, R_Score, F_Score, M_Score,
         CAST(R_Score * 100 + F_Score * 10 + M_Score AS VARCHAR) AS RFM_Score,
         {ELEVEN_CASE} AS Segmento, cod_colaborador_atual
  FROM ({scores_body(money='ticket_medio_posit', eleven=True)})"""

# ---------------------------------------------------------------- registry

CHANNELS, UFS = ("BUILDING", "MACHINERY"), ("NATION_1", "NATION_7", "NATION_12", "NATION_20")
BRANDS = ("Brand#3", "Brand#12", "Brand#20")
SELLER, NAMES = "3", ("Supplier#000000003", "Supplier#000000004")
WANTED = "Clientes fiéis"
FILTERED = dict(channels=CHANNELS, ufs=UFS, brands=BRANDS)

LINE_COLUMNS = f"""p.cod_pedido, p.cpfcnpj, p.dt_faturamento, p.desc_abrev_cfop, p.operacoes_internas,
  p.origem, p.canal_venda, e.cod_empresa_faturamento, e.nome_empresa_faturamento,
  e.uf_empresa_faturamento, e.cod_colaborador_atual, e.nome_colaborador_atual,
  e.nome_colaborador_pedido, e.equipes, i.cod_produto, i.sku, i.marca, {dbl('i.qtd')} AS qtd,
  {dbl('i.preco_total')} AS preco_total, {dbl('i.preco_desconto_rateado')} AS preco_desconto_rateado"""


def all_queries() -> dict[str, str]:
    product = "cod_pedido, cod_produto, mes_ref"
    return {
        "sales_filter": f"{MART} SELECT p.* FROM pedidos p WHERE {VALID} AND {ORIGIN} AND {PERIOD}",
        "dimension_filter": f"""{MART} SELECT {LINE_COLUMNS} FROM {LINES}
            WHERE {VALID} AND {ORIGIN} AND {PERIOD}{dims(**FILTERED, names=NAMES)}""",
        "order_lines": f"""{MART} SELECT {LINE_COLUMNS} FROM {LINES}
            WHERE {VALID} AND {ORIGIN} AND {PERIOD}""",
        "bonus_value": bonus_sql(),
        "bonus_value_by_seller": bonus_sql(by_seller=True),
        "bonus_value_match_brand": bonus_sql(match_brand=True),
        "bonus_value_legacy": bonus_sql(legacy=True),
        "cmv_retail": cost_sql(retail_body(), product),
        "cmv_salon": cost_sql(salon_body(), product),
        "cmv_unit_cost": cost_sql(unit_cost_body(), product),
        "cmv_unit_cost_by_brand": cost_sql(unit_cost_body(True), product + ", marca"),
        "cmv_legacy": cost_sql(LEGACY_COST, "cod_pedido, cod_produto"),
        "month_calendar": f"""{MART}, months AS (
              SELECT CAST(unnest(generate_series({ANCHOR} - INTERVAL 15 MONTH, {ANCHOR}, INTERVAL 1 MONTH))
                AS DATE) AS mes)
            SELECT mes, count(p.cod_pedido) AS qtd_pedido
            FROM months LEFT JOIN pedidos p ON {MONTH} = mes AND {VALID} AND {ORIGIN} GROUP BY mes""",
        "client_profile": f"SELECT * {MONEY_OUT} FROM ({MART} SELECT * FROM perfil_cliente)",
        "monthly_revenue": revenue_sql(),
        "monthly_revenue_by_seller": revenue_sql(seller=SELLER),
        "monthly_revenue_filtered": revenue_sql(**FILTERED),
        "monthly_revenue_by_named_seller": revenue_sql(seller=SELLER, names=NAMES),
        "monthly_revenue_legacy": revenue_sql(legacy=True),
        "monthly_series": MONTHLY_SERIES,
        "latest_month_kpis": LATEST_KPIS,
        "brand_performance": f"{MART} {brand_body()}",
        "brand_performance_filtered": f"{MART} {brand_body(channels=CHANNELS, ufs=UFS, names=NAMES)}",
        "brand_performance_legacy": BRAND_LEGACY,
        "brand_table": brand_table_sql(),
        "brand_table_selected": brand_table_sql(BRANDS),
        "channels_ufs": f"{MART} {pairs_body()}",
        "channels_ufs_of_seller": f"{MART} {pairs_body(SELLER)}",
        "channel_list": f"{MART} SELECT DISTINCT canal_venda FROM ({pairs_body()})",
        "uf_list": f"{MART} SELECT DISTINCT uf_empresa_faturamento FROM ({pairs_body()})",
        "sellers": sellers_sql(),
        "sellers_filtered": sellers_sql(channels=CHANNELS, ufs=UFS),
        "client_status": status_sql(),
        "client_status_filtered": status_sql(channels=CHANNELS, ufs=UFS, names=NAMES),
        "client_status_of_seller": status_sql(seller=SELLER),
        "client_purchase_dates": f"{MART}{status_ctes()} "
        "SELECT DISTINCT client AS cod_cliente, d AS dt_faturamento FROM bought",
        "last_purchase": f"{MART}{status_ctes()} "
        "SELECT client AS cod_cliente, d AS ultima_data_compra FROM last_day",
        "new_clients": status_sql("novas_aberturas"),
        "churned_clients": status_sql("churn"),
        "recovered_clients": status_sql("Recuperado"),
        "reactivated_clients": status_sql("Reativado"),
        "retained_clients": status_sql("Positivado"),
        "client_base": status_sql("Base"),
        "client_status_shares": STATUS_SHARES,
        "rfm_scores": scores_sql(),
        "rfm_scores_filtered": scores_sql(
            f"{in_list('Canal_Venda', CHANNELS)} AND {in_list('uf_empresa', UFS)}"
        ),
        "rfm_segments": segments_sql(4),
        "rfm_segments_drilldown": segments_sql(3),
        "rfm_summary": f"{MART} {summary_body()}",
        "rfm_summary_of_seller": f"{MART} " + summary_body(f"cod_colaborador_atual = '{SELLER}'"),
        "rfm_segment_clients": f"{MART} {clients_body(WANTED)}",
        "rfm_segment_view": f"""{MART} SELECT Cod_Cliente, Nome_Cliente, Recencia, Frequencia, Monetario,
            ticket_medio_posit AS ticket_medio, Mes_Ultima_Compra FROM ({clients_body(WANTED)})""",
        "rfm_segment_size": f"{MART} SELECT count(*) AS clientes FROM ({clients_body(WANTED)})",
        "rfm_segment_list": f"{MART} SELECT DISTINCT Segmento FROM ({summary_body()})",
        "rfm_heatmap": HEATMAP,
        "rfm_eleven_segments": ELEVEN,
    }
