"""Declared columns of the nine mart tables: name and Spark SQL type."""

from __future__ import annotations

from salescope.functions.numeric import AMOUNT, FACTOR

#: An identifier that is only counted and compared keeps the type of its source,
#: as leading zeros tell two codes apart.
IDENTIFIER = "identifier"

SCHEMAS: dict[str, dict[str, str]] = {
    "pedidos": {
        "cod_pedido": "bigint",
        "cpfcnpj": IDENTIFIER,
        "dt_faturamento": "date",
        "desc_abrev_cfop": "string",
        "operacoes_internas": "string",
        "origem": "string",
        "canal_venda": "string",
    },
    "item_pedidos": {
        "cod_pedido": "bigint",
        "cod_produto": IDENTIFIER,
        "sku": "string",
        "marca": "string",
        "qtd": AMOUNT,
        "preco_total": AMOUNT,
        "preco_desconto_rateado": AMOUNT,
    },
    "empresa_pedido": {
        "cod_pedido": "bigint",
        "cod_empresa_faturamento": "string",
        "nome_empresa_faturamento": "string",
        "uf_empresa_faturamento": "string",
        "cod_colaborador_atual": "string",
        "nome_colaborador_atual": "string",
        "nome_colaborador_pedido": "string",
        "equipes": "string",
    },
    "bonificacao": {
        "cod_empresa": "int",
        "mes_ref": "date",
        "cod_marca": "int",
        "marca": "string",
        "fator": FACTOR,
    },
    "varejo_marca": {"cod_marca": "int", "desc_abrev": "string"},
    "varejo_cmv": {
        "cod_pedido": "bigint",
        "cod_produto": "string",
        "dt_faturamento": "date",
        "qtd": AMOUNT,
        "custo_unitario": AMOUNT,
        "cod_marca": "int",
        "cod_empresa": "string",
    },
    "pedidos_salao": {
        "cod_pedido": "bigint",
        "codprod": "string",
        "dtvenda": "date",
        "quant": AMOUNT,
        "custo": AMOUNT,
        "categoria": "string",
    },
    "perfil_cliente": {
        "Cod_Cliente": IDENTIFIER,
        "Nome_Cliente": "string",
        "uf_empresa": "string",
        "Canal_Venda": "string",
        "Recencia": "int",
        "Positivacao": "int",
        "Monetario": AMOUNT,
        "ticket_medio_posit": AMOUNT,
        "Maior_Mes": "date",
        "Ciclo_Vida": "int",
    },
    "cliente_vendedor": {"cod_cliente": IDENTIFIER, "cod_colaborador_atual": "string"},
}
