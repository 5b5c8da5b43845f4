"""Run one registered query on Spark and its SQL on DuckDB and compare rows exactly."""

from __future__ import annotations

import glob
import os
from collections import Counter

import duckdb


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def duck_rows(con, sql: str) -> tuple[list[str], Counter]:
    rel = con.execute(sql)
    names = [d[0] for d in rel.description]
    return _canonical(names, rel.fetchall())


def spark_rows(df) -> tuple[list[str], Counter]:
    return _canonical(df.columns, [tuple(r) for r in df.collect()])


def _canonical(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    cells = (tuple((type(r[i]).__name__, r[i]) for i in order) for r in rows)
    return [names[i] for i in order], Counter(cells)
