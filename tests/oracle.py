"""Comparison of queries with their SQL in DuckDB."""

import math
from datetime import date, datetime
from decimal import Decimal
from pathlib import Path

import duckdb


def canonical(value):
    if value is None or isinstance(value, bool | str):
        return value
    if isinstance(value, datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, date):
        return value.isoformat()
    if isinstance(value, Decimal | int):
        return float(value)
    if isinstance(value, float):
        return "nan" if math.isnan(value) else float(f"{value:.12g}")
    return str(value)


def rows(names, found):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted((tuple(canonical(r[i]) for i in order) for r in found), key=repr)


def duckdb_rows(sql, sf_dir):
    con = duckdb.connect()
    for path in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    cursor = con.execute(sql)
    return rows([d[0] for d in cursor.description], cursor.fetchall())


def spark_rows(df):
    return rows(df.columns, df.collect())
