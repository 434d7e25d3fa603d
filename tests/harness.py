"""Run registered queries in Spark and in DuckDB and compare the rows."""

from __future__ import annotations

import datetime
import decimal
import math

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations").split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def plain(value):
    if isinstance(value, (float, decimal.Decimal)):
        value = float(value)
        if math.isnan(value):
            return None
        return 0.0 if value == 0 else value
    if isinstance(value, datetime.datetime):
        return value.isoformat(sep=" ")
    return value


def table(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    data = [tuple(plain(r[i]) for i in order) for r in rows]
    return [names[i] for i in order], sorted(data, key=repr)


def spark_rows(df):
    return table(df.columns, [tuple(r) for r in df.collect()])


def duck_rows(con, sql):
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    return table(names, result.fetchall())


def difference(spark_side, duck_side) -> str | None:
    """None when equal, types included; else a short description."""
    if spark_side[0] != duck_side[0]:
        return f"columns {spark_side[0]} vs {duck_side[0]}"
    if len(spark_side[1]) != len(duck_side[1]):
        return f"{len(spark_side[1])} rows vs {len(duck_side[1])}"
    for a, b in zip(spark_side[1], duck_side[1]):
        if a != b or [type(x) for x in a] != [type(x) for x in b]:
            return f"{len([1 for x, y in zip(spark_side[1], duck_side[1]) if x != y])} rows differ, first:\n  spark {a}\n  duck  {b}"
    return None
