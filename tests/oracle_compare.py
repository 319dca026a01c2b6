"""Run a query and its SQL side by side and compare all rows exactly."""

from __future__ import annotations

import math

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value)
    if value is None or isinstance(value, (str, bool, int)):
        return value
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return str(value)


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    cells = [tuple(plain(row[i]) for i in order) for row in rows]
    return [columns[i] for i in order], sorted(cells, key=repr)


# Spark type name -> the DuckDB type it must meet.
TYPES = {
    "int": "INTEGER",
    "bigint": "BIGINT",
    "double": "DOUBLE",
    "string": "VARCHAR",
    "boolean": "BOOLEAN",
}


def differences(spark_df, con, sql: str, limit: int = 3) -> list[str]:
    found = []
    relation = con.sql(sql)
    expected_columns, expected = table(relation.columns, relation.fetchall())
    columns, actual = table(spark_df.columns, [tuple(r) for r in spark_df.collect()])
    if columns != expected_columns:
        return [f"columns {columns} != {expected_columns}"]
    relation_types = dict(zip(relation.columns, map(str, relation.types)))
    for name, kind in spark_df.dtypes:
        if TYPES.get(kind, kind) != relation_types[name]:
            found.append(f"type of {name}: {kind} != {relation_types[name]}")
    if len(actual) != len(expected):
        found.append(f"rows {len(actual)} != {len(expected)}")
    if actual != expected:
        pairs = [(a, e) for a, e in zip(actual, expected) if a != e]
        found += [f"{a}\n    != {e}" for a, e in pairs[:limit]]
    return found
