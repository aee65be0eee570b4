"""Run registered queries beside their SQL and compare rows."""

from __future__ import annotations

import math

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(
            f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')"
        )
    return connection


def _value(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else round(x, 5) + 0.0
    return x


def rows_of(columns, rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    cells = [tuple(_value(row[i]) for i in order) for row in rows]
    return sorted(cells, key=lambda row: tuple((v is None, str(v)) for v in row))


def kinds_of(columns, types) -> dict[str, str]:
    return {c: str(t).lower() for c, t in zip(columns, types, strict=True)}


SAME_KIND = {
    "bigint": "bigint", "int": "integer", "string": "varchar", "double": "double",
    "boolean": "boolean",
}


def compare(spark, connection, sf_dir: str, function, sql: str) -> str | None:
    """None if both agree, else what differs."""
    df = function(spark, sf_dir)
    mine = rows_of(df.columns, df.collect())
    cursor = connection.execute(sql)
    columns = [d[0] for d in cursor.description]
    theirs = rows_of(columns, cursor.fetchall())
    if sorted(columns) != sorted(df.columns):
        return f"columns {sorted(df.columns)} / {sorted(columns)}"
    kinds = {d[0]: str(d[1]).lower() for d in cursor.description}
    for name, kind in df.dtypes:
        if SAME_KIND.get(kind, kind) != kinds[name]:
            return f"type of {name}: {kind} / {kinds[name]}"
    if len(mine) != len(theirs):
        return f"rows {len(mine)} / {len(theirs)}"
    for a, b in zip(mine, theirs, strict=True):
        if a != b:
            return f"first difference {str(a)[:500]} / {str(b)[:500]}"
    return None
