"""Compare a Spark result with DuckDB's answer to the oracle SQL on the same tables."""

from __future__ import annotations

import math

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _key(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(round(value, 9) + 0.0)
    if value is None:
        return "\x00null"
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, int):
        return str(value)
    return str(value)


def normalised(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_key(row[i]) for i in order) for row in rows)


def compare(spark_df, con, sql: str) -> str | None:
    """None for equal results, else a short description of the difference."""
    answer = con.execute(sql)
    oracle_columns = [d[0] for d in answer.description]
    expected = normalised(oracle_columns, answer.fetchall())
    got = normalised(spark_df.columns, [tuple(r) for r in spark_df.collect()])
    if sorted(spark_df.columns) != sorted(oracle_columns):
        return f"columns {sorted(spark_df.columns)} != {sorted(oracle_columns)}"
    if len(got) != len(expected):
        return f"{len(got)} rows, oracle {len(expected)}"
    different = [(g, e) for g, e in zip(got, expected) if g != e]
    return f"{len(different)} rows differ, first {different[0]}" if different else None
