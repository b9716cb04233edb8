"""Side-by-side run of catalog queries on Spark and of their SQL on DuckDB."""

from __future__ import annotations

import math

import duckdb

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark",
    "labels", "conversations",
)


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def _plain(v):
    if v is None:
        return (0, "")
    if isinstance(v, bool):
        return (1, str(v))
    if isinstance(v, (int, float)) or type(v).__name__ == "Decimal":
        f = float(v)
        return (2, "nan" if math.isnan(f) else f"{f:.9g}")
    return (3, str(v))


def _table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(_plain(r[i]) for i in order) for r in rows)


def differences(df, con, sql: str) -> list[str]:
    """Empty when both sides have the same columns and the same rows as a multiset."""
    names, spark_rows = _table(df.columns, df.collect())
    cursor = con.execute(sql)
    other, duck_rows = _table([d[0] for d in cursor.description], cursor.fetchall())
    if names != other:
        return [f"columns {sorted(set(names) ^ set(other))}"]
    if spark_rows == duck_rows:
        return []
    from collections import Counter
    a, b = Counter(spark_rows), Counter(duck_rows)
    def show(rows):
        return [dict(zip(names, [v for _, v in r])) for r in list(rows)[:2]]
    return [f"rows spark {len(spark_rows)} duck {len(duck_rows)}", f"only spark {sum((a - b).values())}: {show(a - b)}", f"only duck {sum((b - a).values())}: {show(b - a)}"]
