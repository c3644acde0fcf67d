"""Compare a Spark result with the same query in DuckDB: rows, column names, values."""

from __future__ import annotations

import datetime as dt
import decimal
import math
from collections import Counter

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from '{sf_dir}/{name}.parquet'")
    return con


def _plain(value):
    if value is None or isinstance(value, (bool, str)):
        return value
    if isinstance(value, decimal.Decimal):
        value = float(value)
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return round(value, 6) if value != int(value) else int(value)
    if isinstance(value, (bytes, bytearray)):
        return bytes(value).hex()
    if isinstance(value, dt.datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, (list, tuple)):
        return tuple(_plain(v) for v in value)
    return value


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], Counter(
        tuple(_plain(row[i]) for i in order) for row in rows
    )


def difference(spark_df, con, sql: str, show: int = 3) -> str | None:
    """None when both agree, else a short description."""
    want = con.execute(sql)
    want_names, want_rows = rows_of([d[0] for d in want.description], want.fetchall())
    got_names, got_rows = rows_of(spark_df.columns, spark_df.collect())
    if got_names != want_names:
        return f"columns {got_names} != {want_names}"
    if got_rows == want_rows:
        return None
    extra = list((got_rows - want_rows).items())[:show]
    missing = list((want_rows - got_rows).items())[:show]
    return (
        f"{sum(got_rows.values())} rows, expected {sum(want_rows.values())}; "
        f"extra {extra}; missing {missing}"
    )
