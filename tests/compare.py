"""Run a query in Spark and its SQL in DuckDB, and compare every row and type."""

from collections import Counter
from decimal import Decimal

import duckdb

STAR_TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
               "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def connect(folder):
    con = duckdb.connect()
    con.execute("SET threads = 4")
    for table in STAR_TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    return con


def _value(v):
    # money compares exactly, scale included; text and numbers never mix
    return (type(v).__name__, str(v)) if isinstance(v, Decimal) else (type(v).__name__, v)


def rows_of_spark(df):
    names = sorted(df.columns)
    return names, Counter(tuple(_value(r[n]) for n in names) for r in df.collect())


def rows_of_duckdb(con, sql):
    cursor = con.execute(sql)
    columns = [d[0] for d in cursor.description]
    names = sorted(columns)
    order = [columns.index(n) for n in names]
    return names, Counter(tuple(_value(r[i]) for i in order) for r in cursor.fetchall())


def difference(df, con, sql):
    """None when equal, else a short account of what differs."""
    names, got = rows_of_spark(df)
    expected_names, expected = rows_of_duckdb(con, sql)
    if names != expected_names:
        return f"columns {names} != {expected_names}"
    if got != expected:
        extra, missing = got - expected, expected - got
        return (f"{sum(got.values())} rows, expected {sum(expected.values())}; "
                f"{sum(extra.values())} extra, {sum(missing.values())} missing\n"
                f"columns  {names}\nextra    {sorted(map(str, extra))[:3]}\n"
                f"missing  {sorted(map(str, missing))[:3]}")
    return None
