"""Run one registered query and its SQL and compare the rows."""

import datetime
import decimal
import glob
import os
import time

import duckdb

import __spark_entry__ as entry


def database(folder):
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for path in glob.glob(f"{folder}/*.parquet"):
        con.execute(f"create view {os.path.basename(path)[:-8]} as select * from read_parquet('{path}')")
    return con


def _cell(value):
    if isinstance(value, (list, tuple, dict)):
        raise TypeError("query results should hold plain values")
    if isinstance(value, decimal.Decimal):
        raise TypeError("cast decimals")
    if isinstance(value, (datetime.date, datetime.datetime)):
        raise TypeError("format dates as text")
    kind = "number" if isinstance(value, (int, float)) and not isinstance(value, bool) else type(value).__name__
    return kind, repr(float(value)) if kind == "number" else str(value)


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(_cell(r[i]) for i in order) for r in rows)


def compare(spark, folder, name):
    """Returns (rows, seconds, message); the message is empty if both sides agree."""
    start = time.time()
    df = entry.queries()[name](spark, folder)
    rows = df.collect()
    seconds = time.time() - start
    sql = entry.oracle_sql().get(name)
    if sql is None:
        return len(rows), seconds, ""
    result = database(folder).execute(sql)
    names = [d[0] for d in result.description]
    if sorted(names) != sorted(df.columns):
        return len(rows), seconds, f"columns {sorted(df.columns)} != {sorted(names)}"
    types = {d[0]: str(d[1]) for d in result.description}
    bad = {n: t for n, t in types.items() if "HUGE" in t or "DECIMAL" in t}
    if bad:
        return len(rows), seconds, f"SQL types {bad}"
    got, want = rows_of(df.columns, rows), rows_of(names, result.fetchall())
    if got != want:
        extra, missing = sorted(set(got) - set(want))[:3], sorted(set(want) - set(got))[:3]
        return len(rows), seconds, f"{sorted(names)}\n{len(got)} rows, want {len(want)}\nextra {extra}\nmissing {missing}"
    return len(rows), seconds, ""
