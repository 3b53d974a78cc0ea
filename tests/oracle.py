"""Run a query on Spark and its SQL on DuckDB over the same tables, and compare all rows."""

import datetime
import decimal
import math

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()

TYPES = {"string": "VARCHAR", "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "boolean": "BOOLEAN"}


def connection(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _plain(v):
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, float):
        return None if math.isnan(v) else v + 0.0
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return v


def _kind(v):
    return "num" if isinstance(v, (int, float)) and not isinstance(v, bool) else type(v).__name__


def normal(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(_plain(r[i]) for i in order) for r in rows]
    return [columns[i] for i in order], sorted(out, key=lambda r: tuple((v is None, str(v)) for v in r))


def compare(spark, con, name, fn, sql, sf_dir):
    """None when both sides are equal, else a text that says how they differ."""
    df = fn(spark, sf_dir)
    left = normal(df.columns, [tuple(r) for r in df.collect()])
    theirs = {r[0]: r[1] for r in con.execute("DESCRIBE " + sql).fetchall()}
    ours = {f.name: TYPES.get(f.dataType.simpleString()) for f in df.schema}
    if ours != theirs:
        return f"types {ours} / {theirs}"
    cur = con.execute(sql)
    right = normal([d[0] for d in cur.description], cur.fetchall())
    if left[0] != right[0]:
        return f"columns {left[0]} / {right[0]}"
    if len(left[1]) != len(right[1]):
        return f"rows {len(left[1])} / {len(right[1])}"
    for l, r in zip(left[1], right[1]):
        if l != r or [_kind(x) for x in l] != [_kind(x) for x in r]:
            return f"{left[0]}\n  spark {str(l)[:600]}\n  duck  {str(r)[:600]}"
    return None
