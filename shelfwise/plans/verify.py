"""Result comparison used by the oracle checker and the tests.

Rows are compared order-insensitively after normalising values (decimals and
doubles to 6 places, dates and timestamps to ISO text, nested values to tuples).
"""

from __future__ import annotations

import datetime as dt
import decimal
import math

from shelfwise.sources.views import RAW_TABLES


def norm(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, int):
        return v
    if isinstance(v, (float, decimal.Decimal)):
        f = float(v)
        return None if math.isnan(f) else round(f, 6)
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, dt.date):
        return v.isoformat()
    if isinstance(v, dict):
        return tuple(sorted((str(k), norm(x)) for k, x in v.items()))
    if hasattr(v, "asDict"):
        return tuple(norm(x) for x in v)
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    return str(v)


def rows_key(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((tuple(norm(r[i]) for i in order) for r in rows), key=repr)


def duckdb_connection(sf_dir: str):
    import duckdb
    con = duckdb.connect()
    for t in RAW_TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir.rstrip('/')}/{t}.parquet')")
    return con


def compare(sdf, sql: str, con) -> list[str]:
    """Problems found comparing a Spark DataFrame with DuckDB's answer to ``sql``."""
    scols, srows = sdf.columns, sdf.collect()
    cur = con.execute(sql)
    dcols = [d[0] for d in cur.description]
    drows = cur.fetchall()
    problems = []
    if sorted(scols) != sorted(dcols):
        problems.append(f"columns spark={scols} duckdb={dcols}")
    if len(srows) != len(drows):
        problems.append(f"rows spark={len(srows)} duckdb={len(drows)}")
    if not problems:
        a, b = rows_key(scols, srows), rows_key(dcols, drows)
        if a != b:
            diff = [(x, y) for x, y in zip(a, b) if x != y][:2]
            problems.append(f"values differ, e.g. {diff}")
    return problems
