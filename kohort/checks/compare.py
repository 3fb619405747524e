"""Order-insensitive comparison of a Spark result with its DuckDB oracle."""

from __future__ import annotations

import math


def norm(v):
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return round(v, 6) + 0.0
    if hasattr(v, "isoformat"):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, norm(x)) for k, x in v.items()))
    if hasattr(v, "asDict"):
        return norm(v.asDict())
    return v


def rows_key(rows, cols):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    out = [tuple(norm(r[i]) for i in order) for r in rows]
    return sorted(out, key=lambda t: tuple((x is None, str(type(x)), str(x)) for x in t))


def duckdb_views(sf_dir: str):
    import duckdb
    from kohort.sources.tables import TABLES
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def compare(df, con, sql: str) -> list[str]:
    """Problems found (empty when the results match)."""
    srows, scols = [tuple(r) for r in df.collect()], df.columns
    res = con.sql(sql)
    ocols, orows = res.columns, res.fetchall()
    problems = []
    if sorted(scols) != sorted(ocols):
        problems.append(f"cols spark={sorted(scols)} oracle={sorted(ocols)}")
    if len(srows) != len(orows):
        problems.append(f"rows spark={len(srows)} oracle={len(orows)}")
    if not problems:
        a, b = rows_key(srows, scols), rows_key(orows, ocols)
        if a != b:
            problems.append(f"values differ e.g. {[(x, y) for x, y in zip(a, b) if x != y][:2]}")
    return problems
