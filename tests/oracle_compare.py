"""Spark-vs-DuckDB comparison used by the tests and ``check_oracle.py``.

Mirrors the driver's gate: same column names, same row count and the same
order-insensitive multiset of rows (columns sorted by name).
"""

from __future__ import annotations

import math
import os

import duckdb

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        p = os.path.join(sf_dir, f"{t}.parquet")
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def _norm(v):
    if v is None:
        return "<null>"
    if isinstance(v, float):
        if math.isnan(v):
            return "<null>"
        return f"{v:.6g}"
    if hasattr(v, "item"):
        v = v.item()
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, float):
        return f"{v:.6g}"
    return str(v)


def rows_of(columns, records):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_norm(r[i]) for i in order) for r in records)


def compare(spark, con, sf_dir: str, fn, sql: str | None):
    sdf = fn(spark, sf_dir)
    s_cols = sdf.columns
    s_rows = [tuple(r) for r in sdf.collect()]
    if sql is None:
        return {"ok": True, "rows": len(s_rows), "oracle": False}
    rel = con.sql(sql)
    d_cols = rel.columns
    d_types = dict(zip(d_cols, [str(t) for t in rel.types]))
    d_rows = rel.fetchall()
    family = {"double": "DOUBLE", "bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "boolean": "BOOLEAN"}
    s_types = {f.name: family.get(f.dataType.simpleString(), f.dataType.simpleString())
               for f in sdf.schema.fields}
    res = {"rows": len(s_rows), "oracle_rows": len(d_rows),
           "cols_ok": sorted(s_cols) == sorted(d_cols) and s_types == d_types, "oracle": True}
    if not res["cols_ok"]:
        res["ok"] = False
        res["detail"] = f"spark {sorted(s_types.items())} vs sql {sorted(d_types.items())}"
        return res
    a, b = rows_of(s_cols, s_rows), rows_of(d_cols, d_rows)
    res["ok"] = a == b
    if not res["ok"]:
        sa, sb = set(a), set(b)
        res["detail"] = {"only_spark": sorted(sa - sb)[:3], "only_sql": sorted(sb - sa)[:3],
                         "cols": sorted(s_cols)}
    return res
