"""Side-by-side check of a registered query against its DuckDB SQL twin.

Mirrors what the driver does: same parquet tables, columns sorted by name,
rows compared as an order-insensitive multiset.
"""

from __future__ import annotations

import datetime as dt
import decimal
import math
from collections import Counter

from pyspark.sql import SparkSession

from .sources.tables import TABLES, table_path


def _norm(v):
    if isinstance(v, float):
        if math.isnan(v):
            return "NaN"
        return float(repr(v)) if v != 0 else 0.0
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, dt.datetime):
        return v.isoformat()
    if isinstance(v, dt.date):
        return v.isoformat()
    return v


def duckdb_connection(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{table_path(sf_dir, name)}')")
    return con


def run_oracle(con, sql: str) -> tuple[list[str], list[tuple]]:
    cur = con.execute(sql)
    cols = [d[0] for d in cur.description]
    return cols, cur.fetchall()


def compare(spark: SparkSession, sf_dir: str, name: str, query, sql: str, con=None) -> dict:
    con = con or duckdb_connection(sf_dir)
    df = query(spark, sf_dir)
    s_cols = df.columns
    s_rows = [tuple(r) for r in df.collect()]
    o_cols, o_rows = run_oracle(con, sql)
    out = {"name": name, "spark_rows": len(s_rows), "oracle_rows": len(o_rows)}
    if sorted(s_cols) != sorted(o_cols):
        out.update(ok=False, reason=f"columns differ: spark={s_cols} oracle={o_cols}")
        return out
    order = sorted(s_cols)
    si = [s_cols.index(c) for c in order]
    oi = [o_cols.index(c) for c in order]
    sc = Counter(tuple(_norm(r[i]) for i in si) for r in s_rows)
    oc = Counter(tuple(_norm(r[i]) for i in oi) for r in o_rows)
    if sc == oc:
        out.update(ok=True)
    else:
        only_s = list((sc - oc).elements())[:5]
        only_o = list((oc - sc).elements())[:5]
        out.update(ok=False, reason="values differ", columns=order, only_spark=only_s, only_oracle=only_o,
                   n_only_spark=sum((sc - oc).values()), n_only_oracle=sum((oc - sc).values()))
    return out
