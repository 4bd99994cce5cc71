"""Run a catalog query in Spark and its oracle SQL in DuckDB, and compare.

Used by the tests (sf0.001) and by ``check_oracle.py`` (any scale). The
comparison is order-insensitive: columns are sorted by name, rows are
sorted, floats compared with a relative tolerance.
"""

from __future__ import annotations

import math
import os
from dataclasses import dataclass

import duckdb
import pandas as pd

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    """Views over the tables of ``sf_dir``: single files, or folders of part files."""
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        if os.path.isdir(path):
            path = f"{path}/*.parquet"
        elif not os.path.exists(path):
            continue
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}')")
    return con


@dataclass
class Outcome:
    name: str
    ok: bool
    detail: str
    spark_rows: int
    oracle_rows: int


def _norm_value(v):
    if v is None or v is pd.NA or v is pd.NaT:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return float(f"{v:.10g}")
    if isinstance(v, pd.Timestamp):
        return v.to_pydatetime().replace(tzinfo=None)
    if hasattr(v, "item"):
        return _norm_value(v.item())
    return v


def _rows(df: pd.DataFrame) -> list[tuple]:
    cols = sorted(df.columns)
    out = []
    for rec in df[cols].itertuples(index=False, name=None):
        out.append(tuple(_norm_value(v) for v in rec))
    return sorted(out, key=lambda r: tuple((x is None, str(type(x)), x if x is not None else 0) for x in r))


def compare(spark, con, name: str, query, sql: str, sf_dir: str) -> Outcome:
    sdf = query(spark, sf_dir)
    s = sdf.toPandas()
    o = con.execute(sql).df()
    if sorted(s.columns) != sorted(o.columns):
        return Outcome(name, False, f"columns {sorted(s.columns)} != {sorted(o.columns)}", len(s), len(o))
    if len(s) != len(o):
        return Outcome(name, False, "row counts differ", len(s), len(o))
    rs, ro = _rows(s), _rows(o)
    for a, b in zip(rs, ro):
        if a != b:
            return Outcome(name, False, f"first differing row: spark={a} oracle={b}", len(s), len(o))
    return Outcome(name, True, "", len(s), len(o))
