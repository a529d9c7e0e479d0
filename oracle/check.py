"""Compare a Spark DataFrame with a DuckDB query over the same parquet tables."""

from __future__ import annotations

import hashlib
import math

import duckdb

from propval.sources.tables import TABLES, table_path


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{table_path(sf_dir, t)}')")
    return con


def _norm(v, digits):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return round(v, digits)
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x, digits) for x in v)
    return v


def rows_hash(rows, digits=6) -> str:
    keyed = sorted(repr(r) for r in rows)
    return hashlib.sha256("\n".join(keyed).encode()).hexdigest()


def normalized(rows, cols, digits=6):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return [tuple(_norm(r[i], digits) for i in order) for r in rows]


SPARK_TO_DUCK = {"LongType()": "BIGINT", "IntegerType()": "INTEGER", "DoubleType()": "DOUBLE",
                 "StringType()": "VARCHAR", "BooleanType()": "BOOLEAN", "TimestampNTZType()": "TIMESTAMP"}


def compare(spark_df, sql: str, sf_dir: str, digits: int = 6, con=None):
    """Return (ok, message). Column names and types must agree; rows compared order-insensitively."""
    s_cols = spark_df.columns
    s_types = {f.name: SPARK_TO_DUCK.get(repr(f.dataType), repr(f.dataType)) for f in spark_df.schema.fields}
    s_rows = [tuple(r) for r in spark_df.collect()]
    con = con or duck(sf_dir)
    res = con.execute(sql)
    d_cols = [c[0] for c in res.description]
    d_types = {c[0]: str(c[1]) for c in res.description}
    d_rows = res.fetchall()
    if sorted(s_cols) != sorted(d_cols):
        return False, f"columns differ: spark={sorted(s_cols)} duck={sorted(d_cols)}"
    bad_types = [(c, s_types[c], d_types[c]) for c in s_cols if s_types[c] != d_types[c]]
    if bad_types:
        return False, f"column types differ: {bad_types}"
    if len(s_rows) != len(d_rows):
        return False, f"row count differs: spark={len(s_rows)} duck={len(d_rows)}"
    a = sorted(normalized(s_rows, s_cols, digits), key=repr)
    b = sorted(normalized(d_rows, d_cols, digits), key=repr)
    if a == b:
        return True, f"ok ({len(a)} rows)"
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    names = sorted(s_cols)
    x, y = bad[0]
    diffs = [(names[i], x[i], y[i]) for i in range(len(names)) if x[i] != y[i]]
    return False, f"{len(bad)} rows differ; first diff: {diffs[:6]}"
