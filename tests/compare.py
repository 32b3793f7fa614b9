"""Compare a Spark result with the same question asked in DuckDB."""

from __future__ import annotations

import math
import os
from collections import Counter

import duckdb

from wirelake.plans.tables import RAW

SPARK_TYPES = {
    "BIGINT": "bigint", "INTEGER": "int", "DOUBLE": "double", "VARCHAR": "string",
    "BOOLEAN": "boolean", "TIMESTAMP": "timestamp_ntz", "DATE": "date", "FLOAT": "float",
}


def connect(sf_dir: str):
    con = duckdb.connect()
    for name in RAW:
        path = os.path.join(sf_dir, f"{name}.parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def _norm(value):
    if isinstance(value, float):
        if math.isnan(value):
            return None
        return 0.0 if value == 0 else float(f"{value:.10g}")
    return value


def _bag(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(_norm(r[i]) for i in order) for r in rows)


def differences(df, con, sql: str) -> list[str]:
    """Empty when columns, types, row count and values agree."""
    result = con.execute(sql)
    want_cols = [d[0] for d in result.description]
    want_types = dict(zip(want_cols, [str(d[1]) for d in result.description]))
    want_rows = result.fetchall()
    problems = []
    if sorted(df.columns) != sorted(want_cols):
        return [f"columns {sorted(df.columns)} <> {sorted(want_cols)}"]
    for name, spark_type in df.dtypes:
        mapped = SPARK_TYPES.get(want_types[name], want_types[name])
        if mapped != spark_type:
            problems.append(f"type of {name}: {spark_type} <> {want_types[name]}")
    got_rows = [tuple(r) for r in df.collect()]
    if len(got_rows) != len(want_rows):
        problems.append(f"rows {len(got_rows)} <> {len(want_rows)}")
    got, want = _bag(df.columns, got_rows), _bag(want_cols, want_rows)
    if got != want:
        names = sorted(df.columns)
        problems.append(f"values differ {names}: only spark {list((got - want).items())[:2]} only sql {list((want - got).items())[:2]}")
    return problems
