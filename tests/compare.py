"""Compare a Spark result with a DuckDB one, whatever the order of rows and columns."""

from __future__ import annotations

import glob
import math
import os

import duckdb


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def _cell(value):
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return str(int(value))
    if isinstance(value, float):
        return "NaN" if math.isnan(value) else repr(round(value + 0.0, 6))
    if isinstance(value, int):
        return repr(float(value))
    return str(value)


def rows_of(columns, records):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_cell(r[i]) for i in order) for r in records)


def difference(spark_df, con, sql: str) -> str | None:
    """None when equal, else a short account of what differs."""
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    if sorted(names) != sorted(spark_df.columns):
        return f"columns {sorted(spark_df.columns)} against {sorted(names)}"
    wanted = rows_of(names, result.fetchall())
    found = rows_of(spark_df.columns, spark_df.collect())
    if len(wanted) != len(found):
        return f"{len(found)} rows against {len(wanted)}"
    wrong = [(a, b) for a, b in zip(found, wanted) if a != b]
    if wrong:
        return f"{len(wrong)} rows differ, first {wrong[0]}"
    return None
