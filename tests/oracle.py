"""Side-by-side comparison of a Spark result with DuckDB on the same Parquet files."""

from __future__ import annotations

import math
from collections import Counter

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    return con


def _plain(value):
    if isinstance(value, bool) or value is None or isinstance(value, str):
        return value
    if isinstance(value, float):
        return "nan" if math.isnan(value) else float(f"{value:.12g}")
    try:
        return float(value) if value == value.to_integral_value() or True else value
    except AttributeError:
        pass
    return float(value) if isinstance(value, int) else value


def difference(spark_df, con, sql: str) -> str | None:
    """None when equal as bags of rows, else a short description."""
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    expected_rows = cursor.fetchall()
    if sorted(names) != sorted(spark_df.columns):
        return f"columns {sorted(spark_df.columns)} != {sorted(names)}"
    order = sorted(names)
    where = [names.index(n) for n in order]
    expected = Counter(tuple(_plain(r[i]) for i in where) for r in expected_rows)
    got = Counter(tuple(_plain(v) for v in row) for row in spark_df.select(*[f"`{c}`" for c in order]).collect())
    if expected == got:
        return None
    missing, extra = list((expected - got).items())[:2], list((got - expected).items())[:2]
    return f"{sum(got.values())} rows, expected {sum(expected.values())}; missing {str(missing)[:600]}; extra {str(extra)[:600]}"
