"""Running SQL twins in DuckDB and comparing rows."""

import math
import os

import duckdb


def rows_of(sql: str, sf_dir: str):
    c = duckdb.connect()
    for t in os.listdir(sf_dir):
        c.sql(f"CREATE VIEW {t.removesuffix('.parquet')} AS SELECT * FROM '{sf_dir}/{t}'")
    r = c.sql(sql)
    return list(r.columns), r.fetchall()


def plain(x):
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 6)
    if hasattr(x, "__float__") and not isinstance(x, (int, bool)):
        return round(float(x), 6)
    return x


def same(df, sql: str, sf_dir: str) -> None:
    cols, want = rows_of(sql, sf_dir)
    assert sorted(df.columns) == sorted(cols)
    names = sorted(cols)
    got = sorted(([plain(r[c]) for c in names] for r in df.collect()), key=str)
    at = [cols.index(c) for c in names]
    assert got == sorted(([plain(r[i]) for i in at] for r in want), key=str)
