"""DuckDB beside Spark on the same tables."""

from pathlib import Path

import duckdb


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    for p in Path(sf_dir).glob("*.parquet"):
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}{'/*.parquet' if p.is_dir() else ''}'")
    return con


def _plain(v):
    if isinstance(v, float):
        return round(v, 6) + 0.0
    if isinstance(v, list | tuple):
        return tuple(_plain(x) for x in v)
    return bytes(v) if isinstance(v, bytearray) else v


def rows(columns, values, order):
    at = [columns.index(c) for c in order]
    return sorted(repr(tuple(_plain(r[i]) for i in at)) for r in values)


def agree(df, con, sql) -> None:
    names = sorted(df.columns)
    found = con.sql(sql)
    assert names == sorted(found.columns)
    assert rows(df.columns, [tuple(r) for r in df.collect()], names) == rows(found.columns, found.fetchall(), names)
