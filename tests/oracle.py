"""Rows of a query against those of its SQL in DuckDB: names, types and values."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb

TYPES = {"bigint": "BIGINT", "int": "INTEGER", "smallint": "SMALLINT", "double": "DOUBLE", "float": "FLOAT", "string": "VARCHAR", "boolean": "BOOLEAN", "date": "DATE", "timestamp": "TIMESTAMP"}
DATA = "/root/testdata"


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'; SET threads = 2")
    for p in sorted(Path(sf_dir).glob("*.parquet")):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else 0.0 if v == 0 else v
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v


def same(a, b) -> bool:
    if isinstance(a, float) and isinstance(b, float):
        return a == b or math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-9)
    return a == b


def difference(spark_df, con: duckdb.DuckDBPyConnection, sql: str) -> str:
    """Empty if all is equal, else what differs first."""
    got = con.execute(sql)
    names = [d[0] for d in got.description]
    kinds = dict(zip(names, (str(d[1]) for d in got.description), strict=True))
    if sorted(names) != sorted(spark_df.columns):
        return f"columns {sorted(spark_df.columns)} and {sorted(names)}"
    kinds = dict(con.execute(f"SELECT column_name, column_type FROM (DESCRIBE {sql})").fetchall())
    for c, t in spark_df.dtypes:
        if TYPES.get(t, kinds[c]) != kinds[c] and not (t == "timestamp" and kinds[c].startswith("TIMESTAMP")):
            return f"type of {c}: {t} and {kinds[c]}"
    order = sorted(names)
    key = lambda row: tuple((v is None, str(type(v)), v if not isinstance(v, float) else round(v, 4)) for v in row)
    at = [names.index(c) for c in order]
    theirs = sorted((tuple(plain(r[i]) for i in at) for r in con.execute(sql).fetchall()), key=key)
    ours = sorted((tuple(map(plain, r)) for r in spark_df.select(*order).collect()), key=key)
    if len(ours) != len(theirs):
        return f"{len(ours)} and {len(theirs)} rows"
    for x, y in zip(ours, theirs, strict=True):
        if not all(map(same, x, y)):
            return f"{dict(zip(order, x, strict=True))} and {dict(zip(order, y, strict=True))}"
    return ""
