"""Runs registered queries next to their SQL, the way a reader would check them by hand."""

from __future__ import annotations

import math
import os
import re

import duckdb

from tidyshelf.plans.tables import TABLES


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{os.path.join(folder, name)}.parquet')")
    return con


KINDS = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN",
         "timestamp_ntz": "TIMESTAMP", "float": "FLOAT"}


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 9)
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_plain(r[i]) for i in order) for r in rows), key=lambda r: [(v is None, str(v)) for v in r])


def compare(spark, con, folder: str, build, sql: str) -> str | None:
    """None when rows, column names and types agree, else what differs."""
    df = build(spark, folder)
    got = rows_of(df.columns, df.collect())
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    kinds = {d[0]: str(d[1]) for d in cursor.description}
    want = rows_of(names, cursor.fetchall())
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} / {sorted(names)}"
    wrong = [(c, t, kinds[c]) for c, t in df.dtypes if KINDS.get(re.sub(r"\(.*", "", t), t) != kinds[c]]
    if wrong:
        return f"types {wrong}"
    if len(got) != len(want):
        return f"rows {len(got)} / {len(want)}"
    bad = [(g, w) for g, w in zip(got, want) if g != w]
    return f"values, {len(bad)} of {len(got)} rows, first {bad[0]}" if bad else None
