"""Run a query and its SQL on the same tables and compare rows."""

from __future__ import annotations

import decimal
import math

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _plain(value):
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, (float, decimal.Decimal)):
        return None if math.isnan(value) else round(float(value), 6)
    if isinstance(value, int):
        return float(value)
    return str(value)


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(_plain(r[i]) for i in order) for r in rows]
    return [columns[i] for i in order], sorted(out, key=repr)


def compare(df, con, sql: str):
    """``(equal, message)``."""
    got_columns, got = _rows(df.columns, df.collect())
    result = con.execute(sql)
    want_columns, want = _rows([d[0] for d in result.description], result.fetchall())
    if got_columns != want_columns:
        return False, f"columns {got_columns} != {want_columns}"
    if got != want:
        only_got, only_want = sorted(set(got) - set(want), key=repr), sorted(set(want) - set(got), key=repr)
        return False, f"{len(got)} rows, SQL {len(want)}; only here {only_got[:3]}; only SQL {only_want[:3]}"
    return True, f"{len(got)} rows"
