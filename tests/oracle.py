"""Run a query and its oracle on the same tables and compare all rows."""

from __future__ import annotations

import datetime
import decimal
import glob
import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def cell(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.10g}")
    if isinstance(v, datetime.datetime | datetime.date):
        return str(v)[:19]
    if isinstance(v, list | tuple):
        return tuple(cell(x) for x in v)
    return v


def oracle_rows(sql: str, sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{sf_dir}/{t}.parquet"):
            con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    rel = con.sql(sql)
    return list(rel.columns), rel.fetchall()


def differences(df, sql: str, sf_dir: str) -> str:
    names, want = oracle_rows(sql, sf_dir)
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)}, oracle {sorted(names)}"
    order = sorted(names)
    got = [tuple(cell(r[c]) for c in order) for r in df.collect()]
    want = [tuple(cell(r[names.index(c)]) for c in order) for r in want]
    key = lambda r: tuple((x is None, str(x)) for x in r)
    got.sort(key=key)
    want.sort(key=key)
    if len(got) != len(want):
        return f"{len(got)} rows, oracle {len(want)}; only ours {list(set(got) - set(want))[:3]}, only oracle {list(set(want) - set(got))[:3]}"
    if not want:
        return "no rows on either side: a match that proves nothing"
    bad = [(a, b) for a, b in zip(got, want, strict=True) if a != b]
    return f"{len(bad)} of {len(got)} rows differ: {bad[:3]}" if bad else ""
