"""Compare a registered query with its SQL on the same tables."""

from __future__ import annotations

import math
import time

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()

TIMES: list[float] = []


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _value(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return int(v)
    if isinstance(v, (float, int)) or type(v).__name__ == "Decimal":
        x = float(v)
        return "nan" if math.isnan(x) else float(f"{x:.9g}") + 0.0
    return str(v)


def _rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(_value(r[i]) for i in order) for r in rows), key=repr)


def compare(df, con, sql: str):
    """None when both give the same columns and rows, else a short difference."""
    got_names, got = df.columns, [tuple(r) for r in df.collect()]
    TIMES.append(time.time())
    cur = con.execute(sql)
    want_names, want = [c[0] for c in cur.description], cur.fetchall()
    if sorted(got_names) != sorted(want_names):
        return f"columns {sorted(got_names)} != {sorted(want_names)}"
    a, b = _rows(got_names, got), _rows(want_names, want)
    if len(a) != len(b):
        return f"{len(a)} rows != {len(b)}"
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    return None if not bad else f"{len(bad)}/{len(a)} rows differ, first {bad[0]}"
