"""Compare a registered query with its SQL on the given tables."""

from __future__ import annotations

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET threads TO 8")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _key(v):
    if v is None:
        return (0, "")
    if isinstance(v, bool):
        return (1, int(v))
    if isinstance(v, (int, float)):
        return (1, -math.inf if isinstance(v, float) and math.isnan(v) else round(v, 6) if abs(v) < 1e15 else v)
    return (2, str(v))


def _same(a, b, tol):
    if isinstance(a, float) or isinstance(b, float):
        if a is None or b is None:
            return a is b
        if math.isnan(a) or math.isnan(b):
            return math.isnan(a) and math.isnan(b)
        return a == b or abs(a - b) <= tol * max(1.0, abs(a), abs(b))
    if isinstance(a, (list, tuple)) and isinstance(b, (list, tuple)):
        return len(a) == len(b) and all(_same(x, y, tol) for x, y in zip(a, b))
    return a == b


KINDS = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}


def compare(df, con, sql, tol=0.0):
    """List of differences, empty when equal."""
    cols = sorted(df.columns)
    got = [tuple(r[c] for c in cols) for r in df.collect()]
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    if sorted(names) != cols:
        return [f"columns {cols} vs {sorted(names)}"]
    types = {d[0]: str(d[1]) for d in cur.description}
    issues = []
    for n, t in df.dtypes:
        if t in KINDS and KINDS[t] != types[n]:
            issues.append(f"type {n}: {t} vs {types[n]}")
    idx = [names.index(c) for c in cols]
    want = [tuple(r[i] for i in idx) for r in cur.fetchall()]
    if len(got) != len(want):
        return issues + [f"rows {len(got)} vs {len(want)}"]
    got.sort(key=lambda r: tuple(map(_key, r)))
    want.sort(key=lambda r: tuple(map(_key, r)))
    for g, w in zip(got, want):
        if not all(_same(a, b, tol) for a, b in zip(g, w)):
            issues.append(f"{dict(zip(cols, g))} vs {dict(zip(cols, w))}")
            if len(issues) > 2:
                break
    return issues
