"""Compare a query with its SQL, column by column, on the same Parquet tables."""

import datetime
import decimal
import math
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(x):
    if isinstance(x, (bool, str)) or x is None:
        return x
    if isinstance(x, decimal.Decimal):
        x = float(x)
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 6) + 0.0
    if isinstance(x, (list, tuple)):
        return tuple(map(plain, x))
    if isinstance(x, dict):
        return tuple(sorted((k, plain(v)) for k, v in x.items()))
    return x.isoformat() if isinstance(x, (datetime.date, datetime.datetime)) else x


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted((tuple(plain(r[i]) for i in order) for r in data), key=repr)


def expected(sql, sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        p = Path(sf_dir, f"{t}.parquet")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}{'/*' if p.is_dir() else ''}')")
    cur = con.execute(sql)
    return rows([c[0] for c in cur.description], cur.fetchall())


def difference(df, sql, sf_dir):
    """"" where both agree, else the first difference."""
    names, data = rows(df.columns, [tuple(r) for r in df.collect()])
    want_names, want = expected(sql, sf_dir)
    if names != want_names:
        return f"columns {names} but {want_names}"
    if len(data) != len(want):
        return f"{len(data)} rows but {len(want)}"
    for a, b in zip(data, want, strict=True):
        if a != b:
            return f"{a}\nbut\n{b}"
    return ""
