"""Compares a query's rows with those that DuckDB gives for its SQL."""

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}") + 0.0
    if isinstance(v, dict):
        return tuple((k, plain(x)) for k, x in sorted(v.items()))
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if hasattr(v, "asDict"):
        return plain(v.asDict())
    if hasattr(v, "tzinfo") and v.tzinfo is not None:
        return v.replace(tzinfo=None)
    if type(v).__name__ == "Decimal":
        return plain(float(v)) if v != v.to_integral_value() else int(v)
    return bytes(v) if isinstance(v, bytearray) else v


def duck_rows(sql, sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    cur = con.execute(sql)
    names = [c[0] for c in cur.description]
    return names, cur.fetchall()


def agree(df, sql, sf_dir):
    names, theirs = duck_rows(sql, sf_dir)
    assert sorted(names) == sorted(df.columns), (sorted(names), sorted(df.columns))
    order = sorted(names)
    mine = sorted((tuple(plain(r[c]) for c in order) for r in df.collect()), key=repr)
    at = [names.index(c) for c in order]
    theirs = sorted((tuple(plain(r[k]) for k in at) for r in theirs), key=repr)
    assert len(mine) == len(theirs), (len(mine), len(theirs))
    wrong = [(a, b) for a, b in zip(mine, theirs) if a != b]
    assert not wrong, (order, wrong[:3])
    return len(mine)
