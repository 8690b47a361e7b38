"""Run a query and its SQL side by side."""

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SMALL = "/root/testdata/sf0.001"


def plain(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else round(x, 6) + 0.0
    if isinstance(x, (bytes, bytearray)):
        return bytes(x).hex()
    if isinstance(x, (list, tuple)):
        return tuple(plain(y) for y in x)
    if isinstance(x, bool):
        return int(x)
    return str(x) if x is not None and not isinstance(x, (int, str)) else x


def run_sql(sql, sf_dir=SMALL, tables=None):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    for name, frame in (tables or {}).items():
        con.execute(f"DROP VIEW IF EXISTS {name}")
        con.register(name, frame)
    r = con.execute(sql)
    names = [d[0] for d in r.description]
    return names, r.fetchall()


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def assert_same(df, sql, sf_dir=SMALL):
    a = rows_of(df.columns, [tuple(r) for r in df.collect()])
    b = rows_of(*run_sql(sql, sf_dir))
    assert a[0] == b[0]
    assert len(a[1]) == len(b[1]), (len(a[1]), len(b[1]))
    wrong = [(x, y) for x, y in zip(a[1], b[1]) if x != y]
    assert not wrong, (len(wrong), a[0], wrong[:3])
