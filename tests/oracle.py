"""Run a query in Spark and its SQL in DuckDB over the same tables and compare their rows."""

import decimal

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return "nan" if v != v else float(f"{v:.9g}")
    if isinstance(v, decimal.Decimal):
        return int(v) if v == int(v) else float(f"{float(v):.9g}")
    return v


def assert_same(df, sf_dir, sql):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    found = con.execute(sql)
    names = [c[0] for c in found.description]
    assert sorted(names) == sorted(df.columns)
    order = sorted(names)
    want = sorted(repr(tuple(plain(r[names.index(c)]) for c in order)) for r in found.fetchall())
    got = sorted(repr(tuple(plain(r[c]) for c in order)) for r in df.collect())
    assert got == want
