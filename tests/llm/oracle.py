"""A query's rows held against its SQL in DuckDB over the same tables."""

import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows_of(sql, sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    found = con.execute(sql)
    names = [c[0] for c in found.description]
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted((tuple(r[i] for i in order) for r in found.fetchall()), key=str)


def same(df, sql, sf_dir):
    names, want = rows_of(sql, sf_dir)
    got = sorted((tuple(r[c] for c in names) for r in df.select(*names).collect()), key=str)
    assert sorted(df.columns) == names
    assert len(got) == len(want)
    assert got == want
