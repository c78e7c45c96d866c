"""Every query against its SQL in DuckDB; those without SQL give rows and a stable schema."""

import glob
import os

import duckdb
import pytest
from pyspark.sql import functions as F

from tidewater import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


def plain(v):
    return 0.0 if isinstance(v, float) and v == 0 else v


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_as_its_sql(spark, con, name):
    df = registry.QUERIES[name](spark, SF)
    found = con.execute(registry.ORACLES[name])
    names = [c[0] for c in found.description]
    assert sorted(df.columns) == sorted(names)
    want = sorted((tuple(plain(v) for v in r) for r in found.fetchall()), key=repr)
    got = sorted((tuple(plain(r[c]) for c in names) for r in df.collect()), key=repr)
    assert len(got) == len(want)
    assert got == want


@pytest.fixture(scope="module")
def shuffled(spark, tmp_path_factory):
    """The same tables with their rows in another order, in several files."""
    at = tmp_path_factory.mktemp("shuffled")
    for f in glob.glob(f"{SF}/*.parquet"):
        spark.read.parquet(f).orderBy(F.rand(seed=5)).repartition(3).write.parquet(f"{at}/{os.path.basename(f)}")
    return str(at)


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_query_without_sql(spark, shuffled, name):
    """The same rows from the same tables in another order; none of them all null."""
    df = registry.QUERIES[name](spark, SF)
    rows = sorted(map(tuple, df.collect()), key=repr)
    assert df.columns and all(any(v is not None for v in r) for r in rows)
    again = sorted(map(tuple, registry.QUERIES[name](spark, shuffled).collect()), key=repr)
    assert len(again) == len(rows)
    for a, b in zip(rows, again):
        for x, y in zip(a, b):
            assert x == y or isinstance(x, float) and abs(x - y) <= 1e-6 * max(1.0, abs(x))
