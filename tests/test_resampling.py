"""Random subsets of exact sizes, against subsets taken by sorting."""

import numpy as np
import pytest

from tidewater.operators import resampling as m


def table(spark, n, size=3, parts=3, seed=1):
    rng = np.random.default_rng(seed)
    ids = rng.permutation(5 * n)[:n].tolist()
    return spark.createDataFrame([(i, rng.normal(size=size).tolist()) for i in ids], "id long, v array<double>").repartition(parts)


def plain(rows, size, draws, expand=lambda x: x):
    found = rows.select("id", m.row_number("id").alias("h"), "v").collect()
    ids, h, x = np.array([r.id for r in found]), np.array([r.h for r in found]), expand(np.array([r.v for r in found]))
    out = []
    for d in range(1, draws + 1):
        u = m.place(h, np.array([d]))[:, 0]
        out.append(x[np.lexsort((ids, u))[:size]].sum(0))
    return np.array(out)


def got(df):
    rows = sorted(df.collect())
    assert [r.draw for r in rows] == list(range(1, len(rows) + 1))
    return np.array([r.sums for r in rows])


@pytest.mark.parametrize(("n", "size"), [(2, 1), (40, 39), (700, 210), (5000, 17)])
def test_sums_are_those_of_sorted_rows(spark, monkeypatch, n, size):
    monkeypatch.setattr(m, "DRAWS", 16)
    rows = table(spark, n)
    assert np.allclose(got(m.subset_sums(rows, "id", "v", size, 40)), plain(rows, size, 40), atol=1e-9)
    assert np.allclose(got(m.subset_sums(rows, "id", "v", size, 20, m.squares)), plain(rows, size, 20, m.squares), atol=1e-9)


def test_rows_of_one_number_come_by_id(spark, monkeypatch):
    """All rows have one of three numbers: sizes stay exact."""
    monkeypatch.setattr(m, "row_number", lambda id: m.F.pmod(m.F.col(id), m.F.lit(3)))
    rows = table(spark, 300)
    assert np.allclose(got(m.subset_sums(rows, "id", "v", 77, 30)), plain(rows, 77, 30), atol=1e-9)


def test_sizes_that_are_no_subset_are_refused(spark):
    for size in (0, 5, 9):
        with pytest.raises(ValueError):
            m.subset_sums(table(spark, 5), "id", "v", size, 3)


def test_what_is_kept_of_draws_does_not_grow_with_rows(spark):
    """Rows that are put in order: a few a draw, however many rows there are."""
    draws = 50
    for n in (2_000, 32_000):
        kept = table(spark, n).select("id", m.row_number("id").alias("h"), "v")
        edge, before, width = m._edges(kept, n, n // 3, draws)
        h = np.array([r.h for r in kept.select("h").collect()])
        u = m.place(h, np.arange(draws) + 1)
        inside = ((u >= edge.astype("u8")) & (u < (edge + width).astype("u8"))).sum()
        assert inside <= 12 * draws and ((u < edge.astype("u8")).sum(0) == before).all()


def test_numbers_are_spread_and_sql_makes_them_too():
    import duckdb

    h = np.array([0, 1, 2**31, 2**32 - 1, 123456789])
    want = m.place(h, np.array([1, 2, 5000]))
    sql = ", ".join(f"{m.place_sql(f'{x}::BIGINT', str(d))}" for x in h.tolist() for d in (1, 2, 5000))
    assert list(duckdb.sql(f"SELECT {sql}").fetchall()[0]) == want.ravel().tolist()
    u = m.place(np.arange(4000), np.arange(1, 9)) / 2**32
    assert abs(np.corrcoef(u.T) - np.eye(8)).max() < 0.06 and abs(u.mean(0) - 0.5).max() < 0.02


def test_correlations_are_numpys():
    x = np.random.default_rng(3).normal(size=(60, 5))
    x[:, 2] = 4.0
    sums = m.squares(x).sum(0)[None, :]
    with np.errstate(all="ignore"):
        want = np.nan_to_num(np.corrcoef(x.T))[np.triu_indices(5, 1)]
    assert np.allclose(m.correlations(sums, 60, 5)[0], want, atol=1e-9)
