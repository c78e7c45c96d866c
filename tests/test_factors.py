"""Fits of many draws at once, against a loop of fits by plain steps."""

import numpy as np
import pytest

from tidewater.operators import factors as m


def design(spark):
    rng = np.random.default_rng(1)
    rows = [(str(rng.choice(["a", "b", "c"])), None if rng.random() < 0.1 else str(rng.integers(0, 2))) for _ in range(260)]
    rows = [(a, b, int(rng.random() < 1 / (1 + np.exp(-(-0.5 + 0.9 * (a == "b") + 0.4 * (b == "1")))))) for a, b in rows]
    return m.cells(spark.createDataFrame(rows, "f string, g string, y int"), "y", {"f": "a", "g": "0"}), rows


def plain(x, y):
    """Firth's fit over single rows by small steps of Newton's."""
    b = np.zeros(x.shape[1])
    for _ in range(400):
        p = 1 / (1 + np.exp(-x @ b))
        w = p * (1 - p)
        inverse = np.linalg.inv(x.T @ (w[:, None] * x))
        h = w * np.einsum("ri,ij,rj->r", x, inverse, x)
        b = b + 0.5 * inverse @ (x.T @ (y - p + h * (0.5 - p)))
    p = 1 / (1 + np.exp(-x @ b))
    return b, float((y * np.log(p) + (1 - y) * np.log(1 - p)).sum())


def rows_of(d, x, hits):
    """Cells as single rows."""
    n = d.n.astype(int)
    y = np.concatenate([np.r_[np.ones(int(h)), np.zeros(int(k - h))] for h, k in zip(hits, n)])
    return np.repeat(x, n, axis=0), y


def test_cells_are_counts_of_rows(spark):
    d, rows = design(spark)
    assert d.names == ["(constant)", "f=b", "f=c", "g=(none)", "g=1"] and d.n.sum() == 260 and d.hits.sum() == sum(r[2] for r in rows)
    with pytest.raises(ValueError):
        m.cells(spark.createDataFrame(rows, "f string, g string, y int"), "y", {"f": "zzz"})


def test_deviances_and_coefficients_are_those_of_a_loop(spark):
    d, _ = design(spark)
    draws = 40
    full, ll = plain(*rows_of(d, d.x, d.hits))
    got = {r.factor: r for r in m.deviances(spark, d, draws).collect()}
    for k, f in enumerate(d.columns):
        less, less_ll = plain(*rows_of(d, d.without(f), d.hits))
        observed = max(0.0, 2 * (ll - less_ll))
        assert abs(got[f].deviance - observed) < 1e-4 and got[f].dof == len(d.columns[f]) and got[f].settled == draws
        over = 0
        for hits in m.drawn(m.shares(d.without(f), less[None, :])[0], d.n, np.arange(draws), k):
            a, b = plain(*rows_of(d, d.x, hits))[1], plain(*rows_of(d, d.without(f), hits))[1]
            over += max(0.0, 2 * (a - b)) >= observed - 1e-12
        assert abs(got[f].p - (over + 1) / (draws + 1)) < 1e-12
    c = {r.term: r for r in m.coefficients(spark, d, draws).collect()}
    found = np.array([plain(*rows_of(d, d.x, hits))[0] for hits in m.drawn(m.shares(d.x, full[None, :])[0], d.n, np.arange(draws), 99)])
    for k, term in enumerate(d.names):
        want = (full[k], *np.quantile(found[:, k], [0.025, 0.975]))
        assert np.allclose((c[term].coef, c[term].low, c[term].high), want, atol=1e-4)


def test_separated_cells_stay_finite():
    x = np.array([[1.0, 0.0], [1.0, 1.0]])
    b, ok = m.fitted(x, np.array([20.0, 20.0]), np.array([[0.0, 20.0], [10.0, 10.0]]))
    assert ok.all() and np.isfinite(b).all() and abs(b[1]).max() < 1e-6 and b[0, 1] > 5
