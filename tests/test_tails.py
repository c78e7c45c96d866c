"""Tails against sums of probabilities, closed forms and relations that hold at any size."""

import math
import time

import numpy as np
import pytest

from tidewater.functions import tails as m


def binomial_tail(k, n, p):
    """P(X >= k)."""
    return math.fsum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k, n + 1))


@pytest.mark.parametrize("n", [1, 5, 30, 200])
def test_beta_shares_are_binomial_sums(n):
    for k in {1, max(1, n // 3), n}:
        for p in (1e-6, 0.05, 0.5, 0.93):
            assert abs(m.beta_share([k], [n - k + 1], [p])[0] - binomial_tail(k, n, p)) < 1e-12


def test_bounds_are_those_of_binomial_sums():
    n = 30
    low, high = m.share_bounds(np.arange(n + 1), np.full(n + 1, n))
    assert low[0] == 0 and high[n] == 1
    for k in range(n + 1):
        if k:
            assert abs(binomial_tail(k, n, low[k]) - 0.025) < 1e-9
        if k < n:
            assert abs(1 - binomial_tail(k + 1, n, high[k]) - 0.025) < 1e-9


def test_large_numbers_are_fast_and_near_the_normal():
    began = time.time()
    n = np.array([10**5, 10**7, 10**9, 10**9, 10**9, 10**9])
    hits = np.array([50_000, 10**6, 5 * 10**8, 0, 10**9, 3])
    low, high = m.share_bounds(hits, n)
    assert time.time() - began < 2 and np.isfinite(low).all() and np.isfinite(high).all()
    p, z = hits[:3] / n[:3], 1.959963984540054
    half = z * np.sqrt(p * (1 - p) / n[:3])
    assert (abs((high - low)[:3] / (2 * half) - 1) < 1e-2 * np.sqrt(1e5 / n[:3]) + 1e-4).all()
    # of few or no hits what a Poisson variable has
    assert abs(high[3] * 1e9 - -math.log(0.025)) < 1e-6 and abs((1 - low[4]) * 1e9 - -math.log(0.025)) < 1e-5
    x = low[5] * 1e9
    assert abs(1 - math.exp(-x) * (1 + x + x * x / 2) - 0.025) < 1e-7


def test_both_ways_of_the_beta_share_agree():
    a = np.array([60.0, 300, 900, 1900])
    for q in (-3, -0.5, 0.0, 1.0, 4.0):
        b = np.full(4, 1990.0)
        mean = a / (a + b)
        x = mean + q * np.sqrt(mean * (1 - mean) / (a + b))
        assert np.allclose(m._summed(a, b, x), m.beta_share(a, b, x), atol=1e-11)


def test_gamma_tails():
    for dof in (1, 2, 3, 10, 61):
        for x in (0.0, 0.3, 2.0, 15.0, 90.0):
            if dof % 2 == 0:
                want = math.exp(-x / 2) * math.fsum((x / 2) ** i / math.factorial(i) for i in range(dof // 2))
            else:
                want = math.erfc(math.sqrt(x / 2)) + math.exp(-x / 2) * math.fsum((x / 2) ** (i + 0.5) / math.gamma(i + 1.5) for i in range(dof // 2))
            assert abs(m.chi_square_p([x], [dof])[0] - want) < 1e-12
    big = np.array([1e4, 1e9])
    for z in (-2.0, 0.0, 1.5):
        got = m.gamma_beyond(big, big + z * np.sqrt(big))
        assert (abs(got - 0.5 * math.erfc(z / math.sqrt(2))) < 1 / np.sqrt(big)).all()
    a = np.array([1999.0, 1999.0])
    assert np.allclose(m._gamma_area(a, a + [10, -70]), m.gamma_beyond(a, a + [10, -70]), atol=1e-11)


def test_student_tails():
    for t in (0.0, 0.4, 2.0, 11.0):
        assert abs(m.student_p([t], [1])[0] - (1 - 2 / math.pi * math.atan(t))) < 1e-12
        assert abs(m.student_p([t], [2])[0] - (1 - t / math.sqrt(2 + t * t))) < 1e-12
        assert abs(m.student_p([t], [1e9])[0] - math.erfc(t / math.sqrt(2))) < 1e-8


def test_columns(spark):
    df = spark.createDataFrame([(3.0, 2, 4, 30), (0.0, 1, 0, 10**9), (None, 1, 1, 1)], "x double, dof int, hits long, n long")
    rows = df.select(m.chi_square_tail("x", "dof").alias("p"), m.exact_share("hits", "n").alias("s")).collect()
    assert abs(rows[0].p - math.exp(-1.5)) < 1e-12 and rows[1].p == 1 and rows[1].s.low == 0
