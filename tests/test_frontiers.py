"""Unbeaten policies against all policies there are."""

import itertools

import numpy as np
import pandas as pd
import pytest

from tidewater.operators import frontiers as m


def made(seed, periods, groups=2):
    rng = np.random.default_rng(seed)
    rows = []
    for g, p, i, t, before in itertools.product(range(groups), range(periods), (3, 5), (1.0, 2.0), (1.0, 2.0)):
        rows.append((g, p, before, t, int(rng.integers(1, 9)), float(rng.integers(0, 20)), int(rng.integers(1, 6)), int(rng.integers(0, 4)), f"{i}@{t}"))
    return pd.DataFrame(rows, columns=["g", "period", *m.COLUMNS[:2], "cost", "error", "gap", "captured", "choices"])


def every(f, periods):
    """All ways through the periods: (cost, error, gap, captured, choices)."""
    out = []
    for way in itertools.product(*[f[f.period == p].to_dict("records") for p in range(periods)]):
        if all(a["after"] == b["before"] for a, b in zip(way, way[1:])):
            out.append((sum(w["cost"] for w in way), sum(w["error"] for w in way), max(w["gap"] for w in way), sum(w["captured"] for w in way), "|".join(w["choices"] for w in way)))
    return out


@pytest.mark.parametrize("periods", [1, 2, 3, 4])
def test_limits_are_those_of_all_ways(spark, periods):
    f = made(periods, periods)
    found = m.frontier(spark.createDataFrame(f), ["g"], "period")
    grid = list(itertools.product((5.0, 15.0, 25.0, 40.0, 70.0), (2, 3, 4, 5, 6), (0, 1, 3, 5, 8)))
    limits = spark.createDataFrame(grid, "error_limit double, gap_limit int, captured_least int")
    got = {(r.g, r.error_limit, r.gap_limit, r.captured_least): (r.feasible, r.cost, r.error) for r in m.limited(found, ["g"], limits).collect()}
    assert len(got) == 250
    for g in (0, 1):
        ways = every(f[f.g == g], periods)
        for e, gap, c in grid:
            best = min(((w[0], w[1]) for w in ways if w[1] <= e and w[2] <= gap and w[3] >= c), default=None)
            assert got[g, e, gap, c] == ((True, *best) if best else (False, None, None))


def test_nothing_unbeaten_is_lost_and_nothing_beaten_stays(spark):
    f = made(9, 3, 1)
    rows = m.frontier(spark.createDataFrame(f), ["g"], "period").collect()
    got = {(r.cost, r.error, r.gap, -r.captured) for r in rows}
    ways = {(w[0], w[1], w[2], -w[3]) for w in every(f, 3)}
    best = {a for a in ways if not any(b != a and all(x <= y for x, y in zip(b, a)) for b in ways)}
    assert best <= got <= ways


def test_unbeaten_rows():
    rng = np.random.default_rng(2)
    x = rng.integers(0, 5, (200, 3)).astype(float)
    got = m.unbeaten(x)
    want = [i for i in range(200) if not any((x[j] <= x[i]).all() and ((x[j] < x[i]).any() or j < i) for j in range(200) if j != i)]
    assert got.tolist() == want
