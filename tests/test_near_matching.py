"""Greedy matchings of near points against the plain loop over all pairs in order."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewater.functions.rounding import half_up
from tidewater.operators import spatial


def plain(ids, xy, radius, worth):
    pairs, used, out = [], set(), set()
    for a in range(len(ids)):
        for b in range(len(ids)):
            dx, dy = xy[a] - xy[b]
            d = math.sqrt(dx * dx + dy * dy)
            if ids[a] < ids[b] and d <= radius:
                pairs.append((-worth(np.array([d]))[0], ids[a], ids[b]))
    for _, i, j in sorted(pairs):
        if i not in used and j not in used:
            used |= {i, j}
            out.add((i, j))
    return out


@pytest.mark.parametrize("digits", [6, 1])
def test_matching_over_windows(spark, monkeypatch, digits):
    """Dense and lone points, copies of one place, and worths of which many are equal; few tables are written."""
    rng = np.random.default_rng(digits)
    xy = np.concatenate([rng.normal(scale=0.6, size=(250, 2)), np.full((31, 2), 0.5), rng.uniform(-4, 4, size=(60, 2)), [[0.5, 0.5 + 1e-8], [50.0, 50.0]]])
    ids = rng.permutation(5000)[: len(xy)].tolist()
    worth = lambda d: half_up(1 - d, digits)
    tables, real = [], spatial.written
    monkeypatch.setattr(spatial, "written", lambda *a, **b: tables.append(a) or real(*a, **b))
    rows = spark.createDataFrame([(i, *map(float, v)) for i, v in zip(ids, xy)], "id long, x double, y double")
    got = [(r.i, r.j) for r in spatial.matched_near(rows, 0.3, worth).collect()]
    assert len(got) == len(set(got)) and set(got) == plain(ids, xy, 0.3, worth)
    assert len(tables) <= 14


def test_matching_makes_no_pairs(spark, monkeypatch):
    from tidewater.plans import learning, pricing

    monkeypatch.setattr(pricing.spatial, "radius_pairs", None)
    assert learning.bundle_matching(spark, "/root/testdata/sf0.001").count() > 0


def test_rounding_as_in_spark(spark):
    v = [0.1234565, 0.5, -0.0000005, 0.2345675, 1e-9, 0.30000049999999997, 2.5e-6, -1.0000015]
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(v)], "i int, x double").select("i", F.round("x", 6).alias("r")).orderBy("i").collect()
    assert half_up(np.array(v), 6).tolist() == [r.r for r in rows]
