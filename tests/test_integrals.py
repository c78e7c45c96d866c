"""Sums of drawn residual blocks against loops over draws, blocks and values."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewater.operators import integrals as m


@pytest.mark.parametrize(("known", "most"), [(7, 1 << 20), (60, 50), (300, 400)])
def test_draws_are_those_of_loops(known, most):
    """Few and many sources (more than four times the draws), values met in slices, equally near residuals."""
    rng = np.random.default_rng(known)
    day, draws = 24 * m.HOUR, 20
    end = 12 * day
    t = np.sort(rng.choice(end // (m.HOUR // 6), known + 90, replace=False)) * (m.HOUR // 6)
    own = np.isin(np.arange(len(t)), rng.choice(len(t), known, replace=False))
    rt, e = t[own], rng.normal(size=known)
    t, w, line = t[~own], rng.random(90), rng.normal(size=90)
    got = m.drawn("5", 48, 0, end, {"t": t, "w": w, "line": line}, {"t": rt, "e": e}, (0.5, 2.0), draws, blocks=3, most=most)
    count, want = int((rt + 2 * day <= end).sum()), np.zeros(draws)
    for b in sorted(set(t // (2 * day))):
        h = int(hashlib.md5(f"5/48/{b}".encode()).hexdigest()[:12], 16) % (1 << 32)
        for d, s in enumerate(m.sources(np.array([h]), np.array([count]), draws)[0]):
            for k in np.flatnonzero(t // (2 * day) == b):
                x = min((abs(u - rt[s] - t[k] % (2 * day)), u, v) for u, v in zip(rt, e) if rt[s] <= u < rt[s] + 2 * day)
                want[d] += w[k] * min(2.0, max(0.5, np.exp(line[k] + x[2])))
    assert np.allclose(got, want, rtol=1e-12)


def test_blocks_do_not_meet_as_rows(spark):
    """What blocks of two kinds come to is found where a series lies: no window over rows of both."""
    rows = spark.range(400).select((F.col("id") % 4).alias("k"), (F.col("id") * 3 * m.HOUR).alias("t"), (1 + F.col("id") % 7).cast("double").alias("flow"), F.when(F.col("id") % 5 == 0, 1.0 + F.col("id") % 3).alias("y"))
    found = m.intervals(rows, "k", 0, 1200 * m.HOUR, [24, 72], 30)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and plan.count("Join") == 1
    assert {(r.k, r.hours) for r in found.collect()} == {(k, n) for k in range(4) for n in (24, 72)}
