"""Rays over all mirrors and states, against plain loops on a small lattice."""

import math

import numpy as np

from tidewater.plans import layouts


def cross_free(start, way, centre, s):
    """Whether a ray from start misses the mirror at a centre."""
    t = np.array([0, 0, layouts.TOWER]) - centre
    n = s + t / np.linalg.norm(t)
    n /= np.linalg.norm(n)
    u = np.array([-n[1], n[0], 0]) / max(1e-9, math.hypot(n[0], n[1]))
    if abs(way @ n) < 1e-9:
        return True
    along = (centre - start) @ n / (way @ n)
    hit = start + along * way - centre
    return not (along > 1e-6 and abs(hit @ u) <= 3 and abs(hit @ np.cross(n, u)) <= 3)


def test_rays_as_plain_loops(spark):
    mirrors = layouts.hexagonal(spark, 7.0, 118.0, 110.0).where("y > 90")
    states = layouts.sun(spark).where("month IN (3, 12)")
    got = {(r.month, r.hour): (r.rays, r.lit, r.kept) for r in layouts.kept_rays(mirrors, states).collect()}
    points = [np.array([r.x, r.y, 0.0]) for r in mirrors.collect()]
    want = {}
    for q in states.collect():
        s, lit, kept, rays = np.array([q.sx, q.sy, q.sz]), 0, 0, 0
        for p in points:
            t = np.array([0, 0, layouts.TOWER]) - p
            t /= np.linalg.norm(t)
            n = (s + t) / np.linalg.norm(s + t)
            u = np.array([-n[1], n[0], 0]) / max(1e-9, math.hypot(n[0], n[1]))
            near = [c for c in points if 0 < np.linalg.norm(c - p) <= 40]
            for i in np.linspace(-2.5, 2.5, 5):
                for j in np.linspace(-2.5, 2.5, 5):
                    start = p + i * u + j * np.cross(n, u)
                    seen = all(cross_free(start, s, c, s) for c in near)
                    rays, lit = rays + 1, lit + seen
                    kept += seen and all(cross_free(start, t, c, s) for c in near)
        want[q.month, q.hour] = (rays, round(lit / rays, 6), round(kept / rays, 6))
    assert len(points) > 5 and got.keys() == want.keys() and any(w[2] < 1 for w in want.values())
    for k, w in want.items():
        assert got[k][0] == w[0] and abs(got[k][1] - w[1]) < 2e-3 and abs(got[k][2] - w[2]) < 2e-3


def test_all_mirrors_and_states_are_taken(spark):
    rows = layouts.ray_efficiency(spark, "").collect()
    assert len(rows) == 60 and {r.rays for r in rows} == {25 * layouts.field(spark).count()}
