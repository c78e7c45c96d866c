"""k-means of many models at once, against loops over one model."""

import itertools
import math

import numpy as np
import pytest

from tidewater.operators import clusters as m
from tidewater.operators.resampling import place, row_number


def table(spark, n=180, k=3, size=4, seed=5, parts=4):
    rng = np.random.default_rng(seed)
    centres = 4 * rng.normal(size=(k, size))
    rows = [(i, (centres[i % k] + rng.normal(size=size)).tolist()) for i in range(n)]
    df = m.kept(spark.createDataFrame(rows, "id long, v array<double>").repartition(parts), "id", "v")
    return df, np.array([r.v for r in df.orderBy("id").collect()]), np.array([r.h for r in df.orderBy("id").collect()])


def lloyd(x, centres, w=None, rounds=100):
    """Plain rounds; an empty cluster takes the row furthest from its centre."""
    w = np.ones(len(x)) if w is None else w
    centres = centres.copy()
    for _ in range(rounds):
        d = ((x[:, None, :] - centres[None, :, :]) ** 2).sum(2)
        label, new = d.argmin(1), centres.copy()
        cost = (w * d.min(1)).sum()
        empty = [j for j in range(len(centres)) if not w[label == j].sum()]
        for j in range(len(centres)):
            if j not in empty:
                new[j] = (w[:, None] * x)[label == j].sum(0) / w[label == j].sum()
        if empty:
            new[empty[0]] = x[np.where(w > 0, d.min(1), -1).argmax()]
        if np.allclose(new, centres, rtol=0, atol=1e-10):
            break
        centres = new
    return centres, cost


def test_every_start_is_that_of_a_loop(spark):
    rows, x, _ = table(spark)
    models = m.seeds(rows, (2, 3, 5), 4)
    assert len(models) == 12 and {(a.k, a.start) for a in models} == {(k, s) for k in (2, 3, 5) for s in range(4)}
    want = [lloyd(x, a.centres) for a in models]
    for a, (centres, cost) in zip(m.refined(rows, models), want, strict=True):
        assert np.allclose(a.centres, centres) and abs(a.cost - cost) < 1e-6
    for (_, k), a in m.best(models).items():
        assert abs(a.cost - min(c for (_, c), b in zip(want, models) if b.k == k)) < 1e-6


def test_empty_clusters_take_the_furthest_row(spark):
    rows, x, _ = table(spark, 40)
    seeds = np.array([x[0], x[0] + 900, x[0] + 901])
    (a,) = m.refined(rows, [m.Model(seeds.copy())])
    centres, cost = lloyd(x, seeds)
    assert np.allclose(a.centres, centres) and abs(a.cost - cost) < 1e-6 and (a.sizes > 0).all()


def test_silhouettes_are_those_of_all_pairs(spark):
    rows, x, _ = table(spark, 60)
    models = [m for _, m in sorted(m.best(m.refined(rows, m.seeds(rows, (2, 3), 3))).items())]
    for a, got in zip(models, m.measures(rows, models)):
        label = m.squared(x, a.centres).argmin(1)
        d = ((x[:, None] - x[None]) ** 2).sum(2)
        s = []
        for i in range(len(x)):
            own = [d[i, j] for j in range(len(x)) if label[j] == label[i] and j != i]
            near = np.mean(own) if own else 0.0
            far = min(d[i, label == c].mean() for c in set(label) - {label[i]})
            s.append((far - near) / max(far, near))
        assert abs(np.mean(s) - got) < 1e-9


def test_the_number_of_clusters_is_found(spark):
    rows, x, _ = table(spark, k=4)
    model, told = m.chosen(rows, range(2, 7), 6)
    assert model.k == 4 and max(told, key=lambda t: t["silhouette"])["k"] == 4
    label = {r.id: r.cluster for r in m.labelled(rows, model).collect()}
    assert all(label[i] == label[i % 4] for i in range(180)) and set(label.values()) == {1, 2, 3, 4}


def test_assignments_are_the_least_of_all():
    rng = np.random.default_rng(0)
    for n in range(1, 6):
        for _ in range(40):
            c = rng.integers(0, 9, (n, n)).astype(float)
            got = m.matched(c)
            assert sorted(got) == list(range(n)) and c[np.arange(n), got].sum() == min(sum(c[i, p[i]] for i in range(n)) for p in itertools.permutations(range(n)))


def test_stability_is_that_of_a_loop(spark):
    rows, x, h = table(spark, 90)
    seeds = m.seeds(rows, (3,), 2)
    model, _ = m.chosen(rows, (3,), 4)
    got = {r.id: (r.cluster, r.seen, r.same) for r in m.stability(rows, model, seeds, 25).collect()}
    base = m.squared(x, model.centres).argmin(1)
    seen, same = np.zeros(90, int), np.zeros(90, int)
    for d in range(1, 26):
        w = m.weights(h, np.array([d]))[:, 0]
        centres, _ = min((lloyd(x, s.centres, w) for s in seeds), key=lambda t: t[1])
        cost = m.squared(centres, model.centres)
        to = min(itertools.permutations(range(3)), key=lambda p: sum(cost[i, p[i]] for i in range(3)))
        label = np.array(to)[m.squared(x, centres).argmin(1)]
        seen += w > 0
        same += (w > 0) & (label == base)
    assert got == {i: (base[i] + 1, seen[i], same[i]) for i in range(90)}
    assert 0.5 < seen.mean() / 25 < 0.75


def test_weights_are_poisson(spark):
    h = np.array([r.h for r in spark.range(4000).select(row_number("id").alias("h")).collect()])
    w = m.weights(h, np.arange(0, 40))
    assert (w[:, 0] == 1).all() and abs(w[:, 1:].mean() - 1) < 0.02 and abs(w[:, 1:].var() - 1) < 0.04


def test_passes_run_on_all_cores(spark):
    """A table of one file is dealt to as many tasks as there are cores, and each works on its own rows."""
    rows, x, _ = table(spark, 180, parts=1)
    n = spark.sparkContext.defaultParallelism
    assert n > 1 and rows.rdd.getNumPartitions() == n
    import os

    def work(id, h, v):
        return np.array([[float(os.getpid()), len(id)]])

    found = m._passed(rows, work, lambda a, b: np.concatenate([a, b]))
    assert found[:, 1].sum() == len(x) and len(set(found[:, 0])) > 1


def test_weights_are_those_of_the_cumulated_chances():
    h, draws = np.arange(5000) * 858_993 % (1 << 32), np.array([0, 1, 2, 7])
    steps = np.cumsum([math.exp(-1) / math.factorial(i) for i in range(13)])
    want = np.where(draws[None, :] > 0, np.searchsorted(steps, place(h, draws) / float(1 << 32), "right"), 1)
    assert (m.weights(h, draws) == want).all()


def test_no_rows(spark):
    empty = m.kept(spark.createDataFrame([], "id long, v array<double>"), "id", "v")
    with pytest.raises(ValueError):
        m.seeds(empty, (2,), 1)
