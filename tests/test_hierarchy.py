"""Ward's hierarchy in rounds, against one merge after another."""

import numpy as np
import pytest

from tidewater.operators import hierarchy as m


def plain(x):
    """Merges one after another: (least ids of both, cost, size)."""
    alive = {i: (v, 1) for i, v in enumerate(x)}
    out = []
    while len(alive) > 1:
        ids = sorted(alive)
        c, n = np.array([alive[i][0] for i in ids]), np.array([alive[i][1] for i in ids], float)
        d = ((c[:, None] - c[None]) ** 2).sum(2) * (n[:, None] * n[None]) / (n[:, None] + n[None])
        d[np.tril_indices(len(ids))] = np.inf
        p, q = np.unravel_index(d.argmin(), d.shape)
        a, b = ids[p], ids[q]
        (ca, na), (cb, nb) = alive.pop(a), alive.pop(b)
        alive[a] = ((na * ca + nb * cb) / (na + nb), na + nb)
        out.append((a, b, d[p, q], na + nb))
    return out


def points(spark, x):
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>").repartition(3)


@pytest.mark.parametrize(("n", "size"), [(2, 1), (60, 2), (300, 6)])
def test_merges_are_those_of_one_after_another(spark, n, size):
    rng = np.random.default_rng(n)
    x = rng.normal(size=(n, size)) + 5 * rng.integers(0, 3, (n, 1))
    got = sorted((r.cost, r.a, r.b, r.size) for r in m.ward(points(spark, x), "id", "v").collect())
    want = plain(x)
    assert [t[1:] for t in got] == [(a, b, s) for a, b, _, s in want]
    assert np.allclose([t[0] for t in got], [c for _, _, c, _ in want])


def test_cut_leaves_so_many_clusters(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(80, 3)) * 0.3 + 9 * (np.arange(80) % 4)[:, None]
    rows = points(spark, x)
    merges = m.ward(rows, "id", "v")
    assert {r.id: r.cluster for r in m.cut(rows, "id", merges, 4).collect()} == {i: i % 4 for i in range(80)}
    assert {r.cluster for r in m.cut(rows, "id", merges, 1).collect()} == {0}
    assert all(r.id == r.cluster for r in m.cut(rows, "id", merges, 80).collect())


def test_equal_rows_and_few_rows(spark):
    x = np.zeros((5, 2))
    got = m.ward(points(spark, x), "id", "v").collect()
    assert len(got) == 4 and {r.cost for r in got} == {0.0}
    assert m.ward(points(spark, x).limit(1), "id", "v").collect() == [] == m.ward(points(spark, x).limit(0), "id", "v").collect()


def test_rounds_over_tiles_are_those_of_one_task(spark, monkeypatch):
    """Rounds that meet in tiles merge what one task merges, with copies of rows among them; no round meets rows in cells."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(400, 9))
    x[300:] = x[:100] + rng.normal(size=(100, 9)) * 1e-7
    x[390:] = x[:10]
    told = lambda: sorted((r.a, r.b, r.cost, r.size) for r in m.ward(points(spark, x), "id", "v").collect())
    once = told()
    monkeypatch.setattr(m, "FEW", 20)
    rounds = told()
    assert len(once) == 399 and [t[:2] + t[3:] for t in once] == [t[:2] + t[3:] for t in rounds]
    assert np.allclose([t[2] for t in once], [t[2] for t in rounds], rtol=1e-12, atol=0)


def test_nearest_by_single_precision_is_that_of_full_sums():
    """Blocks of several sizes, copies, rows far from the origin and of great values; who has no other has no cost."""
    rng = np.random.default_rng(5)
    for scale, offset in ((1.0, 0.0), (1e-9, 0.0), (1.0, 1e4), (1e25, 0.0)):
        x = rng.normal(size=(230, 5)) * scale + offset
        x[200:] = x[:30]
        n, ids = rng.integers(1, 4, 230).astype(float), rng.permutation(1000)[:230]
        d = np.zeros((230, 230))
        for c in range(5):
            e = x[:, None, c] - x[None, :, c]
            d += e * e
        d = n[:, None] * n[None, :] / (n[:, None] + n[None, :]) * d
        np.fill_diagonal(d, np.inf)
        some = rng.permutation(230)[:90]
        cost, a, b = m.least(ids[some], n[some], x[some], ids, n, x, rows=16, columns=32)
        want = [min((d[i, j], min(ids[i], ids[j]), max(ids[i], ids[j])) for j in range(230)) for i in some]
        assert [*zip(cost, a, b)] == want
    assert np.isinf(m.least(ids[:1], n[:1], x[:1], ids[:1], n[:1], x[:1])[0]).all()


def test_only_those_look_whose_nearest_has_merged(spark, monkeypatch):
    """After the first round fewer clusters look for their nearest than there are, and merges stay the same."""
    x = np.random.default_rng(6).normal(size=(300, 4))
    looks = []
    monkeypatch.setattr(m, "FEW", 40)
    monkeypatch.setattr(m, "nearest", lambda s, t, some, count, f=m.nearest: looks.append((s.count(), t.count(), some, count)) or f(s, t, some, count))
    got = sorted((r.cost, r.a, r.b, r.size) for r in m.ward(points(spark, x), "id", "v").collect())
    assert [t[1:] for t in got] == [(a, b, s) for a, b, _, s in plain(x)]
    assert looks[0] == (300, 300, 300, 300) and len(looks) > 3
    assert all((a, b) == (some, count) and some < 0.8 * count for a, b, some, count in looks[1:])


def test_silhouettes_of_copies_and_of_all_pairs(spark):
    from tidewater.operators import compositions

    rng = np.random.default_rng(7)
    x = rng.normal(size=(90, 5)) + 1e3
    x[60:] = x[:30]
    g = np.arange(90) % 3
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    rows = spark.createDataFrame([(i, int(g[i]), v.tolist()) for i, v in enumerate(x)], "id long, g int, v array<double>")
    got = {r.id: r.silhouette for r in compositions.silhouettes(rows, "id", "g", "v", each=16).collect()}
    for i in range(90):
        a, b = d[i, g == g[i]].sum() / 29, min(d[i, g == k].mean() for k in range(3) if k != g[i])
        assert abs(got[i] - (b - a) / max(a, b)) < 1e-9
