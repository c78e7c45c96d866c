"""Queries without SQL against plain versions and invariants."""

import math

import numpy as np
import pytest

from tidewater import registry
from tidewater.plans import glass, layouts, learning, network, pricing, river

SF = "/root/testdata/sf0.001"
LARGER = "/root/testdata/sf0.01"  #: where the smallest tables have no such rows


def test_events_are_a_greedy_selection(spark):
    rows = {}
    for r in river.scores(spark, SF).where("score >= 1.2").collect():
        rows.setdefault(r["station"], []).append((-r["score"], r["day"]))
    want = set()
    for station, found in rows.items():
        taken = []
        for _, day in sorted(found):
            if len(taken) < 15 and all(abs((day - t).days) >= 5 for t in taken):
                taken.append(day)
        want |= {(station, d) for d in taken}
    assert {(r["station"], r["day"]) for r in river.event_select(spark, SF).collect()} == want


def test_fourier_ridge_solves_its_equations(spark):
    rows = [r.asDict() for r in learning.waves(river.months(spark, SF).where("total > 0")).where("origin = 'ASIA' AND dest = 'EUROPE'").collect()]
    x = np.array([[1.0, *[r[n] for n in learning.WAVES]] for r in rows])
    y = np.log([r["total"] for r in rows])
    b = np.linalg.solve(x.T @ x + np.diag([0.0, *[1.0] * 5]), x.T @ y)
    got = {r["month"]: r["forecast"] for r in learning.fourier_ridge(spark, SF).where("origin = 'ASIA' AND dest = 'EUROPE'").collect()}
    for m in range(1, 13):
        w = [1.0, 6 + (m - 1) / 12, *[f(2 * math.pi * k / 12 * m) for k in (1, 2) for f in (math.sin, math.cos)]]
        assert got[m] == pytest.approx(math.exp(float(np.dot(b, w))), abs=1e-3)


def test_recursive_forecast_as_a_loop(spark):
    panel = {}
    for r in network.panel_complete(spark, SF).collect():
        panel.setdefault((r["origin"], r["dest"]), []).append((r["day"], r["volume"]))
    got = {(r["origin"], r["dest"], r["step"]): r["forecast"] for r in network.recursive_forecast(spark, SF).collect()}
    for (o, d), rows in panel.items():
        x = [v for _, v in sorted(rows)]
        cap = 1.2 * max(x)
        for step in range(1, 29):
            x.append(min(cap, 0.5 * np.mean([x[-7], x[-14], x[-21], x[-28]]) + 0.5 * np.mean(x[-7:])))
            assert got[o, d, step] == pytest.approx(x[-1], abs=1e-5)


def test_rerouted_flows_balance_within_room(spark):
    assert all(r["balanced"] for r in network.allocation_check(spark, LARGER).collect())
    room = {(r["day"], r["new_origin"], r["new_dest"]): r["spare"] for r in network.reroute_candidates(spark, LARGER).collect()}
    used = {}
    for r in network.reroute_greedy(spark, LARGER).where("new_origin IS NOT NULL").collect():
        k = (r["day"], r["new_origin"], r["new_dest"])
        used[k] = used.get(k, 0) + r["amount"]
    assert used and all(v <= room[k] + 1e-9 for k, v in used.items())


def test_price_steps_keep_the_budget(spark):
    before = {r["id"]: (r["price"], r["logit"]) for r in pricing.logits(spark, SF).collect()}
    rows = pricing.price_greedy(spark, SF).collect()
    p = lambda id, price: 1 / (1 + math.exp(-(before[id][1] + 0.06 * (price - before[id][0]))))
    assert all(max(65, before[r["id"]][0] - 5) - 1e-9 <= r["price"] <= min(85, before[r["id"]][0] + 5) + 1e-9 for r in rows)
    spent = sum(r["price"] * p(r["id"], r["price"]) for r in rows)
    assert abs(spent - rows[0]["spent"]) < 1e-3 and spent <= rows[0]["limit_"] + 1e-3
    assert abs(rows[0]["limit_"] - 1.05 * sum(q * p(i, q) for i, (q, _) in before.items())) < 1e-3
    assert len(rows) == len(before)


def test_diversion_against_a_loop(spark):
    from tidewater.operators import rerouting

    edges = network.edge_days(spark, LARGER)
    scores = network.edge_scores(edges)
    sites = {r["site"] for r in rerouting.staged_sites(network.node_scores(edges), scores, 3, 14).collect()}
    top = {(r["origin"], r["dest"]) for r in sorted(scores.collect(), key=lambda r: (-r["score"], r["origin"], r["dest"]))[:80]}
    rows = edges.toPandas()
    split, first = (__import__("datetime").date.fromisoformat(d) for d in (network.SPLIT, network.DAY))
    caps = rows[rows["day"] < split].groupby(["origin", "dest"])["volume"].max().to_dict()
    want = {}
    for k in range(31):
        day = first + __import__("datetime").timedelta(days=k)
        now = rows[rows["day"] == day]
        room = {(r.origin, r.dest): max(0.0, caps.get((r.origin, r.dest), 0.0) - r.volume) for r in now.itertuples()}
        hub = max(0.0, sum(caps.get((r.origin, r.dest), 0.0) - r.volume for r in now.itertuples() if network.HUB in (r.origin, r.dest)))
        for r in sorted(now.itertuples(), key=lambda r: (r.origin, r.dest)):
            if (r.origin, r.dest) not in top or r.origin not in sites or r.dest not in sites or network.HUB in (r.origin, r.dest) or r.origin == r.dest:
                continue
            amount = min(0.2 * r.volume, room.get((r.origin, network.HUB), 0.0), room.get((network.HUB, r.dest), 0.0), hub / 2)
            if amount > 0:
                room[r.origin, network.HUB] -= amount
                room[network.HUB, r.dest] -= amount
                hub -= 2 * amount
                want[day, r.origin, r.dest] = amount
    got = {(r["day"], r["origin"], r["dest"]): r["amount"] for r in network.node_diversion(spark, LARGER).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_overloads_against_their_draws(spark):
    from tidewater.operators import rerouting

    edges = network.edge_days(spark, SF)
    loads = rerouting.planned_loads(edges, network.diversion(spark, SF), network.DAY, 31, network.SPLIT)
    draws = rerouting.drawn(loads, [0.0, 0.1, 0.15], 200).toPandas()
    assert draws["multiplier"].between(0.70, 1.35).all() and abs(draws[draws["sigma"] == 0.1]["multiplier"].std() - 0.1) < 0.01
    for r in network.robustness(spark, SF).collect():
        own = draws[draws["sigma"] == r["sigma"]]
        over = own["volume"] * own["multiplier"] - own["capacity"] > 1e-9
        counts = over.groupby(own["draw"]).sum()
        assert abs(counts.mean() - r["before_overloads"]) < 1e-9 and abs(np.quantile(counts, 0.95) - r["before_p95"]) < 1e-9
        assert r["after_overloads"] <= r["before_overloads"] and r["after_excess"] <= r["before_excess"]


def test_exact_intervals_by_binomial_sums(spark):
    from math import comb

    from tidewater.plans import factors

    for r in factors.exact_intervals(spark, LARGER).collect():
        n, k, low, high = r["n"], r["hits"], r["low"], r["high"]
        at_least = lambda p: sum(comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k, n + 1))
        at_most = lambda p: sum(comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))
        assert low == 0 if k == 0 else abs(at_least(low) - 0.025) < 1e-5
        assert high == 1 if k == n else abs(at_most(high) - 0.025) < 1e-5
        assert r["weighted_low"] <= r["weighted_high"] and r["effective_n"] <= n + 1e-6


def test_round_robin_against_a_loop(spark):
    from tidewater.plans import bundles

    t = pricing.tasks(spark, SF).collect()
    lists = [[r["id"] for r in sorted(t, key=lambda r: (-r[c], r["id"]))] for c in ("price", "quota", "credit")]
    want, turn = [], 0
    while len(want) < min(12, len(t)):
        want.append((len(want) + 1, turn % 3, next(i for i in lists[turn % 3] if i not in {w[2] for w in want})))
        turn += 1
    assert sorted(map(tuple, bundles.round_robin(spark, SF).collect())) == want


def test_marginal_effects_as_numpy(spark):
    from tidewater.operators import models
    from tidewater.plans import samples
    from tidewater.sources.tables import answers

    rows = answers(spark, LARGER).select("y", "size", "lang").toPandas()
    x = np.column_stack([np.ones(len(rows)), rows["size"], rows["lang"] == "en"]).astype(float)
    b = np.zeros(3)
    for _ in range(40):
        p = 1 / (1 + np.exp(-x @ b))
        held = np.diag([0.0, 1.0, 1.0])
        b = b + np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + held, x.T @ (rows["y"] - p) - held @ b)
    at = lambda e: 1 / (1 + np.exp(-(b[0] + b[1] * rows["size"] + b[2] * e)))
    p = at(x[:, 2])
    r = samples.marginal_effects(spark, LARGER).first()
    want = (at(0).mean(), at(1).mean(), at(1).mean() - at(0).mean(), (p * (1 - p) * b[1]).mean())
    assert models and all(abs(a - w) < 2e-6 for a, w in zip(r, want))


def test_principal_scores_as_numpy(spark):
    rows = sorted((r["id"], r["c"]) for r in glass.ratios(spark, SF).collect())
    x = np.array([c for _, c in rows])
    x -= x.mean(0)
    values, vectors = np.linalg.eigh(x.T @ x / len(x))
    got = np.array([[r["pc1"], r["pc2"]] for r in sorted(glass.pca2(spark, SF).collect(), key=lambda r: r["id"])])
    for k in (0, 1):
        want = x @ vectors[:, -1 - k]
        assert min(np.abs(got[:, k] - want).max(), np.abs(got[:, k] + want).max()) < 1e-5


def test_moorings_meet_the_depth(spark):
    rows = layouts.mooring(spark, SF).collect()
    assert len(rows) == 5 * 3 * 4 * 3
    chains = {k: (link, mass) for k, link, mass in layouts.CHAINS}
    for r in rows:
        link, mass = chains[r["kind"]]
        s, w, h = link * r["links"], mass * 9.8, 0.625 * 4 * r["wind"] ** 2
        if r["reach"] is None:
            assert s <= 16
            continue
        v0 = math.tan(math.radians(r["anchor_angle"])) * h
        rise = h / w * (math.hypot(1, r["chain_force"] / h) - math.hypot(1, v0 / h))
        assert rise == pytest.approx(16, abs=1e-6)


def test_mirrors_keep_their_distance(spark):
    kept = {r["id"] for r in learning.spaced_mirrors(spark, SF).collect()}
    p = np.array([(r["x"], r["y"]) for r in layouts.hexagonal(spark, 9.0, 250.0, 100.0).collect() if r["id"] in kept])
    d = np.hypot(*(p[:, None] - p[None]).transpose(2, 0, 1))
    assert d[np.triu_indices(len(p), 1)].min() > 11.99


def test_bootstrap_intervals_hold_the_mean(spark):
    rows = river.block_bootstrap(spark, SF).collect()
    assert rows and all(r["low"] <= r["mean"] <= r["high"] for r in rows)


def test_event_settings_against_loops(spark):
    """27 settings' events by a loop over each station's scores; matches within two days both ways."""
    days = river.calendar(spark, SF).toPandas().sort_values(["station", "day"])
    events = {}
    for w, t, g in river.SETTINGS:
        own = set()
        for station, d in days.groupby("station"):
            x, day = np.log1p(d["flow"].to_numpy()), d["day"].tolist()
            c = {k: x[k : k + w].mean() - x[k - w : k].mean() for k in range(w, len(x) - w + 1)}
            sd = np.std(list(c.values()), ddof=1) or 1.0
            taken = []
            for k in sorted((k for k in c if abs(c[k] / sd) >= t), key=lambda k: (-abs(c[k] / sd), k)):
                if len(taken) < 15 and all(abs((day[k] - day[j]).days) >= g for j in taken):
                    taken.append(k)
            own |= {(station, day[k]) for k in taken}
        events[w, t, g] = own
    base = events[3, 1.2, 5]
    hit = lambda e, others: any(s == e[0] and abs((d - e[1]).days) <= 2 for s, d in others)
    got = {(r.station, r.day): (r.matched, r.settings) for r in river.event_stability(spark, SF).collect()}
    assert got == {e: (sum(hit(e, events[s]) for s in river.SETTINGS), 27) for e in base}
    for r in river.event_settings(spark, SF).collect():
        own = events[r.width, r.threshold, r.gap]
        assert r.events == len(own) and abs(r.coverage - sum(hit(e, own) for e in base) / len(base)) < 1e-6 and abs(r.matched - sum(hit(e, base) for e in own) / len(own)) < 1e-6


def test_flows_are_joined_once(spark):
    """Plans over lane days read them as a table, however often they do; the largest tables are joined once."""
    for name in ("compare_by_site", "lag_roll_features"):
        plan = registry.QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
        assert "lane-days" in " ".join(registry.QUERIES[name](spark, SF).inputFiles()) and "l_orderkey" not in plan
