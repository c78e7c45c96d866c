"""Small hand-made cases of operators."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from tidewater.operators import compositions, forecast, models, ordered, panels, ranks, records, relations, rerouting, signals, spatial

D = dt.date


def days(spark, values, start=D(2024, 1, 1)):
    return spark.createDataFrame([(1, start + dt.timedelta(days=i), float(v)) for i, v in enumerate(values)], "station int, day date, flow double")


def trigger_days(rows, column):
    return [r["day"] for r in sorted(rows, key=lambda r: r["day"]) if r[column]]


def test_a_jump_adds_two_days(spark):
    rows = signals.triggered(days(spark, [1] + [10] * 30), ["station"], "day", "flow", 14, F.lit(0.5), 1.0).collect()
    assert trigger_days(rows, "extra") == [D(2024, 1, 3), D(2024, 1, 4)]
    assert trigger_days(rows, "planned") == [D(2024, 1, 1), D(2024, 1, 15), D(2024, 1, 29)]


def test_a_jump_on_the_last_day_of_a_month_is_followed_in_the_next(spark):
    threshold = F.when(F.month("day") == 1, 0.5).otherwise(99.0)
    rows = signals.triggered(days(spark, [1] * 30 + [10] * 5), ["station"], "day", "flow", 100, threshold, 1.0).collect()
    assert trigger_days(rows, "extra") == [D(2024, 2, 1), D(2024, 2, 2)]


def test_a_jump_on_the_first_day_of_a_month_compares_with_the_month_before(spark):
    rows = signals.triggered(days(spark, [1] * 31 + [10] * 5), ["station"], "day", "flow", 100, F.lit(0.5), 1.0).collect()
    assert trigger_days(rows, "extra") == [D(2024, 2, 2), D(2024, 2, 3)]


def test_percent_rank_averages_ties(spark):
    df = spark.createDataFrame([(10,), (10,), (30,), (40,)], "v int")
    assert sorted(r[0] for r in df.select(ranks.percent_rank_average("v")).collect()) == [0.375, 0.375, 0.75, 1.0]


def test_trapezoid_weights_with_held_ends(spark):
    base = dt.datetime(2024, 1, 1)
    rows = spark.createDataFrame([(1, base + dt.timedelta(days=d), v) for d, v in ((0, 1.0), (2, 2.0), (5, 4.0))], "station int, ts timestamp_ntz, flow double")
    s = ordered.segments(rows, ["station"], "ts", "flow").agg(F.sum("area").alias("a"), F.sum("seconds").alias("s")).first()
    assert s["s"] == 5 * 86400
    assert s["a"] == pytest.approx((1.5 * 2 + 3 * 3) * 86400)


def test_neighbours_as_brute_force(spark):
    import random

    rng = random.Random(3)
    base = dt.datetime(2024, 1, 1)
    data = [(k, base + dt.timedelta(minutes=rng.randrange(0, 60 * 24 * 9)), rng.choice([None, float(i)])) for k in (1, 2) for i in range(80)]
    data = list({(k, t): (k, t, v) for k, t, v in data}.values())
    df = spark.createDataFrame(data, "station int, ts timestamp_ntz, v double")
    got = {(r["station"], r["ts"]): (r["b"], r["a"], r["n"]) for r in ordered.neighbours(df, ["station"], "ts", "v", "x").select("station", "ts", F.col("x_before.v").alias("b"), F.col("x_after.v").alias("a"), ordered.nearest("ts", "x").alias("n")).collect()}
    for k, t, _ in data:
        before = max(((u, v) for j, u, v in data if j == k and v is not None and u <= t), default=None)
        after = min(((u, v) for j, u, v in data if j == k and v is not None and u >= t), default=None)
        near = before if after is None or (before is not None and t - before[0] <= after[0] - t) else after
        assert got[k, t] == (before and before[1], after and after[1], near and near[1])


def test_band_join_as_brute_force(spark):
    a = spark.createDataFrame([(1, D(2024, 1, d)) for d in (1, 9, 20)], "k int, day date")
    b = spark.createDataFrame([(1, D(2024, 1, d)) for d in (1, 3, 7, 12, 23, 24)], "k int, other date")
    got = {(r[0].day, r[1].day) for r in relations.within(a, b, ["k"], "day", "other", 3).select("l.day", "r.other").collect()}
    assert got == {(x, y) for x in (1, 9, 20) for y in (1, 3, 7, 12, 23, 24) if abs(x - y) <= 3}


def test_validated_join(spark):
    a, b = spark.createDataFrame([(1,), (1,)], "k int"), spark.createDataFrame([(1, "x")], "k int, v string")
    assert relations.validated_join(a, b, ["k"], "many_to_one").count() == 2
    with pytest.raises(ValueError):
        relations.validated_join(a, b, ["k"], "one_to_one")
    with pytest.raises(ValueError, match="lacks z"):
        relations.require_columns(a, ["k", "z"])


def test_undominated(spark):
    df = spark.createDataFrame([("a", 1.0, 5.0), ("b", 2.0, 5.0), ("c", 2.0, 6.0), ("d", 1.0, 5.0)], "k string, cost double, gain double")
    assert sorted(r["k"] for r in relations.undominated(df, "k", ["cost"], ["gain"]).collect()) == ["a", "c", "d"]


def test_radius_and_nearest_as_brute_force(spark):
    import random

    rng = random.Random(1)
    p = [(i, rng.uniform(-3, 3), rng.uniform(-3, 3)) for i in range(60)]
    df = spark.createDataFrame(p, "id int, x double, y double")
    got = {(r[0], r[1]) for r in spatial.radius_pairs(df, df, 0.7).select("l.id", "r.id").collect()}
    assert got == {(a, b) for a, x, y in p for b, u, v in p if math.hypot(x - u, y - v) <= 0.7}
    near = {}
    for r in spatial.nearest(df, df, 2, 0.2, self_join=True).select("l.id", F.col("r.id").alias("o"), "rank").collect():
        near[r["id"], r["rank"]] = r["o"]
    for a, x, y in p:
        want = sorted((math.hypot(x - u, y - v), b) for b, u, v in p if b != a)[:2]
        assert [near[a, 1], near[a, 2]] == [b for _, b in want]


def test_polygon_with_a_hole(spark):
    rings = [[(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0)], [(1.0, 1.0), (3.0, 1.0), (3.0, 3.0), (1.0, 3.0)]]
    df = spark.createDataFrame([(0.5, 0.5), (2.0, 2.0), (5.0, 1.0)], "x double, y double")
    assert [r[0] for r in df.select(spatial.inside("x", "y", rings)).collect()] == [True, False, False]


def test_greedy_rerouting_balances(spark):
    edges = spark.createDataFrame([("A", "X", D(2001, 3, 1), 50.0), ("X", "B", D(2001, 3, 1), 30.0), ("A", "B", D(2000, 1, 1), 20.0), ("B", "A", D(2000, 1, 1), 10.0), ("A", "X", D(2000, 1, 1), 5.0), ("C", "A", D(2000, 1, 1), 8.0)], "origin string, dest string, day date, volume double")
    got = rerouting.greedy(rerouting.candidates(edges, "X", "2001-03-01", 31, "2001-01-01"))
    b = rerouting.balance(got).first()
    assert b["balanced"] and b["demand"] == 80.0 and 0 < b["served"] <= 80.0


def test_calibration_keeps_the_total(spark):
    df = spark.createDataFrame([("a", 3.0, 10.4), ("b", 3.0, 10.4), ("c", 1.0, 2.9)], "k string, base double, target double")
    got = {r["k"]: r["calibrated"] for r in forecast.calibrated(df, ["k"], "base", "target").collect()}
    assert sum(got.values()) == round(10.4 + 10.4 + 2.9)


def test_short_and_odd_panels(spark):
    df = spark.createDataFrame([("a", D(2024, 1, 1), 1.0), ("b", D(2024, 1, 3), 2.0)], "k string, day date, v double")
    got = sorted(map(tuple, panels.complete(df, ["k"], "day", "v").collect()))
    assert len(got) == 6 and sum(r[2] for r in got) == 3.0


def test_clr_round_trip(spark):
    df = spark.createDataFrame([([10.0, 30.0, 60.0],)], "parts array<double>")
    r = df.select(compositions.clr("parts", before_closure=False).alias("c")).select("c", compositions.from_clr("c").alias("p")).first()
    assert sum(r["c"]) == pytest.approx(0)
    assert r["p"] == pytest.approx([10, 30, 60], abs=0.02)


def test_firth_is_finite_where_data_separate(spark):
    df = spark.createDataFrame([(float(i), int(i > 5)) for i in range(12)], "x double, y int")
    m = models.logistic(df, ["x"], "y", firth=True)
    assert 0 < m.coef[1] < 5


def test_logistic_and_ridge_recover(spark):
    df = spark.range(4000).selectExpr("id", "(id % 41) / 10.0 AS x", "(id % 17) / 5.0 AS z").withColumn("y", 2 + 3 * F.col("x") - F.col("z"))
    assert models.ridge(df, ["x", "z"], "y").coef == pytest.approx([2, 3, -1], abs=1e-8)


def test_fields_and_paths(spark):
    df = spark.createDataFrame([(1, "- a: 1\ntext\n- b：two words\n- a: 3"), (2, None)], "id int, text string")
    got = {r["id"]: r["fields"] for r in records.template_fields(df, "id", "text").collect()}
    assert got == {1: {"b": "two words", "a": "3"}, 2: {}}
    p = spark.createDataFrame([("a/b.txt",), ("../x",), ("/abs",), ("a\\b",), ("C:x",), ("",), ("a/./b",), ("a..b/c",)], "p string")
    assert [r[0] for r in p.select(records.safe_path("p")).collect()] == [True, False, False, False, False, False, False, True]


def test_gate(spark):
    one = spark.createDataFrame([(3, 0.5)], "n int, share double")
    ok = records.checks(one, [("some", F.col("n") > 0, F.col("n"))])
    assert records.gate(ok).count() == 1
    with pytest.raises(ValueError, match="share"):
        records.gate(records.checks(one, [("share", F.col("share") > 0.9, F.col("share"))]))


def test_stream_and_batch_agree(spark):
    from tidewater.sources.tables import table
    from tidewater.streaming import events

    sf = "/root/testdata/sf0.001"
    batch = events.tumbling(table(spark, sf, "events"))
    stream = events.replayed(spark, sf, events.tumbling, "t")
    cols = ["start", "event_type", "n"]
    assert sorted(map(tuple, batch.select(cols).collect())) == sorted(map(tuple, stream.select(cols).collect()))


def test_matching_and_selection_as_greedy_ones(spark):
    import random

    from tidewater.operators import choices

    rng = random.Random(4)
    edges = sorted({tuple(sorted(rng.sample(range(25), 2))) for _ in range(60)})
    weighed = [(a, b, rng.randrange(5)) for a, b in edges]
    df = spark.createDataFrame(weighed, "i int, j int, w int")
    used, want = set(), set()
    for a, b, w in sorted(weighed, key=lambda e: (-e[2], e[0], e[1])):
        if not {a, b} & used:
            used |= {a, b}
            want.add((a, b))
    assert {(r["i"], r["j"]) for r in choices.matched(df, "i", "j", -F.col("w")).collect()} == want
    nodes = [(k, rng.randrange(4)) for k in range(25)]
    near = {k: {b for a, b in edges if a == k} | {a for a, b in edges if b == k} for k, _ in nodes}
    kept = []
    for k, _ in sorted(nodes, key=lambda n: (n[1], n[0])):
        if not near[k] & set(kept):
            kept.append(k)
    both = spark.createDataFrame([(a, b) for a, b in edges] + [(b, a) for a, b in edges], "a int, b int")
    got = choices.independent(spark.createDataFrame(nodes, "id int, p int"), both, "id", F.col("p"))
    assert sorted(r["id"] for r in got.collect()) == sorted(kept)


def test_a_price_keeps_the_budget(spark):
    from tidewater.operators import choices

    o = spark.createDataFrame([(k, float(p), g * k, p * 1.0) for k in (1, 2, 3) for p, g in ((1, 1.0), (2, 1.6), (3, 1.9))], "k int, p double, gain double, cost double")
    got = choices.priced_choice(o, "k", "p", "gain", "cost", 7.0, [x / 10 for x in range(40)]).collect()
    assert len(got) == 3 and sum(r["cost"] for r in got) <= 7.0


def test_ranks_and_quantiles_over_ranges(spark):
    """Against pandas, with ties, nulls, groups of one value and a group of one row."""
    import numpy as np
    import pandas as pd

    from tidewater.operators import ranks

    rng = np.random.default_rng(3)
    pdf = pd.DataFrame({"g": rng.integers(0, 4, 600), "v": np.where(rng.random(600) < 0.5, rng.integers(0, 9, 600), rng.normal(0, 1e6, 600)).round(3)})
    pdf = pd.concat([pdf, pd.DataFrame({"g": [7, 8, 8, 8], "v": [3.5, 1.0, 1.0, 1.0]}), pd.DataFrame({"g": [1, 9], "v": [None, None]})], ignore_index=True)
    pdf["id"] = range(len(pdf))
    df = spark.createDataFrame([(int(i), int(g), None if v != v else float(v)) for g, v, i in pdf.itertuples(index=False)], "id long, g long, v double")
    got = {r.id: r.p for r in ranks.percent_ranks(df, "v", "p", "g").collect()}
    want = pdf.groupby("g")["v"].rank(pct=True, method="average")
    assert len(got) == len(pdf)
    for i, w in enumerate(want):
        assert (got[i] is None and w != w) or abs(got[i] - w) < 1e-12
    q = {r.g: r for r in ranks.quantiles(df, ["g"], "v", {"a": 0.0, "b": 0.37, "c": 1.0}).collect()}
    for g, own in pdf.dropna().groupby("g")["v"]:
        assert all(abs(x - y) < 1e-6 for x, y in zip((q[g].a, q[g].b, q[g].c), own.quantile([0.0, 0.37, 1.0])))
    assert ranks.quantiles(df.limit(0), [], "v", {"a": 0.5}).first()["a"] is None


def test_weighted_quantiles_as_a_loop(spark):
    import numpy as np

    from tidewater.operators import ranks

    rng = np.random.default_rng(4)
    rows = [(int(rng.integers(0, 3)), float(rng.integers(0, 40)), float(rng.random())) for _ in range(400)] + [(7, 2.0, 1.0), (8, None, 1.0)]
    df = spark.createDataFrame(rows, "g int, v double, w double")
    got = {r.g: (r.low, r.high) for r in ranks.weighted_quantiles(df, ["g"], "v", "w", {"low": 0.3, "high": 0.75}).collect()}
    for g in (0, 1, 2, 7):
        own = sorted((v, w) for k, v, w in rows if k == g)
        total = np.cumsum([w for _, w in own])
        assert got[g] == tuple(own[int(np.searchsorted(total, q * total[-1] - 1e-9 * total[-1]))][0] for q in (0.3, 0.75))
    assert set(got) == {0, 1, 2, 7}


def test_price_steps_of_tasks_hardly_ever_done(spark):
    """Logits far below -35 still have gains and costs, so their steps are had while the budget lasts."""
    rows = spark.createDataFrame([(1, 70.0, -60.0), (2, 70.0, -300.0), (3, 70.0, 1.0)], "id long, price double, logit double")
    got = {r["id"]: r for r in spatial.price_steps(rows, 0.05, 0.5, 65.0, 85.0, 5.0, 0.06).collect()}
    assert got[1]["price"] > 65.0 and got[1]["price"] == got[2]["price"]
    assert got[3]["spent"] <= got[3]["limit"] + 1e-6


def test_settings_select_without_a_python_group_each(spark):
    """Equal scores, gaps and the most of a key, against a loop; no Python worker for each key and setting."""
    import random

    rng = random.Random(5)
    start = D(2024, 1, 1)
    rows = [(s, start + dt.timedelta(days=i), rng.choice([0.5, 1.0, 1.5, 2.0]), t, g) for s in range(6) for i in range(40) for t, g in ((1.0, 3), (1.4, 7))]
    found = signals.selected_settings(spark.createDataFrame(rows, "station int, day date, score double, threshold double, gap int"), ["station"], "day", 4)
    want = set()
    for s, t, g in {(r[0], r[3], r[4]) for r in rows}:
        taken = []
        for d, score in sorted(((r[1], r[2]) for r in rows if (r[0], r[3], r[4]) == (s, t, g) and r[2] >= t), key=lambda r: (-r[1], r[0])):
            if len(taken) < 4 and all(abs((d - o).days) >= g for o in taken):
                taken.append(d)
                want.add((s, t, g, d, score))
    assert {tuple(r) for r in found.select("station", "threshold", "gap", "day", "score").collect()} == want
    assert "Pandas" not in found._jdf.queryExecution().toString()


def test_block_totals_of_arrays_are_those_of_rows(spark):
    """Pools held as arrays, pools with a row for each block, and a loop over the draws."""
    import numpy as np
    import pandas as pd

    from tidewater.operators import signals

    rng = np.random.default_rng(4)
    pdf = pd.DataFrame({"g": rng.integers(0, 5, 200), "v": rng.normal(10, 3, 200).round(3)})
    rows = spark.createDataFrame(pdf)
    got = {most: {r.g: (r["mean"], r.low, r.high) for r in signals.block_totals(rows, ["g"], "v", 40, 7, most=most).collect()} for most in (4096, 40, 0)}
    at = spark.range(5).selectExpr("id AS g", "explode(sequence(1, 40)) AS d").selectExpr("*", "explode(sequence(1, 7)) AS s").selectExpr("g", "d", "xxhash64(g, d, s, 1) AS h").toPandas()
    order = rows.selectExpr("g", "v", "xxhash64(v, 1) AS h").toPandas().sort_values(["g", "h", "v"])
    for g, own in order.groupby("g"):
        v = own["v"].to_numpy()
        total = at[at.g == g].groupby("d").apply(lambda t: sum(v[int(h) % len(v)] for h in t.h), include_groups=False)
        want = (total.mean(), *np.quantile(total, [0.025, 0.975]))
        assert all(np.allclose(got[most][g], want) for most in got)


def test_hours_of_several_values_join_rows_once(spark):
    """Each value's days come from one table: no value multiplies the reading of the rows."""
    from tidewater.operators import ordered

    rows = spark.sql("SELECT 1 AS k, TIMESTAMP '2024-01-01 00:30:00' + make_interval(0, 0, 0, 0, CAST(id AS INT)) AS ts, CAST(id AS DOUBLE) AS a, IF(id % 2 = 0, CAST(id AS DOUBLE), NULL) AS b, IF(id % 3 = 0, CAST(id AS DOUBLE), NULL) AS c FROM range(60)")
    found = ordered.on_hours(rows, ["k"], "ts", ["a", "b", "c"])
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Union") <= 2
    alone = {v: {r.ts: (r[f"{v}_before"], r[f"{v}_after"]) for r in ordered.on_hours(rows, ["k"], "ts", [v]).collect()} for v in "abc"}
    for r in found.collect():
        assert all((r[f"{v}_before"], r[f"{v}_after"]) == alone[v][r.ts] for v in "abc")


def test_prices_are_tried_where_options_are(spark):
    """No row for each option and price is grouped."""
    from tidewater.operators import choices

    o = spark.createDataFrame([(k, float(p), 0.1 * p, float(p)) for k in range(3) for p in range(1, 4)], "k long, p double, gain double, cost double")
    plan = choices.priced_choice(o, "k", "p", "gain", "cost", 7.0, [0.0, 0.05, 0.1, 0.2])._jdf.queryExecution().optimizedPlan().toString()
    assert not [line for line in plan.splitlines() if "Aggregate [price" in line and "k#" in line]
