"""Tasks and members in space: neighbourhoods, supply, regions, prices and packages."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewater.operators import ranks, spatial
from tidewater.plans.common import Plan, pct
from tidewater.sources.shared import written
from tidewater.sources.tables import POINTS_SQL, points

plan = Plan()
query = plan.query
QUERIES, ORACLES = plan.queries, plan.oracles
RADIUS = 2.0


def tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return points(spark, sf_dir).where("kind = 'task'")


def members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return points(spark, sf_dir).where("kind = 'member'")


NEAR_SQL = POINTS_SQL + f""", near AS (SELECT a.id, a.price, b.id AS other, b.kind, b.price AS p, b.quota, b.credit, sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) AS d
    FROM points a JOIN points b ON a.kind = 'task' AND a.id <> b.id AND sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) <= {RADIUS})"""


@query(f"""WITH {NEAR_SQL}, f AS (SELECT id, count(*) FILTER (kind = 'task') AS n_tasks, count(*) FILTER (kind = 'member') AS n_members, coalesce(sum(quota) FILTER (kind = 'member'), 0) AS quota,
    avg(p) FILTER (kind = 'task') AS mean_price, avg((p > price)::INT) FILTER (kind = 'task') AS dearer, min(d) FILTER (kind = 'task') AS nearest FROM near GROUP BY id)
SELECT t.id, coalesce(n_tasks, 0) AS n_tasks, coalesce(n_members, 0) AS n_members, coalesce(f.quota, 0) AS quota, round(coalesce(mean_price, price), 6) AS mean_price, round(coalesce(dearer, 0), 6) AS dearer, round(nearest, 6) AS nearest,
    round((coalesce(n_tasks, 0) + 1) / (coalesce(f.quota, 0) + 1), 6) AS pressure FROM points t LEFT JOIN f USING (id) WHERE t.kind = 'task'""")
def radius_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is around each task: other tasks, members and their quota, prices. A task alone has its own
    price as the local one."""
    t = tasks(spark, sf_dir)
    numbers = points(spark, sf_dir).select("id", "x", "y", "price", "quota", (F.col("kind") == "task").alias("task"))

    def work(l: dict, r: dict, d: np.ndarray, near: np.ndarray) -> list[np.ndarray]:
        near = near & (l["id"][:, None] != r["id"][None, :])
        task = r["task"].astype(bool)
        own = near[:, task]
        return [own.sum(1), near[:, ~task].sum(1), near[:, ~task] @ r["quota"][~task], own @ r["price"][task], (own & (r["price"][task][None, :] > l["price"][:, None])).sum(1)]

    sums = spatial.radius_sums(t.select("id", "x", "y", "price"), numbers, RADIUS, work, ["n_tasks", "n_members", "quota", "prices", "above"])
    n = F.nullif(F.col("n_tasks"), F.lit(0.0))
    f = sums.select("id", F.col("n_tasks").cast("long").alias("n_tasks"), F.col("n_members").cast("long").alias("n_members"), "quota", (F.col("prices") / n).alias("mean_price"), (F.col("above") / n).alias("dearer"))
    at = t.select("id", "x", "y")
    f = f.join(spatial.nearest(at, at, 1, RADIUS, self_join=True, most=RADIUS).select("l.id", F.col("d").alias("nearest")), "id", "left")
    rows = t.select("id", "price").join(f, "id", "left").fillna(0, ["n_tasks", "n_members", "quota", "dearer"])
    return rows.select("id", "n_tasks", "n_members", "quota", F.round(F.coalesce("mean_price", "price"), 6).alias("mean_price"), F.round("dearer", 6).alias("dearer"), F.round("nearest", 6).alias("nearest"), F.round((F.col("n_tasks") + 1) / (F.col("quota") + 1), 6).alias("pressure"))


@query(f"WITH {NEAR_SQL} SELECT t.id, round(coalesce(sum(exp((p - t.price) / 5)), 0), 6) AS competition FROM points t LEFT JOIN near n ON n.id = t.id AND n.kind = 'task' WHERE t.kind = 'task' GROUP BY t.id")
def competition(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tasks(spark, sf_dir).select("id", "x", "y", "price")
    pairs = spatial.radius_pairs(t, t, RADIUS).where("l.id <> r.id")
    sums = pairs.groupBy(F.col("l.id").alias("id")).agg(F.sum(F.exp((F.col("r.price") - F.col("l.price")) / 5)).alias("c"))
    return t.select("id").join(sums, "id", "left").select("id", F.round(F.coalesce("c", F.lit(0.0)), 6).alias("competition"))


def supply(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, supply, density of each task: members' strengths fall with distance."""
    m = members(spark, sf_dir)
    middle = ranks.quantiles(m.where("quota > 0"), [], "quota", {"_median": 0.5})  # one row
    m = ranks.percent_ranks(m.withColumn("_credit", F.round("credit", 9)), "_credit", "_rank").join(F.broadcast(middle))
    m = m.withColumn("s", F.least(F.lit(3.0), F.greatest(F.lit(0.35), F.sqrt(F.col("quota") / F.col("_median")))) * (0.5 + F.col("_rank")))
    m = m.join(F.broadcast(m.agg(F.avg("s").alias("_mean")))).withColumn("s", F.col("s") / F.col("_mean"))
    t = tasks(spark, sf_dir).select("id", "x", "y", "price")
    at = t.select("id", "x", "y")
    sums = spatial.radius_sums(at, m.select("id", "x", "y", "s"), RADIUS, lambda l, r, d, near: [np.where(near, np.exp(-d / 1.5), 0.0) @ r["s"]], ["supply"])
    around = spatial.radius_sums(at, at, RADIUS, lambda l, r, d, near: [near.sum(1)], ["density"]).withColumn("density", F.col("density").cast("long"))
    return t.join(sums, "id", "left").join(around, "id", "left").select("id", "x", "y", "price", F.coalesce("supply", F.lit(0.0)).alias("supply"), F.coalesce("density", F.lit(0)).alias("density"))


SUPPLY_SQL = NEAR_SQL + f""", mem AS (SELECT *, least(3::DOUBLE, greatest(0.35::DOUBLE, sqrt(quota / (SELECT median(quota) FROM points WHERE kind = 'member' AND quota > 0)))) * (0.5::DOUBLE + {pct("round(credit, 9)")}) AS s0 FROM points WHERE kind = 'member'),
strength AS (SELECT id, x, y, s0 / avg(s0) OVER () AS s FROM mem),
sup AS (SELECT t.id, t.x, t.y, t.price, coalesce((SELECT sum(s * exp(-sqrt((t.x - m.x) ** 2 + (t.y - m.y) ** 2) / 1.5::DOUBLE)) FROM strength m WHERE sqrt((t.x - m.x) ** 2 + (t.y - m.y) ** 2) <= {RADIUS}), 0) AS supply,
    (SELECT count(*) FROM points o WHERE o.kind = 'task' AND sqrt((t.x - o.x) ** 2 + (t.y - o.y) ** 2) <= {RADIUS}) AS density FROM points t WHERE kind = 'task')"""


@query(f"WITH {SUPPLY_SQL} SELECT id, round(supply, 6) AS supply, density, round(density / (supply + 0.5), 6) AS pressure FROM sup")
def effective_supply(spark: SparkSession, sf_dir: str) -> DataFrame:
    return supply(spark, sf_dir).select("id", F.round("supply", 6).alias("supply"), "density", F.round(F.col("density") / (F.col("supply") + 0.5), 6).alias("pressure"))


@query(f"""WITH {SUPPLY_SQL}, p AS (SELECT id, supply, density, density / (supply + 0.5) AS pressure FROM sup),
q AS (SELECT quantile_cont(pressure, 0.75) AS hp, quantile_cont(density, 0.25) AS ld, quantile_cont(density, 0.75) AS hd, quantile_cont(supply, 0.5) AS ms, quantile_cont(pressure, 0.95) AS p95 FROM p)
SELECT id, CASE WHEN density <= ld THEN 2 WHEN pressure >= hp THEN 3 WHEN density >= hd AND supply >= ms THEN 5 ELSE 4 END AS size, CASE WHEN density <= ld THEN 0.55::DOUBLE WHEN pressure >= hp THEN 0.25::DOUBLE WHEN density >= hd AND supply >= ms THEN 0.35::DOUBLE ELSE 0.40::DOUBLE END AS spread,
    round(greatest(0, pressure / p95 - 1), 6) AS penalty FROM p, q""")
def adaptive_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Package size and spread by quartiles; the last rule that fits wins. A penalty for pressure beyond its
    95th percentile."""
    rows = written(supply(spark, sf_dir).withColumn("pressure", F.col("density") / (F.col("supply") + 0.5)), "supply")
    q = ranks.quantiles(rows, [], "pressure", {"hp": 0.75, "p95": 0.95})
    q = q.join(F.broadcast(ranks.quantiles(rows, [], "density", {"ld": 0.25, "hd": 0.75}))).join(F.broadcast(ranks.quantiles(rows, [], "supply", {"ms": 0.5})))
    rows = rows.join(F.broadcast(q))  # one row
    few, high, dense = F.col("density") <= F.col("ld"), F.col("pressure") >= F.col("hp"), (F.col("density") >= F.col("hd")) & (F.col("supply") >= F.col("ms"))
    rule = lambda a, b, c, d: F.when(few, a).when(high, b).when(dense, c).otherwise(d)
    return rows.select("id", rule(2, 3, 5, 4).alias("size"), rule(0.55, 0.25, 0.35, 0.40).alias("spread"), F.round(F.greatest(F.lit(0.0), F.col("pressure") / F.col("p95") - 1), 6).alias("penalty"))


POLYGONS = {
    "east": [[(0.5, -2.0), (3.0, -2.5), (3.5, 2.0), (0.5, 2.5)]],
    "ring": [[(-2.5, -1.5), (0.5, -1.5), (0.5, 1.5), (-2.5, 1.5)], [(-1.5, -0.7), (-0.5, -0.7), (-0.5, 0.7), (-1.5, 0.7)]],
    "north": [[(-2.0, 1.5), (0.4, 1.5), (0.0, 4.0)]],
}
RINGS_SQL = ", ".join(f"('{n}', {k}, {x1}::DOUBLE, {y1}::DOUBLE, {x2}::DOUBLE, {y2}::DOUBLE)" for n, rings in POLYGONS.items() for k, ring in enumerate(rings) for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1]))


@query(f"""WITH {POINTS_SQL}, sides(name, ring, x1, y1, x2, y2) AS (VALUES {RINGS_SQL}),
hits AS (SELECT id, name FROM points JOIN sides ON (y1 > y) <> (y2 > y) AND x < x1 + (y - y1) * (x2 - x1) / (y2 - y1) GROUP BY id, name HAVING count(*) % 2 = 1),
one AS (SELECT id, min(name) AS name FROM hits GROUP BY id), mid AS (SELECT name, avg(x1) AS cx, avg(y1) AS cy FROM sides WHERE ring = 0 GROUP BY name),
near AS (SELECT id, min_by(name, ((x - cx) ** 2 + (y - cy) ** 2, name)) AS name FROM points, mid GROUP BY id)
SELECT id, coalesce(o.name, n.name) AS region, o.name IS NOT NULL AS within FROM near n LEFT JOIN one o USING (id)""")
def pip_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The polygon that each point is in (holes are outside), or the nearest one."""
    return spatial.assigned(points(spark, sf_dir), POLYGONS, "region").select("id", "region", "within")


@query(f"""WITH {POINTS_SQL}, d AS (SELECT t.id, m.id AS member, sqrt((t.x - m.x) ** 2 + (t.y - m.y) ** 2) AS d FROM points t JOIN points m ON t.kind = 'task' AND m.kind = 'member'),
r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d, member) AS rank FROM d) SELECT id, member, round(d, 6) AS d, rank::INT AS rank FROM r WHERE rank <= 3""")
def nearest_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three nearest members of each task."""
    near = spatial.nearest(tasks(spark, sf_dir).select("id", "x", "y"), members(spark, sf_dir).select("id", "x", "y"), 3, 1.0)
    return near.select("l.id", F.col("r.id").alias("member"), F.round("d", 6).alias("d"), "rank")


@query(f"""WITH {POINTS_SQL}, d AS (SELECT t.id, o.price, row_number() OVER (PARTITION BY t.id ORDER BY sqrt((t.x - o.x) ** 2 + (t.y - o.y) ** 2), o.id) AS k FROM points t JOIN points o ON t.kind = 'member' AND o.kind = 'task')
SELECT id, price AS local_price FROM d WHERE k = 1""")
def nearest_transfer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each member's local price: that of the nearest task."""
    near = spatial.nearest(members(spark, sf_dir).select("id", "x", "y"), tasks(spark, sf_dir).select("id", "x", "y", "price"), 1, 1.0)
    return near.select("l.id", F.col("r.price").alias("local_price"))


LOGIT_SQL = SUPPLY_SQL + ", logits AS (SELECT id, price, 0.8 * ln(1 + supply) - 0.05 * density + 0.06 * (price - 75) AS logit FROM sup)"


def logits(spark: SparkSession, sf_dir: str) -> DataFrame:
    z = 0.8 * F.log1p("supply") - 0.05 * F.col("density") + 0.06 * (F.col("price") - 75)
    return supply(spark, sf_dir).withColumn("logit", z)


@query(f"""WITH {LOGIT_SQL}, menu AS (SELECT id, price, logit, unnest(range(0, 41)) * 0.5::DOUBLE + 65 AS p FROM logits),
ok AS (SELECT id, min(CASE WHEN round(1 / (1 + exp(-(logit + 0.06::DOUBLE * (p - price)))), 9) >= 0.6::DOUBLE THEN p END) AS p FROM menu GROUP BY id)
SELECT id, coalesce(p, 85) AS price, p IS NOT NULL AS reachable FROM ok""")
def price_menu(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The least price of the menu at which a task is likely enough to be done; else the top price."""
    rows = logits(spark, sf_dir).withColumn("p", F.explode(F.transform(F.sequence(F.lit(0), F.lit(40)), lambda k: 65 + k * 0.5)))
    z = F.col("logit") + 0.06 * (F.col("p") - F.col("price"))
    done = F.round(1 / (1 + F.exp(-z)), 9) >= 0.6
    best = rows.groupBy("id").agg(F.min(F.when(done, F.col("p"))).alias("p"))
    return best.select("id", F.coalesce("p", F.lit(85.0)).alias("price"), F.col("p").isNotNull().alias("reachable"))


STEP_SQL = LOGIT_SQL + """, st AS (SELECT id, price, logit, greatest(65, price - 5) AS start, floor((least(85, price + 5) - greatest(65, price - 5)) / 0.5 + 1e-9)::INT AS n FROM logits),
ba AS (SELECT sum(price / (1 + exp(-logit))) AS now, sum(start / (1 + exp(-(logit + 0.06::DOUBLE * (start - price))))) AS begun FROM st),
sk AS (SELECT id, k, price, logit, start + 0.5 * (k - 1) AS a, start + 0.5 * k AS b FROM (SELECT *, unnest(range(1, n + 1)) AS k FROM st)),
sg AS (SELECT id, k, 1 / (1 + exp(-(logit + 0.06::DOUBLE * (b - price)))) - 1 / (1 + exp(-(logit + 0.06::DOUBLE * (a - price)))) AS gain, b / (1 + exp(-(logit + 0.06::DOUBLE * (b - price)))) - a / (1 + exp(-(logit + 0.06::DOUBLE * (a - price)))) AS cost FROM sk),
sl AS (SELECT *, min(CASE WHEN gain > 0 AND cost > 0 THEN gain / cost ELSE 0 END) OVER (PARTITION BY id ORDER BY k) AS least FROM sg), sv AS (SELECT *, floor(round(least * 20000, 6)) AS level FROM sl WHERE least > 0),
lv AS (SELECT level, sum(sum(cost)) OVER (ORDER BY level DESC) AS spent FROM sv GROUP BY level), cu AS (SELECT min(level) AS cut, max(spent) AS spent FROM lv, ba WHERE round(begun + spent, 6) <= round(now * 1.05::DOUBLE, 6)), tk AS (SELECT id, count(*) AS taken FROM sv, cu WHERE level >= cut GROUP BY id)"""


@query(f"WITH {STEP_SQL} SELECT id, start + 0.5 * coalesce(taken, 0) AS price, round(now * 1.05::DOUBLE, 4) AS limit_, round(begun + coalesce(spent, 0), 4) AS spent FROM st LEFT JOIN tk USING (id), ba, cu")
def price_greedy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Price steps by gain for cost within 5 % more payout in all, at most 5 off today's price."""
    rows = spatial.price_steps(logits(spark, sf_dir), 0.05, 0.5, 65.0, 85.0, 5.0, 0.06)
    return rows.select("id", "price", F.round("limit", 4).alias("limit_"), F.round("spent", 4).alias("spent"))


@query(f"""WITH {LOGIT_SQL}, s AS (SELECT 'now' AS scheme, price, price AS before, logit FROM logits UNION ALL SELECT 'flat', 75::DOUBLE, price, logit + 0.06::DOUBLE * (75 - price) FROM logits)
SELECT scheme, count(*) AS n, round(avg(price), 6) AS mean_price, round(sum(1 / (1 + exp(-logit))), 5) AS expected, round(sum(price / (1 + exp(-logit))), 4) AS payout, count(*) FILTER (price > before) AS raised, count(*) FILTER (price < before) AS lowered, count(*) FILTER (price >= 85) AS at_top, count(*) FILTER (price <= 65) AS at_bottom FROM s GROUP BY scheme""")
def scheme_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = logits(spark, sf_dir)
    now = rows.select(F.lit("now").alias("scheme"), "price", F.col("price").alias("before"), "logit")
    flat = rows.select(F.lit("flat").alias("scheme"), F.lit(75.0).alias("price"), F.col("price").alias("before"), (F.col("logit") + 0.06 * (75 - F.col("price"))).alias("logit"))
    p = 1 / (1 + F.exp(-F.col("logit")))
    return now.unionByName(flat).groupBy("scheme").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("price"), 6).alias("mean_price"), F.round(F.sum(p), 5).alias("expected"), F.round(F.sum(F.col("price") * p), 4).alias("payout"),
        F.count_if(F.col("price") > F.col("before")).alias("raised"), F.count_if(F.col("price") < F.col("before")).alias("lowered"), F.count_if(F.col("price") >= 85).alias("at_top"), F.count_if(F.col("price") <= 65).alias("at_bottom"))


@query(f"""WITH {POINTS_SQL}, t AS (SELECT * FROM points WHERE kind = 'task'), p AS (SELECT a.id AS i, b.id AS j, a.x AS ax, a.y AS ay, b.x AS bx, b.y AS b_y, sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) AS d, a.price + b.price AS price FROM t a JOIN t b ON a.id < b.id AND sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) <= 0.3),
k AS (SELECT i, j, unnest([0.9, 0.95, 1.0])::DOUBLE AS factor, d, price FROM p)
SELECT i, j, factor, round(d, 6) AS spread, round(price * factor, 6) AS price, round(greatest(0, 0.38 * ln(2) + 0.12 * (1 - d / 0.3) - 0.025), 6) AS bonus FROM k""")
def bundle_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bundles of two near tasks at each price factor, with their route bonus."""
    t = tasks(spark, sf_dir).select("id", "x", "y", "price")
    pairs = spatial.radius_pairs(t, t, 0.3).where("l.id < r.id").withColumn("factor", F.explode(F.array(F.lit(0.9), F.lit(0.95), F.lit(1.0))))
    bonus = F.greatest(F.lit(0.0), 0.38 * F.log(F.lit(2.0)) + 0.12 * (1 - F.col("d") / 0.3) - 0.025)
    return pairs.select(F.col("l.id").alias("i"), F.col("r.id").alias("j"), "factor", F.round("d", 6).alias("spread"), F.round((F.col("l.price") + F.col("r.price")) * F.col("factor"), 6).alias("price"), F.round(bonus, 6).alias("bonus"))


@query(f"WITH {POINTS_SQL}, f AS (SELECT id, completed, (((floor(x / 0.5) * 31 + floor(y / 0.5) * 17)::BIGINT % 5) + 5) % 5 AS fold FROM points) SELECT fold, count(*) AS n, round(avg(completed), 6) AS rate FROM f GROUP BY fold")
def spatial_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cross-validation folds by grid cells."""
    fold = F.pmod(F.floor(F.col("x") / 0.5) * 31 + F.floor(F.col("y") / 0.5) * 17, F.lit(5))
    return points(spark, sf_dir).select(fold.alias("fold"), "completed").groupBy("fold").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("completed"), 6).alias("rate"))


@query()
def package_greedy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packages of near tasks with their size and shortest tree."""
    t = tasks(spark, sf_dir).select("id", "x", "y")
    rows = spatial.packages(t, 0.4, 5).join(t, "id")
    return spatial.spanning_lengths(rows.select("cell", "package", "x", "y"), ["cell", "package"])


@query(f"""WITH {LOGIT_SQL}, g AS (SELECT id % 40 AS bundle, count(*) AS n, avg(logit) AS z, sum(price) AS price FROM logits GROUP BY 1),
o AS (SELECT bundle, n, z, price, unnest(range(1, 71)) AS reward FROM g),
v AS (SELECT *, (price + reward) / (1 + exp(-(z + 0.03::DOUBLE * reward + 0.12))) AS cost, price / (1 + exp(-z)) AS base FROM o)
SELECT bundle, n, max(CASE WHEN round(cost - base * 1.3::DOUBLE, 9) <= 0 THEN reward END)::INT AS reward FROM v GROUP BY bundle, n""")
def neutral_rewards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The largest reward of each bundle whose expected cost stays within 1.3 times today's."""
    g = logits(spark, sf_dir).groupBy(F.pmod("id", F.lit(40)).alias("bundle")).agg(F.count(F.lit(1)).alias("n"), F.avg("logit").alias("z"), F.sum("price").alias("price"))
    rows = g.withColumn("reward", F.explode(F.sequence(F.lit(1), F.lit(70))))
    cost = (F.col("price") + F.col("reward")) / (1 + F.exp(-(F.col("z") + 0.03 * F.col("reward") + 0.12)))
    base = F.col("price") / (1 + F.exp(-F.col("z")))
    return rows.groupBy("bundle", "n").agg(F.max(F.when(F.round(cost - base * 1.3, 9) <= 0, F.col("reward"))).alias("reward"))
