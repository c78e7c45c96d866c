"""Sampling policies replayed by halves of the series, with baselines, ablations and fallbacks; grey-model
and template checks of sections."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewater.operators import ranks, relations
from tidewater.plans.common import Plan
from tidewater.plans.river import CAL_SQL, MONTHS_SQL, calendar, months
from tidewater.plans.sections import CHANGE_SQL, LINE_SQL, grid
from tidewater.sources.tables import HYDRO_SQL, LANES_SQL, hydro, lane_days

plan = Plan()
query = plan.query
QUERIES, ORACLES = plan.queries, plan.oracles

#: name, interval, threshold (none: no visits after jumps)
POLICIES = [("weekly", 7, None), ("fortnightly", 14, None), ("every third day", 3, None), ("weekly, low trigger", 7, 1.0), ("weekly, high trigger", 7, 2.0), ("fortnightly, low trigger", 14, 1.0)]
REFERENCE = "weekly"
POLICY_SQL = "p AS (SELECT * FROM (VALUES " + ", ".join(f"('{n}', {i}, {'NULL' if t is None else t}::DOUBLE)" for n, i, t in POLICIES) + ") v(policy, i, t))"
REPLAY_SQL = CAL_SQL + f""", {POLICY_SQL}, sp AS (SELECT *, CASE WHEN day < DATE '2024-01-16' THEN 'first' ELSE 'second' END AS split, day - min(day) OVER (PARTITION BY station) AS age, coalesce(abs(ln(1 + flow) - lag(ln(1 + flow)) OVER (PARTITION BY station ORDER BY day)) / 2.0::DOUBLE, 0) AS jump FROM days),
s AS (SELECT station, day, split, policy, jump, age % i = 0 OR (t IS NOT NULL AND coalesce(max(jump >= t) OVER (PARTITION BY station, policy ORDER BY day ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING), FALSE)) AS sampled FROM sp, p),
n AS (SELECT *, max(sampled) OVER (PARTITION BY station, policy ORDER BY day ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS near FROM s),
g AS (SELECT split, policy, sum(sampled::INT)::BIGINT AS visits, sum((jump >= 1.5)::INT)::BIGINT AS events, sum((jump >= 1.5 AND near)::INT)::BIGINT AS captured FROM n GROUP BY ALL)"""


def sampled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """station, day, split, policy, jump, sampled, near: every policy over every station's days."""
    own = Window.partitionBy("station").orderBy("day")
    jump = F.coalesce(F.abs(F.log1p("flow") - F.lag(F.log1p(F.col("flow"))).over(own)) / 2.0, F.lit(0.0))
    age = F.datediff("day", F.min("day").over(Window.partitionBy("station")))
    days = calendar(spark, sf_dir).select("station", "day", F.when(F.col("day") < F.lit("2024-01-16").cast("date"), "first").otherwise("second").alias("split"), jump.alias("jump"), age.alias("age"))
    policies = F.array(*[F.struct(F.lit(n).alias("policy"), F.lit(i).alias("i"), F.lit(t).cast("double").alias("t")) for n, i, t in POLICIES])
    rows = days.withColumn("p", F.explode(policies)).select("station", "day", "split", "jump", "age", "p.*")
    each = Window.partitionBy("station", "policy").orderBy("day")
    followed = F.col("t").isNotNull() & F.coalesce(F.max(F.col("jump") >= F.col("t")).over(each.rowsBetween(-2, -1)), F.lit(False))
    rows = rows.withColumn("sampled", (F.col("age") % F.col("i") == 0) | followed)
    return rows.withColumn("near", F.max("sampled").over(each.rowsBetween(-1, 1))).select("station", "day", "split", "policy", "jump", "sampled", "near")


def replayed(rows: DataFrame) -> DataFrame:
    """split, policy, visits, events, captured."""
    event = F.col("jump") >= 1.5
    n = lambda c: F.sum(c.cast("long"))
    return rows.groupBy("split", "policy").agg(n(F.col("sampled")).alias("visits"), n(event).alias("events"), n(event & F.col("near")).alias("captured"))


@query(f"""WITH {REPLAY_SQL} SELECT g.split, g.policy, g.visits, g.captured, round(g.captured / nullif(g.events, 0), 6) AS share, g.visits - r.visits AS more_visits, g.captured - r.captured AS more_captured FROM g JOIN g r ON g.split = r.split AND r.policy = '{REFERENCE}'""")
def policy_baselines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each policy against the weekly one in the same half."""
    g = replayed(sampled(spark, sf_dir))
    r = g.where(F.col("policy") == REFERENCE).select("split", F.col("visits").alias("v"), F.col("captured").alias("c"))
    return g.join(r, "split").select("split", "policy", "visits", "captured", F.round(F.col("captured") / F.nullif("events", F.lit(0)), 6).alias("share"), (F.col("visits") - F.col("v")).alias("more_visits"), (F.col("captured") - F.col("c")).alias("more_captured"))


@query(f"""WITH {REPLAY_SQL}, m AS (SELECT g.split, g.policy, min_by(r.policy, (abs(g.visits - r.visits), r.policy)) AS matched FROM g JOIN g r ON g.split = r.split AND r.policy NOT LIKE '%trigger' AND g.policy LIKE '%trigger' GROUP BY ALL)
SELECT m.split, m.policy, m.matched, g.visits - r.visits AS more_visits, g.captured - r.captured AS more_captured FROM m JOIN g ON g.split = m.split AND g.policy = m.policy JOIN g r ON r.split = m.split AND r.policy = m.matched""")
def cost_matched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Policies with visits after jumps against the fixed one whose visits are nearest in number. Policies
    are a short list."""
    g = replayed(sampled(spark, sf_dir))
    fixed = g.where("policy NOT LIKE '%trigger'").select("split", F.col("policy").alias("matched"), F.col("visits").alias("v"), F.col("captured").alias("c"))
    pairs = g.where("policy LIKE '%trigger'").join(fixed, "split")
    best = ranks.first_of_each(pairs, ["split", "policy"], F.abs(F.col("visits") - F.col("v")), F.col("matched"))
    return best.select("split", "policy", "matched", (F.col("visits") - F.col("v")).alias("more_visits"), (F.col("captured") - F.col("c")).alias("more_captured"))


@query(f"""WITH {REPLAY_SQL}, b AS (SELECT *, split_part(policy, ',', 1) AS base FROM g) SELECT b.split, b.policy, b.base AS without, b.visits - r.visits AS visits_delta, b.captured - r.captured AS captured_delta FROM b JOIN g r ON r.split = b.split AND r.policy = b.base WHERE b.policy <> b.base""")
def trigger_ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the visits after jumps add to a policy of the same interval."""
    g = replayed(sampled(spark, sf_dir))
    base = g.select("split", F.col("policy").alias("without"), F.col("visits").alias("v"), F.col("captured").alias("c"))
    rows = g.where("policy LIKE '%,%'").withColumn("without", F.split_part("policy", F.lit(","), F.lit(1))).join(base, ["split", "without"])
    return rows.select("split", "policy", "without", (F.col("visits") - F.col("v")).alias("visits_delta"), (F.col("captured") - F.col("c")).alias("captured_delta"))


@query(f"""WITH {REPLAY_SQL}, k AS (SELECT station, policy, day, day - lag(day) OVER (PARTITION BY station, policy ORDER BY day) AS gap FROM n WHERE sampled), w AS (SELECT policy, max(gap)::INT AS longest, round(avg(gap), 6) AS mean_gap FROM k GROUP BY policy)
SELECT policy, sum(visits)::BIGINT AS visits, round(sum(captured) / sum(events), 6) AS captured, round(1 - sum(visits) / (SELECT sum(visits) FROM g WHERE policy = 'every third day'), 6) AS saved, any_value(longest) AS longest_gap, any_value(mean_gap) AS mean_gap FROM g JOIN w USING (policy) GROUP BY policy""")
def replay_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both halves together: ratios of sums, and the longest time without a visit."""
    rows = sampled(spark, sf_dir)
    gap = F.datediff("day", F.lag("day").over(Window.partitionBy("station", "policy").orderBy("day")))
    w = rows.where("sampled").withColumn("gap", gap).groupBy("policy").agg(F.max("gap").alias("longest_gap"), F.round(F.avg("gap"), 6).alias("mean_gap"))
    g = replayed(rows).groupBy("policy").agg(F.sum("visits").alias("visits"), F.sum("events").alias("events"), F.sum("captured").alias("c"))
    most = g.where("policy = 'every third day'").select(F.col("visits").alias("most"))  # one row
    out = g.join(F.broadcast(most)).join(w, "policy")
    return out.select("policy", "visits", F.round(F.col("c") / F.col("events"), 6).alias("captured"), F.round(1 - F.col("visits") / F.col("most"), 6).alias("saved"), "longest_gap", "mean_gap")


@query(f"""WITH {CAL_SQL}, ev AS (SELECT station, day, jump FROM (SELECT station, day, coalesce(abs(ln(1 + flow) - lag(ln(1 + flow)) OVER (PARTITION BY station ORDER BY day)) / 2.0::DOUBLE, 0) AS jump FROM days) WHERE jump >= 1.5),
a AS (SELECT station, day FROM days WHERE (day - DATE '2024-01-01') % 7 = 0 UNION SELECT station, day FROM days WHERE (day - DATE '2024-01-01') % 14 = 3)
SELECT station, count(*) AS events, count(*) FILTER (EXISTS (SELECT 1 FROM a WHERE a.station = ev.station AND abs(a.day - ev.day) <= 1)) AS captured, round(sum(CASE WHEN EXISTS (SELECT 1 FROM a WHERE a.station = ev.station AND abs(a.day - ev.day) <= 1) THEN jump ELSE 0 END) / sum(jump), 6) AS weighted FROM ev GROUP BY station""")
def calendar_capture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with a visit at most a day away in the merged calendar of two routes, by number and weighted by
    their jumps."""
    days = calendar(spark, sf_dir)
    jump = F.coalesce(F.abs(F.log1p("flow") - F.lag(F.log1p(F.col("flow"))).over(Window.partitionBy("station").orderBy("day"))) / 2.0, F.lit(0.0))
    events = days.select("station", F.col("day").alias("event"), jump.alias("jump")).where("jump >= 1.5")
    age = F.datediff("day", F.lit("2024-01-01").cast("date"))
    merged = days.select("station", F.col("day").alias("visit"), age.alias("age"))
    merged = merged.where("age % 7 = 0").unionByName(merged.where("age % 14 = 3")).select("station", "visit").distinct()
    near = relations.within(events, merged, ["station"], "event", "visit", 1, "left")
    each = near.groupBy("l.station", "l.event", "l.jump").agg(F.count("r.visit").alias("n"))
    return each.groupBy("station").agg(F.count(F.lit(1)).alias("events"), F.count_if(F.col("n") > 0).alias("captured"), F.round(F.sum(F.when(F.col("n") > 0, F.col("jump")).otherwise(0.0)) / F.sum("jump"), 6).alias("weighted"))


@query(f"""WITH {CAL_SQL}, m AS (SELECT station, day, avg(sediment) AS own FROM (SELECT station, ts::DATE AS day, sediment FROM hydro) GROUP BY 1, 2), d AS (SELECT station, day, flow, own FROM days LEFT JOIN m USING (station, day)),
l AS (SELECT *, last_value(own IGNORE NULLS) OVER w AS last, max(CASE WHEN own IS NOT NULL THEN day END) OVER w AS seen FROM d WINDOW w AS (PARTITION BY station ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT station, day, round(coalesce(own, CASE WHEN day - seen <= 3 THEN last END, flow / 10) + 1e-9, 5) AS signal, CASE WHEN own IS NOT NULL THEN 'own' WHEN day - seen <= 3 THEN 'carried' ELSE 'fallback' END AS origin FROM l""")
def fallback_signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The day's own signal, else the last one of at most three days ago, else a tenth of the flow."""
    own = hydro(spark, sf_dir).groupBy("station", F.to_date("ts").alias("day")).agg(F.avg("sediment").alias("own"))
    d = calendar(spark, sf_dir).select("station", "day", "flow").join(own, ["station", "day"], "left")
    w = Window.partitionBy("station").orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    d = d.withColumns({"last": F.last("own", ignorenulls=True).over(w), "at": F.max(F.when(F.col("own").isNotNull(), F.col("day"))).over(w)})
    fresh = F.datediff("day", "at") <= 3
    origin = F.when(F.col("own").isNotNull(), "own").when(fresh, "carried").otherwise("fallback")
    return d.select("station", "day", F.round(F.coalesce(F.col("own"), F.when(fresh, F.col("last")), F.col("flow") / 10) + 1e-9, 5).alias("signal"), origin.alias("origin"))


GREY_SQL = MONTHS_SQL + """, y AS (SELECT origin, dest, year, sum(total) AS x FROM months GROUP BY ALL), r AS (SELECT origin, dest, year, x, lag(x) OVER (PARTITION BY origin, dest ORDER BY year) / x AS level FROM y),
b AS (SELECT origin, dest, count(*) AS n, min(level) AS low, max(level) AS high FROM r GROUP BY ALL)"""


@query(f"WITH {GREY_SQL} SELECT origin, dest, n, round(low, 6) AS low, round(high, 6) AS high, low > exp(-2.0 / (n + 1)) AND high < exp(2.0 / (n + 1)) AS passed FROM b")
def level_ratio_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a lane's yearly ratios lie within the bounds that a grey model asks for."""
    y = months(spark, sf_dir).groupBy("origin", "dest", "year").agg(F.sum("total").alias("x"))
    r = y.withColumn("level", F.lag("x").over(Window.partitionBy("origin", "dest").orderBy("year")) / F.col("x"))
    b = r.groupBy("origin", "dest").agg(F.count(F.lit(1)).alias("n"), F.min("level").alias("low"), F.max("level").alias("high"))
    edge = 2.0 / (F.col("n") + 1)
    return b.select("origin", "dest", "n", F.round("low", 6).alias("low"), F.round("high", 6).alias("high"), ((F.col("low") > F.exp(-edge)) & (F.col("high") < F.exp(edge))).alias("passed"))


HIND_SQL = MONTHS_SQL + """, y AS (SELECT origin, dest, year, sum(total) AS x FROM months GROUP BY ALL), k AS (SELECT *, sum(x) OVER w AS c, row_number() OVER w AS k FROM y WINDOW w AS (PARTITION BY origin, dest ORDER BY year)),
z AS (SELECT *, -(c + lag(c) OVER (PARTITION BY origin, dest ORDER BY k)) / 2 AS z FROM k WHERE k <= 4), f AS (SELECT origin, dest, regr_slope(x, z) FILTER (k > 1) AS a, regr_intercept(x, z) FILTER (k > 1) AS b, max(CASE WHEN k = 1 THEN x END) AS first FROM z GROUP BY ALL)"""


@query(f"""WITH {HIND_SQL}, h AS (SELECT f.origin, f.dest, a, b, (first - b / a) * (exp(-a * 4) - exp(-a * 3)) AS hindcast, x AS actual FROM f JOIN k ON k.origin = f.origin AND k.dest = f.dest AND k.k = 5 WHERE a <> 0)
SELECT origin, dest, scenario, round(hindcast * factor, 4) AS hindcast, round(actual, 4) AS actual, round(100 * (hindcast * factor - actual) / actual, 4) AS error_pct FROM h, (VALUES ('low', 0.9::DOUBLE), ('central', 1.0::DOUBLE), ('high', 1.1::DOUBLE)) v(scenario, factor)""")
def grey_hindcast(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A grey model of each lane's first four years told for the fifth one, under three scenarios."""
    own = Window.partitionBy("origin", "dest").orderBy("year")
    k = months(spark, sf_dir).groupBy("origin", "dest", "year").agg(F.sum("total").alias("x")).withColumns({"c": F.sum("x").over(own.rowsBetween(Window.unboundedPreceding, 0)), "k": F.row_number().over(own)})
    z = k.where("k <= 4").withColumn("z", -(F.col("c") + F.lag("c").over(Window.partitionBy("origin", "dest").orderBy("k"))) / 2)
    later = F.when(F.col("k") > 1, F.col("x"))
    f = z.groupBy("origin", "dest").agg(F.regr_slope(later, F.col("z")).alias("a"), F.regr_intercept(later, F.col("z")).alias("b"), F.max(F.when(F.col("k") == 1, F.col("x"))).alias("first")).where("a <> 0")
    h = f.join(k.where("k = 5").select("origin", "dest", F.col("x").alias("actual")), ["origin", "dest"])
    value = (F.col("first") - F.col("b") / F.col("a")) * (F.exp(-F.col("a") * 4) - F.exp(-F.col("a") * 3))
    rows = h.select("origin", "dest", "actual", value.alias("h"), F.explode(F.create_map(F.lit("low"), F.lit(0.9), F.lit("central"), F.lit(1.0), F.lit("high"), F.lit(1.1))).alias("scenario", "factor"))
    told = F.col("h") * F.col("factor")
    return rows.select("origin", "dest", "scenario", F.round(told, 4).alias("hindcast"), F.round("actual", 4).alias("actual"), F.round(100 * (told - F.col("actual")) / F.col("actual"), 4).alias("error_pct"))


@query(f"""WITH {CHANGE_SQL}, t AS (SELECT survey, k, d FROM ch WHERE before IS NOT NULL), s AS (SELECT k, sum(d) AS s, count(*) AS n FROM t GROUP BY k HAVING count(*) > 1)
SELECT survey, count(*) AS points, round(sqrt(avg((d - (s - d) / (n - 1)) ** 2)), 5) AS rmse, round(avg(d - (s - d) / (n - 1)), 5) AS bias, round(avg((sign(d) = sign((s - d) / (n - 1)))::INT), 6) AS same_sign FROM t JOIN s USING (k) GROUP BY survey""")
def template_leave_one_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each survey's change against the mean change of all other surveys at the same places, from sums."""
    rows = grid(spark, sf_dir).select("survey", "k", F.col("linear").alias("z"))
    d = F.col("z") - F.lag("z").over(Window.partitionBy("k").orderBy("survey"))
    t = rows.withColumn("d", d).where("d IS NOT NULL")
    s = t.groupBy("k").agg(F.sum("d").alias("s"), F.count(F.lit(1)).alias("n")).where("n > 1")
    other = (F.col("s") - F.col("d")) / (F.col("n") - 1)
    e = F.col("d") - other
    return t.join(s, "k").groupBy("survey").agg(F.count(F.lit(1)).alias("points"), F.round(F.sqrt(F.avg(e * e)), 5).alias("rmse"), F.round(F.avg(e), 5).alias("bias"), F.round(F.avg((F.signum("d") == F.signum(other)).cast("double")), 6).alias("same_sign"))


@query(f"WITH {LINE_SQL}, m AS (SELECT k, survey, z, lag(z) OVER (PARTITION BY k ORDER BY survey) AS b FROM grid) SELECT k, count(*) AS surveys, round(min(z), 5) AS low, round(max(z), 5) AS high, round(arg_min(z, survey), 5) AS first, round(arg_max(z, survey), 5) AS last, round(coalesce(sum(abs(z - b)), 0), 4) AS moved FROM m GROUP BY k")
def survey_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All surveys on the common grid: range at each place, first and last height, and what moved between
    surveys one after another."""
    rows = grid(spark, sf_dir).select("survey", "k", F.col("linear").alias("z"))
    rows = rows.withColumn("b", F.lag("z").over(Window.partitionBy("k").orderBy("survey")))
    r = lambda c, n: F.round(c, n)
    return rows.groupBy("k").agg(F.count(F.lit(1)).alias("surveys"), r(F.min("z"), 5).alias("low"), r(F.max("z"), 5).alias("high"), r(F.min_by("z", "survey"), 5).alias("first"), r(F.max_by("z", "survey"), 5).alias("last"), r(F.coalesce(F.sum(F.abs(F.col("z") - F.col("b"))), F.lit(0.0)), 4).alias("moved"))


@query(f"""WITH {LANES_SQL}, w AS (SELECT origin, dest, year(day)::INT AS year, min(day) FILTER (month(day) = 7) AS july_first, max(day) FILTER (month(day) = 7) AS july_last, min(day) FILTER (month(day) BETWEEN 6 AND 9) AS season_first, max(day) FILTER (month(day) BETWEEN 6 AND 9) AS season_last FROM lanes GROUP BY ALL)
SELECT w.*, a.volume AS volume_first, b.volume AS volume_last, b.volume - a.volume AS change FROM w JOIN lanes a ON a.origin = w.origin AND a.dest = w.dest AND a.day = season_first JOIN lanes b ON b.origin = w.origin AND b.dest = w.dest AND b.day = season_last""")
def season_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first and last day with volume in July and in the season of each year, and the change over it."""
    in_july, season = F.month("day") == 7, F.month("day").between(6, 9)
    at = F.struct("day", "volume")
    g = lane_days(spark, sf_dir).groupBy("origin", "dest", F.year("day").alias("year")).agg(F.min(F.when(in_july, F.col("day"))).alias("july_first"), F.max(F.when(in_july, F.col("day"))).alias("july_last"), F.min(F.when(season, at)).alias("a"), F.max(F.when(season, at)).alias("b"))
    return g.where("a IS NOT NULL").select("origin", "dest", "year", "july_first", "july_last", F.col("a.day").alias("season_first"), F.col("b.day").alias("season_last"), F.col("a.volume").alias("volume_first"), F.col("b.volume").alias("volume_last"), (F.col("b.volume") - F.col("a.volume")).alias("change"))


@query(f"""WITH {LANES_SQL}, y AS (SELECT year(day)::INT AS year, origin, sum(volume) AS v, count(DISTINCT day) AS days FROM lanes GROUP BY ALL), t AS (SELECT *, v - lag(v) OVER (PARTITION BY origin ORDER BY year) AS d FROM y)
SELECT year, origin, CASE WHEN d IS NULL THEN 'first year' WHEN d > 0 THEN 'rise' WHEN d < 0 THEN 'fall' ELSE 'level' END AS verdict, origin || ' ' || year || ': ' || round(v)::BIGINT || ' on ' || days || ' days, ' || coalesce('change ' || round(d)::BIGINT, 'no year before') AS evidence FROM t""")
def evidence_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each year tells of a region, in words."""
    y = lane_days(spark, sf_dir).groupBy(F.year("day").alias("year"), "origin").agg(F.sum("volume").alias("v"), F.count_distinct("day").alias("days"))
    y = y.withColumn("d", F.col("v") - F.lag("v").over(Window.partitionBy("origin").orderBy("year")))
    verdict = F.when(F.col("d").isNull(), "first year").when(F.col("d") > 0, "rise").when(F.col("d") < 0, "fall").otherwise("level")
    whole = lambda c: F.round(c).cast("long").cast("string")
    text = F.concat(F.col("origin"), F.lit(" "), F.col("year").cast("string"), F.lit(": "), whole(F.col("v")), F.lit(" on "), F.col("days").cast("string"), F.lit(" days, "), F.coalesce(F.concat(F.lit("change "), whole(F.col("d"))), F.lit("no year before")))
    return y.select("year", "origin", verdict.alias("verdict"), text.alias("evidence"))
