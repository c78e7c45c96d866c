"""Risk plans, scenario bounds, before-and-after comparisons and design variants."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewater.operators import models, ranks
from tidewater.plans import layouts, pricing, river
from tidewater.plans.common import Plan, pct
from tidewater.sources.tables import ANSWERS_SQL, LANES_SQL, answers, lane_days

plan = Plan()
query = plan.query
QUERIES, ORACLES = plan.queries, plan.oracles
LANE = ["origin", "dest"]

RISK_SQL = river.MONTHS_SQL + """, b AS (SELECT origin, dest, month, quantile_cont(total, 0.9) AS upper, quantile_cont(total, 0.9) - quantile_cont(total, 0.1) AS width, avg(total) AS mean FROM months GROUP BY ALL),
s AS (SELECT *, 0.45::DOUBLE * (ln(1 + upper) - min(ln(1 + upper)) OVER w) / nullif(max(ln(1 + upper)) OVER w - min(ln(1 + upper)) OVER w, 0) + 0.20::DOUBLE * (width - min(width) OVER w) / nullif(max(width) OVER w - min(width) OVER w, 0) + 0.20::DOUBLE * (month BETWEEN 6 AND 10)::INT + 0.15::DOUBLE * (mean >= max(mean) OVER w)::INT AS score FROM b WINDOW w AS (PARTITION BY origin, dest)),
q AS (SELECT origin, dest, quantile_cont(score, 0.7) AS q70 FROM s GROUP BY ALL),
risk AS (SELECT s.*, CASE WHEN round(score, 9) >= round(q70, 9) THEN 'high' WHEN month BETWEEN 4 AND 11 THEN 'medium' ELSE 'low' END AS level FROM s JOIN q USING (origin, dest))"""


def risks(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = river.months(spark, sf_dir)
    b = m.groupBy(*LANE, "month").agg(F.percentile("total", 0.9).alias("upper"), (F.percentile("total", 0.9) - F.percentile("total", 0.1)).alias("width"), F.avg("total").alias("mean"))
    b = b.withColumn("l", F.log1p("upper"))
    peak = (F.col("mean") >= F.max("mean").over(Window.partitionBy(*LANE))).cast("int")
    score = 0.45 * ranks.scaled("l", *LANE) + 0.20 * ranks.scaled("width", *LANE) + 0.20 * F.col("month").between(6, 10).cast("int") + 0.15 * peak
    b = b.withColumn("score", score)
    q = b.groupBy(*LANE).agg(F.percentile("score", 0.7).alias("q70"))
    level = F.when(F.round("score", 9) >= F.round("q70", 9), "high").when(F.col("month").between(4, 11), "medium").otherwise("low")
    return b.join(q, LANE).withColumn("level", level)


@query(f"WITH {RISK_SQL} SELECT origin, dest, month, round(score, 6) AS score, level FROM risk")
def risk_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Months by a score of size, uncertainty, season and peak, in three levels."""
    return risks(spark, sf_dir).select(*LANE, "month", F.round("score", 6).alias("score"), "level")


@query(f"""WITH {RISK_SQL}, e AS (SELECT origin, dest, month, level, unnest(generate_series(make_date(2001, month, 1)::TIMESTAMP, last_day(make_date(2001, month, 1))::TIMESTAMP, CASE level WHEN 'high' THEN INTERVAL 2 DAY WHEN 'medium' THEN INTERVAL 5 DAY ELSE INTERVAL 10 DAY END)) AS day FROM risk),
t AS (SELECT *, unnest(CASE level WHEN 'high' THEN [6, 12, 18] WHEN 'medium' THEN [8, 16] ELSE [12] END) AS hour FROM e) SELECT origin, dest, month, level, count(*) AS visits, count(DISTINCT day) AS days FROM t GROUP BY ALL""")
def schedule_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Visits of a year by level: every 2, 5 or 10 days, three times, twice or once a day."""
    r = risks(spark, sf_dir)
    step = F.when(F.col("level") == "high", 2).when(F.col("level") == "medium", 5).otherwise(10)
    first = F.make_date(F.lit(2001), "month", F.lit(1))
    days = r.withColumn("day", F.explode(F.transform(F.sequence(F.lit(0), F.datediff(F.last_day(first), first), step), lambda k: F.date_add(first, k))))
    hours = F.when(F.col("level") == "high", F.array(F.lit(6), F.lit(12), F.lit(18))).when(F.col("level") == "medium", F.array(F.lit(8), F.lit(16))).otherwise(F.array(F.lit(12)))
    return days.withColumn("hour", F.explode(hours)).groupBy(*LANE, "month", "level").agg(F.count(F.lit(1)).alias("visits"), F.count_distinct("day").alias("days"))


@query(f"WITH {RISK_SQL}, r AS (SELECT month, max(CASE level WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END) AS k FROM risk GROUP BY month) SELECT month, CASE k WHEN 3 THEN 'high' WHEN 2 THEN 'medium' ELSE 'low' END AS worst FROM r")
def worst_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.max(F.when(F.col("level") == "high", 3).when(F.col("level") == "medium", 2).otherwise(1))
    r = risks(spark, sf_dir).groupBy("month").agg(k.alias("k"))
    return r.select("month", F.when(F.col("k") == 3, "high").when(F.col("k") == 2, "medium").otherwise("low").alias("worst"))


@query(f"WITH {LANES_SQL}, d AS (SELECT origin, dest, abs(ln(1 + volume) - lag(ln(1 + volume)) OVER (PARTITION BY origin, dest ORDER BY day)) AS j FROM lanes) SELECT origin, dest, round(quantile_cont(j, 0.9), 6) AS scale, count(j) AS n FROM d GROUP BY ALL")
def change_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 90 % quantile of daily log changes: the unit in which triggers are told."""
    l = lane_days(spark, sf_dir)
    j = F.abs(F.log1p("volume") - F.lag(F.log1p(F.col("volume"))).over(Window.partitionBy(*LANE).orderBy("day")))
    return l.select(*LANE, j.alias("j")).groupBy(*LANE).agg(F.round(F.percentile("j", 0.9), 6).alias("scale"), F.count("j").alias("n"))


@query(f"""WITH {river.MONTHS_SQL}, q AS (SELECT month, quantile_cont(total, 0.1) AS a, quantile_cont(total, 0.9) AS b FROM months GROUP BY month), l AS (SELECT origin, dest, month, max(total) FILTER (year = 2000) AS v FROM months GROUP BY ALL)
SELECT origin, dest, month, round(greatest(a, least(v * 0.8, b)), 4) AS low, round(greatest(a, least(v, b)), 4) AS normal, round(greatest(a, least(v * 1.2, b)), 4) AS high FROM l JOIN q USING (month) WHERE v IS NOT NULL""")
def scenario_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three scenarios of each month inside the month's quantiles."""
    m = river.months(spark, sf_dir)
    q = m.groupBy("month").agg(F.percentile("total", 0.1).alias("a"), F.percentile("total", 0.9).alias("b"))
    l = m.where("year = 2000").select(*LANE, "month", F.col("total").alias("v")).join(F.broadcast(q), "month")  # twelve rows
    at = lambda k: F.round(F.greatest("a", F.least(F.col("v") * k, F.col("b"))), 4)
    return l.select(*LANE, "month", at(0.8).alias("low"), at(1.0).alias("normal"), at(1.2).alias("high"))


@query(f"""WITH {LANES_SQL}, d AS (SELECT origin, dest, year(day)::INT AS year, avg(volume) FILTER (month(day) BETWEEN 4 AND 5) AS before, avg(volume) FILTER (month(day) BETWEEN 7 AND 8) AS after FROM lanes GROUP BY ALL)
SELECT origin, dest, count(*) AS years, round(avg(after - before), 6) AS mean_change, round(stddev_samp(after - before), 6) AS spread, round(avg(((after - before) > 0)::INT), 6) AS share_up, CASE WHEN avg(((after - before) > 0)::INT) >= 0.75 THEN 'rise' WHEN avg(((after - before) > 0)::INT) <= 0.25 THEN 'fall' ELSE 'mixed' END AS outcome FROM d WHERE before IS NOT NULL AND after IS NOT NULL GROUP BY ALL""")
def before_and_after(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each year's months after against those before a season, and what most years say."""
    m = F.month("day")
    d = lane_days(spark, sf_dir).groupBy(*LANE, F.year("day").alias("year")).agg(F.avg(F.when(m.between(4, 5), F.col("volume"))).alias("b"), F.avg(F.when(m.between(7, 8), F.col("volume"))).alias("a")).where("a IS NOT NULL AND b IS NOT NULL").withColumn("d", F.col("a") - F.col("b"))
    up = F.avg((F.col("d") > 0).cast("double"))
    return d.groupBy(*LANE).agg(F.count(F.lit(1)).alias("years"), F.round(F.avg("d"), 6).alias("mean_change"), F.round(F.stddev_samp("d"), 6).alias("spread"), F.round(up, 6).alias("share_up"), F.when(up >= 0.75, "rise").when(up <= 0.25, "fall").otherwise("mixed").alias("outcome"))


@query(f"""WITH {LANES_SQL}, m AS (SELECT origin, dest, date_trunc('month', day)::DATE AS month, sum(volume) AS total FROM lanes GROUP BY ALL), d AS (SELECT l.*, m.total, avg(l.volume) OVER (PARTITION BY l.origin, l.dest, l.day - date_trunc('month', l.day)::DATE) AS shape FROM lanes l JOIN m ON m.origin = l.origin AND m.dest = l.dest AND m.month = date_trunc('month', l.day)::DATE)
SELECT origin, dest, day, round(shape * total / sum(shape) OVER (PARTITION BY origin, dest, date_trunc('month', day)) + 1e-9, 6) AS calibrated FROM d""")
def month_calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days in the mean shape of a month, at each month's own total."""
    l = lane_days(spark, sf_dir).withColumn("month", F.trunc("day", "MM"))
    own = Window.partitionBy(*LANE, "month")
    l = l.withColumns({"total": F.sum("volume").over(own), "shape": F.avg("volume").over(Window.partitionBy(*LANE, F.dayofmonth("day")))})
    return l.select(*LANE, "day", F.round(F.col("shape") * F.col("total") / F.sum("shape").over(own) + 1e-9, 6).alias("calibrated"))


@query(f"""WITH {layouts.EFF_SQL}, p AS (SELECT id, round(avg(dni * cosine * air), 9) AS power FROM eff GROUP BY id), r AS (SELECT *, row_number() OVER (ORDER BY power, id) AS k, sum(power) OVER () AS whole, sum(power) OVER (ORDER BY power, id) AS gone, count(*) OVER () AS n FROM p)
SELECT k AS removed, n - k AS kept, round(whole - gone, 4) AS power, round((whole - gone) / (n - k), 6) AS mean FROM r WHERE k IN (50, 100, 200, 400)""")
def pruning_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of a field without its weakest mirrors."""
    p = layouts.efficiencies(spark).groupBy("id").agg(F.round(F.avg(F.col("dni") * F.col("cosine") * F.col("air")), 9).alias("power"))
    own = Window.orderBy("power", "id")  # one field's mirrors
    r = p.withColumns({"k": F.row_number().over(own), "gone": F.sum("power").over(own), "whole": F.sum("power").over(Window.partitionBy()), "n": F.count(F.lit(1)).over(Window.partitionBy())})
    left, kept = F.col("whole") - F.col("gone"), F.col("n") - F.col("k")
    return r.where(F.col("k").isin(50, 100, 200, 400)).select(F.col("k").cast("long").alias("removed"), kept.alias("kept"), F.round(left, 4).alias("power"), F.round(left / kept, 6).alias("mean"))


@query(f"""WITH {pricing.POINTS_SQL}, g AS (SELECT floor(x / 0.5)::BIGINT AS i, floor(y / 0.5)::BIGINT AS j, count(*) AS n, avg(x) AS cx, avg(y) AS cy, sqrt(var_pop(x) + var_pop(y)) AS spread, sum(price) AS price, avg(completed) AS rate FROM points WHERE kind = 'task' GROUP BY 1, 2)
SELECT i, j, n, round(cx, 6) AS cx, round(cy, 6) AS cy, round(spread, 6) AS spread, round(price, 4) AS price, round(rate, 6) AS rate, round(greatest(0, 0.38 * ln(n) + 0.12 * greatest(0, 1 - spread / 0.5) - 0.025 * (n - 1) ** 2), 6) AS bonus FROM g""")
def cell_packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tasks by cells: centre, spread, price, and the bonus a package of them would have."""
    t = pricing.tasks(spark, sf_dir)
    g = t.groupBy(F.floor(F.col("x") / 0.5).alias("i"), F.floor(F.col("y") / 0.5).alias("j")).agg(F.count(F.lit(1)).alias("n"), F.avg("x").alias("cx"), F.avg("y").alias("cy"), F.sqrt(F.var_pop("x") + F.var_pop("y")).alias("spread"), F.sum("price").alias("price"), F.avg("completed").alias("rate"))
    bonus = F.greatest(F.lit(0.0), 0.38 * F.log("n") + 0.12 * F.greatest(F.lit(0.0), 1 - F.col("spread") / 0.5) - 0.025 * F.pow(F.col("n") - 1, F.lit(2)))
    return g.select("i", "j", "n", *[F.round(c, 6).alias(c) for c in ("cx", "cy", "spread")], F.round("price", 4).alias("price"), F.round("rate", 6).alias("rate"), F.round(bonus, 6).alias("bonus"))


@query(f"""WITH {ANSWERS_SQL}, s AS (SELECT source, count(*) AS n, avg(y) AS rate, median(size) AS size FROM answers GROUP BY source), o AS (SELECT *, avg(y) OVER (PARTITION BY lang) AS expected FROM answers), g AS (SELECT source, avg(y - expected) AS gap FROM o GROUP BY source)
SELECT source, n, round(rate, 6) AS rate, round(gap, 6) AS gap, round(size, 6) AS size, round({pct("round(rate, 9)")}, 6) AS pct FROM s JOIN g USING (source)""")
def group_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups' shares against what their rows' languages let expect."""
    a = answers(spark, sf_dir)
    expected = a.groupBy("lang").agg(F.avg("y").alias("expected"))
    a = a.join(F.broadcast(expected), "lang")  # a row for each language of a fixed list
    s = a.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.avg("y").alias("rate"), F.avg(F.col("y") - F.col("expected")).alias("gap"))
    s = s.join(ranks.quantiles(a, ["source"], "size", {"size": 0.5}), "source")
    s = ranks.percent_ranks(s.withColumn("_rate", F.round("rate", 9)), "_rate", "pct")
    return s.select("source", "n", F.round("rate", 6).alias("rate"), F.round("gap", 6).alias("gap"), F.round("size", 6).alias("size"), F.round("pct", 6).alias("pct"))
