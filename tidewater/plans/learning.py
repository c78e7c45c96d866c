"""Fitted forecasts, their choice by past errors, and choices under a budget."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewater.functions.rounding import half_up
from tidewater.operators import choices, ranks, spatial
from tidewater.plans import glass, layouts, pricing, river, sections
from tidewater.plans.common import Plan
from tidewater.sources import files
from tidewater.sources.shared import written
from tidewater.sources.tables import ANSWERS_SQL, LANES_SQL, answers

plan = Plan()
query = plan.query
QUERIES, ORACLES = plan.queries, plan.oracles
LANE = ["origin", "dest"]
WAVES = ["trend", "s1", "c1", "s2", "c2"]


def waves(rows: DataFrame) -> DataFrame:
    """A trend and two harmonics of the year."""
    m = F.col("month")
    return rows.withColumns({"trend": (F.col("year") - 1995) + (m - 1) / 12, **{f"{n}{k}": f(2 * math.pi * k / 12 * m) for k in (1, 2) for n, f in (("s", F.sin), ("c", F.cos))}})


@query()
def fourier_ridge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twelve months ahead of each lane by ridge regression of logs on a trend and harmonics."""
    m = river.months(spark, sf_dir).where("total > 0").withColumn("l", F.log("total"))
    fit = choices.ridge_by(waves(m), LANE, WAVES, "l", 1.0)
    ahead = waves(fit.withColumns({"year": F.lit(2001), "month": F.explode(F.sequence(F.lit(1), F.lit(12)))}))
    return ahead.select(*LANE, "month", F.round(F.exp(choices.predicted(WAVES)), 4).alias("forecast"))


@query()
def lag_ridge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twelve months ahead, each from the months 1, 2 and 12 before it, forecast ones included."""
    m = river.months(spark, sf_dir).where("total > 0").select(*LANE, (F.col("year") * 12 + F.col("month")).alias("t"), F.log("total").alias("l"))
    rows = ranks.lagged(m, "l", LANE, "t", [1, 2, 12])
    names = ["l_lag1", "l_lag2", "l_lag12"]
    fit = choices.ridge_by(rows.where("l_lag12 IS NOT NULL"), LANE, names, "l", 1.0)
    last = ranks.top_of_each(m, LANE, 12, F.desc("t")).groupBy(*LANE).agg(F.transform(F.array_sort(F.collect_list(F.struct("t", "l"))), lambda s: s["l"]).alias("x"))  # 12 numbers a lane
    one = lambda x: F.col("coef")[0] + F.col("coef")[1] * F.element_at(x, -1) + F.col("coef")[2] * F.element_at(x, -2) + F.col("coef")[3] * F.element_at(x, -12)
    ahead = F.aggregate(F.sequence(F.lit(1), F.lit(12)), F.col("x"), lambda x, _: F.concat(x, F.array(one(x))))
    out = last.join(fit, LANE).where(F.size("x") == 12).select(*LANE, F.posexplode(F.slice(ahead, 13, 12)))
    return out.select(*LANE, (F.col("pos") + 1).alias("step"), F.round(F.exp("col"), 4).alias("forecast"))


TWO_SQL = LANES_SQL + """, m AS (SELECT origin, dest, year(day)::INT AS year, month(day)::INT AS month, sum(volume) AS total FROM lanes WHERE year(day) <= 2000 GROUP BY ALL),
f AS (SELECT a.origin, a.dest, a.year, a.month, a.total, (SELECT b.total FROM m b WHERE b.origin = a.origin AND b.dest = a.dest AND b.month = a.month AND b.year = a.year - 1) AS naive,
    avg(total) OVER (PARTITION BY origin, dest, month ORDER BY year ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS mean FROM m a),
folds AS (SELECT year, w / 10::DOUBLE AS weight, sqrt(avg((w / 10::DOUBLE * naive + (1 - w / 10::DOUBLE) * mean - total) ** 2)) AS rmse FROM f, (SELECT unnest(range(0, 11)) AS w) WHERE year >= 1998 AND naive IS NOT NULL GROUP BY ALL)"""


@query(f"WITH {TWO_SQL} SELECT weight, round(avg(rmse), 6) AS rmse, count(*) AS folds, rank() OVER (ORDER BY round(avg(rmse), 9), weight)::INT AS place FROM folds GROUP BY weight")
def ensemble_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights of "as last year" against the mean of all years before, by the mean error over rolling
    origins."""
    m = river.months(spark, sf_dir)
    own = Window.partitionBy(*LANE, "month").orderBy("year")
    f = m.withColumns({"naive": F.when(F.lag("year").over(own) == F.col("year") - 1, F.lag("total").over(own)), "mean": F.avg("total").over(own.rowsBetween(Window.unboundedPreceding, -1))})
    f = f.where("year >= 1998 AND naive IS NOT NULL").withColumn("weight", F.explode(F.transform(F.sequence(F.lit(0), F.lit(10)), lambda w: w / 10.0)))
    e = F.col("weight") * F.col("naive") + (1 - F.col("weight")) * F.col("mean") - F.col("total")
    folds = f.groupBy("year", "weight").agg(F.sqrt(F.avg(e * e)).alias("rmse"))
    r = folds.groupBy("weight").agg(F.avg("rmse").alias("r"), F.count(F.lit(1)).alias("folds"))
    return r.select("weight", F.round("r", 6).alias("rmse"), "folds", F.rank().over(Window.orderBy(F.round("r", 9), "weight")).alias("place"))


@query(f"""WITH {LANES_SQL}, m AS (SELECT origin, dest, year(day)::INT AS year, month(day)::INT AS month, sum(volume) AS total FROM lanes WHERE year(day) <= 2000 GROUP BY ALL),
s AS (SELECT *, sum(total) OVER w - total AS rest, count(*) OVER w - 1 AS k FROM m WINDOW w AS (PARTITION BY origin, dest, month))
SELECT year, count(*) AS n, round(sqrt(avg((rest / k - total) ** 2)), 6) AS rmse, round(sum(abs(rest / k - total)) / sum(total), 6) AS wape FROM s WHERE k > 0 GROUP BY year""")
def leave_year_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors of each year's months told from all other years: sums less the row itself, no refits."""
    own = Window.partitionBy(*LANE, "month")
    m = river.months(spark, sf_dir).withColumns({"rest": F.sum("total").over(own) - F.col("total"), "k": F.count(F.lit(1)).over(own) - 1}).where("k > 0")
    e = F.col("rest") / F.col("k") - F.col("total")
    return m.groupBy("year").agg(F.count(F.lit(1)).alias("n"), F.round(F.sqrt(F.avg(e * e)), 6).alias("rmse"), F.round(F.sum(F.abs(e)) / F.sum("total"), 6).alias("wape"))


@query()
def boosted_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gradient boosting on absolute errors with early stopping, and a random forest, over lagged months:
    errors on the last year."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor, RandomForestRegressor

    m = river.months(spark, sf_dir).withColumn("t", F.col("year") * 12 + F.col("month"))
    rows = ranks.lagged(m, "total", LANE, "t", [1, 2, 3, 12]).dropna()
    names = ["month", "total_lag1", "total_lag2", "total_lag3", "total_lag12"]
    rows = VectorAssembler(inputCols=names, outputCol="features").transform(rows).withColumn("check", F.col("year") == 1999)
    past, future = rows.where("year < 2000"), rows.where("year = 2000")
    models = {
        "boosting": GBTRegressor(labelCol="total", lossType="absolute", maxIter=20, maxDepth=3, seed=5, validationIndicatorCol="check"),
        "forest": RandomForestRegressor(labelCol="total", numTrees=20, maxDepth=5, seed=5),
    }
    out = None
    for name, model in models.items():
        e = F.abs(F.col("prediction") - F.col("total"))
        r = model.fit(past).transform(future).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(e), 4).alias("mae"), F.round(F.sum(e) / F.sum("total"), 6).alias("wape")).select(F.lit(name).alias("model"), "*")
        out = r if out is None else out.unionByName(r)
    return out


@query(f"""WITH {pricing.LOGIT_SQL}, o AS (SELECT id, p, logit + 0.06::DOUBLE * (p - price) AS z FROM (SELECT *, unnest(range(0, 21)) + 65::DOUBLE AS p FROM logits)), g AS (SELECT id, p, round(1 / (1 + exp(-z)), 9) AS gain, round(p / (1 + exp(-z)), 9) AS cost FROM o),
b AS (SELECT sum(price / (1 + exp(-logit))) * 1.05 AS budget FROM logits), l AS (SELECT unnest(range(0, 61)) / 2000::DOUBLE AS price),
best AS (SELECT l.price, id, max((round(gain - l.price * cost, 9), -cost, -p, gain)) AS b FROM g, l GROUP BY ALL), t AS (SELECT price, sum(-b[2]) AS total FROM best GROUP BY price), w AS (SELECT min(price) AS price FROM t, b WHERE round(total, 6) <= budget)
SELECT id, -b[3] AS p, round(b[4], 6) AS gain, round(-b[2], 6) AS cost FROM best JOIN w USING (price)""")
def price_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One price for each task: most expected completions within 1.05 times today's payout."""
    l = written(pricing.logits(spark, sf_dir), "logits")
    budget = l.agg(F.sum(F.col("price") / (1 + F.exp(-F.col("logit"))))).first()[0] or 0.0  # one number
    o = l.withColumn("p", F.explode(F.transform(F.sequence(F.lit(65), F.lit(85)), lambda k: k.cast("double"))))
    z = F.col("logit") + 0.06 * (F.col("p") - F.col("price"))
    o = o.select("id", "p", F.round(1 / (1 + F.exp(-z)), 9).alias("gain"), F.round(F.col("p") / (1 + F.exp(-z)), 9).alias("cost"))
    r = choices.priced_choice(o, "id", "p", "gain", "cost", 1.05 * budget, [k / 2000 for k in range(61)])
    return r.select("id", "p", F.round("gain", 6).alias("gain"), F.round("cost", 6).alias("cost"))


@query()
def bundle_matching(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bundles of two that share no task, the best bonus for the way first."""
    bonus = lambda d: half_up(np.maximum(0.0, 0.38 * math.log(2.0) + 0.12 * (1 - d / 0.3) - 0.025), 6)
    return spatial.matched_near(pricing.tasks(spark, sf_dir).select("id", "x", "y"), 0.3, bonus)


@query()
def spaced_mirrors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A denser lattice thinned to 12 m: mirrors of the better quarters of the field stay first, in each in
    the order of a hash, so that few rounds settle it."""
    f = layouts.hexagonal(spark, 9.0, 250.0, 100.0).withColumn("priority", F.round(2 * F.col("y") / F.hypot("x", "y")))
    pairs = spatial.radius_pairs(f.select("id", "x", "y"), f.select("id", "x", "y"), 11.999).select(F.col("l.id").alias("a"), F.col("r.id").alias("b"))
    return choices.independent(f, pairs, "id", -F.col("priority"), F.xxhash64("id"))


@query(f"""WITH {sections.CHANGE_SQL}, n AS (SELECT survey, avg(d) AS net FROM ch WHERE before IS NOT NULL GROUP BY survey), t AS (SELECT k, median(d - net) AS t FROM ch JOIN n USING (survey) WHERE before IS NOT NULL GROUP BY k),
z AS (SELECT k, t - avg(t) OVER () AS t FROM t), p AS (SELECT min(net) AS low, median(net) AS central, max(net) AS high FROM n WHERE net > 0)
SELECT k, years::INT AS years, round((t + low) * 10 * (1 - exp(-years / 10::DOUBLE)), 6) AS low, round((t + central) * 10 * (1 - exp(-years / 10::DOUBLE)), 6) AS central, round((t + high) * 10 * (1 - exp(-years / 10::DOUBLE)), 6) AS high FROM z, p, (SELECT unnest([1, 5, 10]) AS years)""")
def bounded_aggradation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Future change: a template of no net change plus the least, middle and largest positive net rate, each
    saturating with a time of ten years."""
    own = Window.partitionBy("k").orderBy("survey")
    d = sections.grid(spark, sf_dir).select("survey", "k", (F.col("linear") - F.lag("linear").over(own)).alias("d")).where("d IS NOT NULL")
    net = d.groupBy("survey").agg(F.avg("d").alias("net"))
    t = d.join(net, "survey").groupBy("k").agg(F.median(F.col("d") - F.col("net")).alias("t"))
    t = t.withColumn("t", F.col("t") - F.avg("t").over(Window.partitionBy()))  # a row for each point of one section
    rates = net.where("net > 0").agg(F.min("net").alias("low"), F.median("net").alias("central"), F.max("net").alias("high"))
    rows = t.join(F.broadcast(rates)).withColumn("years", F.explode(F.array(F.lit(1), F.lit(5), F.lit(10))))
    grow = 10 * (1 - F.exp(-F.col("years") / 10))
    return rows.select("k", "years", *[F.round((F.col("t") + F.col(c)) * grow, 6).alias(c) for c in ("low", "central", "high")])


@query(f"WITH {ANSWERS_SQL} SELECT round(regr_slope(y, size), 6) AS slope, count(*) AS n FROM answers")
def slope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return answers(spark, sf_dir).agg(F.round(F.regr_slope("y", "size"), 6).alias("slope"), F.count(F.lit(1)).alias("n"))


@query()
def sobol_designs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """64 designs that fill the ranges of pitch and radius, rounded, duplicates dropped by a hash."""
    s = files.sobol(spark, 64).select("i", F.round(10 + 8 * F.col("u"), 1).alias("pitch"), F.round(200 + 150 * F.col("v"), 0).alias("radius"))
    return s.withColumn("design", F.sha2(F.concat_ws("/", "pitch", "radius"), 256)).groupBy("design", "pitch", "radius").agg(F.min("i").alias("i"))
