"""Sampling policies by period: what each option would have cost and caught, and which to take within limits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewater.operators import frontiers, ranks
from tidewater.plans.common import Plan, pct
from tidewater.plans.river import CAL_SQL, calendar

plan = Plan()
query = plan.query
QUERIES, ORACLES = plan.queries, plan.oracles

# Days between visits, thresholds of a jump, costs of a visit and its assay, days visited after a
# jump, days by which a visit may miss an event.
INTERVALS, THRESHOLDS, VISIT, ASSAY, FOLLOW, NEAR = (3, 5, 7, 10), (1.0, 1.5, 2.0, 2.5), 4, 1, 2, 1
SCALE, EVENT, PERIOD, CLASSES = 2.0, 1.5, 10, 4
OPTIONS = [(i, t, p) for i in INTERVALS for t in THRESHOLDS for p in THRESHOLDS]
KEY = ["station", "period", "interval", "threshold", "previous"]


def options(spark: SparkSession, sf_dir: str) -> DataFrame:
    """class, period, interval, threshold, previous: visits, cost, error (of what lies between visits, on the line),
    total, captured, events, gap of each option, over the stations of a class (quarters by mean flow). Periods
    have PERIOD days from the table's first; a jump before a period's first day is judged by the threshold of the
    period before. A station's days are dealt once; its options are made where they lie."""
    days = calendar(spark, sf_dir)
    means = ranks.percent_ranks(days.groupBy("station").agg(F.round(F.avg("flow"), 9).alias("mean")), "mean", "share").select("station", F.ceil(F.col("share") * CLASSES).cast("int").alias("class"))
    first = days.agg(F.min("day").alias("first"))  # one row
    rows = days.join(means, "station").join(F.broadcast(first)).withColumn("i", F.datediff("day", "first"))
    own = Window.partitionBy("station").orderBy("day")
    jump = F.coalesce(F.abs(F.log1p("flow") - F.lag(F.log1p(F.col("flow"))).over(own)) / SCALE, F.lit(0.0))
    rows = rows.repartition("station").withColumn("jump", jump)
    rows = rows.withColumns({f"jump{k}": F.coalesce(F.lag("jump", k).over(own), F.lit(0.0)) for k in range(1, FOLLOW + 1)})
    rows = rows.select("station", "class", "flow", "jump", "jump1", "jump2", F.floor(F.col("i") / PERIOD).cast("int").alias("period"), (F.col("i") % PERIOD).alias("pos"))
    rows = rows.withColumn("size", F.count(F.lit(1)).over(Window.partitionBy("station", "period")))
    choice = F.array(*[F.struct(F.lit(i).alias("interval"), F.lit(t).alias("threshold"), F.lit(p).alias("previous")) for i, t, p in OPTIONS])
    rows = rows.withColumn("o", F.explode(choice)).select("*", "o.*").drop("o")
    followed = [F.col(f"jump{k}") >= F.when(F.col("pos") >= k, F.col("threshold")).otherwise(F.col("previous")) for k in range(1, FOLLOW + 1)]
    rows = rows.withColumn("sampled", (F.col("pos") % F.col("interval") == 0) | followed[0] | followed[1])
    w = Window.partitionBy(*KEY).orderBy("pos")
    up, down = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    at = F.when(F.col("sampled"), F.struct("pos", "flow"))
    rows = rows.withColumns({"near": F.max("sampled").over(w.rowsBetween(-NEAR, NEAR)), "a": F.max(at).over(up), "b": F.min(at).over(down), "last": F.max(F.when(F.col("sampled"), F.col("pos"))).over(w.rowsBetween(Window.unboundedPreceding, -1))})
    # a period's first day is always visited; after the last visit its flow is held
    line = F.when(F.col("b").isNull() | (F.col("b.pos") == F.col("a.pos")), F.col("a.flow")).otherwise(F.col("a.flow") + (F.col("b.flow") - F.col("a.flow")) * (F.col("pos") - F.col("a.pos")) / (F.col("b.pos") - F.col("a.pos")))
    end = F.col("pos") == F.col("size") - 1
    gap = F.greatest(F.when(F.col("sampled"), F.col("pos") - F.col("last")), F.when(end, F.col("size") - 1 - F.col("a.pos")))
    event = F.col("jump") >= EVENT
    out = rows.groupBy("class", *KEY[1:]).agg(
        F.sum(F.col("sampled").cast("long")).alias("visits"),
        F.round(F.sum(F.abs(F.col("flow") - line)), 6).alias("error"),
        F.round(F.sum("flow"), 6).alias("total"),
        F.count_if(event & F.col("near")).alias("captured"),
        F.count_if(event).alias("events"),
        F.coalesce(F.max(gap), F.lit(0)).cast("int").alias("gap"),
    )
    return out.withColumn("cost", F.col("visits") * (VISIT + ASSAY))


OPTION_SQL = CAL_SQL + f""", o AS (SELECT interval, threshold, previous FROM (VALUES {", ".join(f"({i}, {t}::DOUBLE, {p}::DOUBLE)" for i, t, p in OPTIONS)}) v(interval, threshold, previous)),
means AS (SELECT station, round(avg(flow), 9) AS mean FROM days GROUP BY station), classes AS (SELECT station, ceil({pct("mean")} * {CLASSES})::INT AS class FROM means),
n AS (SELECT station, class, day, flow, (day - (SELECT a FROM bounds)) AS i, coalesce(abs(ln(1 + flow) - lag(ln(1 + flow)) OVER (PARTITION BY station ORDER BY day)) / {SCALE}::DOUBLE, 0) AS jump FROM days JOIN classes USING (station)),
l AS (SELECT *, i // {PERIOD} AS period, i % {PERIOD} AS pos, coalesce(lag(jump) OVER w, 0) AS jump1, coalesce(lag(jump, 2) OVER w, 0) AS jump2, count(*) OVER (PARTITION BY station, i // {PERIOD}) AS size FROM n WINDOW w AS (PARTITION BY station ORDER BY day)),
s AS (SELECT *, pos % interval = 0 OR jump1 >= CASE WHEN pos >= 1 THEN threshold ELSE previous END OR jump2 >= CASE WHEN pos >= 2 THEN threshold ELSE previous END AS sampled FROM l, o),
f AS (
    SELECT *, max(sampled) OVER (w ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS near,
        max(CASE WHEN sampled THEN pos END) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS pa,
        min(CASE WHEN sampled THEN pos END) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS pb,
        max(CASE WHEN sampled THEN pos END) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last
    FROM s WINDOW w AS (PARTITION BY station, period, interval, threshold, previous ORDER BY pos)),
g AS (SELECT f.*, a.flow AS fa, b.flow AS fb FROM f JOIN l a ON a.station = f.station AND a.period = f.period AND a.pos = pa LEFT JOIN l b ON b.station = f.station AND b.period = f.period AND b.pos = pb),
opts AS (
    SELECT class, period::INT AS period, interval::INT AS interval, threshold, previous, sum(sampled::INT)::BIGINT AS visits, round(sum(abs(flow - CASE WHEN pb IS NULL OR pa = pb THEN fa ELSE fa + (fb - fa) * (pos - pa) / (pb - pa) END)), 6) AS error,
        round(sum(flow), 6) AS total, count(*) FILTER (jump >= {EVENT} AND near) AS captured, count(*) FILTER (jump >= {EVENT}) AS events,
        coalesce(max(greatest(CASE WHEN sampled THEN pos - last END, CASE WHEN pos = size - 1 THEN size - 1 - pa END)), 0)::INT AS gap
    FROM g GROUP BY ALL)"""


@query(f"WITH {OPTION_SQL} SELECT *, visits * {VISIT + ASSAY} AS cost FROM opts")
def policy_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each interval, threshold and threshold before would have cost and caught, by class and period."""
    return options(spark, sf_dir)


def ways(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The options, and the unbeaten policies through all periods of each class."""
    from tidewater.sources.shared import written

    rows = written(options(spark, sf_dir), "policy-options")
    name = F.concat(F.col("interval").cast("string"), F.lit("@"), F.col("threshold").cast("string"))
    return rows, frontiers.frontier(rows.withColumns({"before": F.col("previous"), "after": F.col("threshold"), "choices": name}), ["class"], "period")


@query()
def policy_frontier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Policies (an interval and threshold a period) that no other beats in cost, error, longest gap and events
    captured, whatever they begin after."""
    _, found = ways(spark, sf_dir)
    kinds = ", ".join(f"{c} {found.schema[c].dataType.simpleString()}" for c in ["class", *frontiers.COLUMNS])
    best = found.groupBy("class").applyInPandas(lambda pdf: frontiers.pruned(pdf.assign(before=0.0, after=0.0)).assign(**{"class": pdf["class"].iloc[0]})[["class", *frontiers.COLUMNS]], kinds)
    return best.select("class", "cost", F.round("error", 6).alias("error"), "gap", "captured", "choices")


@query()
def policy_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cheapest policy for each of 5 x 5 x 5 limits: of the error's share of the total, the longest gap and
    the share of events captured."""
    rows, found = ways(spark, sf_dir)
    whole = rows.where((F.col("interval") == INTERVALS[0]) & (F.col("threshold") == THRESHOLDS[0]) & (F.col("previous") == THRESHOLDS[0])).groupBy("class").agg(F.sum("total").alias("total"), F.sum("events").alias("events"))
    lists = {"e": (0.3, 0.4, 0.5, 0.6, 0.8), "g": (3, 4, 5, 7, 9), "c": (0.6, 0.7, 0.8, 0.9, 1.0)}
    for k, v in lists.items():
        whole = whole.withColumn(k, F.explode(F.array(*map(F.lit, v))))
    limits = whole.select("class", F.col("e").alias("error_share"), F.col("c").alias("captured_share"), (F.col("e") * F.col("total")).alias("error_limit"), F.col("g").alias("gap_limit"), (F.col("c") * F.col("events")).alias("captured_least"))
    r = frontiers.limited(found, ["class"], limits)
    return r.select("class", "error_share", "gap_limit", "captured_share", "feasible", "cost", F.round("error", 6).alias("error"), "gap", "captured", "choices")
