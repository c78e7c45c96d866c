"""Season templates: what the days around a day of the year had, near and recent ones weighing more, as they are
and on a line of years."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.operators import ranks
from tidewater.plans.common import Plan
from tidewater.sources.tables import LANES_SQL, lane_days

plan = Plan()
query = plan.query
QUERIES, ORACLES = plan.queries, plan.oracles

LANE = ["origin", "dest"]
# Days around a target (and where there are none, more), the kernel's width, how fast years lose
# weight, the share that years before the last four keep, the largest slope, and for each scenario the share of the
# weights, the slope's factor, the template's factor and the shift of logs.
NEAR, WIDE, WIDTH, DECAY, OLD, YEARS, SLOPE = 15, 31, 7.5, 0.42, 0.45, 4, 0.08
LOW, HIGH = 0.30, 0.75
TREND = {"template": (0.6, 1.0, 1.2), "trend": (0.65, 1.0, 1.2)}
FACTORS, SHIFTS = (0.93, 1.0, 1.08), (-0.04, 0.0, 0.05)
STEP = 15  #: days from one target to the next


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lanes' days up to the table's last full year, with it (`last`)."""
    days = lane_days(spark, sf_dir)
    last = days.agg((F.year(F.date_add(F.max("day"), 1)) - 1).alias("last"))  # one row
    return days.join(F.broadcast(last)).where(F.year("day") <= F.col("last")).withColumn("year", F.year("day"))


def year_fraction(day: str):
    return F.year(day) + (F.dayofyear(day) - 1) / F.dayofyear(F.make_date(F.year(day), F.lit(12), F.lit(31)))


def slopes(days: DataFrame) -> DataFrame:
    """Of each lane the slopes of the last years' logs (of the means; and means of logs), held within bounds, and the
    last level."""
    held = lambda c: F.greatest(F.lit(-SLOPE), F.least(F.lit(SLOPE), F.coalesce(c, F.lit(0.0))))
    years = days.where(F.col("year") > F.col("last") - YEARS).groupBy(*LANE, "year").agg(F.avg(F.log1p("volume")).alias("logs"), F.log1p(F.avg("volume")).alias("level"))
    return years.groupBy(*LANE).agg(held(F.regr_slope("level", "year")).alias("template_slope"), held(F.regr_slope("logs", "year")).alias("trend_slope"), F.max_by("logs", "year").alias("anchor"))


SEASON_SQL = LANES_SQL + f""", lasts AS (SELECT year(max(day) + 1) - 1 AS last FROM lanes), hist AS (SELECT *, year(day) AS year FROM lanes, lasts WHERE year(day) <= last),
years AS (SELECT origin, dest, year, avg(ln(1 + volume)) AS logs, ln(1 + avg(volume)) AS level FROM hist WHERE year > last - {YEARS} GROUP BY ALL),
sl AS (
    SELECT origin, dest, greatest(-{SLOPE}, least({SLOPE}, coalesce(regr_slope(level, year), 0)))::DOUBLE AS template_slope,
        greatest(-{SLOPE}, least({SLOPE}, coalesce(regr_slope(logs, year), 0)))::DOUBLE AS trend_slope, max_by(logs, year) AS anchor
    FROM years GROUP BY ALL),
near AS (
    SELECT h.*, target, least(abs(dayofyear(day) - target), 366 - abs(dayofyear(day) - target)) AS d
    FROM hist h, (SELECT unnest(range(1, 366, {STEP})) AS target)),
w AS (
    SELECT n.*, anchor, template_slope, trend_slope, exp(-0.5 * (d / {WIDTH}::DOUBLE) ** 2) * exp(-{DECAY}::DOUBLE * (last - year)) * CASE WHEN year <= last - {YEARS} THEN {OLD} ELSE 1 END AS w,
        d <= {NEAR} AS close, max(d <= {NEAR}) OVER (PARTITION BY origin, dest, target) AS any_close
    FROM near n JOIN sl USING (origin, dest) WHERE d <= {WIDE}),
v AS (
    SELECT origin, dest, target, 'template' AS method, volume AS v, w FROM w WHERE close = any_close
    UNION ALL SELECT origin, dest, target, 'trend', round(ln(1 + volume) - (anchor + trend_slope * (year + (dayofyear(day) - 1) / dayofyear(make_date(year, 12, 31)) - (last + 0.5::DOUBLE))), 9), w FROM w WHERE close = any_close),
c AS (SELECT *, sum(w) OVER (PARTITION BY origin, dest, target, method ORDER BY v) / sum(w) OVER (PARTITION BY origin, dest, target, method) AS c FROM v),
q AS (SELECT origin, dest, target, method, min(v) FILTER (c >= {LOW} - 1e-9) AS low, sum(v * w) / sum(w) AS normal, min(v) FILTER (c >= {HIGH} - 1e-9) AS high FROM c GROUP BY ALL),
x AS (SELECT q.*, template_slope, trend_slope, anchor, 1 + (target - 1) / dayofyear(make_date(last::INT + 1, 12, 31)) - 0.5::DOUBLE AS ahead FROM q JOIN sl USING (origin, dest), lasts)"""


def scenario_sql(k: int, name: str) -> str:
    template = f"{name} * exp(template_slope * {TREND['template'][k]}::DOUBLE) * {FACTORS[k]}::DOUBLE"
    trend = f"exp(anchor + trend_slope * {TREND['trend'][k]}::DOUBLE * ahead + {name} + {SHIFTS[k]}::DOUBLE) - 1"
    return f"round(greatest(0, CASE WHEN method = 'template' THEN {template} ELSE {trend} END), 4) AS {name}"


@query(f"WITH {SEASON_SQL} SELECT origin, dest, target::INT AS target, method, {', '.join(scenario_sql(k, n) for k, n in enumerate(('low', 'normal', 'high')))} FROM x")
def season_scenarios(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Low, normal and high volumes of the year after the table's last full one, by lane and day of the year: from
    the days around it as they are, times the trend of levels, and from what they are off a line of the last
    four years' logs, put on that line."""
    days = history(spark, sf_dir)
    lines = F.broadcast(slopes(days))  # a row for each of at most 25 lanes
    # a day meets the targets and stays with those within WIDE days of it
    rows = days.join(lines, LANE).withColumn("target", F.explode(F.sequence(F.lit(1), F.lit(365), F.lit(STEP))))
    gap = F.abs(F.dayofyear("day") - F.col("target"))
    rows = rows.withColumn("d", F.least(gap, 366 - gap)).where(F.col("d") <= WIDE).withColumn("close", F.col("d") <= NEAR)
    some = rows.groupBy(*LANE, "target").agg(F.max("close").alias("any_close"))
    rows = rows.join(some, [*LANE, "target"]).where(F.col("close") == F.col("any_close"))
    w = F.exp(-0.5 * F.pow(F.col("d") / WIDTH, F.lit(2))) * F.exp(-DECAY * (F.col("last") - F.col("year"))) * F.when(F.col("year") <= F.col("last") - YEARS, OLD).otherwise(1.0)
    line = F.col("anchor") + F.col("trend_slope") * (year_fraction("day") - (F.col("last") + 0.5))
    both = F.array(F.struct(F.lit("template").alias("method"), F.col("volume").alias("v")), F.struct(F.lit("trend").alias("method"), F.round(F.log1p("volume") - line, 9).alias("v")))
    rows = rows.select(*LANE, "target", "last", w.alias("w"), F.explode(both).alias("b")).select(*LANE, "target", "last", "w", "b.*")
    key = [*LANE, "target", "method"]
    q = ranks.weighted_quantiles(rows, key, "v", "w", {"low": LOW, "high": HIGH})
    q = q.join(rows.groupBy(*key, "last").agg((F.sum(F.col("v") * F.col("w")) / F.sum("w")).alias("normal")), key).join(lines, LANE)
    ahead = 1 + (F.col("target") - 1) / F.dayofyear(F.make_date(F.col("last") + 1, F.lit(12), F.lit(31))) - 0.5

    def scenario(k: int, name: str):
        template = F.col(name) * F.exp(F.col("template_slope") * TREND["template"][k]) * FACTORS[k]
        trend = F.exp(F.col("anchor") + F.col("trend_slope") * TREND["trend"][k] * ahead + F.col(name) + SHIFTS[k]) - 1
        return F.round(F.greatest(F.lit(0.0), F.when(F.col("method") == "template", template).otherwise(trend)), 4).alias(name)

    return q.select(*key, *[scenario(k, n) for k, n in enumerate(("low", "normal", "high"))])
