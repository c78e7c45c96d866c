"""Forecasts held against what came: intervals, rolling origins, calibration between sources, completed
values, and what is told of cycles and blocks. Series have a row for each lane and month or station and
day, so that a group never holds more than its calendar."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewater.functions.digests import digest, digest_sql
from tidewater.operators import forecast, ordered, ranks, signals
from tidewater.plans.common import Plan
from tidewater.plans.river import CAL_SQL, MONTHS_SQL, PAIRS_SQL, POOL_SQL, calendar, months, pool
from tidewater.sources.shared import written
from tidewater.sources.tables import HYDRO_SQL, LANES_SQL, hydro, lane_days, table

plan = Plan()
query = plan.query
QUERIES, ORACLES = plan.queries, plan.oracles
LANE = ["origin", "dest"]

CLIMATE_SQL = MONTHS_SQL + """, climate AS (SELECT origin, dest, month, exp(sum(exp(-0.55::DOUBLE * (2000 - year)) * ln(total)) / sum(exp(-0.55::DOUBLE * (2000 - year)))) AS f FROM months WHERE total > 0 GROUP BY ALL),
resid AS (SELECT m.origin, m.dest, abs(ln(m.total) - ln(c.f)) AS r FROM months m JOIN climate c USING (origin, dest, month) WHERE m.total > 0),
radii AS (SELECT origin, dest, quantile_cont(r, 0.8) AS r80, quantile_cont(r, 0.95) AS r95 FROM resid GROUP BY ALL)"""


def climate(m: DataFrame) -> DataFrame:
    """Log mean of a month over the years, the last ones counting most."""
    w = F.exp(-0.55 * (2000 - F.col("year")))
    return m.where("total > 0").groupBy(*LANE, "month").agg(F.exp(F.sum(w * F.log("total")) / F.sum(w)).alias("f"))


def intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two years ahead with bounds from quantiles of the absolute log residuals; the second year's are wider
    by a quarter, and none is below 0."""
    m = months(spark, sf_dir)
    c = climate(m)
    resid = m.where("total > 0").join(c, [*LANE, "month"]).select(*LANE, F.abs(F.log("total") - F.log("f")).alias("r"))
    radii = forecast.conformal(resid, "r", LANE, [0.8, 0.95])
    ahead = c.join(radii, LANE).withColumn("year", F.explode(F.array(F.lit(2001), F.lit(2002))))
    wide = F.when(F.col("year") == 2002, 1.25).otherwise(1.0)
    bounds = {}
    for p in (80, 95):
        bounds[f"low{p}"] = F.greatest(F.lit(0.0), F.col("f") * F.exp(-F.col(f"radius{p}") * wide))
        bounds[f"high{p}"] = F.col("f") * F.exp(F.col(f"radius{p}") * wide)
    return ahead.withColumns(bounds).select(*LANE, "year", "month", "f", *bounds)


BOUNDS_SQL = CLIMATE_SQL + """, ahead AS (SELECT origin, dest, month, f, r80, r95, unnest([2001, 2002]) AS year FROM climate JOIN radii USING (origin, dest)),
bounds AS (SELECT origin, dest, year, month, f, greatest(0, f * exp(-r80 * w)) AS low80, f * exp(r80 * w) AS high80, greatest(0, f * exp(-r95 * w)) AS low95, f * exp(r95 * w) AS high95
    FROM (SELECT *, CASE WHEN year = 2002 THEN 1.25::DOUBLE ELSE 1.0::DOUBLE END AS w FROM ahead))"""


@query(f"WITH {BOUNDS_SQL} SELECT origin, dest, year, month, round(f, 4) AS forecast, round(low80, 4) AS low80, round(high80, 4) AS high80, round(low95, 4) AS low95, round(high95, 4) AS high95 FROM bounds")
def forecast_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = intervals(spark, sf_dir)
    return rows.select(*LANE, "year", "month", F.round("f", 4).alias("forecast"), *[F.round(c, 4).alias(c) for c in ("low80", "high80", "low95", "high95")])


@query(f"""WITH {BOUNDS_SQL} SELECT a.origin, a.dest, bool_and(a.low95 <= a.low80 AND a.low80 <= a.f AND a.f <= a.high80 AND a.high80 <= a.high95) AND bool_and(b.low95 <= b.low80 AND b.low80 <= b.f AND b.f <= b.high80 AND b.high80 <= b.high95) AS nested,
    bool_and(b.high80 - b.low80 >= a.high80 - a.low80 AND b.high95 - b.low95 >= a.high95 - a.low95) AS widening, count(*) AS months FROM bounds a JOIN bounds b ON a.origin = b.origin AND a.dest = b.dest AND a.month = b.month AND a.year = 2001 AND b.year = 2002 GROUP BY ALL""")
def interval_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether intervals lie within each other and grow with the horizon."""
    rows = intervals(spark, sf_dir)
    inside = (F.col("low95") <= F.col("low80")) & (F.col("low80") <= F.col("f")) & (F.col("f") <= F.col("high80")) & (F.col("high80") <= F.col("high95"))
    width = lambda p, year: F.max(F.when(F.col("year") == year, F.col(f"high{p}") - F.col(f"low{p}")))
    by_month = rows.groupBy(*LANE, "month").agg(F.bool_and(inside).alias("inside"), ((width(80, 2002) >= width(80, 2001)) & (width(95, 2002) >= width(95, 2001))).alias("wider"))
    return by_month.groupBy(*LANE).agg(F.bool_and("inside").alias("nested"), F.bool_and("wider").alias("widening"), F.count(F.lit(1)).alias("months"))


@query(f"""WITH {PAIRS_SQL}, exact AS (SELECT station, day, sum((2 * v0 + (v1 - v0) * ((lo - a) + (hi - a)) / (b - a)) / 2 * (hi - lo) / 1e6) AS volume, sum(hi - lo) / 1e6 AS seconds FROM parts WHERE hi > lo GROUP BY ALL),
plain AS (SELECT station, ts::DATE AS day, avg(flow) AS flow FROM hydro GROUP BY 1, 2), d AS (SELECT station, abs(100 * (flow * seconds - volume) / volume) AS pct FROM exact JOIN plain USING (station, day))
SELECT station, count(*) AS days, round(median(pct), 4) AS median_pct, round(quantile_cont(pct, 0.95), 4) AS p95_pct, round(max(pct), 4) AS max_pct FROM d GROUP BY station""")
def integration_consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far daily integrals of the line between points are from the days' mean over the same time, in %."""
    h = hydro(spark, sf_dir)
    exact = ordered.segments(h, ["station"], "ts", "flow").groupBy("station", "day").agg(F.sum("area").alias("volume"), F.sum("seconds").alias("seconds"))
    plain = h.groupBy("station", F.to_date("ts").alias("day")).agg(F.avg("flow").alias("flow"))
    d = exact.join(plain, ["station", "day"]).select("station", F.abs(100 * (F.col("flow") * F.col("seconds") - F.col("volume")) / F.col("volume")).alias("pct"))
    return d.groupBy("station").agg(F.count(F.lit(1)).alias("days"), F.round(F.median("pct"), 4).alias("median_pct"), F.round(F.percentile("pct", 0.95), 4).alias("p95_pct"), F.round(F.max("pct"), 4).alias("max_pct"))


@query(f"""WITH {MONTHS_SQL}, o AS (SELECT unnest([1998, 1999, 2000]) AS cut), past AS (SELECT cut, origin, dest, month, avg(total) AS mean, max_by(total, year) AS last FROM months JOIN o ON year < cut GROUP BY ALL),
p AS (SELECT m.origin, m.dest, cut, total, unnest(['climatology', 'naive']) AS model, unnest([mean, last]) AS f FROM months m JOIN past p ON m.year = p.cut AND m.origin = p.origin AND m.dest = p.dest AND m.month = p.month)
SELECT cut, model, count(*) AS n, round(avg(abs(f - total)), 4) AS mae, round(sqrt(avg((f - total) ** 2)), 4) AS rmse, round(sum(abs(f - total)) / sum(total), 6) AS wape, round(100 * (sum(f) - sum(total)) / sum(total), 4) AS signed_pct FROM p GROUP BY ALL""")
def rolling_origin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each year forecast from the years before it alone, by two models."""
    m = months(spark, sf_dir)
    cuts = m.withColumn("cut", F.explode(F.array(*map(F.lit, (1998, 1999, 2000)))))
    past = cuts.where("year < cut").groupBy("cut", *LANE, "month").agg(F.avg("total").alias("climatology"), F.max_by("total", "year").alias("naive"))
    both = m.withColumnRenamed("year", "cut").join(past, ["cut", *LANE, "month"]).unpivot(["cut", "total"], ["climatology", "naive"], "model", "f")
    e = F.col("f") - F.col("total")
    return both.groupBy("cut", "model").agg(
        F.count(F.lit(1)).alias("n"),
        F.round(F.avg(F.abs(e)), 4).alias("mae"),
        F.round(F.sqrt(F.avg(e * e)), 4).alias("rmse"),
        F.round(F.sum(F.abs(e)) / F.sum("total"), 6).alias("wape"),
        F.round(100 * F.sum(e) / F.sum("total"), 4).alias("signed_pct"),
    )


@query(f"""WITH {MONTHS_SQL}, y AS (SELECT origin, dest, year, ln(avg(total)) AS v FROM months GROUP BY ALL), t AS (SELECT origin, dest, regr_slope(v, year) AS b, regr_intercept(v, year) AS a FROM y GROUP BY ALL),
r AS (SELECT m.origin, m.dest, month, avg(ln(total) - (a + b * year)) AS s FROM months m JOIN t USING (origin, dest) WHERE total > 0 GROUP BY ALL)
SELECT origin, dest, month, round(a + b * 2001, 6) AS trend, round(s, 6) AS season, round(exp(a + b * 2001 + s), 4) AS forecast FROM r JOIN t USING (origin, dest)""")
def trend_season(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The yearly line of logs and the mean residual of each month, put together for the next year."""
    m = months(spark, sf_dir)
    y = m.groupBy(*LANE, "year").agg(F.log(F.avg("total")).alias("v"))
    t = y.groupBy(*LANE).agg(F.regr_slope("v", "year").alias("b"), F.regr_intercept("v", "year").alias("a"))
    r = m.where("total > 0").join(t, LANE).groupBy(*LANE, "a", "b", "month").agg(F.avg(F.log("total") - (F.col("a") + F.col("b") * F.col("year"))).alias("s"))
    line = F.col("a") + F.col("b") * 2001
    return r.select(*LANE, "month", F.round(line, 6).alias("trend"), F.round("s", 6).alias("season"), F.round(F.exp(line + F.col("s")), 4).alias("forecast"))


@query(f"""WITH {HYDRO_SQL}, k AS (SELECT station, ln(1 + flow) AS x, ln(1 + sediment) AS y, sediment FROM hydro WHERE sediment IS NOT NULL),
f AS (SELECT station, regr_slope(y, x) AS b, regr_intercept(y, x) AS a, quantile_cont(sediment, 0.01) AS lo, quantile_cont(sediment, 0.99) AS hi FROM k GROUP BY station HAVING count(*) >= 3 AND var_pop(x) > 0),
s AS (SELECT station, avg(exp(y - (a + b * x))) AS smear FROM k JOIN f USING (station) GROUP BY station)
SELECT station, ts, sediment IS NULL AS modelled, round(coalesce(sediment, least(hi, greatest(lo, exp(least(50, greatest(-50, a + b * ln(1 + flow)))) * smear - 1))), 6) AS sediment FROM hydro JOIN f USING (station) JOIN s USING (station)""")
def completed_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Missing sediment from the line of logs on flow, with its exponent bounded, Duan's smearing, and kept
    within quantiles of what was measured; flagged."""
    h = hydro(spark, sf_dir)
    k = h.where("sediment IS NOT NULL").select("station", F.log1p("flow").alias("x"), F.log1p("sediment").alias("y"), "sediment")
    f = k.groupBy("station").agg(F.regr_slope("y", "x").alias("b"), F.regr_intercept("y", "x").alias("a"), F.count(F.lit(1)).alias("n"), F.var_pop("x").alias("spread"))
    f = f.where("n >= 3 AND spread > 0").join(ranks.quantiles(k, ["station"], "sediment", {"lo": 0.01, "hi": 0.99}), "station")
    s = k.join(f, "station").groupBy("station").agg(F.avg(F.exp(F.col("y") - (F.col("a") + F.col("b") * F.col("x")))).alias("smear"))
    model = F.exp(F.least(F.lit(50.0), F.greatest(F.lit(-50.0), F.col("a") + F.col("b") * F.log1p("flow")))) * F.col("smear") - 1
    bounded = F.least(F.col("hi"), F.greatest(F.col("lo"), model))
    return h.join(f, "station").join(s, "station").select("station", "ts", F.col("sediment").isNull().alias("modelled"), F.round(F.coalesce("sediment", bounded), 6).alias("sediment"))


@query(f"""WITH {MONTHS_SQL}, q AS (SELECT origin, dest, quantile_cont(total, 0.9) AS q FROM months GROUP BY ALL), l AS (SELECT origin, dest, month, avg(total) AS other, count(*) AS n FROM months GROUP BY ALL HAVING count(*) > 1),
s AS (SELECT m.origin, m.dest, sum(total) AS base, sum(least(total, q)) AS clipped, sum(other) AS seasonal, sum((other * n - total) / (n - 1)) AS crossed FROM months m JOIN q USING (origin, dest) JOIN l USING (origin, dest, month) GROUP BY ALL)
SELECT origin, dest, scenario, round(total, 4) AS total, round(100 * (total - base) / base, 6) + 0.0 AS change_pct FROM (SELECT origin, dest, base, unnest(['clipped', 'seasonal', 'crossed']) AS scenario, unnest([clipped, seasonal, crossed]) AS total FROM s)""")
def sensitivity_scenarios(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A lane's total under other treatments of its months (clipped at a quantile, the month's mean over the
    years, that mean without the year itself), and the change against the total as it is."""
    m = months(spark, sf_dir)
    q = m.groupBy(*LANE).agg(F.percentile("total", 0.9).alias("q"))
    other = m.groupBy(*LANE, "month").agg(F.avg("total").alias("other"), F.count(F.lit(1)).alias("n")).where("n > 1")
    rows = m.join(q, LANE).join(other, [*LANE, "month"])
    s = rows.groupBy(*LANE).agg(F.sum("total").alias("base"), F.sum(F.least("total", "q")).alias("clipped"), F.sum("other").alias("seasonal"), F.sum((F.col("other") * F.col("n") - F.col("total")) / (F.col("n") - 1)).alias("crossed"))
    long = s.unpivot([*LANE, "base"], ["clipped", "seasonal", "crossed"], "scenario", "total")
    return long.select(*LANE, "scenario", F.round("total", 4).alias("total"), (F.round(100 * (F.col("total") - F.col("base")) / F.col("base"), 6) + 0.0).alias("change_pct"))


SHAPES_SQL = MONTHS_SQL + """, sh AS (SELECT origin, dest, month, max(CASE WHEN year = 1999 THEN total END) AS a, max(CASE WHEN year = 2000 THEN total END) AS b, day(last_day(make_date(2000, month, 1))) AS d FROM months GROUP BY ALL),
wt AS (SELECT unnest([0.0, 0.25, 0.5, 0.75, 1.0])::DOUBLE AS w), bl AS (SELECT *, exp((1 - w) * ln(a / d) + w * ln(b / d)) AS g FROM sh, wt WHERE a > 0 AND b > 0),
blend AS (SELECT *, g * sum(b) OVER (PARTITION BY origin, dest, w) / sum(g * d) OVER (PARTITION BY origin, dest, w) AS level FROM bl)"""


def blends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Geometric blends of two years' daily levels by month, whose day-weighted mean is the second year's."""
    year = lambda y: F.max(F.when(F.col("year") == y, F.col("total")))
    shapes = months(spark, sf_dir).groupBy(*LANE, "month").agg(year(1999).alias("a"), year(2000).alias("b")).where("a > 0 AND b > 0")
    rows = shapes.withColumns({"d": F.dayofmonth(F.last_day(F.make_date(F.lit(2000), "month", F.lit(1)))), "w": F.explode(F.array(*map(F.lit, (0.0, 0.25, 0.5, 0.75, 1.0))))})
    rows = rows.withColumn("g", F.exp((1 - F.col("w")) * F.log(F.col("a") / F.col("d")) + F.col("w") * F.log(F.col("b") / F.col("d"))))
    own = Window.partitionBy(*LANE, "w")
    return rows.withColumn("level", F.col("g") * F.sum("b").over(own) / F.sum(F.col("g") * F.col("d")).over(own))


@query(f"WITH {SHAPES_SQL} SELECT origin, dest, month, round(level, 6) AS level, round(level * d, 4) AS total FROM blend WHERE w = 0.5")
def shape_blend(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blends(spark, sf_dir).where("w = 0.5").select(*LANE, "month", F.round("level", 6).alias("level"), F.round(F.col("level") * F.col("d"), 4).alias("total"))


@query(f"WITH {SHAPES_SQL} SELECT origin, dest, w AS weight, max_by(month, (level, -month)) AS peak, min_by(month, (level, month)) AS trough, round(max(level) / min(level), 6) AS spread FROM blend GROUP BY ALL")
def blend_sensitivity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The months of the highest and lowest level as the blend's weight moves."""
    rows = blends(spark, sf_dir)
    return rows.groupBy(*LANE, F.col("w").alias("weight")).agg(
        F.max_by("month", F.struct("level", -F.col("month"))).alias("peak"), F.min_by("month", F.struct("level", "month")).alias("trough"), F.round(F.max("level") / F.min("level"), 6).alias("spread")
    )


@query(f"WITH {MONTHS_SQL}, t AS (SELECT origin, dest, year, sum(total) AS total FROM months GROUP BY ALL), y AS (SELECT *, row_number() OVER (PARTITION BY origin, dest ORDER BY year DESC) AS k FROM t) SELECT origin, dest, count(*) AS years, min(year) AS first, round(avg(total), 4) AS mean FROM y WHERE k <= 4 GROUP BY ALL")
def tail_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each lane's last four years that have some volume."""
    y = months(spark, sf_dir).groupBy(*LANE, "year").agg(F.sum("total").alias("total"))
    last = y.withColumn("k", F.row_number().over(Window.partitionBy(*LANE).orderBy(F.desc("year")))).where("k <= 4")
    return last.groupBy(*LANE).agg(F.count(F.lit(1)).alias("years"), F.min("year").alias("first"), F.round(F.avg("total"), 4).alias("mean"))


@query(f"WITH {HYDRO_SQL} SELECT floor(sediment / 10)::INT AS level, count(*) AS n, round(sum(flow), 4) AS flow FROM hydro GROUP BY 1")
def null_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows without a measurement are a group of their own."""
    return hydro(spark, sf_dir).groupBy(F.floor(F.col("sediment") / 10).cast("int").alias("level")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("flow"), 4).alias("flow"))


@query("""WITH d AS (SELECT o_orderdate::DATE AS day, count(*) AS orders FROM orders GROUP BY 1), l AS (SELECT *, (make_date(year(day) + 1, 1, 1) - make_date(year(day), 1, 1))::DOUBLE AS days FROM d)
SELECT day, orders, days::INT AS year_days, round((dayofyear(day) - 1) / days, 8) AS fraction, round(year(day) + (dayofyear(day) - 1) / days, 8) AS decimal_year FROM l""")
def year_fraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part of its year, leap or not, that is over at a day's start."""
    d = table(spark, sf_dir, "orders").groupBy(F.col("o_orderdate").cast("date").alias("day")).agg(F.count(F.lit(1)).alias("orders"))
    first = F.trunc("day", "YEAR")
    days = F.datediff(F.add_months(first, 12), first)
    part = F.datediff("day", first) / days.cast("double")
    return d.select("day", "orders", days.alias("year_days"), F.round(part, 8).alias("fraction"), F.round(F.year("day") + part, 8).alias("decimal_year"))


CYCLES_SQL = CAL_SQL + """, sp AS (SELECT station, day, flow, s FROM (SELECT *, count(*) OVER (PARTITION BY station) AS c, row_number() OVER (PARTITION BY station ORDER BY day) AS k FROM days), (VALUES ('all'), ('first half')) v(s) WHERE s = 'all' OR k <= c // 2),
r AS (SELECT station, s, ln(1 + flow) AS y, row_number() OVER (PARTITION BY station, s ORDER BY day) - 1 AS i, count(*) OVER (PARTITION BY station, s) AS n FROM sp),
f AS (SELECT station, s, regr_slope(y, i) AS b, regr_intercept(y, i) AS a FROM r GROUP BY ALL),
d AS (SELECT r.station, r.s, i, n, (y - a - b * i) * (0.5 - 0.5 * cos(2 * pi() * i / (n - 1))) AS y FROM r JOIN f ON r.station = f.station AND r.s = f.s WHERE n >= 4),
pw AS (SELECT station, s, n, k, sum(y * cos(2 * pi() * k * i / n)) ** 2 + sum(y * sin(2 * pi() * k * i / n)) ** 2 AS power FROM (SELECT *, unnest(range(1, n // 2 + 1)) AS k FROM d) GROUP BY ALL)"""


@query(f"""WITH {CYCLES_SQL} SELECT station, s AS span, round(max_by(n / k, (round(power, 6), -k)), 6) AS period, round(max(power), 5) AS power, round(max(CASE WHEN n / k BETWEEN 5 AND 10 THEN power END) / max(power), 5) AS week_share FROM pw WHERE n / k BETWEEN 2 AND 20 GROUP BY ALL HAVING max(power) > 1e-9""")
def dominant_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The strongest period of each station between 2 and 20 days, over all its days and over the first half
    of them, and how strong periods of about a week are beside it."""
    days = calendar(spark, sf_dir)
    place = F.row_number().over(Window.partitionBy("station").orderBy("day"))
    both = days.withColumns({"k": place, "c": F.count(F.lit(1)).over(Window.partitionBy("station"))}).withColumn("span", F.explode(F.array(F.lit("all"), F.lit("first half"))))
    p = signals.periodogram(both.where("span = 'all' OR k <= floor(c / 2)"), ["station", "span"], "day", "flow").where("period BETWEEN 2 AND 20")
    week = F.max(F.when(F.col("period").between(5, 10), F.col("power")))
    out = p.groupBy("station", "span").agg(F.max_by("period", F.struct(F.round("power", 6), -F.col("cycles"))).alias("period"), F.max("power").alias("power"), week.alias("week"))
    return out.where("power > 1e-9").select("station", "span", F.round("period", 6).alias("period"), F.round("power", 5).alias("power"), F.round(F.col("week") / F.col("power"), 5).alias("week_share"))


@query(f"""WITH {CYCLES_SQL}, band AS (SELECT station, k, n / k AS period, power, sum(power) OVER (PARTITION BY station) AS whole FROM pw WHERE s = 'all' AND n / k BETWEEN 2 AND 20),
o AS (SELECT *, row_number() OVER (PARTITION BY station ORDER BY round(power / whole, 9) DESC, k) AS rank FROM band WHERE whole > 1e-9)
SELECT station, rank::INT AS rank, round(period, 6) AS period, round(power / whole, 6) AS share FROM o WHERE rank <= 10""")
def strongest_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each station's ten strongest periods between 2 and 20 days, with their shares of the band's power."""
    p = signals.periodogram(calendar(spark, sf_dir), ["station"], "day", "flow").where("period BETWEEN 2 AND 20")
    p = p.withColumn("whole", F.sum("power").over(Window.partitionBy("station"))).where("whole > 1e-9").withColumn("share", F.col("power") / F.col("whole"))
    top = ranks.top_of_each(p, ["station"], 10, F.round("share", 9).desc(), F.col("cycles"))
    return top.select("station", "rank", F.round("period", 6).alias("period"), F.round("share", 6).alias("share"))


@query(f"""WITH {MONTHS_SQL}, y AS (SELECT origin, dest, year, sum(total) AS v FROM months GROUP BY ALL), r AS (SELECT origin, dest, year, ln(v) - lag(ln(v)) OVER (PARTITION BY origin, dest ORDER BY year) AS rate FROM y),
p AS (SELECT avg(rate) AS rate, stddev_samp(rate) / sqrt(count(*)) AS se, avg(rate) FILTER (year < 2000) AS before, stddev_samp(rate) FILTER (year < 2000) AS spread FROM r WHERE rate IS NOT NULL)
SELECT a.origin, a.dest, round(a.v * exp(rate), 4) AS forecast, round(a.v * exp(rate - 1.96 * se), 4) AS low, round(a.v * exp(rate + 1.96 * se), 4) AS high, round(b.v * exp(before), 4) AS hindcast, round(a.v, 4) AS actual,
    a.v BETWEEN b.v * exp(before - 1.96 * spread) AND b.v * exp(before + 1.96 * spread) AS covered FROM y a JOIN y b ON a.origin = b.origin AND a.dest = b.dest AND a.year = 2000 AND b.year = 1999, p""")
def natural_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rate that all lanes have in common carries each one's last year on; the year before, carried on
    by the rates before it, tells whether its interval held."""
    y = months(spark, sf_dir).groupBy(*LANE, "year").agg(F.sum("total").alias("v"))
    rates = y.withColumn("rate", F.log("v") - F.lag(F.log("v")).over(Window.partitionBy(*LANE).orderBy("year"))).where("rate IS NOT NULL")
    early = F.when(F.col("year") < 2000, F.col("rate"))
    pooled = rates.agg(F.avg("rate").alias("rate"), (F.stddev_samp("rate") / F.sqrt(F.count("rate"))).alias("se"), F.avg(early).alias("before"), F.stddev_samp(early).alias("spread"))
    at = lambda k: F.max(F.when(F.col("year") == k, F.col("v")))
    ends = y.groupBy(*LANE).agg(at(2000).alias("a"), at(1999).alias("b")).where("a IS NOT NULL AND b IS NOT NULL").join(F.broadcast(pooled))  # one row
    e = lambda base, x: F.round(F.col(base) * F.exp(x), 4)
    rate, se, before, spread = (F.col(c) for c in ("rate", "se", "before", "spread"))
    covered = F.col("a").between(F.col("b") * F.exp(before - 1.96 * spread), F.col("b") * F.exp(before + 1.96 * spread))
    return ends.select(*LANE, e("a", rate).alias("forecast"), e("a", rate - 1.96 * se).alias("low"), e("a", rate + 1.96 * se).alias("high"), e("b", before).alias("hindcast"), F.round("a", 4).alias("actual"), covered.alias("covered"))


@query("""WITH e AS (SELECT user_id AS station, ts::DATE AS day, avg(value) FILTER (event_type = 'view') AS a, avg(value) FILTER (event_type = 'click') AS b FROM events GROUP BY 1, 2),
c AS (SELECT station, avg(a - b) AS bias, count(*) AS overlap FROM e WHERE a IS NOT NULL AND b IS NOT NULL GROUP BY station)
SELECT station, day, round(coalesce(a, b + bias), 6) AS value, a IS NULL AS calibrated, overlap FROM e JOIN c USING (station) WHERE a IS NOT NULL OR b IS NOT NULL""")
def bias_calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days that only the second source has, by its values and its mean distance from the first on days that
    both have."""
    kind = lambda k: F.avg(F.when(F.col("event_type") == k, F.col("value")))
    e = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("station"), F.to_date("ts").alias("day")).agg(kind("view").alias("a"), kind("click").alias("b"))
    bias = e.where("a IS NOT NULL AND b IS NOT NULL").groupBy("station").agg(F.avg(F.col("a") - F.col("b")).alias("bias"), F.count(F.lit(1)).alias("overlap"))
    rows = e.where("a IS NOT NULL OR b IS NOT NULL").join(bias, "station")
    return rows.select("station", "day", F.round(F.coalesce(F.col("a"), F.col("b") + F.col("bias")), 6).alias("value"), F.col("a").isNull().alias("calibrated"), "overlap")


@query(f"""WITH {HYDRO_SQL}, w AS (SELECT * FROM (VALUES ('early', DATE '2024-01-03', DATE '2024-01-12'), ('late', DATE '2024-01-15', DATE '2024-01-28')) v(win, a, b)),
d AS (SELECT station, ts::DATE AS day, avg(flow) AS flow, avg(sediment) AS sediment FROM hydro GROUP BY 1, 2)
SELECT station, win AS name, count(*) AS days, round(count(*) / any_value(b - a + 1), 6) AS coverage, round(avg(flow) + 1e-9, 4) AS flow, round(avg(sediment) + 1e-9, 4) AS sediment, count(*) / any_value(b - a + 1) >= 0.8 AS enough FROM d JOIN w ON day BETWEEN a AND b GROUP BY ALL""")
def window_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means over fixed windows of days, with the share of days that have some measurement."""
    d = hydro(spark, sf_dir).groupBy("station", F.to_date("ts").alias("day")).agg(F.avg("flow").alias("flow"), F.avg("sediment").alias("sediment"))
    windows = {"early": ("2024-01-03", "2024-01-12", 10), "late": ("2024-01-15", "2024-01-28", 14)}
    name = F.coalesce(*[F.when(F.col("day").between(F.lit(a).cast("date"), F.lit(b).cast("date")), F.lit(k)) for k, (a, b, _) in windows.items()])
    length = F.when(F.col("name") == "early", 10.0).otherwise(14.0)
    g = d.withColumn("name", name).where("name IS NOT NULL").groupBy("station", "name").agg(F.count(F.lit(1)).alias("days"), F.avg("flow").alias("flow"), F.avg("sediment").alias("sediment"))
    share = F.col("days") / length
    return g.select("station", "name", "days", F.round(share, 6).alias("coverage"), F.round(F.col("flow") + 1e-9, 4).alias("flow"), F.round(F.col("sediment") + 1e-9, 4).alias("sediment"), (share >= 0.8).alias("enough"))


@query(f"""WITH {PAIRS_SQL} SELECT station, date_trunc('month', day)::DATE AS month, round(sum((2 * v0 + (v1 - v0) * ((lo - a) + (hi - a)) / (b - a)) / 2 * (hi - lo) / 1e6), 2) AS volume, round(sum(hi - lo) / 1e6, 3) AS seconds, round(max((b - a) / 3.6e9), 6) AS max_gap FROM parts WHERE hi > lo GROUP BY 1, 2""")
def month_integrals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Integrals of the line between points by month, cut exactly where a month ends, and the longest gap."""
    s = ordered.segments(hydro(spark, sf_dir), ["station"], "ts", "flow")
    return s.groupBy("station", F.trunc("day", "MM").alias("month")).agg(F.round(F.sum("area"), 2).alias("volume"), F.round(F.sum("seconds"), 3).alias("seconds"), F.round(F.max("gap"), 6).alias("max_gap"))


@query(f"""WITH {CLIMATE_SQL}, s AS (SELECT origin, dest, month, unnest(['low', 'normal', 'high']) AS scenario, unnest([f * 0.8, f, f * 1.25]) AS v FROM climate)
SELECT origin, scenario, CASE WHEN grouping(month) = 1 THEN 0 ELSE month END AS month, round(sum(v), 3) AS total FROM s GROUP BY GROUPING SETS ((origin, scenario, month), (origin, scenario))""")
def scenario_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scenarios by origin and month, and over the year (month 0)."""
    s = climate(months(spark, sf_dir)).select(*LANE, "month", F.explode(F.create_map(F.lit("low"), F.col("f") * 0.8, F.lit("normal"), F.col("f"), F.lit("high"), F.col("f") * 1.25)).alias("scenario", "v"))
    g = s.groupingSets([["origin", "scenario", "month"], ["origin", "scenario"]], "origin", "scenario", "month").agg(F.grouping("month").alias("g"), F.sum("v").alias("total"))
    return g.select("origin", "scenario", F.when(F.col("g") == 1, 0).otherwise(F.col("month")).alias("month"), F.round("total", 3).alias("total"))


@query(f"""WITH {CLIMATE_SQL} SELECT origin, dest, month, round(avg(total), 4) AS history, round(any_value(f), 4) AS forecast, round(any_value(f) / avg(total), 6) AS ratio, any_value(f) BETWEEN min(total) AND max(total) AS in_range FROM months JOIN climate USING (origin, dest, month) GROUP BY ALL""")
def history_and_forecast(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = months(spark, sf_dir)
    g = m.groupBy(*LANE, "month").agg(F.avg("total").alias("h"), F.min("total").alias("lo"), F.max("total").alias("hi")).join(climate(m), [*LANE, "month"])
    return g.select(*LANE, "month", F.round("h", 4).alias("history"), F.round("f", 4).alias("forecast"), F.round(F.col("f") / F.col("h"), 6).alias("ratio"), F.col("f").between(F.col("lo"), F.col("hi")).alias("in_range"))


@query(f"WITH {POOL_SQL}, b AS (SELECT station, n, total FROM pool WHERE ts + INTERVAL 6 HOUR <= ts::DATE + INTERVAL 1 DAY) SELECT station, count(*) AS blocks, min(n) AS least, median(n) AS middle, max(n) AS most, round(min(total), 6) AS low, round(max(total), 6) AS high FROM b GROUP BY station")
def block_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many measurements the blocks of each station's pool have."""
    b = pool(spark, sf_dir)
    return b.groupBy("station").agg(F.count(F.lit(1)).alias("blocks"), F.min("n").alias("least"), F.median("n").alias("middle"), F.max("n").alias("most"), F.round(F.min("total"), 6).alias("low"), F.round(F.max("total"), 6).alias("high"))


@query(f"""WITH {CAL_SQL}, d AS (SELECT station, day, row_number() OVER (PARTITION BY station ORDER BY day) - 1 AS i, count(*) OVER (PARTITION BY station) AS n, flow FROM days),
s AS (SELECT station, n, unnest(range(0, (n + 2) // 3)) AS slot FROM (SELECT DISTINCT station, n FROM d)),
t AS (SELECT station, n, slot, ('0x' || substr(md5(station || '/' || slot), 1, 12))::BIGINT % greatest(1, n - 2) AS start FROM s)
SELECT t.station, count(*) AS n, round(avg(flow), 6) AS mean, round(min(flow), 6) AS low, round(max(flow), 6) AS high FROM (SELECT *, unnest([0, 1, 2]) AS k FROM t) t JOIN d ON d.station = t.station AND d.i = start + k WHERE slot * 3 + k < t.n GROUP BY t.station""")
def block_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each station's days drawn again in blocks of three days, as many as it has. Starts come from digests,
    the same in every run."""
    own = Window.partitionBy("station")
    d = calendar(spark, sf_dir).select("station", "flow", (F.row_number().over(own.orderBy("day")) - 1).alias("i"), F.count(F.lit(1)).over(own).alias("n"))
    slots = d.select("station", "n").distinct().withColumn("slot", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") + 2) / 3) - 1)))
    digest = F.conv(F.substring(F.md5(F.concat_ws("/", F.col("station").cast("string"), F.col("slot").cast("string")).cast("binary")), 1, 12), 16, 10).cast("long")
    drawn = slots.withColumn("k", F.explode(F.array(*map(F.lit, (0, 1, 2))))).where("slot * 3 + k < n").select("station", (F.pmod(digest, F.greatest(F.lit(1).cast("long"), F.col("n") - 2)) + F.col("k")).cast("int").alias("i"))
    g = drawn.join(d.select("station", "i", "flow"), ["station", "i"])
    return g.groupBy("station").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("flow"), 6).alias("mean"), F.round(F.min("flow"), 6).alias("low"), F.round(F.max("flow"), 6).alias("high"))


YEAR_SQL = LANES_SQL + f""", dv AS (SELECT year(day)::INT AS year, day, sum(volume) AS v FROM lanes WHERE year(day) <= 2000 GROUP BY ALL), di AS (SELECT *, row_number() OVER (PARTITION BY year ORDER BY day) - 1 AS i, count(*) OVER (PARTITION BY year) AS n FROM dv),
kl AS (SELECT unnest([1, 3, 7]) AS k), bl AS (SELECT k, year, i, n, sum(v) OVER (PARTITION BY k, year ORDER BY i ROWS BETWEEN CURRENT ROW AND 6 FOLLOWING) AS t7, sum(v) OVER (PARTITION BY k, year ORDER BY i ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING) AS t3, v AS t1 FROM di, kl),
po AS (SELECT k, year, i, n, CASE k WHEN 1 THEN t1 WHEN 3 THEN t3 ELSE t7 END AS t FROM bl WHERE i <= n - k), sz AS (SELECT k, year, any_value(n) AS n FROM po GROUP BY ALL),
dw AS (SELECT k, year, n, d, unnest(range(0, (n + k - 1) // k)) AS s FROM sz, range(1, 501) r(d)), pk AS (SELECT k, year, d, {digest_sql("year", "k", "d", "s")} % (n - k + 1) AS i FROM dw),
tt AS (SELECT k, year, d, sum(t) AS total FROM pk JOIN po USING (k, year, i) GROUP BY ALL)"""


@query(f"WITH {YEAR_SQL} SELECT k::INT AS days, year, count(*) AS draws, round(avg(total), 4) AS mean, round(quantile_cont(total, 0.025), 4) AS low, round(quantile_cont(total, 0.975), 4) AS high FROM tt GROUP BY ALL")
def year_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A year's total from 500 draws of blocks of 1, 3 and 7 days out of the year, as many as fill it, and its
    95 % interval. Draws come from digests; a block drawn often by one draw is joined once."""
    own = Window.partitionBy("year").orderBy("day")
    days = lane_days(spark, sf_dir).where(F.year("day") <= 2000).groupBy(F.year("day").alias("year"), "day").agg(F.sum("volume").alias("v"))
    days = days.withColumns({"i": (F.row_number().over(own) - 1).cast("long"), "n": F.count(F.lit(1)).over(Window.partitionBy("year"))})
    days = written(days, "year-days")  # a row for each day
    days = days.withColumns({f"t{k}": F.sum("v").over(own.rowsBetween(0, k - 1)) for k in (1, 3, 7)})
    pool = days.select("year", "i", "n", F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"t{k}").alias("t")) for k in (1, 3, 7)])).alias("b")).select("b.k", "year", "i", "n", "b.t").where("i <= n - k")
    sizes = pool.select("k", "year", "n").distinct()
    drawn = sizes.withColumn("d", F.explode(F.sequence(F.lit(1), F.lit(500)))).withColumn("s", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") + F.col("k") - 1) / F.col("k")) - 1)))
    at = drawn.select("k", "year", "d", F.pmod(digest(F.col("year"), F.col("k"), F.col("d"), F.col("s")), F.col("n") - F.col("k") + 1).alias("i"))
    at = at.groupBy("k", "year", "d", "i").agg(F.count(F.lit(1)).alias("w"))
    sums = at.join(pool.select("k", "year", "i", "t"), ["k", "year", "i"]).groupBy("k", "year", "d").agg(F.sum(F.col("t") * F.col("w")).alias("total"))
    return sums.groupBy(F.col("k").alias("days"), "year").agg(F.count(F.lit(1)).alias("draws"), F.round(F.avg("total"), 4).alias("mean"), F.round(F.percentile("total", 0.025), 4).alias("low"), F.round(F.percentile("total", 0.975), 4).alias("high"))
