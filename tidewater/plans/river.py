"""Irregular station series: cleaning, interpolation, integrals, events, cycles, forecasts and sampling.

Values that often end in an exact half at the last decimal are rounded with 1e-9 added."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewater.operators import forecast, integrals, ordered, ranks, relations, signals
from tidewater.plans.common import Plan
from tidewater.sources.shared import written
from tidewater.sources.tables import HYDRO_SQL, LANES_SQL, hydro, lane_days

plan = Plan()
query = plan.query
QUERIES, ORACLES = plan.queries, plan.oracles
KEY = ["station"]


@query(f"WITH {HYDRO_SQL} SELECT station, date_trunc('hour', ts)::TIMESTAMP AS ts, count(*) AS n, round(avg(flow), 6) AS flow, round(avg(sediment), 6) AS sediment FROM hydro GROUP BY 1, 2")
def hydro_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measurements of one hour as their mean."""
    rows = hydro(spark, sf_dir).groupBy("station", F.date_trunc("HOUR", "ts").cast("timestamp_ntz").alias("ts")).agg(F.count(F.lit(1)).alias("n"), F.avg("flow").alias("flow"), F.avg("sediment").alias("sediment"))
    return rows.select("station", "ts", "n", F.round("flow", 6).alias("flow"), F.round("sediment", 6).alias("sediment"))


@query(f"WITH {HYDRO_SQL} SELECT station, ts, last_value(sediment IGNORE NULLS) OVER (PARTITION BY station ORDER BY ts) AS sediment FROM hydro")
def forward_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ordered.neighbours(hydro(spark, sf_dir), KEY, "ts", "sediment", "s")
    return rows.select("station", "ts", F.col("s_before.v").alias("sediment"))


AROUND_SQL = HYDRO_SQL + """, known AS (SELECT station, ts, sediment AS v FROM hydro WHERE sediment IS NOT NULL),
around AS (SELECT h.station, h.ts, a.ts AS ta, a.v AS va, b.ts AS tb, b.v AS vb
    FROM hydro h ASOF LEFT JOIN known a ON h.station = a.station AND h.ts >= a.ts ASOF LEFT JOIN known b ON h.station = b.station AND h.ts <= b.ts)"""


@query(f"""WITH {AROUND_SQL} SELECT station, ts, round(CASE WHEN va IS NULL OR vb IS NULL OR ta = tb THEN coalesce(va, vb) ELSE va + (vb - va) * (epoch_us(ts) - epoch_us(ta)) / (epoch_us(tb) - epoch_us(ta)) END, 6) AS held,
    round(CASE WHEN va IS NULL OR vb IS NULL THEN NULL WHEN ta = tb THEN va ELSE va + (vb - va) * (epoch_us(ts) - epoch_us(ta)) / (epoch_us(tb) - epoch_us(ta)) END, 6) AS inside,
    CASE WHEN va IS NULL OR (vb IS NOT NULL AND tb - ts < ts - ta) THEN vb ELSE va END AS nearest FROM around""")
def interp_linear_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sediment at every time: on the line between measurements with the ends held, only between
    measurements, and that of the nearest one."""
    rows = ordered.neighbours(hydro(spark, sf_dir), KEY, "ts", "sediment", "s")
    return rows.select("station", "ts", F.round(ordered.interpolated("ts", "s"), 6).alias("held"), F.round(ordered.interpolated("ts", "s", inside=True), 6).alias("inside"), ordered.nearest("ts", "s").alias("nearest"))


ROWS_SQL = HYDRO_SQL + """, n AS (SELECT station, row_number() OVER (PARTITION BY station ORDER BY ts) AS i, sediment AS v FROM hydro), k AS (SELECT * FROM n WHERE v IS NOT NULL),
around AS (SELECT n.station, n.i, a.i AS ia, a.v AS va, b.i AS ib, b.v AS vb FROM n ASOF LEFT JOIN k a ON n.station = a.station AND n.i >= a.i ASOF LEFT JOIN k b ON n.station = b.station AND n.i <= b.i)"""


@query(f"WITH {ROWS_SQL} SELECT station, i::INT AS place, round(CASE WHEN va IS NULL OR vb IS NULL OR ia = ib THEN coalesce(va, vb) ELSE va + (vb - va) * (i - ia) / (ib - ia) END + 1e-9, 6) AS sediment FROM around")
def interp_linear_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by the place of rows instead of their time. Places come from counts over ranges of time, neighbours
    from a row's own day and what is carried into it, so that no task has a station's whole series."""
    rows = hydro(spark, sf_dir).withColumn("t", ordered.micros("ts"))
    below = ranks.running(rows, KEY, "t").select(*KEY, "t", "below")
    tie = F.row_number().over(Window.partitionBy("station", "t").orderBy("flow"))
    rows = rows.join(below, [*KEY, "t"]).withColumn("place", (F.col("below") + tie).cast("int"))
    rows = rows.withColumn("k", F.when(F.col("sediment").isNotNull(), F.struct(F.col("place").alias("i"), F.col("sediment").alias("v"))))
    rows = ordered.neighbours(rows, KEY, "ts", "k", "k", first=["place"])
    a, b = F.col("k_before.v"), F.col("k_after.v")
    line = F.when(a["i"] < b["i"], a["v"] + (b["v"] - a["v"]) * (F.col("place") - a["i"]) / (b["i"] - a["i"])).otherwise(F.coalesce(a["v"], b["v"]))
    return rows.select("station", "place", F.round(line + 1e-9, 6).alias("sediment"))


GRID_SQL = HYDRO_SQL + """, grid AS (SELECT station, unnest(generate_series(date_trunc('hour', min(ts)) + INTERVAL 1 HOUR, date_trunc('hour', max(ts)), INTERVAL 1 HOUR))::TIMESTAMP AS ts FROM hydro GROUP BY station)"""


@query(f"WITH {GRID_SQL} SELECT g.station, g.ts, h.flow FROM grid g ASOF LEFT JOIN hydro h ON g.station = h.station AND g.ts >= h.ts")
def interp_previous(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last flow before each full hour."""
    return ordered.on_hours(hydro(spark, sf_dir), KEY, "ts", ["flow"]).select("station", "ts", F.col("flow_before.v").alias("flow"))


def line_sql(t: str, a: str, b: str, v: str) -> str:
    return f"CASE WHEN {a}.ts IS NULL OR {b}.ts IS NULL OR {a}.ts = {b}.ts THEN coalesce({a}.{v}, {b}.{v}) ELSE {a}.{v} + ({b}.{v} - {a}.{v}) * (epoch_us({t}) - epoch_us({a}.ts)) / (epoch_us({b}.ts) - epoch_us({a}.ts)) END"


@query(f"""WITH {GRID_SQL}, m AS (SELECT station, ts, flow * sediment AS flux, sediment FROM hydro WHERE sediment IS NOT NULL),
hourly AS (SELECT g.station, g.ts, {line_sql("g.ts", "a", "b", "flux")} AS direct, ({line_sql("g.ts", "c", "d", "flow")}) * ({line_sql("g.ts", "a", "b", "sediment")}) AS product, c.flow * coalesce(a.sediment, b.sediment) AS previous
    FROM grid g ASOF LEFT JOIN m a ON g.station = a.station AND g.ts >= a.ts ASOF LEFT JOIN m b ON g.station = b.station AND g.ts <= b.ts
        ASOF LEFT JOIN hydro c ON g.station = c.station AND g.ts >= c.ts ASOF LEFT JOIN hydro d ON g.station = d.station AND g.ts <= d.ts)
SELECT station, ts::DATE AS day, count(*) AS hours, round(avg(direct) + 1e-9, 6) AS direct, round(avg(product) + 1e-9, 6) AS product, round(avg(previous) + 1e-9, 6) AS previous FROM hourly GROUP BY 1, 2""")
def hourly_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily means of the hourly flux: the flux itself interpolated, flow and concentration interpolated
    and multiplied, and previous values (the first one before there is one)."""
    rows = hydro(spark, sf_dir).withColumn("flux", F.col("flow") * F.col("sediment"))
    h = ordered.on_hours(rows, KEY, "ts", ["flux", "flow", "sediment"])
    product = ordered.interpolated("ts", "flow") * ordered.interpolated("ts", "sediment")
    previous = F.col("flow_before.v") * F.coalesce("sediment_before.v", "sediment_after.v")
    h = h.select("station", F.to_date("ts").alias("day"), ordered.interpolated("ts", "flux").alias("direct"), product.alias("product"), previous.alias("previous"))
    return h.groupBy("station", "day").agg(F.count(F.lit(1)).alias("hours"), *[F.round(F.avg(c) + 1e-9, 6).alias(c) for c in ("direct", "product", "previous")])


PAIRS_SQL = HYDRO_SQL + """, pairs AS (SELECT station, epoch_us(ts) AS a, flow AS v0, epoch_us(lead(ts) OVER w) AS b, lead(flow) OVER w AS v1, ts::DATE AS d0, (lead(ts) OVER w)::DATE AS d1 FROM hydro WINDOW w AS (PARTITION BY station ORDER BY ts)),
cut AS (SELECT *, unnest(generate_series(d0::TIMESTAMP, d1::TIMESTAMP, INTERVAL 1 DAY))::DATE AS day FROM pairs WHERE b IS NOT NULL),
parts AS (SELECT *, greatest(a, epoch_us(day::TIMESTAMP)) AS lo, least(b, epoch_us(day::TIMESTAMP) + 86400000000) AS hi FROM cut)"""


@query(f"""WITH {PAIRS_SQL} SELECT station, day, round(sum((2 * v0 + (v1 - v0) * ((lo - a) + (hi - a)) / (b - a)) / 2 * (hi - lo) / 1e6), 3) AS volume, round(sum(hi - lo) / 1e6, 3) AS seconds, round(max((b - a) / 3.6e9), 6) AS max_gap
FROM parts WHERE hi > lo GROUP BY 1, 2""")
def trapz_day_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact integrals of the lines between measurements over each day, with the largest gap."""
    s = ordered.segments(hydro(spark, sf_dir), KEY, "ts", "flow")
    return s.groupBy("station", "day").agg(F.round(F.sum("area"), 3).alias("volume"), F.round(F.sum("seconds"), 3).alias("seconds"), F.round(F.max("gap"), 6).alias("max_gap"))


@query(f"""WITH {HYDRO_SQL}, p AS (SELECT epoch_us(date_trunc('month', min(ts))::TIMESTAMP) / 1e6 AS a, epoch_us((date_trunc('month', max(ts)) + INTERVAL 1 MONTH)::TIMESTAMP) / 1e6 AS b FROM hydro),
e AS (SELECT station, flow, epoch_us(ts) / 1e6 AS t, a, b FROM hydro, p),
n AS (SELECT *, lag(t) OVER w AS before, lead(t) OVER w AS after FROM e WINDOW w AS (PARTITION BY station ORDER BY t)),
w AS (SELECT station, flow, (CASE WHEN after IS NULL THEN 2 * b - t ELSE after END - CASE WHEN before IS NULL THEN 2 * a - t ELSE before END) / 2 AS weight FROM n)
SELECT station, count(*) AS n, round(sum(flow * weight), 2) AS total, round(sum(weight), 2) AS seconds FROM w GROUP BY station""")
def trapz_period(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The integral over the table's whole months as a weighted sum: each value counts for half of both gaps, the
    first and last one up to the period's ends."""
    rows = hydro(spark, sf_dir)
    ends = rows.agg(F.date_trunc("month", F.min("ts")).cast("timestamp_ntz").alias("a"), (F.date_trunc("month", F.max("ts")) + F.expr("INTERVAL 1 MONTH")).cast("timestamp_ntz").alias("b"))
    ends = ends.select(ordered.micros("a").alias("a"), ordered.micros("b").alias("b")).first()
    rows = ordered.adjacent(rows.select("station", "flow", (ordered.micros("ts") / 1e6).alias("t"), F.to_date("ts").alias("day")), KEY, "t", "day")
    a, b = (ends.a or 0) / 1e6, (ends.b or 0) / 1e6
    rows = rows.withColumn("w", (F.coalesce("_after", 2 * b - F.col("t")) - F.coalesce("_before", 2 * a - F.col("t"))) / 2)
    return rows.groupBy("station").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(F.col("flow") * F.col("w")), 2).alias("total"), F.round(F.sum("w"), 2).alias("seconds"))


@query(f"""WITH {HYDRO_SQL}, g AS (SELECT station, (epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY station ORDER BY ts))) / 3.6e9 AS gap FROM hydro)
SELECT station, count(gap) AS gaps, round(median(gap), 6) AS median_gap, round(max(gap), 6) AS max_gap, round(quantile_cont(gap, 0.95), 6) AS p95_gap FROM g GROUP BY station""")
def gap_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hours between a station's measurements; quantiles from counts over ranges of gaps."""
    rows = hydro(spark, sf_dir).select("station", ordered.micros("ts").alias("t"), F.to_date("ts").alias("day"))
    rows = ordered.adjacent(rows, KEY, "t", "day").withColumn("gap", (F.col("t") - F.col("_before")) / 3.6e9)
    whole = rows.groupBy("station").agg(F.count("gap").alias("gaps"), F.round(F.max("gap"), 6).alias("max_gap"))
    q = ranks.quantiles(rows, KEY, "gap", {"median_gap": 0.5, "p95_gap": 0.95})
    return whole.join(q, KEY, "left").select("station", "gaps", F.round("median_gap", 6).alias("median_gap"), "max_gap", F.round("p95_gap", 6).alias("p95_gap"))


CAL_SQL = HYDRO_SQL + """, daily AS (SELECT station, ts::DATE AS day, avg(flow) AS flow, sum(flow) AS total, count(*) AS n FROM hydro GROUP BY 1, 2),
bounds AS (SELECT min(day) AS a, max(day) AS b FROM daily),
cal AS (SELECT station, unnest(generate_series(a::TIMESTAMP, b::TIMESTAMP, INTERVAL 1 DAY))::DATE AS day FROM (SELECT DISTINCT station FROM daily), bounds),
days AS (SELECT station, day, coalesce(flow, 0) AS flow, n FROM cal LEFT JOIN daily USING (station, day))"""


def calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """station, day, flow (0 without a measurement) for all days of the table."""
    from tidewater.operators.panels import complete

    days = hydro(spark, sf_dir).groupBy("station", F.to_date("ts").alias("day")).agg(F.avg("flow").alias("flow"))
    return complete(days, KEY, "day", "flow")


@query(f"""WITH {CAL_SQL}, miss AS (SELECT station, day - DATE '2024-01-01' AS i FROM days WHERE n IS NULL), isl AS (SELECT station, i, i - row_number() OVER (PARTITION BY station ORDER BY i) AS g FROM miss),
runs AS (SELECT station, min(i) AS first, max(i) AS last, count(*) AS length FROM isl GROUP BY station, g)
SELECT station, max(length) AS longest, min_by(first, (-length, first))::INT AS first, count(*) AS runs FROM runs GROUP BY station""")
def longest_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The longest run of days without a measurement."""
    days = calendar(spark, sf_dir).withColumn("i", F.datediff("day", F.lit("2024-01-01").cast("date")))
    runs = ranks.runs(days, KEY, "i", F.col("flow") == 0)
    return runs.groupBy("station").agg(F.max("length").alias("longest"), F.min_by("first", F.struct(-F.col("length"), "first")).alias("first"), F.count(F.lit(1)).alias("runs"))


@query(f"""WITH {LANES_SQL}, m AS (SELECT year(day)::INT AS year, month(day)::INT AS month, sum(volume) AS total FROM lanes GROUP BY 1, 2),
s AS (SELECT *, total / sum(total) OVER (PARTITION BY year) AS share, total / nullif(lag(total) OVER (PARTITION BY month ORDER BY year), 0) AS ratio FROM m)
SELECT year, month, total, round(share, 6) AS share, round(ratio, 6) AS ratio, round(sum(CASE WHEN month BETWEEN 6 AND 10 THEN share ELSE 0 END) OVER (PARTITION BY year), 6) AS flood_share FROM s""")
def seasonal_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each month's share of its year, its ratio to the same month a year ago, the flood months' share."""
    months = lane_days(spark, sf_dir).groupBy(F.year("day").alias("year"), F.month("day").alias("month")).agg(F.sum("volume").alias("total"))
    rows = months.withColumns({"share": ranks.share("total", "year"), "ratio": F.try_divide("total", F.lag("total").over(Window.partitionBy("month").orderBy("year")))})
    flood = F.sum(F.when(F.col("month").between(6, 10), F.col("share")).otherwise(0.0)).over(Window.partitionBy("year"))
    return rows.select("year", "month", "total", F.round("share", 6).alias("share"), F.round("ratio", 6).alias("ratio"), F.round(flood, 6).alias("flood_share"))


ABRUPT_SQL = CAL_SQL + """, l AS (SELECT station, day, ln(1 + flow) AS x FROM days),
c AS (SELECT station, day, CASE WHEN count(*) OVER a = 3 AND count(*) OVER b = 3 THEN avg(x) OVER a - avg(x) OVER b END AS c FROM l
    WINDOW a AS (PARTITION BY station ORDER BY day ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING), b AS (PARTITION BY station ORDER BY day ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING)),
z AS (SELECT station, day, c / (CASE WHEN stddev_samp(c) OVER (PARTITION BY station) > 0 THEN stddev_samp(c) OVER (PARTITION BY station) ELSE 1 END) AS z FROM c),
scores AS (SELECT station, day, z, abs(z) AS score FROM z WHERE z IS NOT NULL)"""


def scores(spark: SparkSession, sf_dir: str, width: int = 3) -> DataFrame:
    return signals.abrupt(calendar(spark, sf_dir), KEY, "day", ["flow"], width)


@query(f"WITH {ABRUPT_SQL} SELECT station, day, round(z, 5) AS flow_z, round(score, 5) AS score FROM scores")
def abrupt_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores(spark, sf_dir).select("station", "day", F.round("flow_z", 5).alias("flow_z"), F.round("score", 5).alias("score"))


@query()
def event_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Greedy: the highest scores first, a gap of 5 days, 15 events at most."""
    return signals.selected(scores(spark, sf_dir), KEY, "day", 1.2, 5, 15)


SETTINGS = [(w, t, g) for w in (2, 3, 4) for t in (1.0, 1.2, 1.4) for g in (3, 5, 7)]  #: width, threshold, gap


def settings_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """station, width, threshold, gap, day, score: the events of each of 27 settings."""
    days, found = calendar(spark, sf_dir), None
    for width in sorted({w for w, _, _ in SETTINGS}):
        of = F.array(*[F.struct(F.lit(t).alias("threshold"), F.lit(g).alias("gap")) for w, t, g in SETTINGS if w == width])
        s = signals.abrupt(days, KEY, "day", ["flow"], width).select("station", F.lit(width).alias("width"), "day", "score", F.explode(of).alias("o")).select("station", "width", "day", "score", "o.*")
        found = s if found is None else found.unionByName(s)
    return signals.selected_settings(found, ["station", "width"], "day", 15)


@query()
def event_stability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many of the 27 settings find each event of the basic one (3, 1.2, 5) within 2 days."""
    base = event_select(spark, sf_dir)
    found = settings_events(spark, sf_dir).select("station", F.col("day").alias("other"), F.concat_ws("-", "width", "threshold", "gap").alias("setting"))
    near = relations.within(base, found, KEY, "day", "other", 2, "left")
    return near.groupBy("l.station", "l.day").agg(F.count_distinct("r.setting").alias("matched"), F.lit(len(SETTINGS)).alias("settings"), (F.count_distinct("r.setting") / len(SETTINGS)).alias("stability"))


@query()
def event_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each setting: its events, the share of basic events that it finds within 2 days, and the share of its
    events that are basic ones."""
    base = event_select(spark, sf_dir)
    n = base.agg(F.count(F.lit(1)).alias("n"))  # one row
    found = written(settings_events(spark, sf_dir), "event-settings")
    key = ["width", "threshold", "gap"]
    matched = relations.within(found, base.select("station", F.col("day").alias("other")), KEY, "day", "other", 2, "left")
    own = matched.groupBy("l.station", *[f"l.{c}" for c in key], "l.day").agg(F.max(F.col("r.other").isNotNull().cast("int")).alias("hit"))
    own = own.groupBy(*key).agg(F.count(F.lit(1)).alias("events"), F.avg("hit").alias("matched"))
    covered = relations.within(base, found.select("station", F.col("day").alias("other"), *key), KEY, "day", "other", 2)
    covered = covered.groupBy(*[f"r.{c}" for c in key]).agg(F.count_distinct("l.station", "l.day").alias("k"))
    out = own.join(covered, key, "left").join(F.broadcast(n))
    return out.select(*key, "events", F.round(F.coalesce("k", F.lit(0)) / F.col("n"), 6).alias("coverage"), F.round("matched", 6).alias("matched"))


@query(f"""WITH {CAL_SQL}, a AS (SELECT station, day FROM days WHERE flow >= 60), b AS (SELECT station, day FROM days WHERE n >= 4)
SELECT station, day, EXISTS (SELECT 1 FROM b WHERE b.station = a.station AND abs(b.day - a.day) <= 2) AS matched FROM a""")
def event_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days of high flow with a day of many measurements at most two days away."""
    rows = hydro(spark, sf_dir).groupBy("station", F.to_date("ts").alias("day")).agg(F.avg("flow").alias("flow"), F.count(F.lit(1)).alias("n"))
    a, b = rows.where("flow >= 60").select("station", "day"), rows.where("n >= 4").select("station", F.col("day").alias("other"))
    return relations.within(a, b, KEY, "day", "other", 2, "left").groupBy("l.station", "l.day").agg((F.count("r.other") > 0).alias("matched"))


@query(f"""WITH {CAL_SQL}, p AS (SELECT a.station, (b.day - a.day)::INT AS lag, a.flow AS x, b.flow AS y FROM days a JOIN days b ON a.station = b.station AND b.day - a.day IN (1, 2, 3, 7, 14))
SELECT station, lag, count(*) AS n, round(corr(x, y), 6) AS r FROM p GROUP BY 1, 2""")
def acf(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = signals.autocorrelation(calendar(spark, sf_dir), KEY, "day", "flow", [1, 2, 3, 7, 14])
    return rows.select("station", "lag", "n", F.round("r", 6).alias("r"))


@query(f"""WITH {CAL_SQL}, r AS (SELECT station, ln(1 + flow) AS y, row_number() OVER (PARTITION BY station ORDER BY day) - 1 AS i, count(*) OVER (PARTITION BY station) AS n FROM days),
d AS (SELECT station, i, n, (y - regr_intercept(y, i) OVER w - regr_slope(y, i) OVER w * i) * (0.5::DOUBLE - 0.5::DOUBLE * cos(2 * pi() * i / (n - 1))) AS y FROM r WINDOW w AS (PARTITION BY station)),
k AS (SELECT *, unnest(range(1, n // 2 + 1)) AS k FROM d WHERE n >= 4)
SELECT station, k::INT AS cycles, round(n / k, 6) AS period, round(sum(y * cos(2 * pi() * k * i / n)) ** 2 + sum(y * sin(2 * pi() * k * i / n)) ** 2, 5) AS power FROM k GROUP BY station, k, n""")
def periodogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = signals.periodogram(calendar(spark, sf_dir), KEY, "day", "flow")
    return rows.select("station", "cycles", F.round("period", 6).alias("period"), F.round("power", 5).alias("power"))


MONTHS_SQL = LANES_SQL + """, months AS (SELECT origin, dest, year(day)::INT AS year, month(day)::INT AS month, sum(volume) AS total FROM lanes WHERE year(day) <= 2000 GROUP BY ALL)"""


def months(spark: SparkSession, sf_dir: str) -> DataFrame:
    lanes = lane_days(spark, sf_dir).where(F.year("day") <= 2000)
    return lanes.groupBy("origin", "dest", F.year("day").alias("year"), F.month("day").alias("month")).agg(F.sum("volume").alias("total"))


@query(f"""WITH {MONTHS_SQL}, y AS (SELECT origin, dest, year, sum(total) AS total FROM months GROUP BY ALL), s AS (SELECT origin, dest, least(0.12::DOUBLE, greatest(-0.12::DOUBLE, regr_slope(ln(total), year))) AS slope FROM y WHERE total > 0 GROUP BY ALL)
SELECT origin, dest, month, round(total * exp(slope), 4) AS forecast FROM months JOIN s USING (origin, dest) WHERE year = 2000""")
def seasonal_naive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last year's months times the clipped growth of the years' logs."""
    m = months(spark, sf_dir)
    years = m.groupBy("origin", "dest", "year").agg(F.sum("total").alias("t")).where("t > 0")
    slope = years.groupBy("origin", "dest").agg(F.least(F.lit(0.12), F.greatest(F.lit(-0.12), F.regr_slope(F.log("t"), F.col("year")))).alias("slope"))
    return m.where("year = 2000").join(slope, ["origin", "dest"]).select("origin", "dest", "month", F.round(F.col("total") * F.exp("slope"), 4).alias("forecast"))


@query(f"WITH {MONTHS_SQL} SELECT origin, dest, month, round(exp(sum(exp(-0.55::DOUBLE * (2000 - year)) * ln(total)) / sum(exp(-0.55::DOUBLE * (2000 - year)))), 4) AS forecast FROM months WHERE total > 0 GROUP BY ALL")
def regime_climatology(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean logs of each calendar month, older years weighing less."""
    w = F.exp(-0.55 * (2000 - F.col("year")))
    rows = months(spark, sf_dir).where("total > 0").groupBy("origin", "dest", "month").agg((F.sum(w * F.log("total")) / F.sum(w)).alias("l"))
    return rows.select("origin", "dest", "month", F.round(F.exp("l"), 4).alias("forecast"))


@query(f"""WITH {LANES_SQL}, t AS (SELECT unnest(range(1, 366, 15)) AS target),
k AS (SELECT origin, dest, target::INT AS target, volume, least(abs(dayofyear(day) - target), 366 - abs(dayofyear(day) - target)) AS d, year(day) AS y FROM lanes JOIN t ON least(abs(dayofyear(day) - target), 366 - abs(dayofyear(day) - target)) <= 15 WHERE year(day) <= 2000),
w AS (SELECT *, exp(-0.5::DOUBLE * (d / 7.5::DOUBLE) ** 2) * exp(-0.42::DOUBLE * (2000 - y)) * CASE WHEN y < 1997 THEN 0.45::DOUBLE ELSE 1 END AS w FROM k),
g AS (SELECT origin, dest, target, volume, sum(w) AS w FROM w GROUP BY ALL),
c AS (SELECT *, sum(w) OVER (PARTITION BY origin, dest, target ORDER BY volume ROWS UNBOUNDED PRECEDING) / sum(w) OVER (PARTITION BY origin, dest, target) AS c FROM g)
SELECT origin, dest, target, round(sum(w * volume) / sum(w), 6) AS normal, min(CASE WHEN c >= 0.30 - 1e-9 THEN volume END) * 0.93::DOUBLE AS low, min(CASE WHEN c >= 0.75 - 1e-9 THEN volume END) * 1.08::DOUBLE AS high FROM c GROUP BY ALL""")
def template_forecast(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A season's template: weighted means and quantiles of the days around a day of the year, near and
    recent ones weighing more."""
    lanes = lane_days(spark, sf_dir).where(F.year("day") <= 2000)
    # a day meets 25 targets and stays with those within 15 days of it
    rows = lanes.withColumn("target", F.explode(F.sequence(F.lit(1), F.lit(365), F.lit(15))))
    gap = F.abs(F.dayofyear("day") - F.col("target"))
    rows = rows.withColumn("d", F.least(gap, 366 - gap)).where("d <= 15")
    y = F.year("day")
    w = F.exp(-0.5 * F.pow(F.col("d") / 7.5, F.lit(2))) * F.exp(-0.42 * (2000 - y)) * F.when(y < 1997, 0.45).otherwise(1.0)
    key = ["origin", "dest", "target"]
    rows = rows.groupBy(*key, "volume").agg(F.sum(w).alias("w"))
    own = Window.partitionBy(*key)
    rows = rows.withColumn("c", F.sum("w").over(own.orderBy("volume").rowsBetween(Window.unboundedPreceding, 0)) / F.sum("w").over(own))
    q = lambda p: F.min(F.when(F.col("c") >= p - 1e-9, F.col("volume")))
    return rows.groupBy(*key).agg(F.round(F.sum(F.col("w") * F.col("volume")) / F.sum("w"), 6).alias("normal"), (q(0.30) * 0.93).alias("low"), (q(0.75) * 1.08).alias("high"))


@query(f"""WITH {MONTHS_SQL}, p AS (SELECT a.origin, a.dest, a.month, a.total, b.total AS before FROM months a JOIN months b ON a.origin = b.origin AND a.dest = b.dest AND a.month = b.month AND a.year = b.year + 1 WHERE a.total > 0 AND b.total > 0)
SELECT month, count(*) AS n, round(quantile_cont(abs(ln(total / before)), 0.8), 6) AS radius80, round(quantile_cont(abs(ln(total / before)), 0.95), 6) AS radius95 FROM p GROUP BY month""")
def conformal_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Radii of intervals from the log errors of the forecast "as a year ago"."""
    m = months(spark, sf_dir).where("total > 0")
    before = m.select("origin", "dest", "month", (F.col("year") + 1).alias("year"), F.col("total").alias("before"))
    res = m.join(before, ["origin", "dest", "month", "year"]).withColumn("res", F.log(F.col("total") / F.col("before")))
    r = forecast.conformal(res, "res", ["month"], [0.8, 0.95])
    return r.select("month", "n", F.round("radius80", 6).alias("radius80"), F.round("radius95", 6).alias("radius95"))


@query(f"""WITH {MONTHS_SQL}, y AS (SELECT origin, dest, year, ln(sum(total)) AS v FROM months GROUP BY ALL),
s AS (SELECT origin, dest, year AS split, avg(v) OVER (PARTITION BY origin, dest ORDER BY year ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) - avg(v) OVER (PARTITION BY origin, dest ORDER BY year ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS shift,
    count(*) OVER (PARTITION BY origin, dest ORDER BY year ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS after FROM y)
SELECT origin, dest, max_by(split, (round(abs(shift), 9), -split)) AS split, round(max_by(shift, (round(abs(shift), 9), -split)), 6) AS shift FROM s WHERE shift IS NOT NULL AND after >= 2 GROUP BY ALL""")
def change_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The year from which on the level differs most from before; two years at least follow."""
    years = months(spark, sf_dir).groupBy("origin", "dest", "year").agg(F.log(F.sum("total")).alias("v"))
    own = Window.partitionBy("origin", "dest").orderBy("year")
    rest = own.rowsBetween(0, Window.unboundedFollowing)
    rows = years.withColumns({"shift": F.avg("v").over(rest) - F.avg("v").over(own.rowsBetween(Window.unboundedPreceding, -1)), "after": F.count(F.lit(1)).over(rest)})
    order = F.struct(F.round(F.abs("shift"), 9), -F.col("year"))
    return rows.where("shift IS NOT NULL AND after >= 2").groupBy("origin", "dest").agg(F.max_by("year", order).alias("split"), F.round(F.max_by("shift", order), 6).alias("shift"))


@query(f"""WITH {MONTHS_SQL}, y AS (SELECT origin, dest, year, sum(total) AS x FROM months GROUP BY ALL), c AS (SELECT *, sum(x) OVER w AS c, row_number() OVER w AS k FROM y WINDOW w AS (PARTITION BY origin, dest ORDER BY year)),
z AS (SELECT *, -(c + lag(c) OVER (PARTITION BY origin, dest ORDER BY year)) / 2 AS z FROM c),
f AS (SELECT origin, dest, count(*) AS n, regr_slope(CASE WHEN k > 1 THEN x END, z) AS a, regr_intercept(CASE WHEN k > 1 THEN x END, z) AS b, min_by(x, year) AS first FROM z GROUP BY ALL)
SELECT origin, dest, step::INT AS step, round(a, 8) AS a, round(b, 3) AS b, round((first - b / a) * (exp(-a * (n + step - 1)) - exp(-a * (n + step - 2))), 3) AS forecast FROM (SELECT *, unnest([1, 2, 3]) AS step FROM f) WHERE a <> 0""")
def gm11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grey forecasts of annual totals."""
    years = months(spark, sf_dir).groupBy("origin", "dest", "year").agg(F.sum("total").alias("x"))
    rows = forecast.grey(years, ["origin", "dest"], "year", "x", 3)
    return rows.select("origin", "dest", "step", F.round("a", 8).alias("a"), F.round("b", 3).alias("b"), F.round("forecast", 3).alias("forecast"))


POOL_SQL = HYDRO_SQL + """, pool AS (SELECT station, ts, flow, count(*) OVER w AS n, sum(flow) OVER w AS total FROM hydro WINDOW w AS (PARTITION BY station, ts::DATE ORDER BY ts RANGE BETWEEN CURRENT ROW AND INTERVAL 21599999999 MICROSECONDS FOLLOWING))"""


def pool(spark: SparkSession, sf_dir: str, hours: int = 6) -> DataFrame:
    """Blocks of `hours` from each measurement on that end on the same day."""
    rows = hydro(spark, sf_dir).withColumns({"day": F.to_date("ts"), "t": ordered.micros("ts")})
    own = Window.partitionBy("station", "day").orderBy("t").rangeBetween(0, hours * 3_600_000_000 - 1)
    rows = rows.withColumns({"n": F.count(F.lit(1)).over(own), "total": F.sum("flow").over(own)})
    return rows.where(F.col("t") + hours * 3_600_000_000 <= (F.unix_date("day").cast("long") + 1) * 86_400_000_000)


@query(f"WITH {POOL_SQL} SELECT station, ts, n, round(total, 6) AS total FROM pool WHERE ts + INTERVAL 6 HOUR <= ts::DATE + INTERVAL 1 DAY")
def block_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pool(spark, sf_dir).select("station", "ts", "n", F.round("total", 6).alias("total"))


@query()
def block_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """200 draws of a month of blocks, one a day, with replacement; the interval of their totals."""
    return signals.block_totals(pool(spark, sf_dir).select("station", "total"), KEY, "total", 200, 31)


TRIGGER_SQL = CAL_SQL + """, j AS (SELECT station, day, coalesce(abs(ln(1 + flow) - lag(ln(1 + flow)) OVER (PARTITION BY station ORDER BY day)) / 2.0::DOUBLE, 0) AS jump, (day - min(day) OVER (PARTITION BY station)) % 7 = 0 AS planned FROM days),
t AS (SELECT *, jump >= CASE WHEN day < DATE '2024-01-16' THEN 0.8 ELSE 1.5 END AS trigger FROM j),
f AS (SELECT *, coalesce(max(trigger) OVER (PARTITION BY station ORDER BY day ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING), FALSE) AS followed FROM t)"""


@query(f"WITH {TRIGGER_SQL} SELECT station, day, round(jump, 6) AS jump, trigger, planned, followed, planned OR followed AS sampled, followed AND NOT planned AS extra FROM f")
def trigger_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A schedule every 7 days with visits on the two days after a jump; the threshold is that of the half
    month in which the jump was."""
    threshold = F.when(F.col("day") < F.lit("2024-01-16").cast("date"), 0.8).otherwise(1.5)
    rows = signals.triggered(calendar(spark, sf_dir), KEY, "day", "flow", 7, threshold, 2.0)
    return rows.withColumn("jump", F.round("jump", 6))


OPTIONS = [(i, t) for i in (3, 5, 7, 10, 14) for t in (1.0, 1.5, 2.0, 2.5)]  #: interval, threshold


def options(spark: SparkSession, sf_dir: str) -> DataFrame:
    """interval, threshold, cost, captured of each policy, replayed over all stations."""
    days = calendar(spark, sf_dir).withColumn("p", F.explode(F.array(*[F.struct(F.lit(i).alias("interval"), F.lit(t).alias("threshold")) for i, t in OPTIONS]))).select("*", "p.*")
    key = ["station", "interval", "threshold"]
    own = Window.partitionBy(*key).orderBy("day")
    jump = F.coalesce(F.abs(F.log1p("flow") - F.lag(F.log1p(F.col("flow"))).over(own)) / 2.0, F.lit(0.0))
    rows = days.withColumn("jump", jump).withColumn("trigger", F.col("jump") >= F.col("threshold"))
    rows = rows.withColumn("sampled", (F.datediff("day", F.min("day").over(Window.partitionBy(*key))) % F.col("interval") == 0) | F.coalesce(F.max("trigger").over(own.rowsBetween(-2, -1)), F.lit(False)))
    near = F.max("sampled").over(own.rowsBetween(-1, 1))
    rows = rows.withColumn("captured", (F.col("jump") >= 1.5) & near)
    return rows.groupBy("interval", "threshold").agg(F.sum(F.col("sampled").cast("long") * 5).alias("cost"), F.round(F.sum(F.col("captured").cast("double")) / F.sum((F.col("jump") >= 1.5).cast("double")), 9).alias("captured"))


OPTIONS_SQL = CAL_SQL + f""", o AS (SELECT i, t FROM (VALUES {", ".join(f"({i}, {t}::DOUBLE)" for i, t in OPTIONS)}) v(i, t)),
j AS (SELECT station, day, i, t, coalesce(abs(ln(1 + flow) - lag(ln(1 + flow)) OVER w) / 2.0::DOUBLE, 0) AS jump, (day - min(day) OVER (PARTITION BY station, i, t)) % i = 0 AS planned FROM days, o WINDOW w AS (PARTITION BY station, i, t ORDER BY day)),
s AS (SELECT *, planned OR coalesce(max(jump >= t) OVER (PARTITION BY station, i, t ORDER BY day ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING), FALSE) AS sampled FROM j),
n AS (SELECT *, max(sampled) OVER (PARTITION BY station, i, t ORDER BY day ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS near FROM s),
policies AS (SELECT i::INT AS interval, t AS threshold, (sum(sampled::INT) * 5)::BIGINT AS cost, round(sum((jump >= 1.5 AND near)::INT) / sum((jump >= 1.5)::INT), 9) AS captured FROM n GROUP BY i, t)"""


@query(f"WITH {OPTIONS_SQL} SELECT *, NOT EXISTS (SELECT 1 FROM policies o WHERE o.cost <= p.cost AND o.captured >= p.captured AND (o.cost < p.cost OR o.captured > p.captured)) AS undominated FROM policies p")
def policy_pareto(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cost and captured events of 20 policies, and which no other one beats."""
    rows = options(spark, sf_dir).withColumn("name", F.concat_ws("-", "interval", "threshold"))
    best = relations.undominated(rows, "name", ["cost"], ["captured"]).select("name", F.lit(True).alias("u"))
    return rows.join(best, "name", "left").select("interval", "threshold", "cost", "captured", F.coalesce("u", F.lit(False)).alias("undominated"))


@query(f"""WITH {OPTIONS_SQL}, w AS (SELECT unnest([0.1, 0.5, 1.0, 2.0])::DOUBLE AS weight), sc AS (SELECT weight, interval, threshold, captured - weight * cost / max(cost) OVER () AS score FROM policies, w)
SELECT weight, interval, threshold, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY weight ORDER BY round(score, 9) DESC, interval, threshold) AS k FROM sc) WHERE k = 1""")
def cost_sensitivity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best policy for each weight of the cost."""
    rows = options(spark, sf_dir).withColumn("weight", F.explode(F.array(*map(F.lit, (0.1, 0.5, 1.0, 2.0)))))
    score = F.col("captured") - F.col("weight") * F.col("cost") / F.max("cost").over(Window.partitionBy("weight"))
    best = ranks.first_of_each(rows.withColumn("score", score), ["weight"], F.round("score", 9).desc(), F.col("interval"), F.col("threshold"))
    return best.select("weight", "interval", "threshold", F.round("score", 6).alias("score"))


@query(f"""WITH {CAL_SQL}, c AS (SELECT 'complete' AS name, count(*) = count(DISTINCT (station, day)) AS passed, count(*)::DOUBLE AS value FROM days
    UNION ALL SELECT 'positive flow', bool_and(flow >= 0), min(flow) FROM days UNION ALL SELECT 'measured share', avg((n IS NOT NULL)::INT) >= 0.1, round(avg((n IS NOT NULL)::INT), 6) FROM days) SELECT * FROM c""")
def quality_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table of named checks."""
    days = calendar(spark, sf_dir)
    one = days.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("station", "day").alias("k"), F.min("flow").alias("low"), F.round(F.avg((F.col("flow") > 0).cast("double")), 6).alias("share"))
    checks = F.array(
        F.struct(F.lit("complete").alias("name"), (F.col("n") == F.col("k")).alias("passed"), F.col("n").cast("double").alias("value")),
        F.struct(F.lit("positive flow").alias("name"), (F.col("low") >= 0).alias("passed"), F.col("low").alias("value")),
        F.struct(F.lit("measured share").alias("name"), (F.col("share") >= 0.1).alias("passed"), F.col("share").alias("value")),
    )
    return one.select(F.explode(checks).alias("c")).select("c.*")
