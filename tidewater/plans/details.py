"""Small forms that the larger plans have no place for: lookups, pivots, first and commonest values, scales,
calendars, edges of buckets, and measures of series and sections."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewater.operators import compositions as comp
from tidewater.operators import panels, ranks, relations, signals, spatial
from tidewater.plans.common import Plan
from tidewater.plans.glass import CLR_SQL, ratios
from tidewater.plans.network import COMPARE_SQL, EDGES_SQL, PANEL_SQL, edge_days, ends, panel_complete
from tidewater.plans.pricing import tasks
from tidewater.plans.river import CAL_SQL, MONTHS_SQL, calendar, months
from tidewater.plans.sections import LINE_SQL, grid
from tidewater.sources.tables import ANSWERS_SQL, HYDRO_SQL, LANES_SQL, PARTS, POINTS_SQL, answers, hydro, lane_days, points, table

plan = Plan()
query = plan.query
QUERIES, ORACLES = plan.queries, plan.oracles
LANE = ["origin", "dest"]
LEVELS = {"1-URGENT": 1, "2-HIGH": 2, "3-MEDIUM": 3}


@query("SELECT CASE o_orderpriority WHEN '1-URGENT' THEN 1 WHEN '2-HIGH' THEN 2 WHEN '3-MEDIUM' THEN 3 END AS level, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1")
def mapped_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A column from a map of values; what the map lacks is null."""
    at = F.create_map(*[F.lit(x) for kv in LEVELS.items() for x in kv])
    return table(spark, sf_dir, "orders").groupBy(F.try_element_at(at, "o_orderpriority").alias("level")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("SELECT o_orderpriority AS priority, count(*) AS n FROM orders WHERE (o_custkey, o_orderstatus) IN (SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'F' ELSE 'O' END FROM customer WHERE c_mktsegment = 'BUILDING') GROUP BY 1")
def tuple_membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders whose customer and status are a pair of a list."""
    pairs = table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"), F.when(F.col("c_acctbal") < 0, "F").otherwise("O").alias("o_orderstatus"))
    return table(spark, sf_dir, "orders").join(pairs, ["o_custkey", "o_orderstatus"], "left_semi").groupBy(F.col("o_orderpriority").alias("priority")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {HYDRO_SQL}, f AS (SELECT station, count(*) AS n, min_by(sediment, ts) FILTER (sediment IS NOT NULL) AS first_valid, min_by(flow, ts) AS first FROM hydro GROUP BY station),
c AS (SELECT user_id AS station, event_type, count(*) AS k FROM events GROUP BY ALL), m AS (SELECT station, arg_max(event_type, (k, -CASE event_type WHEN 'click' THEN 1 WHEN 'error' THEN 2 WHEN 'purchase' THEN 3 WHEN 'signup' THEN 4 ELSE 5 END)) AS mode FROM c GROUP BY station)
SELECT station, n, first, first_valid, mode FROM f JOIN m USING (station)""")
def first_and_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A station's first value, its first measured one, and its commonest kind of event (the first by name on
    ties), from counts."""
    f = hydro(spark, sf_dir).groupBy("station").agg(F.count(F.lit(1)).alias("n"), F.min_by("flow", "ts").alias("first"), F.min_by("sediment", F.when(F.col("sediment").isNotNull(), F.col("ts"))).alias("first_valid"))
    c = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("station"), "event_type").agg(F.count(F.lit(1)).alias("k"))
    m = c.groupBy("station").agg(F.min(F.struct((-F.col("k")).alias("k"), "event_type")).alias("m"))
    return f.join(m.select("station", F.col("m.event_type").alias("mode")), "station").select("station", "n", "first", "first_valid", "mode")


@query(f"WITH {MONTHS_SQL} SELECT origin, dest, round(avg(total) FILTER (month = 4), 4) AS april, round(avg(total) FILTER (month = 7), 4) AS july, round(avg(total) FILTER (month = 7) - avg(total) FILTER (month = 4), 4) AS change FROM months GROUP BY ALL")
def pivoted_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means of two months as columns, and their difference."""
    p = months(spark, sf_dir).groupBy(*LANE).pivot("month", [4, 7]).agg(F.avg("total"))
    return p.select(*LANE, F.round("4", 4).alias("april"), F.round("7", 4).alias("july"), F.round(F.col("7") - F.col("4"), 4).alias("change"))


@query(f"""WITH {MONTHS_SQL}, p AS (SELECT b.total AS a, a.total AS f FROM months a JOIN months b ON a.origin = b.origin AND a.dest = b.dest AND a.month = b.month AND b.year = a.year + 1),
s AS (SELECT 'raw' AS space, a, f FROM p UNION ALL SELECT 'log', ln(1 + a), ln(1 + f) FROM p)
SELECT space, count(*) AS n, round(avg(abs(f - a)), 6) AS mae, round(sqrt(avg((f - a) ** 2)), 6) AS rmse, round(sum(abs(f - a)) / sum(a), 6) AS wape, round(1 - sum((f - a) ** 2) / (var_pop(a) * count(*)), 5) AS r2 FROM s GROUP BY space""")
def errors_in_both_spaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors of the year before as a forecast, of the values and of their logs."""
    m = months(spark, sf_dir)
    f = m.select(*LANE, (F.col("year") + 1).alias("year"), "month", F.col("total").alias("f"))
    p = m.join(f, [*LANE, "year", "month"]).select(F.col("total").alias("a"), "f")
    both = p.select(F.explode(F.array(F.struct(F.lit("raw").alias("space"), "a", "f"), F.struct(F.lit("log").alias("space"), F.log1p("a").alias("a"), F.log1p("f").alias("f")))).alias("s")).select("s.*")
    e = F.col("f") - F.col("a")
    return both.groupBy("space").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.abs(e)), 6).alias("mae"), F.round(F.sqrt(F.avg(e * e)), 6).alias("rmse"), F.round(F.sum(F.abs(e)) / F.sum("a"), 6).alias("wape"), F.round(1 - F.sum(e * e) / (F.var_pop("a") * F.count(F.lit(1))), 5).alias("r2"))


@query(f"""WITH {CLR_SQL} SELECT a.glass, a.part::INT AS i, b.part::INT AS j, CASE WHEN a.part = b.part THEN 1.0 ELSE round(coalesce(corr(a.c, b.c), 0), 5) END AS r FROM clr a JOIN clr b ON a.id = b.id GROUP BY a.glass, a.part, b.part""")
def correlation_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole matrix for each type: 1 on the diagonal, 0 where a part doesn't vary."""
    r = comp.pairs(ratios(spark, sf_dir), "c", PARTS, "glass").select("glass", "i", "j", F.round("r", 5).alias("r"))
    diagonal = r.select("glass").distinct().select("glass", F.explode(F.sequence(F.lit(1), F.lit(PARTS))).alias("i")).select("glass", "i", F.col("i").alias("j"), F.lit(1.0).alias("r"))
    return r.unionByName(r.select("glass", F.col("j").alias("i"), F.col("i").alias("j"), "r")).unionByName(diagonal)


TWO_SQL = CAL_SQL + """, tw AS (SELECT station, day, ln(1 + flow) AS a, ln(1 + 0.1 * flow * flow) AS b FROM days),
ct AS (SELECT station, day, CASE WHEN count(a) OVER p = 3 AND count(a) OVER q = 3 THEN avg(a) OVER q - avg(a) OVER p END AS ca, CASE WHEN count(b) OVER p = 3 AND count(b) OVER q = 3 THEN avg(b) OVER q - avg(b) OVER p END AS cb FROM tw
    WINDOW p AS (PARTITION BY station ORDER BY day ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), q AS (PARTITION BY station ORDER BY day ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING)),
zs AS (SELECT *, ca / coalesce(nullif(stddev_samp(ca) OVER (PARTITION BY station), 0), 1) AS za, cb / coalesce(nullif(stddev_samp(cb) OVER (PARTITION BY station), 0), 1) AS zb FROM ct)"""


@query(f"WITH {TWO_SQL} SELECT station, day, round(za, 5) AS flow_z, round(zb, 5) AS load_z, round(greatest(abs(za), abs(zb)), 5) AS score, CASE WHEN abs(za) >= abs(zb) THEN 'flow' ELSE 'load' END AS main FROM zs WHERE za IS NOT NULL AND zb IS NOT NULL")
def abrupt_of_two(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contrasts of two values; the larger one is the main one, the first on ties."""
    days = calendar(spark, sf_dir).select("station", "day", "flow", (0.1 * F.col("flow") * F.col("flow")).alias("load"))
    s = signals.abrupt(days, ["station"], "day", ["flow", "load"], 3)
    return s.select("station", "day", *[F.round(c, 5).alias(c) for c in ("flow_z", "load_z", "score")], "main")


@query("""WITH h AS (SELECT vec_id, sha256(array_to_string([CASE WHEN round(v::DOUBLE, 1) = 0 THEN '0.0' ELSE printf('%.1f', round(v::DOUBLE, 1)) END FOR v IN embedding[1:3]], ';')) AS sha FROM embeddings) SELECT sha, min(vec_id) AS first, count(*) AS copies FROM h GROUP BY sha""")
def coordinate_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One of each place, by a hash of rounded coordinates."""
    text = F.array_join(F.transform(F.slice("embedding", 1, 3), lambda v: F.when(F.round(v.cast("double"), 1) == 0, "0.0").otherwise(F.format_string("%.1f", F.round(v.cast("double"), 1)))), ";")
    h = table(spark, sf_dir, "embeddings").select("vec_id", F.sha2(text.cast("binary"), 256).alias("sha"))
    return h.groupBy("sha").agg(F.min("vec_id").alias("first"), F.count(F.lit(1)).alias("copies"))


@query(f"""WITH {POINTS_SQL} SELECT id, round(log2(1 + credit), 6) AS doublings, round(greatest(x, y) + ln(1 + exp(-abs(x - y))), 6) AS log_sum, round(1 / (1 + exp(-least(35, greatest(-35, x)))), 6) AS chance, round(ln(((id % 9) + 0.5) / (9.5 - (id % 9))), 6) AS logit FROM points""")
def log_scales(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, y = F.col("x"), F.col("y")
    share = F.pmod("id", F.lit(9)) + 0.5
    return points(spark, sf_dir).select(
        "id", F.round(F.log2(1 + F.col("credit")), 6).alias("doublings"), F.round(F.greatest(x, y) + F.log1p(F.exp(-F.abs(x - y))), 6).alias("log_sum"),
        F.round(1 / (1 + F.exp(-F.least(F.lit(35.0), F.greatest(F.lit(-35.0), x)))), 6).alias("chance"), F.round(F.log(share / (10 - share)), 6).alias("logit"),
    )


@query(f"""WITH {POINTS_SQL}, c AS (SELECT id, 113 + x / 10 AS lon, 23 + y / 10 AS lat FROM points) SELECT id, round((lon - 113.0) * (111.32 * cos(radians(23.0))), 6) AS east, round((lat - 23.0) * 110.574, 6) AS north,
    (['N', 'NE', 'E', 'SE', 'S', 'SW', 'W', 'NW'])[1 + floor((((degrees(atan2(lon - 113.0, lat - 23.0)) + 22.5) % 360 + 360) % 360) / 45)::INT] AS direction FROM c""")
def local_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kilometres from an origin in degrees, and the compass direction from it."""
    c = points(spark, sf_dir).select("id", (113 + F.col("x") / 10).alias("lon"), (23 + F.col("y") / 10).alias("lat"))
    east, north = spatial.local_km("lon", "lat", 113.0, 23.0)
    names = F.array(*map(F.lit, ("N", "NE", "E", "SE", "S", "SW", "W", "NW")))
    angle = F.pmod(F.degrees(F.atan2(F.col("lon") - 113.0, F.col("lat") - 23.0)) + 22.5, F.lit(360.0))
    return c.select("id", F.round(east, 6).alias("east"), F.round(north, 6).alias("north"), names[F.floor(angle / 45).cast("int")].alias("direction"))


@query("""WITH d AS (SELECT DISTINCT o_orderdate::DATE AS day FROM orders), a AS (SELECT day, 2 * pi() * dayofyear(day) / 365.25 AS t FROM d)
SELECT day, """ + ", ".join(f"round(sin({k} * t), 6) AS sin{k}, round(cos({k} * t), 6) AS cos{k}" for k in (1, 2, 3)) + """, date_trunc('month', day)::DATE AS month_begin, last_day(day) AS month_end, (day - INTERVAL 1 YEAR)::DATE AS year_before, day::TIMESTAMP + INTERVAL 6 HOUR AS six_hours_on FROM a""")
def seasonal_basis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three harmonics of the year, and a day's offsets: month's begin and end, a year before, hours on."""
    d = table(spark, sf_dir, "orders").select(F.col("o_orderdate").cast("date").alias("day")).distinct()
    t = 2 * F.pi() * F.dayofyear("day") / F.lit(365.25)
    waves = [F.round(f(k * t), 6).alias(f"{n}{k}") for k in (1, 2, 3) for n, f in (("sin", F.sin), ("cos", F.cos))]
    return d.select("day", *waves, F.trunc("day", "MM").alias("month_begin"), F.last_day("day").alias("month_end"), F.add_months("day", -12).alias("year_before"), (F.col("day").cast("timestamp_ntz") + F.expr("INTERVAL 6 HOURS")).alias("six_hours_on"))


@query(f"""WITH {POINTS_SQL}, b AS (SELECT min(credit) AS a, max(credit) AS z, quantile_cont(credit, 0.25) AS q1, quantile_cont(credit, 0.5) AS q2, quantile_cont(credit, 0.75) AS q3 FROM points),
c AS (SELECT least(3, floor((credit - a) / (z - a) * 4)::INT) AS width_bucket, (credit >= q1)::INT + (credit >= q2)::INT + (credit >= q3)::INT AS quartile FROM points, b) SELECT width_bucket, quartile, count(*) AS n FROM c GROUP BY ALL""")
def bucket_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Buckets of equal width and of equal numbers, closed on the left."""
    p = points(spark, sf_dir).select("credit")
    b = p.agg(F.min("credit").alias("a"), F.max("credit").alias("z")).join(F.broadcast(ranks.quantiles(p, [], "credit", {"q1": 0.25, "q2": 0.5, "q3": 0.75})))  # one row
    wide = F.least(F.lit(3), F.floor((F.col("credit") - F.col("a")) / (F.col("z") - F.col("a")) * 4).cast("int"))
    equal = reduce(Column.__add__, [(F.col("credit") >= F.col(q)).cast("int") for q in ("q1", "q2", "q3")])
    return p.join(F.broadcast(b)).groupBy(wide.alias("width_bucket"), equal.alias("quartile")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {CAL_SQL}, a AS (SELECT station, day FROM days WHERE flow >= 60), b AS (SELECT station, day FROM days WHERE n >= 4), d AS (SELECT 'flow' AS of, station, day, EXISTS (SELECT 1 FROM b WHERE b.station = a.station AND abs(b.day - a.day) <= 2) AS near FROM a
    UNION ALL SELECT 'count', station, day, EXISTS (SELECT 1 FROM a WHERE a.station = b.station AND abs(a.day - b.day) <= 2) FROM b) SELECT of AS events, count(*) AS n, count(*) FILTER (near) AS matched, round(avg(near::INT), 6) AS share FROM d GROUP BY 1""")
def overlap_both_ways(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many events of each of two kinds have one of the other within two days."""
    many = hydro(spark, sf_dir).groupBy("station", F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("n")).where("n >= 4")
    kinds = {"flow": calendar(spark, sf_dir).where("flow >= 60").select("station", "day"), "count": many.select("station", "day")}
    out = []
    for name, other in (("flow", "count"), ("count", "flow")):
        near = relations.within(kinds[name], kinds[other].withColumnRenamed("day", "other"), ["station"], "day", "other", 2, "left")
        each = near.groupBy("l.station", "l.day").agg(F.count("r.other").alias("k"))
        out.append(each.agg(F.lit(name).alias("events"), F.count(F.lit(1)).alias("n"), F.count_if(F.col("k") > 0).alias("matched"), F.round(F.avg((F.col("k") > 0).cast("double")), 6).alias("share")))
    return out[0].unionByName(out[1])


@query(f"""WITH {EDGES_SQL}, b AS (SELECT origin AS site, day, volume FROM edges UNION ALL SELECT dest, day, volume FROM edges), y AS (SELECT site, year(day)::INT AS year, sum(volume) AS total FROM b GROUP BY ALL),
p AS (SELECT site, year, total, coalesce(lag(total) OVER (PARTITION BY site ORDER BY year), 0) AS before FROM y) SELECT site, year, before, total, round(total / (before + 1e-9), 6) AS ratio FROM p WHERE before >= 100 AND total / (before + 1e-9) < 0.9""")
def site_shutdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sites that fell below a share of the year before (here 0.9)."""
    y = ends(edge_days(spark, sf_dir)).groupBy("site", F.year("day").alias("year")).agg(F.sum("volume").alias("total"))
    return panels.shutdowns(y, ["site"], "year", "total", least=100.0, below=0.9)


@query(f"""WITH {PANEL_SQL}, w AS (SELECT *, lag(volume, 1) OVER o AS l1, lag(volume, 7) OVER o AS l7, avg(volume) OVER (o ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING) AS m7, stddev_samp(volume) OVER (o ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING) AS s7, row_number() OVER o AS k FROM panel WINDOW o AS (PARTITION BY origin, dest ORDER BY day)),
st AS (SELECT origin, dest, avg(volume) AS mean, max(volume) AS top FROM panel GROUP BY ALL)
SELECT origin, dest, day, volume, coalesce(l1, 0) AS l1, coalesce(l7, 0) AS l7, round(coalesce(m7, 0), 6) AS m7, round(coalesce(s7, 0), 5) AS s7, isodow(day)::INT - 1 AS weekday, month(day)::INT AS month, round(mean, 6) AS mean, top FROM w JOIN st USING (origin, dest) WHERE k > 28""")
def feature_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lags, rolling means and spreads, calendar and a lane's own figures in one frame, without the first 28
    days."""
    p = panel_complete(spark, sf_dir)
    own = Window.partitionBy(*LANE).orderBy("day")
    week = own.rowsBetween(-7, -1)
    w = p.withColumns({"l1": F.lag("volume", 1).over(own), "l7": F.lag("volume", 7).over(own), "m7": F.avg("volume").over(week), "s7": F.stddev_samp("volume").over(week), "k": F.row_number().over(own)}).where("k > 28")
    st = p.groupBy(*LANE).agg(F.avg("volume").alias("mean"), F.max("volume").alias("top"))
    zero = lambda c, n=None: F.coalesce(c, F.lit(0.0)) if n is None else F.round(F.coalesce(c, F.lit(0.0)), n)
    return w.join(st, LANE).select(*LANE, "day", "volume", zero("l1").alias("l1"), zero("l7").alias("l7"), zero("m7", 6).alias("m7"), zero("s7", 5).alias("s7"), F.weekday("day").alias("weekday"), F.month("day").alias("month"), F.round("mean", 6).alias("mean"), "top")


@query(f"""WITH {COMPARE_SQL}, b AS (SELECT origin AS site, volume, forecast FROM paired UNION ALL SELECT dest, volume, forecast FROM paired) SELECT site, count(*) AS n, round(sum(volume), 4) AS volume, round(sum(forecast), 4) AS forecast, round(sum(forecast) / nullif(sum(volume), 0) - 1, 6) AS change, round(sum(abs(forecast - volume)) / nullif(sum(volume), 0), 6) AS wape FROM b GROUP BY site""")
def compare_by_site(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forecast and volume by site: each lane counts for both of its ends."""
    p = panel_complete(spark, sf_dir)
    old = p.select(*LANE, F.date_add("day", 364).alias("day"), F.col("volume").alias("forecast"))
    rows = p.where("day >= DATE '2001-01-01'").join(old, [*LANE, "day"])
    b = rows.select(F.explode(F.array(*LANE)).alias("site"), "volume", "forecast")
    v, f = F.sum("volume"), F.sum("forecast")
    return b.groupBy("site").agg(F.count(F.lit(1)).alias("n"), F.round(v, 4).alias("volume"), F.round(f, 4).alias("forecast"), F.round(f / F.nullif(v, F.lit(0.0)) - 1, 6).alias("change"), F.round(F.sum(F.abs(F.col("forecast") - F.col("volume"))) / F.nullif(v, F.lit(0.0)), 6).alias("wape"))


@query(f"""WITH {MONTHS_SQL}, y AS (SELECT origin, dest, year, sum(total) AS v FROM months GROUP BY ALL), s AS (SELECT origin, dest, greatest(-0.08::DOUBLE, least(0.08::DOUBLE, regr_slope(ln(v), year))) AS b FROM y GROUP BY ALL),
c AS (SELECT origin, dest, month, sum(exp(-0.55::DOUBLE * (2000 - year)) * ln(total)) / sum(exp(-0.55::DOUBLE * (2000 - year))) AS f FROM months WHERE total > 0 GROUP BY ALL) SELECT origin, dest, month, round(b, 6) AS slope, round(exp(f + b), 4) AS forecast FROM c JOIN s USING (origin, dest)""")
def regime_with_slope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The recency-weighted log mean of a month, carried on by the lane's clipped yearly slope."""
    m = months(spark, sf_dir)
    s = m.groupBy(*LANE, "year").agg(F.sum("total").alias("v")).groupBy(*LANE).agg(F.greatest(F.lit(-0.08), F.least(F.lit(0.08), F.regr_slope(F.log("v"), F.col("year")))).alias("b"))
    w = F.exp(-0.55 * (2000 - F.col("year")))
    c = m.where("total > 0").groupBy(*LANE, "month").agg((F.sum(w * F.log("total")) / F.sum(w)).alias("f"))
    return c.join(s, LANE).select(*LANE, "month", F.round("b", 6).alias("slope"), F.round(F.exp(F.col("f") + F.col("b")), 4).alias("forecast"))


@query(f"""WITH {ANSWERS_SQL}, z AS (SELECT y::DOUBLE AS y, (size - avg(size) OVER ()) / stddev_pop(size) OVER () AS a FROM answers), f AS (SELECT regr_slope(ln(1 + y), a) AS b, regr_intercept(ln(1 + y), a) AS c FROM z),
r AS (SELECT any_value(b) AS b, any_value(c) AS c, avg(exp(ln(1 + y) - (c + b * a))) AS smear, count(*) AS n FROM z, f) SELECT n, round(b, 6) AS slope, round(c, 6) AS constant, round(smear, 6) AS smearing, round(exp(c) * smear - 1, 6) AS at_mean FROM r""")
def standardised_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Least squares of a log on a standardised feature, and Duan's factor that brings predictions back."""
    rows = answers(spark, sf_dir).select(F.log1p(F.col("y").cast("double")).alias("l"), "size")
    m = rows.agg(F.avg("size").alias("m"), F.stddev_pop("size").alias("s"))  # one row
    z = rows.join(F.broadcast(m)).select("l", ((F.col("size") - F.col("m")) / F.col("s")).alias("a"))
    f = z.agg(F.regr_slope("l", "a").alias("b"), F.regr_intercept("l", "a").alias("c"))  # one row
    r = z.join(F.broadcast(f)).groupBy("b", "c").agg(F.avg(F.exp(F.col("l") - (F.col("c") + F.col("b") * F.col("a")))).alias("smear"), F.count(F.lit(1)).alias("n"))
    return r.select("n", F.round("b", 6).alias("slope"), F.round("c", 6).alias("constant"), F.round("smear", 6).alias("smearing"), F.round(F.exp("c") * F.col("smear") - 1, 6).alias("at_mean"))


@query(f"""WITH {CLR_SQL}, m AS (SELECT part, avg(c) AS m, stddev_pop(c) AS s FROM clr GROUP BY part), zz AS (SELECT id, glass, part, (c - m) / s AS z FROM clr JOIN m USING (part)), ce AS (SELECT glass AS k, part, avg(z) AS z FROM zz GROUP BY ALL),
d AS (SELECT x.id, x.glass, c.k, sum((x.z - c.z) ** 2) AS d FROM zz x JOIN ce c USING (part) GROUP BY ALL) SELECT id, glass, min_by(k, (round(d, 9), k)) AS predicted, round(max(d) - min(d), 5) AS margin FROM d GROUP BY id, glass""")
def standardised_centroid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nearest centres of parts standardised by the reference's mean and spread."""
    rows = ratios(spark, sf_dir).select("id", "glass", "c")
    m = comp.long(rows, "c").groupBy("part").agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("s"))
    one = m.agg(F.transform(F.array_sort(F.collect_list(F.struct("part", "m", "s"))), lambda x: F.struct(x["m"].alias("m"), x["s"].alias("s"))).alias("ms"))  # 14 pairs of numbers
    z = rows.join(F.broadcast(one)).select("id", "glass", F.zip_with("c", "ms", lambda v, x: (v - x["m"]) / x["s"]).alias("z"))
    c = comp.long(z, "z", "glass").groupBy("glass", "part").agg(F.avg("v").alias("v")).groupBy(F.col("glass").alias("k")).agg(F.transform(F.array_sort(F.collect_list(F.struct("part", "v"))), lambda x: x["v"]).alias("y"))
    c = F.broadcast(c.agg(F.collect_list(F.struct("k", "y")).alias("ks")))  # two centres
    d = z.join(c).select("id", "glass", "z", F.explode("ks").alias("k")).select("id", "glass", F.col("k.k").alias("k"), comp.squared("z", F.col("k.y")).alias("d"))
    return d.groupBy("id", "glass").agg(F.min_by("k", F.struct(F.round("d", 9).alias("d"), "k")).alias("predicted"), F.round(F.max("d") - F.min("d"), 5).alias("margin"))


@query(f"""WITH {CAL_SQL}, s AS (SELECT station, day, day - lag(day) OVER (PARTITION BY station ORDER BY day) AS step FROM days) SELECT station, count(*) AS days, count(*) = max(day) - min(day) + 1 AS complete, count(*) = count(DISTINCT day) AS is_unique, coalesce(bool_and(step = 1), TRUE) AS steady FROM s GROUP BY station""")
def calendar_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a station's calendar is complete, without repeats, and goes on by a day at a time."""
    s = calendar(spark, sf_dir).select("station", "day", F.datediff("day", F.lag("day").over(Window.partitionBy("station").orderBy("day"))).alias("step"))
    n = F.count(F.lit(1))
    return s.groupBy("station").agg(n.alias("days"), (n == F.datediff(F.max("day"), F.min("day")) + 1).alias("complete"), (n == F.count_distinct("day")).alias("is_unique"), F.coalesce(F.bool_and(F.col("step") == 1), F.lit(True)).alias("steady"))


@query(f"""WITH {EDGES_SQL}, b AS (SELECT origin AS site, day, volume FROM edges UNION ALL SELECT dest, day, volume FROM edges), l AS (SELECT site, day, sum(volume) AS load FROM b GROUP BY ALL), c AS (SELECT site, max(load) AS capacity FROM l WHERE day < DATE '2001-01-01' GROUP BY site)
SELECT site, count(*) AS days, round(max(load / capacity), 6) AS worst FROM l JOIN c USING (site) WHERE day >= DATE '2001-01-01' AND load > capacity GROUP BY site""")
def site_overloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sites with more on a planned day than on any day before."""
    l = ends(edge_days(spark, sf_dir)).groupBy("site", "day").agg(F.sum("volume").alias("load"))
    split = F.lit("2001-01-01").cast("date")
    c = l.where(F.col("day") < split).groupBy("site").agg(F.max("load").alias("capacity"))
    return l.where(F.col("day") >= split).join(c, "site").where("load > capacity").groupBy("site").agg(F.count(F.lit(1)).alias("days"), F.round(F.max(F.col("load") / F.col("capacity")), 6).alias("worst"))


@query("""SELECT page_id, coalesce(length(trim(regexp_replace(regexp_extract(html, '(?s)<head[^>]*>(.*?)</head>', 1), '<[^>]*>', '', 'g'))) > 0, FALSE) AS head_filled, coalesce(length(trim(regexp_replace(regexp_extract(html, '(?s)<body[^>]*>(.*?)</body>', 1), '<[^>]*>', '', 'g'))) > 0, FALSE) AS body_filled FROM pages""")
def filled_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a page's sections have some text besides tags."""
    text = lambda tag: F.trim(F.regexp_replace(F.regexp_extract("html", f"(?s)<{tag}[^>]*>(.*?)</{tag}>", 1), "<[^>]*>", ""))
    filled = lambda tag: F.coalesce(F.char_length(text(tag)) > 0, F.lit(False))
    return table(spark, sf_dir, "pages").select("page_id", filled("head").alias("head_filled"), filled("body").alias("body_filled"))


@query(f"""WITH {LINE_SQL}, b AS (SELECT survey, min(z) AS lo, max(z) AS hi FROM profiles GROUP BY survey), g AS (SELECT survey, k, z, lag(z) OVER w AS p, lead(z) OVER w AS n FROM grid WINDOW w AS (PARTITION BY survey ORDER BY k))
SELECT survey, count(*) AS points, round(min(z), 5) AS thalweg, round(coalesce(sum((n - 2 * z + p) ** 2), 0), 4) AS roughness, round(greatest(0, max(z) - any_value(hi)) + greatest(0, any_value(lo) - min(z)), 5) AS overshoot FROM g JOIN b USING (survey) GROUP BY survey""")
def section_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fitted section's lowest point, its squared second differences, and how far it leaves the range of what
    was measured."""
    from tidewater.sources.tables import profiles

    g = grid(spark, sf_dir).select("survey", "k", F.col("linear").alias("z"))
    w = Window.partitionBy("survey").orderBy("k")
    g = g.withColumn("c", F.lead("z").over(w) - 2 * F.col("z") + F.lag("z").over(w))
    b = profiles(spark, sf_dir).groupBy("survey").agg(F.min("z").alias("lo"), F.max("z").alias("hi"))
    out = g.groupBy("survey").agg(F.count(F.lit(1)).alias("points"), F.min("z").alias("low"), F.max("z").alias("high"), F.coalesce(F.sum(F.col("c") * F.col("c")), F.lit(0.0)).alias("rough")).join(b, "survey")
    over = F.greatest(F.lit(0.0), F.col("high") - F.col("hi")) + F.greatest(F.lit(0.0), F.col("lo") - F.col("low"))
    return out.select("survey", "points", F.round("low", 5).alias("thalweg"), F.round("rough", 4).alias("roughness"), F.round(over, 5).alias("overshoot"))


@query(f"""WITH {LANES_SQL} SELECT origin, year(day)::INT AS year, round(coalesce(sum(volume) FILTER (month(day) IN (6, 7)), 0) / sum(volume), 6) AS inside, round(coalesce(sum(volume) FILTER (month(day) NOT IN (6, 7)), 0) / sum(volume), 6) AS outside FROM lanes GROUP BY ALL""")
def season_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """June's and July's share of a year, and the rest's."""
    in_season = F.month("day").isin(6, 7)
    part = lambda c: F.round(F.sum(F.when(c, F.col("volume")).otherwise(0.0)) / F.sum("volume"), 6)
    return lane_days(spark, sf_dir).groupBy("origin", F.year("day").alias("year")).agg(part(in_season).alias("inside"), part(~in_season).alias("outside"))


@query(f"""WITH {POINTS_SQL}, t AS (SELECT * FROM points WHERE kind = 'task'), b AS (SELECT a.id AS i, b.id AS j, a.price + b.price AS price FROM t a JOIN t b ON a.id < b.id AND sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) <= 0.1),
f AS (SELECT i, min_by(j, (price, j)) AS j, min(price) AS price FROM b GROUP BY i), o AS (SELECT 'b' || i AS option, i::VARCHAR || ';' || j AS members, price, 2 AS n FROM f UNION ALL SELECT 's' || id, id::VARCHAR, price, 1 FROM t)
SELECT option, unnest(string_split(members, ';'))::BIGINT AS task, round(price / n, 6) AS share FROM o""")
def task_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Single tasks and each task's cheapest bundle of two as options, and the tasks of every option with their
    part of its price."""
    t = tasks(spark, sf_dir).select("id", "x", "y", "price")
    pairs = spatial.radius_pairs(t, t, 0.1).where("l.id < r.id")
    best = pairs.groupBy(F.col("l.id").alias("i")).agg(F.min(F.struct((F.col("l.price") + F.col("r.price")).alias("price"), F.col("r.id").alias("j"))).alias("b"))
    two = best.select(F.concat(F.lit("b"), F.col("i").cast("string")).alias("option"), F.concat_ws(";", F.col("i").cast("string"), F.col("b.j").cast("string")).alias("members"), F.col("b.price").alias("price"))
    one = t.select(F.concat(F.lit("s"), F.col("id").cast("string")).alias("option"), F.col("id").cast("string").alias("members"), "price")
    o = two.unionByName(one).withColumn("m", F.split("members", ";"))
    rows = o.select("option", F.explode("m").alias("task"), F.round(F.col("price") / F.size("m"), 6).alias("share"))
    return rows.withColumn("task", F.col("task").cast("long"))


