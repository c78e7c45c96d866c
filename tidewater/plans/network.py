"""Network flows: importance, capacity, shutdowns, corrections, comparison and rerouting."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewater.operators import forecast, panels, ranks, relations, rerouting
from tidewater.plans.common import Plan, pct
from tidewater.sources.tables import FLOWS_SQL, LANES_SQL, flows, lane_days

SPLIT = "2001-01-01"  #: history ends here, what follows stands for the forecast
EPS = 1e-9
plan = Plan()
query = plan.query
QUERIES, ORACLES = plan.queries, plan.oracles


def edge_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At most 625 rows a day: everything below works on these sums."""
    return flows(spark, sf_dir).groupBy("origin", "dest", "day").agg(F.sum("volume").alias("volume"))


EDGES_SQL = FLOWS_SQL + ", edges AS (SELECT origin, dest, day, sum(volume) AS volume FROM flows GROUP BY ALL)"
ENDS_SQL = EDGES_SQL + """, ends AS (
    SELECT origin AS site, origin, dest, day, volume FROM edges UNION ALL SELECT dest, origin, dest, day, volume FROM edges),
loads AS (SELECT site, day, sum(volume) AS load FROM ends GROUP BY ALL)"""


def ends(edges: DataFrame) -> DataFrame:
    """Each edge's row for both of its ends."""
    return edges.select(F.explode(F.array("origin", "dest")).alias("site"), "*")


def node_scores(edges: DataFrame) -> DataFrame:
    both = ends(edges)
    past = F.col("day") < F.lit(SPLIT).cast("date")
    loads = both.groupBy("site", "day").agg(F.sum("volume").alias("load"))
    by_load = loads.groupBy("site").agg(
        F.sum(F.when(past, F.col("load")).otherwise(0.0)).alias("history"),
        F.sum(F.when(~past, F.col("load")).otherwise(0.0)).alias("planned"),
        (F.stddev_pop(F.when(past, F.col("load"))) / (F.avg(F.when(past, F.col("load"))) + EPS)).alias("cv"),
        F.coalesce(F.max(F.when(~past, F.col("load"))), F.lit(0.0)).alias("peak"),
    )
    degree = both.groupBy("site").agg(F.count_distinct("origin", "dest").alias("degree"))
    rows = by_load.join(degree, "site").withColumn("volume", 0.75 * F.col("planned") + 0.25 * F.col("history"))
    rank = lambda c: ranks.percent_rank_average(F.round(c, 9))
    score = 0.35 * rank("volume") + 0.25 * rank("degree") + 0.15 * rank("cv") + 0.25 * rank("peak")
    return rows.withColumn("score", score)


NODE_SQL = ENDS_SQL + f""", stats AS (
    SELECT site, sum(CASE WHEN day < DATE '{SPLIT}' THEN load ELSE 0 END) AS history, sum(CASE WHEN day >= DATE '{SPLIT}' THEN load ELSE 0 END) AS planned,
        stddev_pop(load) FILTER (day < DATE '{SPLIT}') / (avg(load) FILTER (day < DATE '{SPLIT}') + 1e-9) AS cv,
        coalesce(max(load) FILTER (day >= DATE '{SPLIT}'), 0) AS peak FROM loads GROUP BY site),
degrees AS (SELECT site, count(DISTINCT (origin, dest)) AS degree FROM ends GROUP BY site),
sized AS (SELECT *, 0.75::DOUBLE * planned + 0.25::DOUBLE * history AS volume FROM stats JOIN degrees USING (site)),
rounded AS (SELECT *, round(volume, 9) AS v, round(cv, 9) AS c, round(peak, 9) AS k FROM sized),
nodes AS (SELECT *, 0.35::DOUBLE * {pct("v")} + 0.25::DOUBLE * {pct("degree")} + 0.15::DOUBLE * {pct("c")} + 0.25::DOUBLE * {pct("k")} AS score FROM rounded)"""


@query(f"WITH {NODE_SQL} SELECT site, round(volume, 4) AS volume, degree, round(cv, 6) AS cv, peak, round(score, 6) AS score, score >= 0.8 AS high_load FROM nodes")
def site_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weighted average percent ranks of volume, degree, variation and peak load."""
    rows = node_scores(edge_days(spark, sf_dir))
    return rows.select("site", F.round("volume", 4).alias("volume"), "degree", F.round("cv", 6).alias("cv"), "peak", F.round("score", 6).alias("score"), (F.col("score") >= 0.8).alias("high_load"))


EDGE_SQL = NODE_SQL + f""", caps AS (
    SELECT origin, dest, sum(volume) AS volume, avg(volume) AS mean, max(volume) AS capacity, stddev_pop(volume) / (avg(volume) + 1e-9) AS cv FROM edges GROUP BY ALL),
alternatives AS (
    SELECT c.*, (sum(capacity) OVER (PARTITION BY dest) - capacity) / (mean + 1e-9) AS alternative, o.score + d.score AS ends_score
    FROM caps c JOIN nodes o ON o.site = origin JOIN nodes d ON d.site = dest),
r AS (SELECT *, round(volume, 9) AS v, round(ends_score, 9) AS e, round(cv, 9) AS c, -round(alternative, 9) AS a FROM alternatives),
ranked AS (SELECT *, 0.35::DOUBLE * {pct("v")} + 0.25::DOUBLE * {pct("e")} + 0.15::DOUBLE * {pct("c")} + 0.25::DOUBLE * {pct("a")} AS score FROM r)"""


def edge_scores(edges: DataFrame) -> DataFrame:
    # a row for each pair of sites: the table of sites is small as sites are a fixed list
    sites = node_scores(edges).select("site", "score")
    caps = edges.groupBy("origin", "dest").agg(F.sum("volume").alias("volume"), F.avg("volume").alias("mean"), F.max("volume").alias("capacity"), (F.stddev_pop("volume") / (F.avg("volume") + EPS)).alias("cv"))
    rows = caps.join(sites.select(F.col("site").alias("origin"), F.col("score").alias("o")), "origin").join(sites.select(F.col("site").alias("dest"), F.col("score").alias("d")), "dest")
    other = (F.sum("capacity").over(Window.partitionBy("dest")) - F.col("capacity")) / (F.col("mean") + EPS)
    rows = rows.withColumns({"alternative": other, "ends_score": F.col("o") + F.col("d")})
    rank = lambda c: ranks.percent_rank_average(c)
    score = 0.35 * rank(F.round("volume", 9)) + 0.25 * rank(F.round("ends_score", 9)) + 0.15 * rank(F.round("cv", 9)) + 0.25 * rank(-F.round("alternative", 9))
    return rows.withColumn("score", score)


@query(f"WITH {EDGE_SQL} SELECT origin, dest, volume, capacity, round(alternative, 4) AS alternative, round(score, 6) AS score FROM ranked")
def edge_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = edge_scores(edge_days(spark, sf_dir))
    return rows.select("origin", "dest", "volume", "capacity", F.round("alternative", 4).alias("alternative"), F.round("score", 6).alias("score"))


@query(f"""WITH {ENDS_SQL}
SELECT 'edge' AS kind, origin || '->' || dest AS name, max(volume) AS capacity, avg(volume) AS mean_load, count(*) AS days FROM edges GROUP BY origin, dest
UNION ALL SELECT 'site', site, max(load), avg(load), count(*) FROM loads GROUP BY site""")
def edge_site_capacity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Capacity is the largest load of a day, of edges and of sites (in and out together)."""
    edges = edge_days(spark, sf_dir)
    stats = [F.max("v").alias("capacity"), F.avg("v").alias("mean_load"), F.count(F.lit(1)).alias("days")]
    by_edge = edges.select(F.concat_ws("->", "origin", "dest").alias("name"), F.col("volume").alias("v")).groupBy("name").agg(*stats)
    by_site = ends(edges).groupBy(F.col("site").alias("name"), "day").agg(F.sum("volume").alias("v")).groupBy("name").agg(*stats)
    return by_edge.select(F.lit("edge").alias("kind"), "*").unionByName(by_site.select(F.lit("site").alias("kind"), "*"))


@query(f"""WITH {EDGES_SQL},
caps AS (SELECT origin, dest, max(volume) AS capacity FROM edges WHERE day < DATE '{SPLIT}' GROUP BY ALL)
SELECT origin, dest, day, volume, coalesce(capacity, 0) AS capacity, volume - coalesce(capacity, 0) AS excess
FROM edges LEFT JOIN caps USING (origin, dest) WHERE day >= DATE '{SPLIT}' AND volume > coalesce(capacity, 0)""")
def capacity_anomalies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days on which an edge is to carry more than it ever did."""
    edges = edge_days(spark, sf_dir)
    past = F.col("day") < F.lit(SPLIT).cast("date")
    caps = edges.where(past).groupBy("origin", "dest").agg(F.max("volume").alias("capacity"))
    rows = edges.where(~past).join(caps, ["origin", "dest"], "left").fillna(0, ["capacity"])
    return rows.where("volume > capacity").withColumn("excess", F.col("volume") - F.col("capacity"))


PANEL_SQL = LANES_SQL + """, bounds AS (SELECT min(day) AS a, max(day) AS b FROM lanes),
grid AS (SELECT origin, dest, CAST(unnest(generate_series(a::TIMESTAMP, b::TIMESTAMP, INTERVAL 1 DAY)) AS DATE) AS day FROM (SELECT DISTINCT origin, dest FROM lanes), bounds),
panel AS (SELECT origin, dest, day, coalesce(volume, 0) AS volume FROM grid LEFT JOIN lanes USING (origin, dest, day))"""


@query(f"WITH {PANEL_SQL} SELECT * FROM panel")
def panel_complete(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panels.complete(lane_days(spark, sf_dir), ["origin", "dest"], "day", "volume")


FEATURES = [1, 2, 3, 7, 14, 28, 365]
WIDTHS = [7, 14, 28, 56]


@query("WITH " + PANEL_SQL + " SELECT origin, dest, day, volume, " + ", ".join(f"lag(volume, {k}) OVER w AS volume_lag{k}" for k in FEATURES) + ", " + ", ".join(f"round(avg(volume) OVER w{k}, 6) AS volume_mean{k}, max(volume) OVER w{k} AS volume_max{k}, round(coalesce(avg((volume > 0)::INT) OVER w{k}, 0), 6) AS volume_pos{k}" for k in WIDTHS) + " FROM panel WINDOW w AS (PARTITION BY origin, dest ORDER BY day), " + ", ".join(f"w{k} AS (PARTITION BY origin, dest ORDER BY day ROWS BETWEEN {k} PRECEDING AND 1 PRECEDING)" for k in WIDTHS))
def lag_roll_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    panel = panel_complete(spark, sf_dir)
    rows = ranks.lagged(panel, "volume", ["origin", "dest"], "day", FEATURES)
    rows = ranks.rolled(rows, "volume", ["origin", "dest"], "day", WIDTHS)
    return rows.withColumns({c: F.round(c, 6) for w in WIDTHS for c in (f"volume_mean{w}", f"volume_pos{w}")})


HOLIDAYS = ["1999-02-16", "2000-02-05", "2001-01-24"]  #: the days that corrections are aligned to


@query(f"""WITH {PANEL_SQL}, days AS (SELECT DISTINCT day FROM panel),
near AS (SELECT day, min_by(day - h, (abs(day - h), h)) AS delta FROM days, (SELECT unnest([{", ".join(f"DATE '{h}'" for h in HOLIDAYS)}]) AS h) GROUP BY day)
SELECT day, year(day)::INT AS year, month(day)::INT AS month, day(day)::INT AS day_of_month, (isodow(day) - 1)::INT AS weekday, weekofyear(day)::INT AS week, dayofyear(day)::INT AS day_of_year,
    day = date_trunc('month', day)::DATE AS month_start, day = last_day(day) AS month_end, delta::INT AS holiday_delta, abs(delta) <= 7 AS near_holiday,
    round(sin(2 * pi() * dayofyear(day) / 365.25::DOUBLE), 6) AS season_sin, round(cos(2 * pi() * dayofyear(day) / 365.25::DOUBLE), 6) AS season_cos
FROM near""")
def calendar_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panels.calendar(panel_complete(spark, sf_dir).select("day").distinct(), "day", HOLIDAYS)


@query(f"""WITH {LANES_SQL}, years AS (SELECT origin, dest, year(day)::INT AS year, sum(volume) AS total FROM lanes GROUP BY ALL),
paired AS (SELECT origin, dest, year, total, coalesce(lag(total) OVER (PARTITION BY origin, dest ORDER BY year), 0) AS before FROM years)
SELECT origin, dest, year, before, total, round(total / (before + 1e-9), 6) AS ratio FROM paired WHERE before >= 50 AND total / (before + 1e-9) < 0.95""")
def long_shutdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges that fell below a share of the year before (here 0.95, as nothing in these tables shuts down)."""
    years = lane_days(spark, sf_dir).groupBy("origin", "dest", F.year("day").alias("year")).agg(F.sum("volume").alias("total"))
    return panels.shutdowns(years, ["origin", "dest"], "year", "total", least=50.0, below=0.95)


@query(f"""WITH {PANEL_SQL}, m AS (SELECT origin, dest, date_trunc('month', day)::DATE AS month, sum(volume) AS total FROM panel GROUP BY ALL),
n AS (SELECT *, lag(total, 2) OVER w AS a, lag(total) OVER w AS b, lead(total) OVER w AS c, lead(total, 2) OVER w AS d FROM m WINDOW w AS (PARTITION BY origin, dest ORDER BY month)),
o AS (SELECT *, (a + b + c + d - greatest(a, b, c, d) - least(a, b, c, d)) / 2 AS base FROM n WHERE a IS NOT NULL AND d IS NOT NULL)
SELECT origin, dest, month, total, base FROM o WHERE base >= 50 AND total <= 0.85 * base AND b >= 0.35 * base AND c >= 0.35 * base""")
def short_month_drop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Months far below the median of the two before and the two after (here below 0.85 of it). A month
    without any row counts as 0."""
    months = panel_complete(spark, sf_dir).groupBy("origin", "dest", F.trunc("day", "MM").alias("month")).agg(F.sum("volume").alias("total"))
    return panels.dips(months, ["origin", "dest"], "month", "total", least=50.0, below=0.85, sides=0.35)


@query(f"""WITH {PANEL_SQL}, target AS (SELECT origin, dest, day, volume FROM panel WHERE day BETWEEN DATE '2000-06-01' AND DATE '2000-06-30'),
lv AS (SELECT origin, dest, median(t) AS level FROM (SELECT origin, dest, date_trunc('month', day) AS m, sum(volume) AS t FROM panel WHERE date_trunc('month', day)::DATE IN (DATE '2000-04-01', DATE '2000-05-01', DATE '2000-07-01', DATE '2000-08-01') GROUP BY ALL) GROUP BY ALL),
shaped AS (SELECT t.origin, t.dest, t.day, t.volume, level, coalesce((p.volume + q.volume) / 2, p.volume, q.volume, 0) AS shape FROM target t JOIN lv USING (origin, dest)
    LEFT JOIN panel p ON p.origin = t.origin AND p.dest = t.dest AND p.day = (t.day - INTERVAL 1 MONTH)::DATE
    LEFT JOIN panel q ON q.origin = t.origin AND q.dest = t.dest AND q.day = (t.day + INTERVAL 1 MONTH)::DATE)
SELECT origin, dest, day, volume, round(CASE WHEN sum(shape) OVER w > 0 THEN shape * level / sum(shape) OVER w ELSE level / count(*) OVER w END, 6) AS corrected
FROM shaped WINDOW w AS (PARTITION BY origin, dest)""")
def month_shape_correction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A month's days in the shape of the same days of the months around it, at the level of the four
    months around it."""
    rows = panels.reshaped(panel_complete(spark, sf_dir), ["origin", "dest"], "day", "volume", "2000-06-01", "2000-06-30")
    return rows.withColumn("corrected", F.round("corrected", 6))


@query(f"""WITH {PANEL_SQL}, shut AS (SELECT origin, dest FROM panel GROUP BY ALL HAVING sum(CASE WHEN year(day) = 1999 THEN volume ELSE 0 END) >= 50 AND sum(CASE WHEN year(day) = 2000 THEN volume ELSE 0 END) / (sum(CASE WHEN year(day) = 1999 THEN volume ELSE 0 END) + 1e-9) < 0.95),
windows AS (SELECT sum(CASE WHEN day BETWEEN DATE '1999-02-16' - 21 AND DATE '1999-02-16' + 9 THEN volume END) AS old, sum(CASE WHEN day BETWEEN DATE '2000-02-05' - 21 AND DATE '2000-02-05' + 9 THEN volume END) AS now FROM panel ANTI JOIN shut USING (origin, dest)),
growth AS (SELECT least(1.3::DOUBLE, greatest(0.8::DOUBLE, CASE WHEN old > 0 THEN now / old ELSE 1 END)) AS g FROM windows),
target AS (SELECT origin, dest, day, day - DATE '2001-01-24' AS delta FROM panel WHERE day BETWEEN DATE '2001-01-24' - 21 AND DATE '2001-01-24' + 9)
SELECT t.origin, t.dest, t.day, p.volume AS source_volume, round(p.volume * g, 6) AS corrected FROM target t JOIN panel p ON p.origin = t.origin AND p.dest = t.dest AND p.day = DATE '2000-02-05' + delta::INT CROSS JOIN growth""")
def holiday_correction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A festival's days from those of the last one at the same distance, times a clipped growth that lanes
    which shut down (here: fell below 0.95 of the year before) have no part in."""
    shut = long_shutdown(spark, sf_dir).where("year = 2000")
    rows = panels.holiday_aligned(panel_complete(spark, sf_dir), ["origin", "dest"], "day", "volume", HOLIDAYS[0], HOLIDAYS[1], HOLIDAYS[2], shut)
    return rows.withColumn("corrected", F.round("corrected", 6))


@query(f"""WITH {PANEL_SQL}, years AS (SELECT origin, dest, sum(CASE WHEN year(day) = 1999 THEN volume ELSE 0 END) AS a, sum(CASE WHEN year(day) = 2000 THEN volume ELSE 0 END) AS b FROM panel GROUP BY ALL),
wanted AS (SELECT origin, dest, 0.35::DOUBLE * a + 0.65::DOUBLE * b AS target, b FROM years),
scaled AS (SELECT *, round_even(b * sum(target) OVER () / (sum(b) OVER () + 1e-9), 0)::BIGINT AS part, round_even(sum(target) OVER (), 0)::BIGINT AS whole FROM wanted)
SELECT origin, dest, part + CASE WHEN row_number() OVER (ORDER BY part DESC, origin, dest) = 1 THEN whole - sum(part) OVER () ELSE 0 END AS calibrated FROM scaled""".replace("THEN whole - sum(part) OVER () ELSE 0 END", "THEN (whole - sum(part) OVER ())::BIGINT ELSE 0 END"))
def calibrate_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rounded parts of a blended total; what rounding leaves goes to the largest part."""
    year = lambda y: F.sum(F.when(F.year("day") == y, F.col("volume")).otherwise(0.0))
    years = lane_days(spark, sf_dir).groupBy("origin", "dest").agg(year(1999).alias("a"), year(2000).alias("b"))
    return forecast.calibrated(years.withColumn("target", 0.35 * F.col("a") + 0.65 * F.col("b")), ["origin", "dest"], "b", "target")


COMPARE_SQL = PANEL_SQL + """, old AS (SELECT origin, dest, day + INTERVAL 364 DAY AS d, volume AS forecast FROM panel),
paired AS (SELECT p.origin, p.dest, p.day, p.volume, o.forecast FROM panel p JOIN old o ON o.origin = p.origin AND o.dest = p.dest AND o.d::DATE = p.day WHERE p.day >= DATE '2001-01-01')"""


@query(f"""WITH {COMPARE_SQL}
SELECT coalesce(origin, 'all') AS origin, coalesce(dest, 'all') AS dest, count(*) AS days, round(avg(abs(forecast - volume)), 6) AS mae, round(sqrt(avg((forecast - volume) ** 2)), 6) AS rmse,
    round(sum(abs(forecast - volume)) / nullif(sum(volume), 0), 6) AS wape, round(avg(CASE WHEN forecast + volume > 0 THEN 2 * abs(forecast - volume) / (forecast + volume) ELSE 0 END), 6) AS smape,
    round(1 - sum((forecast - volume) ** 2) / nullif(sum(volume ** 2) - sum(volume) ** 2 / count(*), 0), 6) AS r2
FROM paired GROUP BY ROLLUP (origin, dest)""")
def forecast_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors of the forecast "as 52 weeks ago", by edge, origin and in all."""
    panel = panel_complete(spark, sf_dir)
    old = panel.select("origin", "dest", F.date_add("day", 364).alias("day"), F.col("volume").alias("forecast"))
    pairs = panel.where(F.col("day") >= F.lit(SPLIT).cast("date")).join(old, ["origin", "dest", "day"])
    rows = pairs.rollup("origin", "dest").agg(F.count(F.lit(1)).alias("days"), *forecast.errors("volume", "forecast"))
    return rows.select(F.coalesce("origin", F.lit("all")).alias("origin"), F.coalesce("dest", F.lit("all")).alias("dest"), "days", *[F.round(c, 6).alias(c) for c in ("mae", "rmse", "wape", "smape", "r2")])


CLOSED = "NATION_7"
DAY = "2001-03-01"


DEMAND_SQL = EDGES_SQL + f""", caps AS (SELECT origin, dest, max(volume) AS capacity FROM edges WHERE day < DATE '{SPLIT}' GROUP BY ALL),
demand AS (SELECT origin, dest, day, volume FROM edges WHERE day BETWEEN DATE '{DAY}' AND DATE '{DAY}' + 30 AND (origin = '{CLOSED}') <> (dest = '{CLOSED}')),
sites AS (SELECT DISTINCT origin AS site FROM edges UNION SELECT DISTINCT dest FROM edges),
options AS (SELECT d.origin, d.dest, d.day, d.volume, s.site, CASE WHEN d.dest = '{CLOSED}' THEN d.origin ELSE s.site END AS new_origin, CASE WHEN d.dest = '{CLOSED}' THEN s.site ELSE d.dest END AS new_dest
    FROM demand d JOIN sites s ON s.site <> '{CLOSED}' AND s.site <> d.origin AND s.site <> d.dest),
spare AS (SELECT o.*, coalesce(c.capacity, (SELECT max(capacity) FROM caps)) - coalesce(e.volume, 0) AS spare
    FROM options o LEFT JOIN caps c ON c.origin = new_origin AND c.dest = new_dest LEFT JOIN edges e ON e.origin = new_origin AND e.dest = new_dest AND e.day = o.day)"""


@query(f"WITH {DEMAND_SQL} SELECT origin, dest, day, volume, site, new_origin, new_dest, spare FROM spare WHERE spare > 0")
def reroute_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Other ends for the flows of a closed site: inbound flows keep their origin, outbound ones their
    destination. An edge not used so far may carry what the largest one does."""
    return rerouting.candidates(edge_days(spark, sf_dir), CLOSED, DAY, 31, SPLIT)


@query()
def reroute_greedy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A served and an unserved part of each flow of the closed site: largest flows first, into the edges
    with most room."""
    return rerouting.greedy(reroute_candidates(spark, sf_dir))


@query()
def allocation_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Served and unserved volume of each day balance the demand, and no edge is over its room."""
    return rerouting.balance(reroute_greedy(spark, sf_dir))


@query(f"""WITH {EDGES_SQL}, b AS (SELECT origin AS site, sum(volume) AS outbound FROM edges GROUP BY 1), i AS (SELECT dest AS site, sum(volume) AS inbound FROM edges GROUP BY 1),
f AS (SELECT site, coalesce(outbound, 0) AS outbound, coalesce(inbound, 0) AS inbound FROM b FULL JOIN i USING (site))
SELECT site, outbound, inbound, round(outbound / (outbound + inbound), 6) AS out_share,
    CASE WHEN outbound / (outbound + inbound) >= 0.6 THEN 'source' WHEN inbound / (outbound + inbound) >= 0.6 THEN 'sink' ELSE 'transit' END AS role FROM f""")
def site_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = edge_days(spark, sf_dir)
    both = relations.outer_sums(edges.groupBy(F.col("origin").alias("site")).agg(F.sum("volume").alias("outbound")), edges.groupBy(F.col("dest").alias("site")).agg(F.sum("volume").alias("inbound")), ["site"], "outbound", "inbound")
    out = F.col("outbound") / (F.col("outbound") + F.col("inbound"))
    return both.select("site", "outbound", "inbound", F.round(out, 6).alias("out_share"), F.when(out >= 0.6, "source").when(F.col("inbound") / (F.col("outbound") + F.col("inbound")) >= 0.6, "sink").otherwise("transit").alias("role"))


@query(f"""WITH {EDGE_SQL}, core AS (SELECT site FROM nodes ORDER BY score DESC, site LIMIT 3),
staged AS (SELECT site, 1 AS stage, 0 AS place FROM core
    UNION ALL SELECT CASE WHEN origin IN (FROM core) THEN dest ELSE origin END, 2, row_number() OVER (ORDER BY score DESC, origin, dest) FROM ranked WHERE (origin IN (FROM core)) <> (dest IN (FROM core))
    UNION ALL SELECT site, 3, row_number() OVER (ORDER BY peak DESC, site) FROM nodes),
firsts AS (SELECT site, stage FROM (SELECT *, row_number() OVER (PARTITION BY site ORDER BY stage, place) AS k FROM staged) WHERE k = 1),
placed AS (SELECT s.site, s.stage, s.place FROM staged s JOIN firsts f ON f.site = s.site AND f.stage = s.stage),
once AS (SELECT site, stage, min(place) AS place FROM placed GROUP BY ALL)
SELECT site, stage::INT AS stage, k::INT AS position FROM (SELECT *, row_number() OVER (ORDER BY stage, place, site) AS k FROM once) WHERE k <= 14""")
def connected_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Up to 14 sites: the three most important, then those tied to them by important edges, then those
    under most load."""
    edges = edge_days(spark, sf_dir)
    return rerouting.staged_sites(node_scores(edges), edge_scores(edges), 3, 14)


HUB = "NATION_3"


def diversion(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = edge_days(spark, sf_dir)
    scores = edge_scores(edges)
    sites = rerouting.staged_sites(node_scores(edges), scores, 3, 14).select("site")
    top = scores.orderBy(F.desc("score"), "origin", "dest").limit(80).select("origin", "dest")
    return rerouting.diverted(edges, HUB, DAY, 31, SPLIT, sites, top)


@query()
def node_diversion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fifth of the volume of the 80 most important edges between chosen sites by way of a hub, as far as
    both new edges and the hub have room."""
    return diversion(spark, sf_dir)


@query(f"""WITH {DEMAND_SQL}, kinds AS (SELECT origin, dest, 'closed' AS status, volume FROM edges WHERE day = DATE '{DAY}' AND (origin = '{CLOSED}' OR dest = '{CLOSED}')
    UNION ALL SELECT origin, dest, 'active', volume FROM edges WHERE day = DATE '{DAY}' AND origin <> '{CLOSED}' AND dest <> '{CLOSED}'
    UNION ALL SELECT DISTINCT new_origin, new_dest, 'opened', 0::DOUBLE FROM spare WHERE spare > 0 AND day = DATE '{DAY}' AND (new_origin, new_dest) NOT IN (SELECT (origin, dest) FROM edges WHERE day = DATE '{DAY}'))
SELECT status, count(*) AS edges, sum(volume) AS volume FROM kinds GROUP BY status""")
def workload_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges of a day that close, stay and could be opened."""
    edges = edge_days(spark, sf_dir)
    return rerouting.changes(edges, rerouting.candidates(edges, CLOSED, DAY, 31, SPLIT), CLOSED, DAY)


@query(f"""WITH {EDGES_SQL}, caps AS (SELECT origin, dest, max(volume) AS capacity, avg(volume) AS mean FROM edges GROUP BY ALL),
reasons AS (SELECT origin, dest, 1 AS k, 'overload' AS reason, ceil(capacity * 1.2::DOUBLE / 1000) * 1000 AS planned FROM caps WHERE capacity > 4 * mean
    UNION ALL SELECT dest, origin, 2, 'return', ceil(mean / 1000) * 1000 FROM caps WHERE mean >= 25 AND origin <> dest)
SELECT origin, dest, string_agg(reason, ';' ORDER BY k) AS reasons, max(planned) AS planned FROM reasons GROUP BY ALL""")
def line_additions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New capacity for edges, in thousands, with all its reasons."""
    caps = edge_days(spark, sf_dir).groupBy("origin", "dest").agg(F.max("volume").alias("capacity"), F.avg("volume").alias("mean"))
    up = lambda c: F.ceil(c / 1000).cast("double") * 1000
    over = caps.where("capacity > 4 * mean").select("origin", "dest", F.struct(F.lit(1).alias("k"), F.lit("overload").alias("reason")).alias("r"), up(F.col("capacity") * 1.2).alias("planned"))
    back = caps.where("mean >= 25 AND origin <> dest").select(F.col("dest").alias("origin"), F.col("origin").alias("dest"), F.struct(F.lit(2).alias("k"), F.lit("return").alias("reason")).alias("r"), up(F.col("mean")).alias("planned"))
    rows = over.unionByName(back).groupBy("origin", "dest").agg(F.sort_array(F.collect_set("r")).alias("rs"), F.max("planned").alias("planned"))
    return rows.select("origin", "dest", F.array_join(F.transform("rs", lambda r: r["reason"]), ";").alias("reasons"), "planned")


@query()
def robustness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often edges are overloaded when volumes vary, before and after the diversion by the hub: 200 draws
    of clipped normal multipliers."""
    return rerouting.overload_draws(edge_days(spark, sf_dir), diversion(spark, sf_dir), DAY, 31, SPLIT, [0.0, 0.1, 0.15], 200)


@query()
def recursive_forecast(spark: SparkSession, sf_dir: str) -> DataFrame:
    """28 days ahead of each edge, each day from the days before it, forecast ones included."""
    return forecast.recursive(panel_complete(spark, sf_dir), ["origin", "dest"], "day", "volume", 28)
