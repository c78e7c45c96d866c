"""Generated designs: mirror fields under the sun, and moorings; nothing is read."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewater.operators import ranks, relations, spatial
from tidewater.plans.common import Plan

plan = Plan()
query = plan.query
QUERIES, ORACLES = plan.queries, plan.oracles

# Latitude in degrees, altitude in km, and the coefficients of direct irradiance there.
LATITUDE = 39.4
DNI = (1.366, 0.34981, 0.5783875, 0.275745)
# The coefficients of atmospheric transmission by distance in m.
AIR = (0.99321, 0.0001176, 1.97e-8)
HOURS = (9.0, 10.5, 12.0, 13.5, 15.0)
TOWER = 80.0  #: height of the receiver above the mirrors


def hexagonal(spark: SparkSession, pitch: float, radius: float, ring: float) -> DataFrame:
    """Points of a hexagonal lattice in a circle, but for a ring around the tower: id, x, y."""
    rows, cols = math.ceil(radius / (pitch * math.sqrt(3) / 2)), math.ceil(radius / pitch) + 1
    g = spark.range(-rows, rows + 1).withColumnRenamed("id", "i").withColumn("j", F.explode(F.sequence(F.lit(-cols), F.lit(cols))))
    p = g.select("i", "j", ((F.col("j") + F.pmod("i", F.lit(2)) * 0.5) * pitch).alias("x"), (F.col("i") * (pitch * math.sqrt(3) / 2)).alias("y"))
    d = F.hypot("x", "y")
    return p.where((d <= radius) & (d >= ring)).select((F.col("i") * 100_000 + F.col("j")).alias("id"), "x", "y")


HEX_SQL = """hx AS (SELECT i, j, (j + ((i % 2) + 2) % 2 * 0.5::DOUBLE) * 14.0::DOUBLE AS x, i * (14.0::DOUBLE * sqrt(3) / 2) AS y FROM (SELECT unnest(range(-29, 30)) AS i), (SELECT unnest(range(-26, 27)) AS j)),
field AS (SELECT i * 100000 + j AS id, x, y FROM hx WHERE sqrt(x * x + y * y) BETWEEN 100 AND 350)"""


def field(spark: SparkSession) -> DataFrame:
    return hexagonal(spark, 14.0, 350.0, 100.0)


@query(f"WITH {HEX_SQL} SELECT id, round(x, 6) AS x, round(y, 6) AS y FROM field")
def hex_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return field(spark).select("id", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


def sun(spark: SparkSession) -> DataFrame:
    """month, hour, sin_alt, dni and the direction sx, sy, sz (east, north, up) on the 21st of each month."""
    start = F.lit("2023-03-21").cast("date")
    months = spark.range(1, 13).select(F.col("id").cast("int").alias("month"), F.explode(F.array(*map(F.lit, HOURS))).alias("hour"))
    day = F.datediff(F.make_date(F.lit(2023), "month", F.lit(21)), start)
    phi = math.radians(LATITUDE)
    rows = months.withColumns({"sd": F.sin(2 * F.pi() * day / 365) * math.sin(2 * math.pi * 23.45 / 360), "om": F.pi() / 12 * (F.col("hour") - 12)})
    rows = rows.withColumn("cd", F.sqrt(1 - F.col("sd") * F.col("sd")))
    rows = rows.withColumn("sin_alt", F.col("cd") * math.cos(phi) * F.cos("om") + F.col("sd") * math.sin(phi))
    a, b, c, d = DNI
    east = -F.col("cd") * F.sin("om")
    north = F.col("sd") * math.cos(phi) - F.col("cd") * math.sin(phi) * F.cos("om")
    return rows.select("month", "hour", "sin_alt", (a * (b + c * F.exp(-d / F.col("sin_alt")))).alias("dni"), east.alias("sx"), north.alias("sy"), F.col("sin_alt").alias("sz"))


SUN_SQL = """st AS (SELECT month, hour, sin(2 * pi() * (make_date(2023, month, 21) - DATE '2023-03-21') / 365) * sin(2 * pi() * 23.45 / 360) AS sd, pi() / 12 * (hour - 12) AS om FROM (SELECT unnest(range(1, 13)) AS month), (SELECT unnest([9.0, 10.5, 12.0, 13.5, 15.0])::DOUBLE AS hour)),
s2 AS (SELECT *, sqrt(1 - sd * sd) AS cd FROM st), s3 AS (SELECT *, cd * cos(radians(39.4)) * cos(om) + sd * sin(radians(39.4)) AS sz FROM s2),
sun AS (SELECT month::INT AS month, hour, sz, 1.366::DOUBLE * (0.34981::DOUBLE + 0.5783875::DOUBLE * exp(-0.275745::DOUBLE / sz)) AS dni, -cd * sin(om) AS sx, sd * cos(radians(39.4)) - cd * sin(radians(39.4)) * cos(om) AS sy FROM s3)"""


@query(f"WITH {SUN_SQL} SELECT month, hour, round(degrees(asin(sz)), 6) AS altitude, round(dni, 6) AS dni, round(sx, 6) AS east, round(sy, 6) AS north FROM sun")
def solar_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sun(spark).select("month", "hour", F.round(F.degrees(F.asin("sin_alt")), 6).alias("altitude"), F.round("dni", 6).alias("dni"), F.round("sx", 6).alias("east"), F.round("sy", 6).alias("north"))


def efficiencies(spark: SparkSession) -> DataFrame:
    """cosine and air efficiency of each mirror and state: the normal halves the angle of sun and tower."""
    m = field(spark).withColumn("d", F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y") + TOWER * TOWER))
    states = F.broadcast(sun(spark).agg(F.collect_list(F.struct("month", "hour", "dni", "sx", "sy", "sz")).alias("states")))  # 60 states
    rows = m.join(states).select("id", "x", "y", "d", F.explode("states").alias("s")).select("id", "x", "y", "d", "s.*")
    dot = (-F.col("x") * F.col("sx") - F.col("y") * F.col("sy") + TOWER * F.col("sz")) / F.col("d")
    a, b, c = AIR
    return rows.withColumns({"cosine": F.sqrt((1 + dot) / 2), "air": a - b * F.col("d") + c * F.col("d") * F.col("d")})


EFF_SQL = HEX_SQL + ", " + SUN_SQL + """, md AS (SELECT *, sqrt(x * x + y * y + 6400) AS d FROM field),
eff AS (SELECT id, x, y, month, hour, dni, sqrt((1 + (-x * sx - y * sy + 80 * sz) / d) / 2) AS cosine, 0.99321::DOUBLE - 0.0001176::DOUBLE * d + 1.97e-8 * d * d AS air FROM md, sun)"""


@query(f"WITH {EFF_SQL}, m AS (SELECT month, hour, avg(cosine) AS cosine, avg(air) AS air, sum(dni * 36 * 0.92 * cosine * air) / 1000 AS power FROM eff GROUP BY ALL) SELECT coalesce(month, 0)::INT AS month, round(avg(cosine), 6) AS cosine, round(avg(air), 6) AS air, round(avg(power), 4) AS power FROM m GROUP BY ROLLUP (month)")
def field_efficiency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means of states, of each month and (month 0) of the year."""
    e = efficiencies(spark).groupBy("month", "hour").agg(F.avg("cosine").alias("cosine"), F.avg("air").alias("air"), (F.sum(F.col("dni") * 36 * 0.92 * F.col("cosine") * F.col("air")) / 1000).alias("power"))
    r = e.rollup("month").agg(F.avg("cosine").alias("cosine"), F.avg("air").alias("air"), F.avg("power").alias("power"))
    return r.select(F.coalesce("month", F.lit(0)).alias("month"), F.round("cosine", 6).alias("cosine"), F.round("air", 6).alias("air"), F.round("power", 4).alias("power"))


@query(f"""WITH {EFF_SQL}, p AS (SELECT id, x, y, avg(dni * cosine * air) AS power FROM eff GROUP BY ALL), z AS (SELECT least(4, floor(round(sqrt(x * x + y * y), 9) / 70))::INT AS ring, (floor(round((degrees(atan2(x, y)) + 360) % 360, 9) / 30)::INT) % 12 AS sector, power FROM p),
g AS (SELECT a.ring::INT AS ring, b.sector::INT AS sector, count(power) AS n, avg(power) AS mean FROM (SELECT unnest(range(0, 5)) AS ring) a CROSS JOIN (SELECT unnest(range(0, 12)) AS sector) b LEFT JOIN z ON z.ring = a.ring AND z.sector = b.sector GROUP BY ALL)
SELECT ring, sector, n, round(mean, 6) AS mean, n >= 10 AND coalesce(round(mean, 9) <= round((SELECT quantile_cont(mean, 0.25) FROM g WHERE n >= 10), 9), FALSE) AS low FROM g""")
def zone_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five rings by twelve sectors, empty ones too; low: in the lowest quarter of zones with ten mirrors."""
    p = efficiencies(spark).groupBy("id", "x", "y").agg(F.avg(F.col("dni") * F.col("cosine") * F.col("air")).alias("power"))
    ring = F.least(F.lit(4), F.floor(F.round(F.hypot("x", "y"), 9) / 70).cast("int"))
    sector = F.floor(F.round(F.pmod(F.degrees(F.atan2("x", "y")), F.lit(360.0)), 9) / 30).cast("int") % 12
    z = p.groupBy(ring.alias("ring"), sector.alias("sector")).agg(F.count(F.lit(1)).alias("n"), F.avg("power").alias("mean"))
    all_zones = spark.range(60).select((F.col("id") / 12).cast("int").alias("ring"), (F.col("id") % 12).cast("int").alias("sector"))
    g = all_zones.join(z, ["ring", "sector"], "left").fillna(0, ["n"])
    cut = g.where("n >= 10").agg(F.percentile("mean", 0.25).alias("cut"))
    low = (F.col("n") >= 10) & F.coalesce(F.round("mean", 9) <= F.round("cut", 9), F.lit(False))
    return g.join(F.broadcast(cut)).select("ring", "sector", "n", F.round("mean", 6).alias("mean"), low.alias("low"))


@query(f"WITH {HEX_SQL}, n AS (SELECT a.id, min(sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2)) AS d FROM field a JOIN field b ON a.id <> b.id AND abs(a.x - b.x) < 30 AND abs(a.y - b.y) < 30 GROUP BY a.id) SELECT (SELECT count(*) FROM field) AS mirrors, round(min(d), 6) AS least, round(max(d), 6) AS most, bool_and(round(d, 9) >= 13) AS spaced FROM n")
def geometry_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The field's spacing: every mirror's nearest neighbour."""
    f = field(spark)
    pairs = spatial.radius_pairs(f, f, 15.0).where("l.id <> r.id")
    d = pairs.groupBy("l.id").agg(F.min("d").alias("d"))
    out = d.agg(F.round(F.min("d"), 6).alias("least"), F.round(F.max("d"), 6).alias("most"), F.bool_and(F.round("d", 9) >= 13).alias("spaced"))
    return f.agg(F.count(F.lit(1)).alias("mirrors")).join(F.broadcast(out))


def kept_rays(mirrors: DataFrame, states: DataFrame) -> DataFrame:
    """month, hour, rays, lit, kept: shares of each state's rays that other mirrors neither shade nor block,
    over all mirrors. A row is a mirror in a state, dealt by both; near mirrors are bounded by the spacing."""
    near = spatial.radius_pairs(mirrors, mirrors, 40.0).where("l.id <> r.id")
    near = near.groupBy(F.col("l.id").alias("id")).agg(F.collect_list(F.struct("r.x", "r.y")).alias("near"))
    states = F.broadcast(states.agg(F.collect_list(F.struct("month", "hour", "sx", "sy", "sz")).alias("states")))  # 60 states
    rows = mirrors.join(near, "id", "left").join(states).select("id", "x", "y", "near", F.explode("states").alias("s")).select("id", "x", "y", "near", "s.*")
    rows = rows.repartition("id", "month", "hour")

    def run(batches):
        import numpy as np

        offsets = np.stack(np.meshgrid(np.linspace(-2.5, 2.5, 5), np.linspace(-2.5, 2.5, 5)), -1).reshape(-1, 2)

        def frames(p, s):
            t = np.array([0, 0, TOWER]) - p
            t /= np.linalg.norm(t, axis=1, keepdims=True)
            n = s + t
            n /= np.linalg.norm(n, axis=1, keepdims=True)
            u = np.stack([-n[:, 1], n[:, 0], np.zeros(len(n))], 1) / np.maximum(1e-9, np.hypot(n[:, 0], n[:, 1]))[:, None]
            return t, n, u, np.cross(n, u)

        for pdf in batches:
            out = []
            for r in pdf.itertuples():
                s = np.array([r.sx, r.sy, r.sz])
                c = np.array([[r.x, r.y, 0.0], *([q["x"], q["y"], 0.0] for q in (r.near if r.near is not None else []))])
                t, m, a, b = frames(c, s)  # the mirror itself first
                start = c[0] + offsets[:, :1] * a[0] + offsets[:, 1:] * b[0]
                c, m, a, b = c[1:], m[1:], a[1:], b[1:]
                free = []
                for way in (s, t[0]):
                    slope = m @ way
                    level = np.abs(slope) < 1e-9
                    along = ((c * m).sum(1)[:, None] - m @ start.T) / np.where(level, 1.0, slope)[:, None]
                    inside = [np.abs(k @ start.T + along * (k @ way)[:, None] - (k * c).sum(1)[:, None]) <= 3 for k in (a, b)]
                    free.append(~((along > 1e-6) & inside[0] & inside[1] & ~level[:, None]).any(0))
                out.append((r.month, r.hour, len(start), int(free[0].sum()), int((free[0] & free[1]).sum())))
            yield pd.DataFrame(out, columns=["month", "hour", "rays", "lit", "kept"])

    hits = rows.mapInPandas(run, "month int, hour double, rays long, lit long, kept long")
    return hits.groupBy("month", "hour").agg(F.sum("rays").alias("rays"), F.round(F.sum("lit") / F.sum("rays"), 6).alias("lit"), F.round(F.sum("kept") / F.sum("rays"), 6).alias("kept"))


@query()
def ray_efficiency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares of rays that other mirrors neither shade nor block, of all mirrors in all 60 states. Truncation
    at the receiver is not worked out."""
    return kept_rays(field(spark), sun(spark))


CHAINS = [("I", 0.078, 3.2), ("II", 0.105, 7.0), ("III", 0.12, 12.5), ("IV", 0.15, 19.5), ("V", 0.18, 28.12)]  #: kind, link in m, kg per m


def moorings(spark: SparkSession) -> DataFrame:
    """kind, links, ballast, wind: the grid of designs and weather."""
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(l).alias("link"), F.lit(m).alias("mass")) for k, l, m in CHAINS])
    g = spark.range(1).select(F.explode(kinds).alias("c")).select("c.*")
    g = g.withColumn("links", F.explode(F.array(*map(F.lit, (180, 210, 240))))).withColumn("ballast", F.explode(F.array(*map(F.lit, (1200.0, 1800.0, 2400.0, 3000.0)))))
    return g.withColumn("wind", F.explode(F.array(*map(F.lit, (12.0, 24.0, 36.0)))))


def catenary(rows: DataFrame, depth: float = 16.0) -> DataFrame:
    """reach, anchor_angle, draft_force of a chain of weight w and length s that a horizontal force pulls: it
    lies on the ground in part, or hangs free with the vertical force at the anchor found by bisection, a
    fold of 60 halvings over an array of steps."""
    rows = rows.withColumns({"s": F.col("link") * F.col("links"), "w": F.col("mass") * 9.8, "force": 0.625 * 4 * F.col("wind") * F.col("wind")})
    hanging = F.sqrt(F.lit(depth * depth) + 2 * depth * F.col("force") / F.col("w"))
    rows = rows.withColumn("hanging", hanging)
    rise = lambda v: F.col("force") / F.col("w") * (F.sqrt(1 + F.pow((v + F.col("w") * F.col("s")) / F.col("force"), F.lit(2))) - F.sqrt(1 + F.pow(v / F.col("force"), F.lit(2))))
    bounds = F.struct(F.lit(0.0).alias("lo"), (F.col("force") * 1000).alias("hi"))

    def halve(b, _):
        mid = (b["lo"] + b["hi"]) / 2
        low = rise(mid) < depth
        return F.struct(F.when(low, mid).otherwise(b["lo"]).alias("lo"), F.when(low, b["hi"]).otherwise(mid).alias("hi"))

    v0 = F.aggregate(F.sequence(F.lit(1), F.lit(60)), bounds, halve)["lo"]
    # a chain shorter than the depth has no equilibrium: nulls
    rows = rows.withColumn("v0", F.when(F.col("hanging") <= F.col("s"), 0.0).when(F.col("s") > depth, v0))
    length = F.least("hanging", "s")
    reach = F.col("s") - length + F.col("force") / F.col("w") * (F.asinh((F.col("v0") + F.col("w") * length) / F.col("force")) - F.asinh(F.col("v0") / F.col("force")))
    return rows.select("kind", "links", "ballast", "wind", reach.alias("reach"), F.degrees(F.atan2("v0", "force")).alias("anchor_angle"), (F.col("v0") + F.col("w") * length).alias("chain_force"))


@query()
def mooring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equilibria of all designs and winds."""
    return catenary(moorings(spark))


GRID_SQL = "d AS (SELECT kind, mass, links::INT AS links, ballast::DOUBLE AS ballast, mass * link * links + ballast AS total, link * links AS length, 90 / (1 + ballast / 500 + mass) AS tilt FROM (VALUES " + ", ".join(f"('{k}', {l}::DOUBLE, {m}::DOUBLE)" for k, l, m in CHAINS) + ") c(kind, link, mass), (SELECT unnest([180, 210, 240]) AS links), (SELECT unnest([1200, 1800, 2400, 3000]) AS ballast))"


@query(f"""WITH {GRID_SQL}, u AS (SELECT * FROM d WHERE NOT EXISTS (SELECT 1 FROM d o WHERE o.total <= d.total AND o.length <= d.length AND o.tilt <= d.tilt AND (o.total < d.total OR o.length < d.length OR o.tilt < d.tilt))),
s AS (SELECT *, (total - min(total) OVER ()) / (max(total) OVER () - min(total) OVER ()) AS a, (length - min(length) OVER ()) / (max(length) OVER () - min(length) OVER ()) AS b, (tilt - min(tilt) OVER ()) / (max(tilt) OVER () - min(tilt) OVER ()) AS c FROM u)
SELECT kind, links, ballast, ceil(total / 50) * 50 AS mass, round(length, 6) AS length, round(tilt, 6) AS tilt, round(sqrt(a * a + b * b + c * c), 6) AS ideal_distance FROM s""")
def design_pareto(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Designs that no other beats in mass, length and tilt, with their distance from the ideal point."""
    g = moorings(spark).select("kind", "mass", "link", "links", "ballast").distinct()
    g = g.withColumns({"total": F.col("mass") * F.col("link") * F.col("links") + F.col("ballast"), "length": F.col("link") * F.col("links"), "tilt": 90 / (1 + F.col("ballast") / 500 + F.col("mass"))}).withColumn("key", F.concat_ws("-", "kind", "links", "ballast"))
    u = relations.undominated(g, "key", ["total", "length", "tilt"], [])
    s = [ranks.scaled(c) for c in ("total", "length", "tilt")]
    return u.select("kind", "links", "ballast", (F.ceil(F.col("total") / 50) * 50).cast("double").alias("mass"), F.round("length", 6).alias("length"), F.round("tilt", 6).alias("tilt"), F.round(F.sqrt(s[0] * s[0] + s[1] * s[1] + s[2] * s[2]), 6).alias("ideal_distance"))


@query()
def worst_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each design's worst weather."""
    r = catenary(moorings(spark))
    return r.groupBy("kind", "links", "ballast").agg(F.max("reach").alias("reach"), F.max("anchor_angle").alias("anchor_angle"), F.max_by("wind", "anchor_angle").alias("wind"))
