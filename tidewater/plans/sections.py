"""Surveys of cross-sections."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewater.operators import ranks, sections
from tidewater.plans.common import Plan
from tidewater.sources.tables import PROFILES_SQL, profiles

plan = Plan()
query = plan.query
QUERIES, ORACLES = plan.queries, plan.oracles
STEP = 0.5

LINE_SQL = PROFILES_SQL + """, seg AS (SELECT survey, x AS x0, z AS z0, lead(x) OVER w AS x1, lead(z) OVER w AS z1, lead(x, 2) OVER w IS NULL AS last FROM profiles WINDOW w AS (PARTITION BY survey ORDER BY x)),
grid AS (SELECT survey, k, k * 0.5::DOUBLE AS x, z0 + (z1 - z0) * (k * 0.5::DOUBLE - x0) / (x1 - x0) AS z FROM (SELECT *, unnest(range(ceil(x0 * 2)::BIGINT, CASE WHEN last THEN floor(x1 * 2)::BIGINT + 1 ELSE ceil(x1 * 2)::BIGINT END)) AS k FROM seg WHERE x1 IS NOT NULL))"""


def grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sections.on_grid(profiles(spark, sf_dir), ["survey"], "x", "z", STEP)


@query(f"WITH {LINE_SQL} SELECT survey, k, x, round(z + 1e-9, 6) AS z FROM grid")
def profile_linear(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid(spark, sf_dir).select("survey", "k", "x", F.round(F.col("linear") + 1e-9, 6).alias("z"))


@query(f"""WITH {PROFILES_SQL}, a AS (SELECT survey, x, z, row_number() OVER w AS i, count(*) OVER (PARTITION BY survey) AS n FROM profiles WINDOW w AS (PARTITION BY survey ORDER BY x)),
d AS (SELECT a.survey, a.i, b.x - a.x AS h, (b.z - a.z) / (b.x - a.x) AS d FROM a JOIN a b ON a.survey = b.survey AND b.i = a.i + 1),
m AS (SELECT a.survey, a.i, a.n, a.x, a.z, p.h AS hp, p.d AS dp, q.h AS hq, q.d AS dq, r.h AS hr, r.d AS dr, o.h AS ho, o.d AS d_o FROM a LEFT JOIN d p ON p.survey = a.survey AND p.i = a.i - 1 LEFT JOIN d q ON q.survey = a.survey AND q.i = a.i
    LEFT JOIN d r ON r.survey = a.survey AND r.i = a.i + 1 LEFT JOIN d o ON o.survey = a.survey AND o.i = a.i - 2),
e AS (SELECT *, CASE WHEN i = 1 THEN ((2 * hq + hr) * dq - hq * dr) / (hq + hr) WHEN i = n THEN ((2 * hp + ho) * dp - hp * d_o) / (hp + ho) END AS raw FROM m),
s AS (SELECT *, CASE WHEN i = 1 AND dr IS NULL THEN dq WHEN i = n AND d_o IS NULL THEN dp
    WHEN i = 1 THEN CASE WHEN sign(raw) <> sign(dq) THEN 0 WHEN sign(dq) <> sign(dr) AND abs(raw) > 3 * abs(dq) THEN 3 * dq ELSE raw END
    WHEN i = n THEN CASE WHEN sign(raw) <> sign(dp) THEN 0 WHEN sign(dp) <> sign(d_o) AND abs(raw) > 3 * abs(dp) THEN 3 * dp ELSE raw END
    WHEN dp * dq <= 0 THEN 0 ELSE (3 * hp + 3 * hq) / ((2 * hq + hp) / dp + (hq + 2 * hp) / dq) END AS slope FROM e),
v AS (SELECT s.survey, s.x AS x0, s.z AS z0, s.slope AS m0, t.x AS x1, t.z AS z1, t.slope AS m1, t.i = t.n AS last FROM s JOIN s t ON t.survey = s.survey AND t.i = s.i + 1),
g AS (SELECT *, unnest(range(ceil(x0 * 2)::BIGINT, CASE WHEN last THEN floor(x1 * 2)::BIGINT + 1 ELSE ceil(x1 * 2)::BIGINT END)) AS k FROM v), u AS (SELECT *, (k * 0.5::DOUBLE - x0) / (x1 - x0) AS t FROM g)
SELECT survey, k, round((2 * t ** 3 - 3 * t ** 2 + 1) * z0 + (t ** 3 - 2 * t ** 2 + t) * (x1 - x0) * m0 + (3 * t ** 2 - 2 * t ** 3) * z1 + (t ** 3 - t ** 2) * (x1 - x0) * m1 + 1e-9, 6) AS z FROM u""")
def profile_pchip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monotone cubic interpolation."""
    return grid(spark, sf_dir).select("survey", "k", F.round(F.col("monotone") + 1e-9, 6).alias("z"))


CHANGE_SQL = LINE_SQL + """, ch AS (SELECT survey, k, z - lag(z) OVER w AS d, lag(survey) OVER w AS before FROM grid WINDOW w AS (PARTITION BY k ORDER BY survey)),
nx AS (SELECT *, CASE WHEN lead(k) OVER w = k + 1 THEN lead(d) OVER w END AS e FROM ch WHERE before IS NOT NULL WINDOW w AS (PARTITION BY survey, before ORDER BY k))"""


@query(f"""WITH {CHANGE_SQL} SELECT survey, before, round(coalesce(sum((d + e) / 4), 0), 4) AS net, round(coalesce(sum((greatest(d, 0) + greatest(e, 0)) / 4) FILTER (e IS NOT NULL), 0), 4) AS deposition, round(coalesce(sum((greatest(-d, 0) + greatest(-e, 0)) / 4) FILTER (e IS NOT NULL), 0), 4) AS erosion,
    round(max(d), 6) AS top, round(min(d), 6) AS bottom, count(*) AS n FROM nx GROUP BY survey, before""")
def section_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = sections.changes(grid(spark, sf_dir), "survey", "linear", STEP)
    return r.select("survey", "before", *[F.round(c, 4).alias(c) for c in ("net", "deposition", "erosion")], F.round("top", 6).alias("top"), F.round("bottom", 6).alias("bottom"), "n")


@query(f"""WITH {PROFILES_SQL}, w AS (SELECT survey, x, z, (coalesce(x - lag(x) OVER o, 0) + coalesce(lead(x) OVER o - x, 0)) / 2 AS w FROM profiles WINDOW o AS (PARTITION BY survey ORDER BY x))
SELECT survey, count(*) AS n, round(sum(w), 6) AS width, round(sum(w * (z - 900)), 4) AS area, round(sum(w * (z - 900) * (1 + x / 50)) / nullif(sum(w * (z - 900)), 0), 6) AS velocity FROM w GROUP BY survey""")
def velocity_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each point stands for half the way to its neighbours; velocities weigh by the area under them."""
    p = profiles(spark, sf_dir).withColumn("w", ranks.half_gaps("x", ["survey"])).withColumn("a", F.col("w") * (F.col("z") - 900))
    return p.groupBy("survey").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("w"), 6).alias("width"), F.round(F.sum("a"), 4).alias("area"), F.round(F.try_divide(F.sum(F.col("a") * (1 + F.col("x") / 50)), F.sum("a")), 6).alias("velocity"))


@query(f"""WITH {CHANGE_SQL}, q AS (SELECT survey, quantile_cont(abs(d), 0.75) AS q FROM nx GROUP BY survey), h AS (SELECT survey, k, sign(d)::INT AS side FROM nx JOIN q USING (survey) WHERE round(abs(d), 9) >= round(q, 9) AND d <> 0),
i AS (SELECT survey, side, k, k - row_number() OVER (PARTITION BY survey, side ORDER BY k) AS g FROM h) SELECT survey, side, min(k) AS first, max(k) AS last, count(*) AS length FROM i GROUP BY survey, side, g""")
def hotspots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stretches of the largest quarter of changes with one sign."""
    own = Window.partitionBy("k").orderBy("survey")
    d = grid(spark, sf_dir).select("survey", "k", (F.col("linear") - F.lag("linear").over(own)).alias("d")).where("d IS NOT NULL")
    q = d.groupBy("survey").agg(F.percentile(F.abs("d"), 0.75).alias("q"))
    rows = d.join(q, "survey").withColumn("side", F.signum("d").cast("int"))
    return ranks.runs(rows, ["survey", "side"], "k", (F.round(F.abs("d"), 9) >= F.round("q", 9)) & (F.col("d") != 0))


@query(f"""WITH {PROFILES_SQL}, s AS (SELECT survey, x, z, z - 2 * lag(z) OVER w + lag(z, 2) OVER w AS second, row_number() OVER w - 1 AS i FROM profiles WINDOW w AS (PARTITION BY survey ORDER BY x))
SELECT survey, round(sqrt(avg(second ** 2)), 6) AS roughness, min(z) AS lowest, min_by(x, (z, x)) AS lowest_at, count(DISTINCT i // 5 % 4) AS folds FROM s GROUP BY survey""")
def fit_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Roughness (second differences), the lowest point, and blocked folds of five neighbours."""
    own = Window.partitionBy("survey").orderBy("x")
    p = profiles(spark, sf_dir).withColumns({"second": F.col("z") - 2 * F.lag("z").over(own) + F.lag("z", 2).over(own), "fold": F.floor((F.row_number().over(own) - 1) / 5) % 4})
    return p.groupBy("survey").agg(F.round(F.sqrt(F.avg(F.col("second") * F.col("second"))), 6).alias("roughness"), F.min("z").alias("lowest"), F.min_by("x", F.struct("z", "x")).alias("lowest_at"), F.count_distinct("fold").alias("folds"))
