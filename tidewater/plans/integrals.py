"""Integrals of what was measured now and then, with the intervals that their models leave."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.functions.digests import digest_sql
from tidewater.operators import integrals, resampling
from tidewater.operators.ordered import micros
from tidewater.plans.common import Plan
from tidewater.sources.tables import HYDRO_SQL, hydro

plan = Plan()
query = plan.query
QUERIES, ORACLES = plan.queries, plan.oracles

HOURS, DRAWS = (24, 72, 168), 500
DAY = 24 * integrals.HOUR

INTEGRAL_SQL = HYDRO_SQL + f""", rows AS (SELECT station, epoch_us(ts) AS t, avg(flow) AS flow, avg(sediment) AS y FROM hydro GROUP BY ALL),
span AS (SELECT min(t) // {DAY} * {DAY} AS a, (max(t) // {DAY} + 1) * {DAY} AS b FROM rows),
wt AS (
    SELECT rows.*, coalesce((t - lag(t) OVER k) / 2e6, (t - a) / 1e6) + coalesce((lead(t) OVER k - t) / 2e6, (b - t) / 1e6) AS w, a AS a0, b AS b0
    FROM rows, span WINDOW k AS (PARTITION BY station ORDER BY t)),
fit AS (
    SELECT station, regr_slope(ln(y), ln(flow)) AS b, regr_intercept(ln(y), ln(flow)) AS a, min(y) AS lo, max(y) AS hi FROM wt WHERE y > 0 AND flow > 0
    GROUP BY station HAVING count(*) >= 3 AND var_pop(ln(flow)) > 1e-12),
r AS (SELECT wt.*, lo, hi, a + b * ln(flow) AS line FROM wt JOIN fit USING (station) WHERE flow > 0),
sure AS (SELECT station, coalesce(sum(w * flow * y) FILTER (y > 0), 0) AS sure, coalesce(sum(w * flow * least(hi, greatest(lo, exp(line)))) FILTER (y IS NULL), 0) AS modelled FROM r GROUP BY station),
hs AS (SELECT unnest({list(HOURS)})::BIGINT AS hours),
miss AS (SELECT r.*, hours, (t - a0) // (hours * {integrals.HOUR}) AS block, (t - a0) % (hours * {integrals.HOUR}) AS at FROM r, hs WHERE y IS NULL),
res AS (SELECT station, t, b0, ln(y) - line AS e FROM r WHERE y > 0),
src AS (SELECT station, hours, t AS begin, row_number() OVER (PARTITION BY station, hours ORDER BY t) - 1 AS source, count(*) OVER (PARTITION BY station, hours) AS sources FROM res, hs WHERE t + hours * {integrals.HOUR} <= b0),
tg AS (SELECT *, {digest_sql("station", "hours", "block")} % {1 << resampling.BITS} AS h FROM (SELECT DISTINCT m.station, m.hours, block, sources FROM miss m JOIN src s ON s.station = m.station AND s.hours = m.hours)),
dr AS (SELECT station, hours, block, d, {resampling.place_sql("h", "d")} % sources AS source FROM tg, range(1, {DRAWS + 1}) q(d)),
pairs AS (SELECT DISTINCT station, hours, block, source FROM dr),
near AS (
    SELECT m.station, m.hours, m.block, p.source, m.t, any_value(m.w * m.flow) AS wf, any_value(m.line) AS line, any_value(lo) AS lo, any_value(hi) AS hi, min_by(e, (abs(x.t - s.begin - m.at), x.t)) AS e
    FROM miss m JOIN pairs p ON p.station = m.station AND p.hours = m.hours AND p.block = m.block JOIN src s ON s.station = p.station AND s.hours = p.hours AND s.source = p.source
        JOIN res x ON x.station = s.station AND x.t >= s.begin AND x.t < s.begin + s.hours * {integrals.HOUR}
    GROUP BY m.station, m.hours, m.block, p.source, m.t),
g AS (SELECT station, hours, block, source, sum(wf * least(hi, greatest(lo, exp(line + e)))) AS g FROM near GROUP BY ALL),
tot AS (SELECT station, hours, d, sum(g) AS total FROM dr JOIN g USING (station, hours, block, source) GROUP BY ALL)"""


@query(f"""WITH {INTEGRAL_SQL} SELECT station, hours::INT AS hours, {DRAWS} AS draws, round((any_value(sure) + any_value(modelled)) / 1e6, 5) AS base, round((any_value(sure) + quantile_cont(total, 0.5)) / 1e6, 5) AS median,
    round((any_value(sure) + quantile_cont(total, 0.025)) / 1e6, 5) AS low, round((any_value(sure) + quantile_cont(total, 0.975)) / 1e6, 5) AS high
FROM tot JOIN sure USING (station) GROUP BY station, hours""")
def integral_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each station's load over the table's days from 500 draws of residuals in blocks of one, three and seven days,
    and its 95 % interval."""
    rows = hydro(spark, sf_dir).groupBy("station", micros("ts").alias("t")).agg(F.avg("flow").alias("flow"), F.avg("sediment").alias("y"))
    span = rows.agg(F.min("t").alias("a"), F.max("t").alias("b")).first()
    if span.a is None:
        return spark.createDataFrame([], "station long, hours int, draws int, base double, median double, low double, high double")
    r = integrals.intervals(rows, "station", span.a // DAY * DAY, (span.b // DAY + 1) * DAY, list(HOURS), DRAWS)
    return r.select("station", "hours", "draws", *[F.round(F.col(c) / 1e6, 5).alias(c) for c in ("base", "median", "low", "high")])
