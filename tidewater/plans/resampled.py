"""What random re-labellings of the rows say of a difference: correlations, means and tables of counts. Each
re-labelling keeps the sizes of the groups."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.operators import compositions as comp
from tidewater.operators import ranks, resampling
from tidewater.plans.common import Plan
from tidewater.plans.glass import CLR_SQL, ratios
from tidewater.sources.tables import ANSWERS_SQL, PARTS, answers

plan = Plan()
query = plan.query
QUERIES, ORACLES = plan.queries, plan.oracles

DRAWS = 5_000
PAIRS = [(i, j) for i in range(1, PARTS + 1) for j in range(i + 1, PARTS + 1)]
ZERO_RATE = 0.75  #: a pair is reliable if each of its parts is there in so many samples that no more than this share lacks it


def labels_sql(rows: str, flag: str, draws: int, id: str = "id") -> str:
    """Tables `labels` (id, d, g): draw 0 has the rows' own flag, the others one of as many rows."""
    return f"""ids AS (SELECT {id} AS id, {flag} AS flag, {resampling.row_sql(id)} AS h FROM {rows}),
drawn AS (SELECT id, d, row_number() OVER (PARTITION BY d ORDER BY {resampling.place_sql("h", "d")}, id) AS k FROM ids, range(1, {draws + 1}) r(d)),
labels AS (
    SELECT id, d, (k <= (SELECT sum(flag) FROM ids))::INT AS g FROM drawn
    UNION ALL SELECT id, 0, flag FROM ids)"""


WIDE_SQL = CLR_SQL + ", wide AS (SELECT id, glass, " + ", ".join(f"max(c) FILTER (part = {i}) AS c{i}" for i in range(1, PARTS + 1)) + " FROM clr GROUP BY ALL)"
ABSENT_SQL = "absent AS (SELECT glass, part, avg((v <= 1e-12)::INT) AS z FROM comp GROUP BY ALL)"
CORR_SQL = f"""{WIDE_SQL}, {labels_sql("wide", "glass", DRAWS)},
rs AS (SELECT d, g, {", ".join(f"corr(c{i}, c{j}) AS r{i}_{j}" for i, j in PAIRS)} FROM labels JOIN wide USING (id) GROUP BY d, g),
long AS (UNPIVOT rs ON {", ".join(f"r{i}_{j}" for i, j in PAIRS)} INTO NAME pair VALUE r),
ds AS (SELECT d, pair, max(r) FILTER (g = 1) AS one, max(r) FILTER (g = 0) AS other, max(r) FILTER (g = 1) - max(r) FILTER (g = 0) AS x FROM long GROUP BY ALL),
own AS (SELECT pair, one, other, x AS difference FROM ds WHERE d = 0)"""


def labellings(spark: SparkSession, sf_dir: str, draws: int) -> tuple[DataFrame, np.ndarray, np.ndarray]:
    """draw, differences, norm of each random labelling; the types' own correlations (flagged first)."""
    rows = ratios(spark, sf_dir).select("id", "glass", "c")
    own = rows.groupBy("glass").agg(F.count(F.lit(1)).alias("n"), F.array(*[F.sum(x) for x in _squares("c")]).alias("s")).collect()  # a row for each of two types
    n, sums = {r.glass: r.n for r in own}, {r.glass: np.array(r.s) for r in own}
    whole, size = sum(sums.values()), n[1]
    drawn = resampling.subset_sums(rows, "id", "c", size, draws, resampling.squares)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = b.column("sums").flatten().to_numpy().reshape(b.num_rows, -1)
            d = resampling.correlations(s, size, PARTS) - resampling.correlations(whole - s, n[0], PARTS)
            yield pa.RecordBatch.from_arrays([b.column("draw"), pa.array(d.tolist(), pa.list_(pa.float64())), pa.array(np.sqrt((d * d).sum(1)))], names=["draw", "differences", "norm"])

    both = [resampling.correlations(sums[g][None, :], n[g], PARTS)[0] for g in (1, 0)]
    return drawn.mapInArrow(run, "draw int, differences array<double>, norm double"), *both


def _squares(values: str) -> list:
    x = [F.element_at(values, i + 1) for i in range(PARTS)]
    return [*x, *(x[i] * x[j] for i in range(PARTS) for j in range(i, PARTS))]


@query(f"""WITH {CORR_SQL}, {ABSENT_SQL},
p AS (
    SELECT pair, one, other, difference, ((SELECT count(*) FROM ds WHERE ds.pair = own.pair AND d > 0 AND abs(x) >= abs(difference) - 1e-12) + 1) / {DRAWS + 1}.0::DOUBLE AS p FROM own),
q AS (SELECT *, split_part(substr(pair, 2), '_', 1)::INT AS i, split_part(pair, '_', 2)::INT AS j, row_number() OVER (ORDER BY p, pair) AS k, count(*) OVER () AS m FROM p),
z AS (SELECT part, max(z) AS z FROM absent GROUP BY part)
SELECT i, j, round(one, 6) AS one, round(other, 6) AS other, round(difference, 6) AS difference, round(p, 9) AS p,
    round(least(1, min(p * m / k) OVER (ORDER BY k DESC)), 9) AS q, greatest(a.z, b.z) <= {ZERO_RATE} AS reliable
FROM q JOIN z a ON a.part = i JOIN z b ON b.part = j""")
def correlation_permutation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Differences of the two types' correlations for all pairs of parts, held against random labellings of
    the samples and adjusted; whether both parts are there often enough in both types."""
    drawn, one, other = labellings(spark, sf_dir, DRAWS)
    own = spark.createDataFrame([(i, j, float(a), float(b), float(a - b)) for (i, j), a, b in zip(PAIRS, one, other, strict=True)], "i int, j int, one double, other double, difference double")
    each = drawn.select(F.posexplode("differences").alias("k", "x"))
    named = spark.createDataFrame([(k, i, j) for k, (i, j) in enumerate(PAIRS)], "k int, i int, j int").join(own, ["i", "j"])
    p = resampling.share_beyond(each.join(F.broadcast(named), "k"), F.abs("x"), F.abs("difference"), "i", "j", "one", "other", "difference")
    # ties in p give the same adjusted value in any order
    q = ranks.adjusted_p(p.withColumn("all", F.lit(1)), "p", ["all"], "q")
    absent = comp.long(ratios(spark, sf_dir), "parts", "glass").groupBy("glass", "part").agg(F.avg((F.col("v") <= 1e-12).cast("double")).alias("z")).groupBy("part").agg(F.max("z").alias("z"))
    a, b = (F.broadcast(absent.select(F.col("part").alias(c), F.col("z").alias(f"z{c}"))) for c in ("i", "j"))  # 14 rows
    q = q.join(a, "i").join(b, "j")
    return q.select("i", "j", *[F.round(c, 6).alias(c) for c in ("one", "other", "difference")], F.round("p", 9).alias("p"), F.round("q", 9).alias("q"), (F.greatest("zi", "zj") <= ZERO_RATE).alias("reliable"))


@query(f"""WITH {CORR_SQL}, norms AS (SELECT d, sqrt(sum(x * x)) AS norm FROM ds GROUP BY d), o AS (SELECT norm AS observed FROM norms WHERE d = 0),
n AS (SELECT count(*) FILTER (flag = 1) AS ones, count(*) FILTER (flag = 0) AS others FROM ids)
SELECT round(any_value(observed), 6) AS observed, round((count(*) FILTER (norm >= observed - 1e-12) + 1) / {DRAWS + 1}.0::DOUBLE, 9) AS p, round(avg(norm), 6) AS mean, round(quantile_cont(norm, 0.95), 6) AS p95,
    count(*) AS draws, any_value(ones) AS ones, any_value(others) AS others
FROM norms, o, n WHERE d > 0""")
def correlation_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far apart the two types' correlations are as a whole: the root of the sum of squared differences,
    held against random labellings."""
    drawn, one, other = labellings(spark, sf_dir, DRAWS)
    observed = float(np.sqrt(((one - other) ** 2).sum()))
    n = ratios(spark, sf_dir).agg(F.count_if(F.col("glass") == 1).alias("ones"), F.count_if(F.col("glass") == 0).alias("others"))
    r = drawn.agg(
        F.round(F.lit(observed), 6).alias("observed"),
        F.round((F.count_if(F.col("norm") >= observed - 1e-12) + 1) / (F.count(F.lit(1)) + 1), 9).alias("p"),
        F.round(F.avg("norm"), 6).alias("mean"),
        F.round(F.percentile("norm", F.lit(0.95)), 6).alias("p95"),  # of one number a draw
        F.count(F.lit(1)).alias("draws"),
    )
    return r.join(F.broadcast(n))


@query(f"""WITH {CLR_SQL}, flags AS (SELECT DISTINCT id, weathered FROM clr), {labels_sql("flags", "weathered", DRAWS)},
m AS (SELECT d, part, avg(c) FILTER (g = 1) - avg(c) FILTER (g = 0) AS x FROM clr JOIN labels USING (id) GROUP BY ALL),
p AS (SELECT part, max(x) FILTER (d = 0) AS difference, (count(*) FILTER (d > 0 AND abs(x) >= abs(o) - 1e-12) + 1) / {DRAWS + 1}.0::DOUBLE AS p
    FROM m JOIN (SELECT part, x AS o FROM m WHERE d = 0) USING (part) GROUP BY part),
q AS (SELECT *, row_number() OVER (ORDER BY p, part) AS k, count(*) OVER () AS n FROM p)
SELECT part::INT AS part, round(difference, 9) AS difference, round(p, 9) AS p, round(least(1, min(p * n / k) OVER (ORDER BY k DESC)), 9) AS q FROM q""")
def permutation_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Differences of mean log-ratios between weathered and clean samples, held against random flaggings of as
    many samples and adjusted."""
    rows = ratios(spark, sf_dir).select("id", "weathered", "c")
    own = comp.long(rows, "c", "weathered").groupBy("part").agg(
        F.sum("v").alias("total"), F.count(F.lit(1)).alias("n"), F.sum("weathered").alias("size"), (F.avg(F.when(F.col("weathered") == 1, F.col("v"))) - F.avg(F.when(F.col("weathered") == 0, F.col("v")))).alias("difference")
    )
    size = rows.agg(F.sum("weathered")).first()[0]
    each = resampling.subset_sums(rows, "id", "c", size, DRAWS).select(F.posexplode("sums").alias("k", "s")).withColumn("part", F.col("k") + 1)
    made = F.col("s") / F.col("size") - (F.col("total") - F.col("s")) / (F.col("n") - F.col("size"))
    p = resampling.share_beyond(each.join(F.broadcast(own), "part"), F.abs(made), F.abs("difference"), "part", "difference")
    q = ranks.adjusted_p(p.withColumn("all", F.lit(1)), "p", ["all"], "q")
    return q.select("part", *[F.round(c, 9).alias(c) for c in ("difference", "p", "q")])


FACTORS = ("lang", "source", "toxic")


@query(f"""WITH {ANSWERS_SQL}, {labels_sql("answers", "y", DRAWS, "doc_id")},
f AS ({" UNION ALL ".join(f"SELECT '{f}' AS factor, doc_id AS id, {f}::VARCHAR AS level FROM answers" for f in FACTORS)}),
t AS (SELECT d, factor, level, count(*) AS n, sum(g)::DOUBLE AS hits FROM labels JOIN f USING (id) GROUP BY ALL),
s AS (SELECT *, sum(hits) OVER (PARTITION BY d, factor) / sum(n) OVER (PARTITION BY d, factor) AS q FROM t),
x AS (SELECT d, factor, sum((hits - n * q) ** 2 / (n * q * (1 - q))) AS chi2, count(*) AS levels, sum(n)::BIGINT AS n FROM s GROUP BY ALL),
o AS (SELECT factor, chi2 AS observed FROM x WHERE d = 0)
SELECT factor, round(any_value(observed), 6) AS chi2, any_value(levels) - 1 AS dof, any_value(levels) AS levels, any_value(n) AS n, round((count(*) FILTER (d > 0 AND chi2 >= observed - 1e-9) + 1) / {DRAWS + 1}.0::DOUBLE, 9) AS p,
    round(sqrt(any_value(observed) / any_value(n)), 6) AS cramers_v
FROM x JOIN o USING (factor) GROUP BY factor""")
def association_permutation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """chi2 of quality with each factor, held against random choices of as many good documents. Levels of
    factors are a fixed list; all factors see the same choices."""
    rows = answers(spark, sf_dir)
    each = rows.select(F.explode(F.array(*[F.struct(F.lit(f).alias("factor"), F.col(f).cast("string").alias("level")) for f in FACTORS])).alias("f"), "y")
    found = each.groupBy("f.factor", "f.level").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("hits")).orderBy("factor", "level").collect()
    n, size = rows.count(), rows.agg(F.sum("y")).first()[0]
    marks = F.array(*[F.col(r.factor).cast("string").eqNullSafe(r.level).cast("double") for r in found])
    q = size / n
    spread = F.array(*[F.lit(r.n * q * (1 - q)) for r in found])
    mean = F.array(*[F.lit(r.n * q) for r in found])
    drawn = resampling.subset_sums(rows.select("doc_id", marks.alias("v")), "doc_id", "v", size, DRAWS)
    parts = drawn.select("draw", F.posexplode(F.zip_with(F.zip_with("sums", mean, lambda a, b: (a - b) * (a - b)), spread, lambda a, b: a / b)).alias("k", "x"))
    one = {f: [r for r in found if r.factor == f] for f in FACTORS}
    own = spark.createDataFrame([(f, sum((r.hits - r.n * q) ** 2 / (r.n * q * (1 - q)) for r in own), len(own)) for f, own in one.items()], "factor string, observed double, levels long")
    of = spark.createDataFrame([(k, r.factor) for k, r in enumerate(found)], "k int, factor string")
    chi2 = parts.join(F.broadcast(of), "k").groupBy("draw", "factor").agg(F.sum("x").alias("chi2")).join(F.broadcast(own), "factor")
    p = chi2.groupBy("factor", "observed", "levels").agg(((F.count_if(F.col("chi2") >= F.col("observed") - 1e-9) + 1) / (F.count(F.lit(1)) + 1)).alias("p"))
    return p.select("factor", F.round("observed", 6).alias("chi2"), (F.col("levels") - 1).alias("dof"), "levels", F.lit(n).cast("long").alias("n"), F.round("p", 9).alias("p"), F.round(F.sqrt(F.col("observed") / n), 6).alias("cramers_v"))
