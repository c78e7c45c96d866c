"""Compositions and labelled rows: log-ratios, association, classification, clusters, regressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewater.operators import compositions as comp
from tidewater.operators import models, ranks
from tidewater.plans.common import Plan, pct
from tidewater.sources.tables import ANSWERS_SQL, COMP_SQL, PARTS, answers, composition

plan = Plan()
query = plan.query
QUERIES, ORACLES = plan.queries, plan.oracles

CLR_SQL = COMP_SQL + """, shifted AS (SELECT *, (v + 0.01::DOUBLE) / sum(v + 0.01::DOUBLE) OVER (PARTITION BY id) AS s FROM comp),
clr AS (SELECT id, artifact, glass, weathered, part, ln(s) - avg(ln(s)) OVER (PARTITION BY id) AS c, ln(v + 0.01::DOUBLE) - avg(ln(v + 0.01::DOUBLE)) OVER (PARTITION BY id) AS late FROM shifted)"""


def ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    return composition(spark, sf_dir).withColumns({"c": comp.clr("parts"), "late": comp.clr("parts", before_closure=False)})


@query(f"WITH {CLR_SQL} SELECT id, part::INT AS part, round(c, 6) AS clr, round(late, 6) AS clr_late FROM clr")
def clr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both conventions: the pseudocount before closure and after it."""
    rows = ratios(spark, sf_dir).select("id", F.posexplode(F.arrays_zip("c", "late")))
    return rows.select("id", (F.col("pos") + 1).alias("part"), F.round("col.c", 6).alias("clr"), F.round("col.late", 6).alias("clr_late"))


EFFECT_SQL = CLR_SQL + """, m AS (SELECT glass, part, median(c) FILTER (weathered = 1) - median(c) FILTER (weathered = 0) AS raw FROM clr GROUP BY ALL),
effect AS (SELECT glass, part, greatest(-2.5::DOUBLE, least(2.5::DOUBLE, raw)) AS effect FROM m)"""


def effects(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = comp.long(ratios(spark, sf_dir), "c", "glass", "weathered")
    medians = ranks.quantiles(rows, ["glass", "part", "weathered"], "v", {"m": 0.5})
    m = lambda w: F.max(F.when(F.col("weathered") == w, F.col("m")))
    return medians.groupBy("glass", "part").agg(F.greatest(F.lit(-2.5), F.least(F.lit(2.5), m(1) - m(0))).alias("effect"))


@query(f"WITH {EFFECT_SQL} SELECT glass, part::INT AS part, round(effect, 6) AS effect FROM effect")
def weathering_effect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return effects(spark, sf_dir).select("glass", "part", F.round("effect", 6).alias("effect"))


@query(f"""WITH {EFFECT_SQL}, b AS (SELECT id, part, exp(c - effect) AS e FROM clr JOIN effect USING (glass, part) WHERE weathered = 1)
SELECT id, part::INT AS part, round(100 * e / sum(e) OVER (PARTITION BY id), 6) AS predicted FROM b""")
def inverse_prediction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weathered samples without the effect, as closed compositions."""
    e = effects(spark, sf_dir).groupBy("glass").agg(F.transform(F.array_sort(F.collect_list(F.struct("part", "effect"))), lambda s: s["effect"]).alias("e"))  # 14 numbers a group
    rows = ratios(spark, sf_dir).where("weathered = 1").join(F.broadcast(e), "glass").withColumn("p", comp.from_clr(F.zip_with("c", "e", lambda a, b: a - b)))
    return comp.long(rows, "p", "id").select("id", "part", F.round("v", 6).alias("predicted"))


@query(f"""WITH {ANSWERS_SQL}, t AS (SELECT lang, y, count(*) AS n FROM answers GROUP BY ALL), m AS (SELECT *, sum(n) OVER (PARTITION BY lang) AS ra, sum(n) OVER (PARTITION BY y) AS rb, sum(n) OVER () AS t FROM t),
s AS (SELECT sum(n * n / (ra * rb)) AS s, sum(n)::BIGINT AS n, count(DISTINCT lang) AS ka, count(DISTINCT y) AS kb FROM m)
SELECT round(n * (s - 1), 6) AS chi2, (ka - 1) * (kb - 1) AS dof, n, round(sqrt(n * (s - 1) / (n * (least(ka, kb) - 1))), 6) AS cramers_v FROM s""")
def chi_square(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Association of language and quality."""
    t = answers(spark, sf_dir).groupBy("lang", "y").agg(F.count(F.lit(1)).alias("n"))
    r = models.chi_square(t, "lang", "y", "n")
    return r.select(F.round("chi2", 6).alias("chi2"), "dof", "n", F.round("cramers_v", 6).alias("cramers_v"))


@query(f"""WITH {CLR_SQL}, p AS (SELECT glass, part, abs(avg(c) FILTER (weathered = 1) - avg(c) FILTER (weathered = 0)) AS d FROM clr GROUP BY ALL), q AS (SELECT glass, part, round(exp(-4 * d), 9) AS p FROM p),
k AS (SELECT *, row_number() OVER (PARTITION BY glass ORDER BY p, part) AS k, count(*) OVER (PARTITION BY glass) AS m FROM q)
SELECT glass, part::INT AS part, p, round(least(1, min(p * m / k) OVER (PARTITION BY glass ORDER BY k DESC)), 9) AS q FROM k""")
def bh_adjust(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Adjusted probabilities (here of a stand-in statistic, so that SQL can tell them too)."""
    rows = comp.long(ratios(spark, sf_dir), "c", "glass", "weathered")
    m = lambda w: F.avg(F.when(F.col("weathered") == w, F.col("v")))
    p = rows.groupBy("glass", "part").agg(F.round(F.exp(-4 * F.abs(m(1) - m(0))), 9).alias("p"))
    return ranks.adjusted_p(p, "p", ["glass"], "q").withColumn("q", F.round("q", 9))


@query(f"""WITH {CLR_SQL}, g AS (SELECT part, c AS s, count(*) AS n, sum(glass) AS pos FROM (SELECT part, round(c, 6) AS c, glass FROM clr) GROUP BY ALL),
w AS (SELECT *, sum(pos) OVER (PARTITION BY part) AS tp0, sum(n) OVER (PARTITION BY part) AS n0, coalesce(sum(pos) OVER o, 0) AS fn, coalesce(sum(n) OVER o, 0) AS below, lag(s) OVER (PARTITION BY part ORDER BY s) AS before, lead(s) OVER (PARTITION BY part ORDER BY s) IS NULL AS last FROM g WINDOW o AS (PARTITION BY part ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT part, coalesce((before + s) / 2, s - 1e-9) AS t, tp0, n0, fn, below FROM w UNION ALL SELECT part, s + 1e-9, tp0, n0, tp0, n0 FROM w WHERE last),
e AS (SELECT part, t, round(coalesce((tp0 - fn) / nullif(tp0, 0), 0) + coalesce((below - fn) / nullif(n0 - tp0, 0), 0) - 1, 9) AS youden, round((tp0 - fn + below - fn) / n0, 9) AS accuracy FROM t),
r AS (SELECT *, row_number() OVER (PARTITION BY part ORDER BY youden DESC, accuracy DESC, t) AS k FROM e)
SELECT part::INT AS part, round(t, 8) AS threshold, youden, accuracy FROM r WHERE k = 1""")
def youden(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best single threshold of each part's log-ratio for the glass type."""
    rows = comp.long(ratios(spark, sf_dir), "c", "glass").withColumn("v", F.round("v", 6))
    return comp.best_threshold(rows, "v", "glass", "part").select("part", F.round("threshold", 8).alias("threshold"), "youden", "accuracy")


CENTRE_SQL = CLR_SQL + """, cen AS (SELECT glass, part, sum(c) AS s, count(*) AS n FROM clr GROUP BY ALL),
dist AS (SELECT x.id, x.glass, k.glass AS k, sum((x.c - CASE WHEN x.glass = k.glass THEN (k.s - x.c) / (k.n - 1) ELSE k.s / k.n END) ** 2) AS d FROM clr x JOIN cen k USING (part) GROUP BY ALL),
two AS (SELECT id, glass, min_by(k, (d, k)) AS predicted, max(d) - min(d) AS margin FROM dist GROUP BY ALL)"""


@query(f"WITH {CENTRE_SQL} SELECT id, glass, predicted, round(margin, 6) AS margin FROM two")
def loo_centroid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nearest centre with the sample itself left out of its own one, and the margin to the second."""
    rows = ratios(spark, sf_dir).select("id", "glass", "c")
    sums = comp.long(rows, "c", "glass").groupBy("glass", "part").agg(F.sum("v").alias("s"), F.count(F.lit(1)).alias("n"))
    centres = sums.groupBy(F.col("glass").alias("k")).agg(F.transform(F.array_sort(F.collect_list(F.struct("part", "s"))), lambda x: x["s"]).alias("s"), F.max("n").alias("n"))
    # two centres of 14 numbers: the classes are a fixed list
    centres = F.broadcast(centres.agg(F.collect_list(F.struct("k", "s", "n")).alias("ks")))
    pairs = rows.join(centres).select("id", "glass", "c", F.explode("ks").alias("k")).select("id", "glass", "c", "k.*")
    own = F.col("glass") == F.col("k")
    centre = F.when(own, F.zip_with("s", "c", lambda s, c: (s - c) / (F.col("n") - 1))).otherwise(F.transform("s", lambda s: s / F.col("n")))
    d = pairs.withColumn("d", comp.squared("c", centre))
    return d.groupBy("id", "glass").agg(F.min_by("k", F.struct("d", "k")).alias("predicted"), F.round(F.max("d") - F.min("d"), 6).alias("margin"))


@query(f"""WITH {CENTRE_SQL}, n AS (SELECT glass AS a, predicted AS b, count(*) AS n FROM two GROUP BY ALL), s AS (SELECT sum(n * (n - 1) / 2) AS sij, any_value((SELECT sum(t * (t - 1) / 2) FROM (SELECT sum(n) AS t FROM n GROUP BY a))) AS sa,
    any_value((SELECT sum(t * (t - 1) / 2) FROM (SELECT sum(n) AS t FROM n GROUP BY b))) AS sb, sum(n) AS n FROM n)
SELECT n::BIGINT AS n, round((sij - sa * sb / (n * (n - 1) / 2)) / ((sa + sb) / 2 - sa * sb / (n * (n - 1) / 2)), 6) AS ari FROM s""")
def ari(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Adjusted Rand index of the types and the predicted ones."""
    t = loo_centroid(spark, sf_dir).groupBy("glass", "predicted").agg(F.count(F.lit(1)).alias("n"))
    two = lambda c: c * (c - 1) / 2
    t = t.withColumns({"ra": F.sum("n").over(Window.partitionBy("glass")), "rb": F.sum("n").over(Window.partitionBy("predicted"))})
    # a margin's pairs, shared out over the cells of its row
    s = t.agg(F.sum(two(F.col("n"))).alias("sij"), F.sum(two(F.col("ra")) * F.col("n") / F.col("ra")).alias("sa"), F.sum(two(F.col("rb")) * F.col("n") / F.col("rb")).alias("sb"), F.sum("n").alias("n"))
    expected = F.col("sa") * F.col("sb") / two(F.col("n"))
    return s.select("n", F.round((F.col("sij") - expected) / ((F.col("sa") + F.col("sb")) / 2 - expected), 6).alias("ari"))


@query(f"""WITH {CLR_SQL} SELECT a.glass, a.part::INT AS i, b.part::INT AS j, count(*) AS n, round(corr(a.c, b.c), 5) AS r, abs(round(corr(a.c, b.c), 5)) >= 0.3 AS strong FROM clr a JOIN clr b ON a.id = b.id AND a.part < b.part GROUP BY ALL""")
def corr_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Correlations of the log-ratios of all pairs of parts, by type."""
    r = comp.pairs(ratios(spark, sf_dir), "c", PARTS, "glass")
    return r.select("glass", "i", "j", "n", F.round("r", 5).alias("r"), (F.abs(F.round("r", 5)) >= 0.3).alias("strong"))


@query(f"""WITH {CLR_SQL}, r AS (SELECT a.glass, a.part AS i, b.part AS j, corr(a.c, b.c) AS r FROM clr a JOIN clr b ON a.id = b.id AND a.part < b.part GROUP BY ALL)
SELECT count(*) AS pairs, round(sqrt(sum((x.r - y.r) ** 2)), 6) AS frobenius, round(max(abs(x.r - y.r)), 6) AS largest FROM r x JOIN r y ON x.glass = 0 AND y.glass = 1 AND x.i = y.i AND x.j = y.j""")
def corr_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = comp.pairs(ratios(spark, sf_dir), "c", PARTS, "glass")
    x = r.groupBy("i", "j").agg(F.sum(F.when(F.col("glass") == 0, F.col("r")).otherwise(-F.col("r"))).alias("d"))
    return x.agg(F.count(F.lit(1)).alias("pairs"), F.round(F.sqrt(F.sum(F.col("d") * F.col("d"))), 6).alias("frobenius"), F.round(F.max(F.abs("d")), 6).alias("largest"))


SCORE_SQL = ANSWERS_SQL + ", scored AS (SELECT doc_id, y, round(1 / (1 + exp(-(size - 7) * 0.8)), 4) AS score FROM answers)"


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return answers(spark, sf_dir).select("doc_id", "y", F.round(1 / (1 + F.exp(-(F.col("size") - 7) * 0.8)), 4).alias("score"))


@query(f"""WITH {SCORE_SQL}, r AS (SELECT y, score, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2 AS rk FROM scored)
SELECT round((sum(CASE WHEN y = 1 THEN rk ELSE 0 END) - count(*) FILTER (y = 1) * (count(*) FILTER (y = 1) + 1) / 2) / (count(*) FILTER (y = 1) * count(*) FILTER (y = 0)), 6) AS auc, round(avg((score - y) ** 2), 6) AS brier,
    round(-avg(y * ln(least(1 - 1e-12, greatest(1e-12, score))) + (1 - y) * ln(1 - least(1 - 1e-12, greatest(1e-12, score)))), 6) AS log_loss, round(avg(((score >= 0.5)::INT = y)::INT), 6) AS accuracy FROM r""")
def auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = models.ranked_auc(scored(spark, sf_dir), "score", "y")
    return r.select(*[F.round(c, 6).alias(c) for c in ("auc", "brier", "log_loss", "accuracy")])


@query(f"""WITH {ANSWERS_SQL}, r AS (SELECT lang, {pct("size", "lang")} AS a, {pct("doc_id", "lang")} AS b FROM answers) SELECT lang, count(*) AS n, round(corr(a, b), 6) AS rho FROM r GROUP BY lang""")
def spearman(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = answers(spark, sf_dir).select("lang", "size", "doc_id")
    rows = ranks.percent_ranks(ranks.percent_ranks(rows, "size", "a", "lang"), "doc_id", "b", "lang")
    return rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.round(F.corr("a", "b"), 6).alias("rho"))


@query(f"""WITH {ANSWERS_SQL}, x AS (SELECT y::DOUBLE AS y, size AS a, (lang = 'en')::INT::DOUBLE AS b FROM answers),
s AS (SELECT count(*)::DOUBLE AS n, sum(a) AS sa, sum(b) AS sb, sum(y) AS sy, sum(a * a) AS aa, sum(b * b) AS bb, sum(a * b) AS ab, sum(a * y) AS ay, sum(b * y) AS yb FROM x),
c AS (SELECT n, sa, sb, sy, aa - sa * sa / n AS caa, bb - sb * sb / n AS cbb, ab - sa * sb / n AS cab, ay - sa * sy / n AS cay, yb - sb * sy / n AS cby FROM s),
b AS (SELECT *, (cay * cbb - cby * cab) / (caa * cbb - cab * cab) AS b1, (cby * caa - cay * cab) / (caa * cbb - cab * cab) AS b2 FROM c)
SELECT '(constant)' AS term, round((sy - b1 * sa - b2 * sb) / n, 6) AS coef FROM b UNION ALL SELECT 'a', round(b1, 6) FROM b UNION ALL SELECT 'b', round(b2, 6) FROM b""")
def least_squares(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = answers(spark, sf_dir).select("y", F.col("size").alias("a"), (F.col("lang") == "en").cast("double").alias("b"))
    return models.ridge(x, ["a", "b"], "y").table(spark).select("term", F.round("coef", 6).alias("coef"))


@query()
def logistic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ridge logistic regression with standard errors, and the same by Firth's penalty."""
    x = answers(spark, sf_dir).select("y", F.col("size").alias("a"), (F.col("lang") == "en").cast("double").alias("b"))
    plain = models.logistic(x, ["a", "b"], "y", penalty=1.0).table(spark).withColumn("method", F.lit("ridge"))
    firth = models.logistic(x, ["a", "b"], "y", firth=True).table(spark).withColumn("method", F.lit("firth"))
    bounded = models.logistic(x, ["a", "b"], "y", penalty=1.0, floor={"a": 0.0}).table(spark).withColumn("method", F.lit("bounded"))
    out = plain.unionByName(firth).unionByName(bounded)
    return out.select("method", "term", F.round("coef", 6).alias("coef"), F.round("std_error", 6).alias("std_error"), F.round(F.exp("coef"), 6).alias("odds_ratio"))


@query(f"""WITH {ANSWERS_SQL}, g AS (SELECT source, count(*) AS n, sum(y)::BIGINT AS hits FROM answers GROUP BY source), z AS (SELECT *, 1.959963984540054::DOUBLE AS z, hits / n AS p FROM g)
SELECT source, n, hits, round((p + z * z / (2 * n) - z * sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n), 6) AS low, round((p + z * z / (2 * n) + z * sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n), 6) AS high FROM z""")
def wilson(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = answers(spark, sf_dir).groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("y").cast("long")).alias("hits"))
    low, high = models.wilson(F.col("hits"), F.col("n"))
    return g.select("source", "n", "hits", F.round(low, 6).alias("low"), F.round(high, 6).alias("high"))


@query()
def pca2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each sample's place on the two directions of most variance."""
    rows = ratios(spark, sf_dir).select("id", "c")
    mean, vectors, share = models.principal(rows, "c", PARTS)
    score = lambda v: comp.total(F.zip_with(F.zip_with("c", F.array(*map(F.lit, mean.tolist())), lambda a, b: a - b), F.array(*map(F.lit, v.tolist())), lambda a, b: a * b))
    return rows.select("id", *[F.round(score(v), 6).alias(f"pc{i + 1}") for i, v in enumerate(vectors)], *[F.lit(round(float(s), 6)).alias(f"share{i + 1}") for i, s in enumerate(share)])


@query(f"""WITH {CLR_SQL}, d AS (SELECT a.id, a.glass, b.id AS o, b.glass AS g, sqrt(sum((a.c - b.c) ** 2)) AS d FROM clr a JOIN clr b USING (part) GROUP BY ALL), m AS (SELECT id, glass, g, CASE WHEN glass = g AND count(*) = 1 THEN 0 ELSE sum(d) / (CASE WHEN glass = g THEN count(*) - 1 ELSE count(*) END) END AS m FROM d GROUP BY id, glass, g),
s AS (SELECT id, glass, max(CASE WHEN g = glass THEN m END) AS a, min(CASE WHEN g <> glass THEN m END) AS b FROM m GROUP BY ALL) SELECT id, glass, round((b - a) / greatest(a, b), 6) AS silhouette FROM s""")
def silhouette(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Silhouettes under Euclidean distances; of a sample alone in its group the inner distance is 0."""
    s = comp.silhouettes(ratios(spark, sf_dir), "id", "glass", "c")
    return s.select("id", "glass", F.round("silhouette", 6).alias("silhouette"))
