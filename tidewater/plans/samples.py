"""Labelled samples: which are valid, how far a classification holds under other choices, and random
re-labellings. Random choices come from digests of ids, so that every run, and SQL, makes the same."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewater.functions.digests import digest, digest_sql
from tidewater.operators import compositions as comp
from tidewater.operators import models, ranks
from tidewater.plans.common import Plan
from tidewater.plans.glass import CENTRE_SQL, CLR_SQL, EFFECT_SQL, effects, ratios
from tidewater.sources.tables import ANSWERS_SQL, COMP_SQL, HYDRO_SQL, PARTS, answers, composition, hydro, table

plan = Plan()
query = plan.query
QUERIES, ORACLES = plan.queries, plan.oracles


@query("""WITH s AS (SELECT vec_id AS id, round(30 * list_sum([abs(v::DOUBLE) FOR v IN embedding[1:14]]), 6) AS total FROM embeddings)
SELECT id, total, total BETWEEN 25 AND 55 AS valid, CASE WHEN total < 25 THEN 'low' WHEN total > 55 THEN 'high' ELSE 'valid' END AS state FROM s""")
def valid_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples whose parts sum to what a whole sample has (here 25 to 55)."""
    total = F.round(30 * comp.total(F.transform(F.slice("embedding", 1, PARTS), lambda v: F.abs(v.cast("double")))), 6)
    s = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), total.alias("total"))
    state = F.when(F.col("total") < 25, "low").when(F.col("total") > 55, "high").otherwise("valid")
    return s.select("id", "total", F.col("total").between(25, 55).alias("valid"), state.alias("state"))


@query(f"WITH {ANSWERS_SQL} SELECT doc_id, (lang = 'en')::INT::DOUBLE AS lang_en, (lang = 'es')::INT::DOUBLE AS lang_es, (lang = 'fr')::INT::DOUBLE AS lang_fr, (toxic = 1)::INT::DOUBLE AS toxic_1, (lang = 'en' AND toxic = 1)::INT::DOUBLE AS en_toxic FROM answers")
def factor_design(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A column for each level of the factors but their references (de, not toxic), and one interaction."""
    one = lambda c: c.cast("double")
    lang, toxic = F.col("lang"), F.col("toxic") == 1
    return answers(spark, sf_dir).select("doc_id", *[one(lang == v).alias(f"lang_{v}") for v in ("en", "es", "fr")], one(toxic).alias("toxic_1"), one((lang == "en") & toxic).alias("en_toxic"))


@query(f"""WITH {EFFECT_SQL}, b AS (SELECT id, artifact, glass, part, weathered, exp(CASE WHEN weathered = 1 THEN c - effect ELSE c END) AS e FROM clr JOIN effect USING (glass, part)),
s AS (SELECT id, artifact, glass, part, e / sum(e) OVER (PARTITION BY id) AS v FROM b), am AS (SELECT artifact, part, avg(v) AS v, count(*) AS n FROM s GROUP BY ALL)
SELECT artifact, part::INT AS part, n, round(100 * v / sum(v) OVER (PARTITION BY artifact), 6) AS share FROM am""")
def artifact_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Artifacts' mean compositions, closed again: of clean samples as measured, of weathered ones as
    predicted without the effect."""
    e = effects(spark, sf_dir).groupBy("glass").agg(F.transform(F.array_sort(F.collect_list(F.struct("part", "effect"))), lambda s: s["effect"]).alias("e"))  # 14 numbers a group
    x = F.when(F.col("weathered") == 1, F.zip_with("c", "e", lambda a, b: a - b)).otherwise(F.col("c"))
    rows = ratios(spark, sf_dir).join(F.broadcast(e), "glass").withColumn("p", comp.from_clr(x))
    m = comp.long(rows, "p", "artifact").groupBy("artifact", "part").agg(F.avg("v").alias("v"), F.count(F.lit(1)).alias("n"))
    return m.select("artifact", "part", "n", F.round(100 * F.col("v") / F.sum("v").over(Window.partitionBy("artifact")), 6).alias("share"))


def centre_distances(rows: DataFrame, leave_one_out: bool = True) -> DataFrame:
    """id, glass, k, by_part: squared distances of each sample to the types' centres, part by part. Centres
    are two rows of 14 numbers."""
    sums = comp.long(rows, "c", "glass").groupBy("glass", "part").agg(F.sum("v").alias("s"), F.count(F.lit(1)).alias("n"))
    centres = sums.groupBy(F.col("glass").alias("k")).agg(F.transform(F.array_sort(F.collect_list(F.struct("part", "s"))), lambda x: x["s"]).alias("s"), F.max("n").alias("n"))
    centres = F.broadcast(centres.agg(F.collect_list(F.struct("k", "s", "n")).alias("ks")))
    pairs = rows.select("id", "glass", "c").join(centres).select("id", "glass", "c", F.explode("ks").alias("k")).select("id", "glass", "c", "k.*")
    own = (F.col("glass") == F.col("k")) & F.lit(leave_one_out)
    centre = F.when(own, F.zip_with("s", "c", lambda s, c: (s - c) / (F.col("n") - 1))).otherwise(F.transform("s", lambda s: s / F.col("n")))
    return pairs.select("id", "glass", "k", F.zip_with("c", centre, lambda a, b: (a - b) * (a - b)).alias("by_part"))


def nearest_types(d: DataFrame, value: str, *by: str) -> DataFrame:
    return d.groupBy("id", "glass", *by).agg(F.min_by("k", F.struct(F.round(value, 9).alias("d"), "k")).alias("predicted"))


DROP_SQL = CLR_SQL + """, cen AS (SELECT glass, part, sum(c) AS s, count(*) AS n FROM clr GROUP BY ALL),
pp AS (SELECT x.id, x.glass, k.glass AS k, x.part, (x.c - CASE WHEN x.glass = k.glass THEN (k.s - x.c) / (k.n - 1) ELSE k.s / k.n END) ** 2 AS q, (x.c - k.s / k.n) ** 2 AS w FROM clr x JOIN cen k USING (part)),
tt AS (SELECT id, glass, k, sum(q) AS q, sum(w) AS w FROM pp GROUP BY ALL)"""


@query(f"""WITH {DROP_SQL}, d AS (SELECT id, glass, k, part, t.q - p.q AS d FROM tt t JOIN pp p USING (id, glass, k) UNION ALL SELECT id, glass, k, 0, q FROM tt),
b AS (SELECT id, glass, part, min_by(k, (round(d, 9), k)) AS predicted FROM d GROUP BY ALL), f AS (SELECT id, predicted AS full_predicted FROM b WHERE part = 0)
SELECT part::INT AS part, count(*) AS n, round(avg((predicted = glass)::INT), 6) AS accuracy, count(*) FILTER (predicted <> full_predicted) AS changed FROM b JOIN f USING (id) GROUP BY part""")
def feature_drop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nearest centres, each sample left out of its own, without each part in turn (0: with all)."""
    d = centre_distances(ratios(spark, sf_dir))
    whole = comp.total("by_part")
    each = d.select("id", "glass", "k", F.posexplode(F.concat(F.array(F.lit(0.0)), F.col("by_part"))).alias("part", "q"), whole.alias("t"))
    b = nearest_types(each.withColumn("d", F.col("t") - F.col("q")), "d", "part")
    own = Window.partitionBy("id")
    b = b.withColumn("full", F.max(F.when(F.col("part") == 0, F.col("predicted"))).over(own))
    return b.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg((F.col("predicted") == F.col("glass")).cast("double")), 6).alias("accuracy"), F.count_if(F.col("predicted") != F.col("full")).alias("changed"))


@query(f"""WITH {DROP_SQL}, a AS (SELECT id, glass, min_by(k, (round(w, 9), k)) AS predicted FROM tt GROUP BY ALL), b AS (SELECT id, glass, min_by(k, (round(q, 9), k)) AS predicted FROM tt GROUP BY ALL),
u AS (SELECT 'centre, all in' AS method, * FROM a UNION ALL SELECT 'centre, one out', * FROM b)
SELECT method, count(*) AS n, count(*) FILTER (predicted = glass) AS correct, round(avg((predicted = glass)::INT), 6) AS accuracy, count(*) FILTER (predicted = 1 AND glass = 0) AS false_ones, count(*) FILTER (predicted = 0 AND glass = 1) AS missed_ones FROM u GROUP BY method""")
def classification_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accuracy of the nearest centre within the sample and with each sample left out."""
    rows = ratios(spark, sf_dir)
    parts = []
    for name, out in (("centre, all in", False), ("centre, one out", True)):
        parts.append(nearest_types(centre_distances(rows, out).withColumn("d", comp.total("by_part")), "d").withColumn("method", F.lit(name)))
    both = parts[0].unionByName(parts[1])
    hit, p, g = F.col("predicted") == F.col("glass"), F.col("predicted"), F.col("glass")
    return both.groupBy("method").agg(F.count(F.lit(1)).alias("n"), F.count_if(hit).alias("correct"), F.round(F.avg(hit.cast("double")), 6).alias("accuracy"), F.count_if((p == 1) & (g == 0)).alias("false_ones"), F.count_if((p == 0) & (g == 1)).alias("missed_ones"))


@query(f"""WITH {CLR_SQL}, r AS (SELECT a.part AS i, b.part AS j, corr(a.c, b.c) AS r FROM clr a JOIN clr b ON a.id = b.id AND a.part <> b.part GROUP BY ALL), g AS (SELECT part, avg(c) AS m, var_samp(c) AS v FROM clr GROUP BY part), h AS (SELECT i AS part, avg(abs(r)) AS r FROM r GROUP BY i)
SELECT part::INT AS part, round(m, 6) AS mean, round(v, 6) AS variance, round(r, 5) AS mean_correlation FROM g JOIN h USING (part)""")
def component_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each part's log-ratio: mean, variance, and how strongly it goes with the other parts."""
    rows = ratios(spark, sf_dir)
    g = comp.long(rows, "c").groupBy("part").agg(F.avg("v").alias("mean"), F.var_samp("v").alias("variance"))
    r = comp.pairs(rows, "c", PARTS).select(F.explode(F.array("i", "j")).alias("part"), F.abs("r").alias("r")).groupBy("part").agg(F.avg("r").alias("r"))
    return g.join(r, "part").select("part", F.round("mean", 6).alias("mean"), F.round("variance", 6).alias("variance"), F.round("r", 5).alias("mean_correlation"))


def pseudo_sql(e: float) -> str:
    return f"""s AS (SELECT *, (v + {e}::DOUBLE) / sum(v + {e}::DOUBLE) OVER (PARTITION BY id) AS s FROM comp), clr AS (SELECT id, glass, part, ln(s) - avg(ln(s)) OVER (PARTITION BY id) AS c FROM s), cen AS (SELECT glass, part, avg(c) AS m FROM clr GROUP BY ALL),
d AS (SELECT x.id, x.glass, k.glass AS k, sum((x.c - k.m) ** 2) AS d FROM clr x JOIN cen k USING (part) GROUP BY ALL), b AS (SELECT id, glass, min_by(k, (round(d, 9), k)) AS p FROM d GROUP BY ALL)
SELECT {e}::DOUBLE AS pseudocount, count(*) AS n, round(avg((p = glass)::INT), 6) AS accuracy FROM b"""


@query(" UNION ALL ".join(f"SELECT * FROM (WITH {COMP_SQL}, {pseudo_sql(e)})" for e in (0.005, 0.01, 0.05)))
def pseudocounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accuracy of the nearest centre by the count that stands for absent parts."""
    base, out = composition(spark, sf_dir), None
    for e in (0.005, 0.01, 0.05):
        count = F.lit(e)
        x = comp.closed(F.transform("parts", lambda v: v + count))
        logs = F.transform(x, lambda v: F.log(v))
        c = comp.let(logs, lambda l: comp.let(comp.total(l) / F.size(l), lambda m: F.transform(l, lambda v: v - m)))
        b = nearest_types(centre_distances(base.withColumn("c", c), False).withColumn("d", comp.total("by_part")), "d")
        one = b.agg(F.lit(e).alias("pseudocount"), F.count(F.lit(1)).alias("n"), F.round(F.avg((F.col("predicted") == F.col("glass")).cast("double")), 6).alias("accuracy"))
        out = one if out is None else out.unionByName(one)
    return out


@query(f"""WITH {CENTRE_SQL}, m AS (SELECT *, margin / 14 AS unit FROM two) SELECT id, predicted, round(margin, 6) AS margin, CASE WHEN unit >= 0.2 THEN 'high' WHEN unit >= 0.05 THEN 'medium' ELSE 'low' END AS confidence, CASE WHEN unit < 0.01 THEN 'undecided' WHEN predicted = glass THEN 'agrees' ELSE 'differs' END AS decision FROM m""")
def candidate_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each sample's candidate type by the nearest centre, how sure its margin makes it, and whether that is
    what it was labelled."""
    d = centre_distances(ratios(spark, sf_dir)).withColumn("d", comp.total("by_part"))
    b = d.groupBy("id", "glass").agg(F.min_by("k", F.struct("d", "k")).alias("predicted"), (F.max("d") - F.min("d")).alias("margin"))
    unit = F.col("margin") / 14
    sure = F.when(unit >= 0.2, "high").when(unit >= 0.05, "medium").otherwise("low")
    decision = F.when(unit < 0.01, "undecided").when(F.col("predicted") == F.col("glass"), "agrees").otherwise("differs")
    return b.select("id", "predicted", F.round("margin", 6).alias("margin"), sure.alias("confidence"), decision.alias("decision"))


@query(f"""WITH {HYDRO_SQL}, s AS (SELECT station, k, avg(flow) AS m FROM hydro, range(1, 6) r(k) WHERE {digest_sql("station", "epoch_us(ts)", "k")} % 4 > 0 GROUP BY ALL)
SELECT station, count(*) AS seeds, round(avg(m), 6) AS mean, round(stddev_samp(m), 6) AS sd, round(avg(m) - 1.96 * stddev_samp(m), 5) AS lower FROM s GROUP BY station""")
def seed_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A station's mean flow over five random three quarters of its rows, their spread and a lower bound."""
    from tidewater.operators.ordered import micros

    rows = hydro(spark, sf_dir).withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(5)))).where(F.pmod(digest(F.col("station"), micros("ts"), F.col("k")), F.lit(4)) > 0)
    s = rows.groupBy("station", "k").agg(F.avg("flow").alias("m"))
    return s.groupBy("station").agg(F.count(F.lit(1)).alias("seeds"), F.round(F.avg("m"), 6).alias("mean"), F.round(F.stddev_samp("m"), 6).alias("sd"), F.round(F.avg("m") - 1.96 * F.stddev_samp("m"), 5).alias("lower"))


@query(f"""WITH {ANSWERS_SQL}, s AS (SELECT 'all' AS spec, y, size FROM answers UNION ALL SELECT 'english', y, size FROM answers WHERE lang = 'en' UNION ALL SELECT 'clean', y, size FROM answers WHERE toxic = 0 UNION ALL SELECT 'long', y, size FROM answers WHERE size >= 7)
SELECT spec, count(*) AS n, round(regr_slope(y, size), 6) AS slope, round(regr_intercept(y, size), 6) AS constant, round(regr_r2(y, size), 6) AS r2 FROM s GROUP BY spec""")
def specifications(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same slope under other choices of rows."""
    names = F.array_compact(F.array(F.lit("all"), F.when(F.col("lang") == "en", "english"), F.when(F.col("toxic") == 0, "clean"), F.when(F.col("size") >= 7, "long")))
    s = answers(spark, sf_dir).select(F.explode(names).alias("spec"), F.col("y").cast("double").alias("y"), "size")
    return s.groupBy("spec").agg(F.count(F.lit(1)).alias("n"), F.round(F.regr_slope("y", "size"), 6).alias("slope"), F.round(F.regr_intercept("y", "size"), 6).alias("constant"), F.round(F.regr_r2("y", "size"), 6).alias("r2"))


@query()
def marginal_effects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean probabilities with every row English and with none, and the effect of English and of size, by a
    ridge logistic regression."""
    x = answers(spark, sf_dir).select("y", F.col("size").alias("a"), (F.col("lang") == "en").cast("double").alias("b"))
    fit = models.logistic(x, ["a", "b"], "y", penalty=1.0)
    at = lambda b: models.sigmoid(fit.coef[0] + float(fit.coef[1]) * F.col("a") + float(fit.coef[2]) * b)
    p = at(F.col("b"))
    r = x.agg(F.avg(at(F.lit(0.0))).alias("others"), F.avg(at(F.lit(1.0))).alias("english"), F.avg(p * (1 - p) * float(fit.coef[1])).alias("size_effect"))
    return r.select(F.round("others", 6).alias("others"), F.round("english", 6).alias("english"), F.round(F.col("english") - F.col("others"), 6).alias("difference"), F.round("size_effect", 6).alias("size_effect"))
