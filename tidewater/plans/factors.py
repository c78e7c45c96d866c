"""What factors say of an outcome: draws from fitted models, and tails of the tests' distributions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.functions import tails
from tidewater.operators import factors, models, ranks
from tidewater.plans.common import Plan
from tidewater.sources.tables import answers

plan = Plan()
query = plan.query
QUERIES, ORACLES = plan.queries, plan.oracles

DRAWS = 2_000
REFERENCES = {"lang": "de", "toxic": "0", "band": "short"}


def design(spark: SparkSession, sf_dir: str) -> factors.Design:
    band = F.when(F.col("size") < 6, "short").when(F.col("size") < 8, "middle").otherwise("long")
    return factors.cells(answers(spark, sf_dir).withColumn("band", band), "y", REFERENCES)


@query()
def factor_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a logistic model of quality loses without language, toxicity or length, against 2,000 draws from the
    model without it, and the large-sample chance of such a loss."""
    r = factors.deviances(spark, design(spark, sf_dir), DRAWS)
    return r.select("factor", F.round("deviance", 6).alias("deviance"), "dof", F.round("p", 6).alias("p"), F.round(tails.chi_square_tail("deviance", "dof"), 6).alias("chi_square_p"), "settled")


@query()
def coefficient_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intervals of all coefficients of that model from 2,000 draws, and their odds ratios."""
    r = factors.coefficients(spark, design(spark, sf_dir), DRAWS)
    return r.select("term", *[F.round(c, 5).alias(c) for c in ("coef", "low", "high")], F.round(F.exp("coef"), 5).alias("odds_ratio"), "settled")


@query()
def likelihood_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether features say more than those before them: twice the gain in log-likelihood, and its chance."""
    x = answers(spark, sf_dir).select("y", F.col("size").alias("a"), *[(F.col("lang") == v).cast("double").alias(v) for v in ("en", "es", "fr")])
    sets = [[], ["a"], ["a", "en", "es", "fr"]]
    fits = [models.logistic(x, names, "y") for names in sets]
    ll = [F.sum(F.col("y") * F.log(models.sigmoid(m.column())) + (1 - F.col("y")) * F.log(1 - models.sigmoid(m.column()))) for m in fits]
    tests = [(2, 0), (2, 1), (1, 0)]
    rows = x.agg(*[v.alias(f"l{k}") for k, v in enumerate(ll)]).select(
        F.explode(F.array(*[F.struct(F.lit("+".join(sets[i])).alias("model"), F.lit("+".join(sets[j])).alias("against"), F.lit(len(sets[i]) - len(sets[j])).alias("dof"), (2 * (F.col(f"l{i}") - F.col(f"l{j}"))).alias("statistic")) for i, j in tests])).alias("t")
    ).select("t.*")
    return rows.select("model", "against", "dof", F.round("statistic", 6).alias("statistic"), F.round(tails.chi_square_tail("statistic", "dof"), 9).alias("p"))


@query()
def spearman_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rank correlations of length and place by language, and how often ranks without any relation have as much."""
    rows = answers(spark, sf_dir).select("lang", "size", "doc_id")
    rows = ranks.percent_ranks(ranks.percent_ranks(rows, "size", "a", "lang"), "doc_id", "b", "lang")
    r = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.corr("a", "b").alias("rho"))
    t = F.col("rho") * F.sqrt((F.col("n") - 2) / F.greatest(F.lit(1e-300), 1 - F.col("rho") * F.col("rho")))
    p = F.when(F.col("n") > 2, tails.student_tail(t, F.greatest(F.lit(1), F.col("n") - 2)))
    return r.select("lang", "n", F.round("rho", 6).alias("rho"), F.round(t, 6).alias("t"), F.round(p, 9).alias("p"))


@query()
def exact_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clopper-Pearson intervals of each source's share of good documents, and Wilson's with every document
    weighted by its size at the effective number of rows."""
    g = answers(spark, sf_dir).groupBy("source").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("y").cast("long")).alias("hits"), F.sum("size").alias("w"), F.sum(F.col("size") * F.col("size")).alias("w2"), F.sum(F.col("size") * F.col("y")).alias("wy")
    )
    g = g.withColumn("exact", tails.exact_share("hits", "n"))
    effective = F.col("w") * F.col("w") / F.col("w2")
    low, high = models.wilson(F.col("wy") / F.col("w") * effective, effective)
    return g.select("source", "n", "hits", F.round("exact.low", 8).alias("low"), F.round("exact.high", 8).alias("high"), F.round(effective, 6).alias("effective_n"), F.round(low, 6).alias("weighted_low"), F.round(high, 6).alias("weighted_high"))
