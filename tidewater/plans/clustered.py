"""Clusters of samples: which number, how stable, what they are called."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.operators import clusters, hierarchy, ranks
from tidewater.operators import compositions as comp
from tidewater.plans.common import Plan
from tidewater.plans.glass import ratios
from tidewater.sources.shared import dropped, written
from tidewater.sources.tables import composition

plan = Plan()
query = plan.query
QUERIES, ORACLES = plan.queries, plan.oracles

KS, STARTS, DRAWS = range(2, 7), 20, 200


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters.kept(ratios(spark, sf_dir), "id", "c")


@query()
def kmeans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cluster of each sample's log-ratios, for the number of clusters with the best silhouette."""
    rows = samples(spark, sf_dir)
    model, told = clusters.chosen(rows, KS, STARTS)
    own = next(t for t in told if t["k"] == model.k)
    return clusters.labelled(rows, model).select("id", "cluster", F.lit(model.k).alias("k"), F.lit(round(own["silhouette"], 6)).alias("silhouette"))


@query()
def cluster_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What speaks for each number of clusters: the least cost over all starts, silhouette, size of the smallest."""
    rows = samples(spark, sf_dir)
    model, told = clusters.chosen(rows, KS, STARTS)
    dropped(rows)
    return spark.createDataFrame([(t["k"], round(t["cost"], 4), round(t["silhouette"], 6), t["least"], t["k"] == model.k) for t in told], "k int, cost double, silhouette double, least long, chosen boolean")


@query()
def cluster_stability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often the samples of each cluster stay in it when 200 draws of the samples are clustered again."""
    rows = samples(spark, sf_dir)
    seeds = clusters.seeds(rows, KS, STARTS)
    model, _ = clusters.chosen(rows, KS, STARTS)
    found = clusters.stability(rows, model, [m for m in seeds if m.k == model.k and m.start < 5], DRAWS)
    rate = F.col("same") / F.nullif(F.col("seen"), F.lit(0))
    return found.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), F.sum("seen").alias("seen"), F.round(F.avg(rate), 6).alias("agreement"), F.round(F.min(rate), 6).alias("least"), F.count_if(rate >= 0.75).alias("stable"))


def subclasses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, glass, sub: clusters within each type of sample (there are two types)."""
    out = None
    for g in (0, 1):
        rows = clusters.kept(ratios(spark, sf_dir).where(F.col("glass") == g), "id", "c")
        model, _ = clusters.chosen(rows, KS, STARTS)
        own = clusters.labelled(rows, model).select("id", F.lit(g).alias("glass"), F.col("cluster").alias("sub"))
        out = own if out is None else out.unionByName(own)
    return out


def _named(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The samples' first three parts with their subclasses, and the subclasses' medians."""
    part = lambda i: F.element_at("parts", i).alias(f"p{i}")
    wide = written(composition(spark, sf_dir).select("id", part(1), part(2), part(3)).join(subclasses(spark, sf_dir), "id"), "subclasses")
    c = wide.groupBy("glass", "sub").agg(F.count(F.lit(1)).alias("n"))
    for p in ("p1", "p2", "p3"):
        c = c.join(ranks.quantiles(wide, ["glass", "sub"], p, {p: 0.5}), ["glass", "sub"])
    return wide, c


@query()
def subclass_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Median centres of the clusters within each type, named by the first rule that fits."""
    _, c = _named(spark, sf_dir)
    name = F.when(F.col("p1") >= 10, "rich").when(F.col("p2") >= F.col("p3") + 1, "second").when(F.col("p3") >= F.col("p2") + 1, "third").otherwise("mixed")
    return c.select("glass", "sub", "n", *[F.round(p, 6).alias(p) for p in ("p1", "p2", "p3")], name.alias("name"))


@query()
def subclass_assembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many of a subclass's samples lie nearest to its own median centre. Centres are a few numbers each."""
    wide, c = _named(spark, sf_dir)
    centres = F.broadcast(c.select("glass", F.col("sub").alias("k"), F.array("p1", "p2", "p3").alias("c")))
    d = wide.select("id", "glass", "sub", F.array("p1", "p2", "p3").alias("p")).join(centres, "glass").withColumn("d", comp.squared("p", "c"))
    b = d.groupBy("id", "glass", "sub").agg(F.min_by("k", F.struct("d", "k")).alias("nearest"))
    kept = F.count_if(F.col("sub") == F.col("nearest"))
    return b.groupBy("glass", "sub").agg(F.count(F.lit(1)).alias("n"), kept.alias("kept"), F.round(kept / F.count(F.lit(1)), 6).alias("share"))


@query()
def ward_merges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ward's hierarchy over all samples: which cluster joins which, at what cost, in the order of costs."""
    m = hierarchy.ward(ratios(spark, sf_dir), "id", "c")
    return m.select("a", "b", "size", F.round("cost", 6).alias("cost"))
