"""Projections, filters, joins, sets, aggregates and order over the star tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewater.operators import ranks, relations
from tidewater.plans.common import Plan, pct
from tidewater.sources.tables import table

plan = Plan()
query = plan.query
QUERIES, ORACLES = plan.queries, plan.oracles


@query("""SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_price, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc, round(avg(l_discount), 6) AS avg_disc, count(*) AS n, round(stddev_samp(l_quantity), 6) AS sd, round(stddev_pop(l_quantity) / avg(l_quantity), 6) AS cv
FROM lineitem WHERE l_shipdate <= DATE '2001-06-01' GROUP BY ALL""")
def pricing_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Many aggregates in one pass: sums, means, sample and population spread."""
    l = table(spark, sf_dir, "lineitem").where(F.col("l_shipdate") <= F.lit("2001-06-01").cast("timestamp_ntz"))
    return l.groupBy("l_returnflag", "l_linestatus").agg(
        F.sum("l_quantity").alias("sum_qty"), F.round(F.sum("l_extendedprice"), 2).alias("sum_price"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("sum_disc"),
        F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.count(F.lit(1)).alias("n"), F.round(F.stddev_samp("l_quantity"), 6).alias("sd"), F.round(F.stddev_pop("l_quantity") / F.avg("l_quantity"), 6).alias("cv"))


@query("SELECT coalesce(o_orderstatus, 'all') AS status, coalesce(o_orderpriority, 'all') AS priority, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")
def totals_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Details with all their subtotals."""
    c = table(spark, sf_dir, "orders").cube("o_orderstatus", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))
    return c.select(F.coalesce("o_orderstatus", F.lit("all")).alias("status"), F.coalesce("o_orderpriority", F.lit("all")).alias("priority"), "n", "total")


@query("SELECT o_orderpriority, " + ", ".join(f"round(coalesce(sum(o_totalprice) FILTER (o_orderstatus = '{s}'), 0), 2) AS {s}" for s in "FOP") + " FROM orders GROUP BY o_orderpriority")
def pivot_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long to wide with listed values."""
    p = table(spark, sf_dir, "orders").groupBy("o_orderpriority").pivot("o_orderstatus", ["F", "O", "P"]).agg(F.sum("o_totalprice"))
    return p.select("o_orderpriority", *[F.round(F.coalesce(c, F.lit(0.0)), 2).alias(c) for c in "FOP"])


@query("SELECT p_partkey, measure, value FROM (SELECT p_partkey, p_size::DOUBLE AS size, p_retailprice AS price FROM part) UNPIVOT (value FOR measure IN (size, price))")
def unpivot_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select("p_partkey", F.col("p_size").cast("double").alias("size"), F.col("p_retailprice").alias("price"))
    return p.unpivot("p_partkey", ["size", "price"], "measure", "value")


@query("SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS k FROM orders) WHERE k = 1")
def last_of_each(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Duplicates dropped but for the last: a maximum of a struct, which sums up before it shuffles."""
    o = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.max(F.struct("o_orderdate", "o_orderkey", "o_totalprice")).alias("r"))
    return o.select("o_custkey", "r.o_orderkey", "r.o_totalprice")


@query("SELECT p_brand, p_partkey, p_retailprice, k::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS k FROM part) WHERE k <= 3")
def top_per_brand(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select("p_brand", "p_partkey", "p_retailprice")
    return ranks.top_of_each(p, ["p_brand"], 3, F.desc("p_retailprice"), F.col("p_partkey"))


@query("SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 20")
def top_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A top-k report: the limit is the feature."""
    return table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal").orderBy(F.desc("c_acctbal"), "c_custkey").limit(20)


@query("WITH a AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderstatus = 'F'), b AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderstatus = 'O') SELECT 'both' AS part, count(*) AS n FROM (FROM a INTERSECT FROM b) UNION ALL SELECT 'either', count(*) FROM (FROM a UNION FROM b) UNION ALL SELECT 'first only', count(*) FROM (FROM a EXCEPT FROM b)")
def set_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    a, b = (o.where(F.col("o_orderstatus") == s).select(F.col("o_custkey").alias("k")) for s in "FO")
    parts = {"both": a.intersect(b), "either": a.union(b).distinct(), "first only": a.subtract(b)}
    out = [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("part"), "n") for name, df in parts.items()]
    return out[0].unionByName(out[1]).unionByName(out[2])


@query("SELECT c_mktsegment, count(*) FILTER (k IS NOT NULL) AS with_orders, count(*) FILTER (k IS NULL) AS without FROM customer LEFT JOIN (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_totalprice > 400000) ON k = c_custkey GROUP BY ALL")
def semi_and_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with and without a large order."""
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    large = table(spark, sf_dir, "orders").where("o_totalprice > 400000").select(F.col("o_custkey").alias("c_custkey"))
    has = c.join(large, "c_custkey", "left_semi").groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("with_orders"))
    not_ = c.join(large, "c_custkey", "left_anti").groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("without"))
    return relations.outer_sums(has, not_, ["c_mktsegment"], "with_orders", "without")


@query("SELECT n_name, count(*) AS customers, round(sum(c_acctbal), 2) AS balance FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name")
def validated_dimension(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A join that is checked to be many to one."""
    c = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("key"), "c_acctbal")
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("key"), "n_name")
    return relations.validated_join(c, n, ["key"], "many_to_one").groupBy("n_name").agg(F.count(F.lit(1)).alias("customers"), F.round(F.sum("c_acctbal"), 2).alias("balance"))


@query("WITH q AS (SELECT p_type, quantile_cont(p_retailprice, 1 / 3.0) AS a, quantile_cont(p_retailprice, 2 / 3.0) AS b FROM part GROUP BY p_type) SELECT p_type, CASE WHEN round(p_retailprice, 9) <= round(a, 9) THEN 'low' WHEN round(p_retailprice, 9) <= round(b, 9) THEN 'medium' ELSE 'high' END AS level, count(*) AS n FROM part JOIN q USING (p_type) GROUP BY 1, 2")
def quantile_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three classes by exact quantiles, closed on the right."""
    p = table(spark, sf_dir, "part").select("p_type", "p_retailprice")
    q = ranks.quantiles(p, ["p_type"], "p_retailprice", {"a": 1 / 3, "b": 2 / 3})
    price = F.round("p_retailprice", 9)
    level = F.when(price <= F.round("a", 9), "low").when(price <= F.round("b", 9), "medium").otherwise("high")
    return p.join(q, "p_type").groupBy("p_type", level.alias("level")).agg(F.count(F.lit(1)).alias("n"))


@query("WITH g AS (SELECT l_returnflag AS f, l_discount AS v, sum(l_quantity) AS w FROM lineitem GROUP BY ALL), c AS (SELECT f, v, sum(w) OVER (PARTITION BY f ORDER BY v) / sum(w) OVER (PARTITION BY f) AS c FROM g) SELECT f AS flag, min(v) FILTER (c >= 0.5 - 1e-12) AS median, min(v) FILTER (c >= 0.9 - 1e-12) AS p90 FROM c GROUP BY f")
def weighted_quantile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantiles by weight, from sums over distinct values: rows of one value are summed before the sort."""
    g = table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("flag"), F.col("l_discount").alias("v")).agg(F.sum("l_quantity").alias("w"))
    own = Window.partitionBy("flag")
    c = g.withColumn("c", F.sum("w").over(own.orderBy("v")) / F.sum("w").over(own))
    at = lambda p: F.min(F.when(F.col("c") >= p - 1e-12, F.col("v")))
    return c.groupBy("flag").agg(at(0.5).alias("median"), at(0.9).alias("p90"))


@query("SELECT o_custkey, string_agg(o_orderkey::VARCHAR, ';' ORDER BY o_orderkey) AS orders, count(*) AS n FROM orders WHERE o_totalprice > 450000 GROUP BY o_custkey")
def ordered_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of a customer's largest orders as one string, in order."""
    o = table(spark, sf_dir, "orders").where("o_totalprice > 450000")
    return o.groupBy("o_custkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list("o_orderkey")), lambda k: k.cast("string")), ";").alias("orders"), F.count(F.lit(1)).alias("n"))


@query("WITH s AS (SELECT o_custkey, unnest(string_split(string_agg(o_orderkey::VARCHAR, ';'), ';'))::BIGINT AS o_orderkey FROM orders WHERE o_totalprice > 450000 GROUP BY o_custkey) SELECT s.o_custkey, round(sum(o_totalprice), 2) AS total FROM s JOIN orders USING (o_orderkey) GROUP BY ALL")
def member_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums over the members that such a string names."""
    s = ordered_names(spark, sf_dir).select("o_custkey", F.explode(F.split("orders", ";").cast("array<long>")).alias("o_orderkey"))
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    return s.join(o, "o_orderkey").groupBy("o_custkey").agg(F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("WITH c AS (SELECT p_type, count(*) AS n FROM part GROUP BY p_type), k AS (SELECT p_brand, p_type, dense_rank() OVER (ORDER BY p_brand) - 1 AS code FROM part) SELECT k.p_brand, any_value(code) AS code, " + ", ".join(f"count(*) FILTER (p_type = '{t}')::DOUBLE AS \"{t}\"" for t in ("MEDIUM", "PROMO", "SMALL", "STANDARD", "LARGE")) + ", round(max(c.n / (SELECT max(n) FROM c)), 6) AS busiest FROM k JOIN c USING (p_type) GROUP BY k.p_brand")
def encoded_brands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dense codes, indicator columns and counts as shares of the largest one."""
    types = ["MEDIUM", "PROMO", "SMALL", "STANDARD", "LARGE"]
    p = relations.dense_codes(table(spark, sf_dir, "part").select("p_brand", "p_type"), "p_brand", "code").withColumn("code", F.col("code").cast("long"))
    counts = p.groupBy("p_type").agg(F.count(F.lit(1)).alias("n")).withColumn("share", F.col("n") / F.max("n").over(Window.partitionBy()))
    p = p.join(F.broadcast(counts.select("p_type", "share")), "p_type")  # a row for each of a fixed list of types
    return p.groupBy("p_brand").agg(F.first("code").alias("code"), *[F.sum((F.col("p_type") == t).cast("double")).alias(t) for t in types], F.round(F.max("share"), 6).alias("busiest"))


@query(f"""WITH y AS (SELECT year(o_orderdate)::INT AS year, sum(o_totalprice) AS v FROM orders GROUP BY 1)
SELECT year, round(v, 2) AS v, round(sum(v) OVER (ORDER BY year), 2) AS running, round(v - lag(v) OVER (ORDER BY year), 2) AS step, round(v / lag(v) OVER (ORDER BY year) - 1, 6) AS change, round((v - min(v) OVER ()) / (max(v) OVER () - min(v) OVER ()), 6) AS scaled, round(v / stddev_samp(v) OVER (), 6) AS standard, round({pct("v")}, 6) AS pct FROM y""")
def yearly_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Running sums, steps, changes and scales over a short series (a row for each year)."""
    y = table(spark, sf_dir, "orders").groupBy(F.year("o_orderdate").alias("year")).agg(F.sum("o_totalprice").alias("v"))
    own = Window.orderBy("year")
    return y.select("year", F.round("v", 2).alias("v"), F.round(F.sum("v").over(own), 2).alias("running"), F.round(F.col("v") - F.lag("v").over(own), 2).alias("step"), F.round(F.col("v") / F.lag("v").over(own) - 1, 6).alias("change"),
        F.round(ranks.scaled("v"), 6).alias("scaled"), F.round(ranks.standardised("v"), 6).alias("standard"), F.round(ranks.percent_rank_average("v"), 6).alias("pct"))


@query("""WITH d AS (SELECT o_custkey, o_orderkey, o_orderdate::DATE AS day FROM orders WHERE o_orderpriority = '1-URGENT'), c AS (SELECT o_custkey, o_orderdate::DATE AS other FROM orders WHERE o_orderpriority = '5-LOW')
SELECT d.o_orderkey, count(c.other) AS near FROM d LEFT JOIN c ON c.o_custkey = d.o_custkey AND abs(d.day - c.other) <= 30 GROUP BY d.o_orderkey""")
def band_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Low orders of the same customer within 30 days of each urgent one."""
    o = table(spark, sf_dir, "orders").withColumn("day", F.to_date("o_orderdate"))
    a = o.where("o_orderpriority = '1-URGENT'").select("o_custkey", "o_orderkey", "day")
    b = o.where("o_orderpriority = '5-LOW'").select("o_custkey", F.col("day").alias("other"))
    return relations.within(a, b, ["o_custkey"], "day", "other", 30, "left").groupBy("l.o_orderkey").agg(F.count("r.other").alias("near"))


@query("""SELECT o_orderkey, CASE WHEN o_totalprice >= 400000 THEN 'large' WHEN o_totalprice >= 200000 THEN 'medium' ELSE 'small' END AS size, greatest(0, least(1, o_totalprice / 500000)) AS part, round(ln(1 + o_totalprice), 6) AS log, (o_totalprice / 1000)::BIGINT AS rounded, try_cast(split_part(o_orderpriority, '-', 1) AS INT) AS priority, upper(o_orderstatus) || '>' || o_orderpriority AS label, last_day(o_orderdate) AS month_end
FROM orders WHERE o_orderstatus IN ('F', 'O') AND o_orderdate BETWEEN TIMESTAMP '1997-01-01' AND TIMESTAMP '1997-12-31' AND NOT starts_with(o_orderpriority, '5')""".replace("(o_totalprice / 1000)::BIGINT", "round_even(o_totalprice / 1000, 0)::BIGINT"))
def projections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filters that reach the scan, and derived columns of all kinds."""
    o = table(spark, sf_dir, "orders").where(F.col("o_orderstatus").isin("F", "O") & F.col("o_orderdate").between(F.lit("1997-01-01").cast("timestamp_ntz"), F.lit("1997-12-31").cast("timestamp_ntz")) & ~F.col("o_orderpriority").startswith("5"))
    price = F.col("o_totalprice")
    return o.select("o_orderkey", F.when(price >= 400000, "large").when(price >= 200000, "medium").otherwise("small").alias("size"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), price / 500000)).alias("part"), F.round(F.log1p(price), 6).alias("log"),
        F.rint(price / 1000).cast("long").alias("rounded"), F.split("o_orderpriority", "-")[0].try_cast("int").alias("priority"), F.concat(F.upper("o_orderstatus"), F.lit(">"), "o_orderpriority").alias("label"), F.last_day("o_orderdate").alias("month_end"))
