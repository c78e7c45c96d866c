"""Tables of a folder of Parquet files, and the domain views that the plans work on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.operators.compositions import closed
from tidewater.sources.shared import written


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each shipment: origin and dest (nations), their regions, day and volume."""
    places = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))

    def place(key: str, name: str) -> DataFrame:
        # nations are a fixed list of countries, not data that grows
        return F.broadcast(places.select(F.col("n_nationkey").alias(key), F.col("n_name").alias(name), F.col("r_name").alias(f"{name}_region")))

    # small tables meet orders and items first, and names come last: items are shuffled twice, without names
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", F.col("l_shipdate").cast("date").alias("day"), F.col("l_quantity").alias("volume"))
    items = items.join(table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey")).select("l_orderkey", "s_nationkey", "day", "volume")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    orders = orders.join(table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_nationkey")
    rows = items.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(place("c_nationkey", "dest"), "c_nationkey").join(place("s_nationkey", "origin"), "s_nationkey")
    return rows.select("origin", "dest", "origin_region", "dest_region", "day", "volume")


FLOWS_SQL = """flows AS (
    SELECT sn.n_name AS origin, cn.n_name AS dest, sr.r_name AS origin_region, cr.r_name AS dest_region,
        CAST(l_shipdate AS DATE) AS day, l_quantity AS volume
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey
        JOIN nation sn ON s_nationkey = sn.n_nationkey JOIN region sr ON sn.n_regionkey = sr.r_regionkey
        JOIN nation cn ON c_nationkey = cn.n_nationkey JOIN region cr ON cn.n_regionkey = cr.r_regionkey)"""


def lane_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Volume of each pair of regions and day that has some: at most 25 rows a day, whatever the input is. A table of
    its own, as plans read it several times and flows are joins of the largest tables."""
    days = flows(spark, sf_dir).groupBy(F.col("origin_region").alias("origin"), F.col("dest_region").alias("dest"), "day").agg(F.sum("volume").alias("volume"))
    return written(days, "lane-days")


LANES_SQL = FLOWS_SQL + """, lanes AS (
    SELECT origin_region AS origin, dest_region AS dest, day, sum(volume) AS volume FROM flows GROUP BY ALL)"""


def hydro(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An irregular series for each station: ts, flow, and sediment where it was measured."""
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("user_id").alias("station"),
        "ts",
        (F.col("value") + 1).alias("flow"),
        F.when(F.col("event_type") == "purchase", F.col("value") / 10).alias("sediment"),
    )


HYDRO_SQL = """hydro AS (
    SELECT user_id AS station, ts, value + 1 AS flow, CASE WHEN event_type = 'purchase' THEN value / 10 END AS sediment FROM events)"""


def _dim(i: int) -> Column:
    return F.element_at("embedding", i).cast("double")


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tasks and members on a plane in km: id, kind, x, y, price, quota, credit, completed."""
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("id"),
        F.when(F.col("label") < 5, "task").otherwise("member").alias("kind"),
        (_dim(1) * 10).alias("x"),
        (_dim(2) * 10).alias("y"),
        (65 + F.pmod(F.col("vec_id"), F.lit(41)) * 0.5).alias("price"),
        (1 + F.pmod(F.col("vec_id"), F.lit(7))).cast("double").alias("quota"),
        F.abs(_dim(3) * 100).alias("credit"),
        (F.pmod(F.col("vec_id"), F.lit(3)) > 0).cast("int").alias("completed"),
    )


POINTS_SQL = """points AS (
    SELECT vec_id AS id, CASE WHEN label < 5 THEN 'task' ELSE 'member' END AS kind,
        embedding[1]::DOUBLE * 10 AS x, embedding[2]::DOUBLE * 10 AS y, 65 + (vec_id % 41) * 0.5::DOUBLE AS price,
        (1 + vec_id % 7)::DOUBLE AS quota, abs(embedding[3]::DOUBLE * 100) AS credit, (vec_id % 3 > 0)::INT AS completed
    FROM embeddings)"""

PARTS = 14  #: components of a composition


def composition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A closed composition for each sample: id, artifact, glass, weathered, parts (in %)."""
    raw = F.transform(F.slice("embedding", 1, PARTS), lambda v: F.abs(v.cast("double")))
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.floor(F.col("vec_id") / 2).alias("artifact"), F.pmod(F.col("label"), F.lit(2)).cast("int").alias("glass"), (F.pmod(F.col("vec_id"), F.lit(3)) == 0).cast("int").alias("weathered"), raw.alias("raw"))
    return rows.select("id", "artifact", "glass", "weathered", closed("raw").alias("parts"))


#: The same in long form: a row for each sample and part.
COMP_SQL = f"""raw AS (
    SELECT vec_id AS id, vec_id // 2 AS artifact, (label % 2)::INT AS glass, (vec_id % 3 = 0)::INT AS weathered,
        unnest(range(1, {PARTS + 1})) AS part, unnest([abs(v::DOUBLE) FOR v IN embedding[1:{PARTS}]]) AS v
    FROM embeddings),
comp AS (SELECT id, artifact, glass, weathered, part, 100 * v / sum(v) OVER (PARTITION BY id) AS v FROM raw)"""


def profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cross-sections: survey (brand), x (size), z (mean price)."""
    return table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("survey"), F.col("p_size").cast("double").alias("x")).agg(F.avg("p_retailprice").alias("z"))


PROFILES_SQL = """profiles AS (
    SELECT p_brand AS survey, p_size::DOUBLE AS x, avg(p_retailprice) AS z FROM part GROUP BY ALL)"""


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents: doc_id, y, toxic, size (log of characters), lang, source."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")
    return table(spark, sf_dir, "labels").join(docs, "doc_id").select("doc_id", F.col("quality").alias("y"), "toxic", F.log1p("n_chars").alias("size"), "lang", "source")


ANSWERS_SQL = """answers AS (
    SELECT doc_id, quality AS y, toxic, ln(1 + n_chars) AS size, lang, source FROM labels JOIN documents USING (doc_id))"""
