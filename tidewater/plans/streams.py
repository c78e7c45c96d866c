"""Streams over the events, run to the end of what is there."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.plans.common import Plan
from tidewater.streaming import events

plan = Plan()
query = plan.query
QUERIES, ORACLES = plan.queries, plan.oracles


@query("SELECT time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '2024-01-01')::TIMESTAMP AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def stream_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.replayed(spark, sf_dir, events.tumbling, "tumbling").withColumn("total", F.round("total", 4))


@query("WITH w AS (SELECT value, unnest([time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '2024-01-01'), time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '2024-01-01') - INTERVAL 6 HOUR])::TIMESTAMP AS start FROM events) SELECT start, count(*) AS n, max(value) AS largest FROM w GROUP BY start")
def stream_sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.replayed(spark, sf_dir, events.sliding, "sliding")


@query("WITH g AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER w + INTERVAL 3 HOUR THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM g) SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, s")
def stream_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.replayed(spark, sf_dir, events.sessions, "sessions")


@query("""WITH g AS (SELECT *, coalesce(ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) > INTERVAL 10 DAY, FALSE) AS new FROM events),
s AS (SELECT *, sum(new::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM g),
j AS (SELECT user_id, s, ts, event_id, coalesce(abs(ln(1 + value) - lag(ln(1 + value)) OVER w), 0) AS jump FROM s WINDOW w AS (PARTITION BY user_id, s ORDER BY ts, event_id))
SELECT user_id, ts, round(jump, 6) AS jump, coalesce(max(jump >= 1.5) OVER (PARTITION BY user_id, s ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING), FALSE) AS action FROM j""")
def stream_jumps(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = events.replayed(spark, sf_dir, events.jumps, "jumps", "append")
    return out.select("user_id", F.col("ts").cast("timestamp_ntz").alias("ts"), F.round("jump", 6).alias("jump"), "action")


@query("SELECT event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY event_type")
def stream_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = events.replayed(spark, sf_dir, events.distinct_events, "distinct", "append")
    return out.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))
