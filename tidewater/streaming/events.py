"""Event streams: windows with watermarks, sessions, deduplication, and a trigger that remembers."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tidewater.sources.shared import fresh
from tidewater.sources.tables import table

LATE = "2 hours"  #: how late an event may come and still count


def read_stream(spark: SparkSession, sf_dir: str, files: int = 1) -> DataFrame:
    """The events as a stream of files, `files` of them a batch, from one file or a folder of them. Files of
    a folder should follow each other in time: what comes LATE behind the newest event may be left out."""
    schema = table(spark, sf_dir, "events").schema
    # a pattern, as the reader takes folders and patterns but no single file
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(f"{sf_dir}/events.parque[t]")


def tumbling(events: DataFrame, width: str = "6 hours") -> DataFrame:
    """start, event_type, n, total of fixed windows; batch and stream alike."""
    e = events.withColumn("ts", F.col("ts").cast("timestamp"))
    e = e.withWatermark("ts", LATE) if e.isStreaming else e
    g = e.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return g.select(F.col("w.start").cast("timestamp_ntz").alias("start"), "event_type", "n", "total")


def sliding(events: DataFrame, width: str = "12 hours", step: str = "6 hours") -> DataFrame:
    e = events.withColumn("ts", F.col("ts").cast("timestamp"))
    e = e.withWatermark("ts", LATE) if e.isStreaming else e
    g = e.groupBy(F.window("ts", width, step).alias("w")).agg(F.count(F.lit(1)).alias("n"), F.max("value").alias("largest"))
    return g.select(F.col("w.start").cast("timestamp_ntz").alias("start"), "n", "largest")


def sessions(events: DataFrame, gap: str = "3 hours") -> DataFrame:
    """user_id, start, n of runs of a user's events less than `gap` apart."""
    e = events.withColumn("ts", F.col("ts").cast("timestamp"))
    e = e.withWatermark("ts", LATE) if e.isStreaming else e
    g = e.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return g.select("user_id", F.col("w.start").cast("timestamp_ntz").alias("start"), "n")


def distinct_events(events: DataFrame) -> DataFrame:
    """Each event once, however often it is delivered within the watermark."""
    e = events.withColumn("ts", F.col("ts").cast("timestamp"))
    return e.withWatermark("ts", LATE).dropDuplicatesWithinWatermark(["event_id"]) if e.isStreaming else e.dropDuplicates(["event_id"])


class Jumps(StatefulProcessor):
    """A user's last value, its time, and how many events are still to follow a jump. Events of a batch are
    taken by time. A user of whom nothing comes for `idle` starts anew: a timer of event time deletes what is
    kept, and an event that comes later still takes nothing from before."""

    def __init__(self, threshold: float, follow: int, idle: int):
        self.threshold, self.follow, self.idle = threshold, follow, idle  # idle: microseconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.kept = handle.getValueState("kept", "last double, at long, pending int")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        last, at, pending = self.kept.get() if self.kept.exists() else (None, None, 0)
        batch = pd.concat(list(rows)).sort_values(["at", "event_id"])
        out = []
        for ts, now_at, value in zip(batch["ts"], batch["at"].tolist(), batch["value"].tolist(), strict=True):
            if at is not None and now_at - at > self.idle:
                last, pending = None, 0
            now = math.log1p(value)
            jump = 0.0 if last is None else abs(now - last)
            out.append((key[0], ts, jump, pending > 0))
            pending = self.follow if jump >= self.threshold else max(0, pending - 1)
            last, at = now, now_at
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.kept.update((last, at, pending))
        self.handle.registerTimer((at + self.idle) // 1000 + 1)
        yield pd.DataFrame(out, columns=["user_id", "ts", "jump", "action"])

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.kept.clear()
        return iter([])

    def close(self) -> None:
        pass


def jumps(events: DataFrame, threshold: float = 1.5, follow: int = 2, idle_days: int = 10) -> DataFrame:
    """user_id, ts, jump, action: a jump of the log of a user's value by the threshold asks for action on the
    next `follow` events, in whichever batch these come. Nothing is kept of users idle for `idle_days`."""
    spark = events.sparkSession
    # keys' values and timers live in a store on disk that writes its changes to the checkpoint
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    e = events.select("user_id", "event_id", F.col("ts").cast("timestamp").alias("ts"), "value").withColumn("at", F.unix_micros("ts")).withWatermark("ts", LATE)
    return e.groupBy("user_id").transformWithStateInPandas(
        statefulProcessor=Jumps(threshold, follow, idle_days * 86_400_000_000),
        outputStructType="user_id long, ts timestamp, jump double, action boolean",
        outputMode="append",
        timeMode="eventTime",
    )


def run_to_table(spark: SparkSession, stream: DataFrame, label: str, mode: str = "append") -> DataFrame:
    """The table that a stream of what is there now makes. complete: the last result replaces all before;
    append: a batch written again after a failure replaces itself, as its folder has its number."""
    path = fresh(spark, label)

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/{'all' if mode == 'complete' else f'batch={number}'}")

    q = stream.writeStream.outputMode(mode).option("checkpointLocation", fresh(spark, f"{label}-checkpoint")).trigger(availableNow=True).foreachBatch(write).start()
    q.awaitTermination()
    at = f"{path}/all" if mode == "complete" else f"{path}/batch=*"
    place = spark._jvm.org.apache.hadoop.fs.Path(at)
    if not place.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(place):  # no batch at all
        return spark.createDataFrame([], stream.schema)
    return spark.read.schema(stream.schema).parquet(at)


def replayed(spark: SparkSession, sf_dir: str, what: Callable[[DataFrame], DataFrame], label: str, mode: str = "complete", files: int = 1) -> DataFrame:
    return run_to_table(spark, what(read_stream(spark, sf_dir, files)), label, mode)
