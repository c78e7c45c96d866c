"""Event streams over one file, a folder of files and an empty table."""

import os

import pytest
from pyspark.sql import functions as F

from tidewater.plans import streams
from tidewater.streaming import events

SF = "/root/testdata/sf0.001"
NAMES = sorted(streams.QUERIES)


@pytest.fixture(scope="module")
def folders(spark, tmp_path_factory):
    """The same events as three files that follow each other in time, and none at all."""
    at = tmp_path_factory.mktemp("tables")
    e = spark.read.parquet(f"{SF}/events.parquet")
    place = F.ntile(3).over(__import__("pyspark").sql.Window.orderBy("ts"))
    parts = e.withColumn("p", place)
    for k in (1, 2, 3):
        parts.where(F.col("p") == k).drop("p").coalesce(1).write.mode("append").parquet(f"{at}/many/events.parquet")
        for f in os.listdir(f"{at}/many/events.parquet"):  # files are taken by age
            if f.endswith(".parquet") and not os.path.exists(f"{at}/{f}"):
                os.utime(f"{at}/many/events.parquet/{f}", (1_700_000_000 + 10 * k,) * 2)
                open(f"{at}/{f}", "w").close()
    e.limit(0).coalesce(1).write.parquet(f"{at}/none/events.parquet")
    return str(at)


def rows(df):
    return sorted(map(tuple, df.select(*sorted(df.columns)).collect()), key=repr)


@pytest.mark.parametrize("name", NAMES)
def test_folder_of_files(spark, folders, name):
    assert rows(streams.QUERIES[name](spark, f"{folders}/many")) == rows(streams.QUERIES[name](spark, SF))


@pytest.mark.parametrize("name", NAMES)
def test_no_events(spark, folders, name):
    got = streams.QUERIES[name](spark, f"{folders}/none")
    assert got.collect() == [] and got.columns == streams.QUERIES[name](spark, SF).columns


def test_several_files_a_batch(spark, folders):
    one, all_ = (events.replayed(spark, f"{folders}/many", events.tumbling, f"files{n}", files=n) for n in (1, 3))
    assert rows(one.withColumn("total", F.round("total", 6))) == rows(all_.withColumn("total", F.round("total", 6)))


def test_idle_users_start_anew_and_hold_no_state(spark, tmp_path):
    """Three files two weeks apart: of users of the first alone nothing is kept, and one who comes back starts anew."""
    import datetime

    at = datetime.datetime(2024, 1, 1)
    parts = [
        [(1, 1, at, 1.0), (2, 2, at, 1.0), (3, 1, at + datetime.timedelta(hours=1), 90.0)],
        [(4, 3, at + datetime.timedelta(days=14), 5.0)],
        [(5, 1, at + datetime.timedelta(days=28), 1.0), (6, 1, at + datetime.timedelta(days=28, hours=1), 1.0)],
    ]
    os.makedirs(f"{tmp_path}/in")
    for k, rows_ in enumerate(parts):
        spark.createDataFrame(rows_, "event_id long, user_id long, ts timestamp_ntz, value double").coalesce(1).write.parquet(f"{tmp_path}/{k}")
        (f,) = [f for f in os.listdir(f"{tmp_path}/{k}") if f.endswith(".parquet")]
        os.rename(f"{tmp_path}/{k}/{f}", f"{tmp_path}/in/{k}.parquet")
        os.utime(f"{tmp_path}/in/{k}.parquet", (1_700_000_000 + 10 * k,) * 2)
    e = spark.readStream.schema("event_id long, user_id long, ts timestamp_ntz, value double").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    q = events.jumps(e).writeStream.format("memory").queryName("idle").outputMode("append").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    q.awaitTermination()
    got = sorted((r.user_id, r.ts.day, round(r.jump, 3), r.action) for r in spark.table("idle").collect())
    assert got == [(1, 1, 0.0, False), (1, 1, 3.818, False), (1, 29, 0.0, False), (1, 29, 0.0, False), (2, 1, 0.0, False), (3, 15, 0.0, False)]
    kept = spark.read.format("statestore").option("stateVarName", "kept").load(f"{tmp_path}/c")
    assert {r.key.user_id for r in kept.select("key").collect()} == {1}
