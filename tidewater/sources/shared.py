"""Tables written on the way in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; a temporary folder only in local mode with none set."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    folder = tempfile.mkdtemp(prefix="spark-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def fresh(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder that goes when the application ends."""
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)
    return path


#: For rows of megabytes: so few of them in a batch of a reader and of a Python worker.
WIDE = {"spark.sql.parquet.columnarReaderBatchSize": "1", "spark.sql.execution.arrow.maxRecordsPerBatch": "1"}


def written(df: DataFrame, label: str, conf: dict[str, str] | None = None, **options: str) -> DataFrame:
    """df as a Parquet table in the shared folder, read again: lineage ends there, and a lost executor costs
    no earlier stage. The shuffle files that made it go once it is written. conf holds while it is written."""
    spark = df.sparkSession
    path = fresh(spark, label)
    conf = {CLEANUP: "true"} | (conf or {})
    before = {k: spark.conf.get(k, "false") if k == CLEANUP else spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        df.write.options(**options).parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_at = path
    return out


def dropped(*tables: DataFrame) -> None:
    """Delete tables of written() that nothing reads any more."""
    for df in tables:
        spark = df.sparkSession
        at = spark._jvm.org.apache.hadoop.fs.Path(df.written_at)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
