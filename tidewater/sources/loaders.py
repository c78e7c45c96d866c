"""Loaders above the workbook reader: what sheets of some layouts hold, as tables.

A sheet's rows are numbered, so what a row carries down from the rows above it is the last value before it;
a sheet is one group, as a workbook's sheet is bounded by its format."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewater.sources.files import clock, workbooks

#: Days from 1970 back to the day from which workbooks count.
EPOCH = 25_569


def cell(column: str) -> Column:
    return F.col("cells")[column]


def numeric(column: str) -> Column:
    """A finite number in a cell, or null."""
    return F.when(F.trim(cell(column)).rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"), F.trim(cell(column)).try_cast("double"))


def dated(value: Column) -> Column:
    """A date from a cell: days as workbooks count them, or text as year, month and day."""
    days = F.trim(value).try_cast("double")
    text = F.try_to_timestamp(F.regexp_replace(F.trim(value), r"[./年月]", "-").substr(F.lit(1), F.lit(10)), F.lit("yyyy-M-d")).cast("date")
    return F.when(days.isNotNull() & (days > 0), F.date_add(F.lit("1970-01-01").cast("date"), (F.floor(days) - EPOCH).cast("int"))).otherwise(text)


def carried(value: Column) -> Column:
    """The value, or the last one above it in its sheet."""
    return F.last(value, ignorenulls=True).over(Window.partitionBy("path", "sheet").orderBy("row").rowsBetween(Window.unboundedPreceding, 0))


def first_path(spark: SparkSession, candidates: list[str]) -> str:
    """The first of some paths that exists in its file system; an error that names them all if none does."""
    for path in candidates:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        if at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
            return path
    raise FileNotFoundError(f"none of these is there: {', '.join(candidates)}")


def history(spark: SparkSession, path: str) -> DataFrame:
    """origin, dest, day, volume of the first sheet's first four columns, whatever their titles are."""
    rows = workbooks(spark, path).where("number = 1 AND row > 1").select(F.trim(cell("A")).alias("origin"), F.trim(cell("B")).alias("dest"), dated(cell("C")).alias("day"), numeric("D").alias("volume"))
    return rows.where("origin IS NOT NULL AND dest IS NOT NULL AND day IS NOT NULL AND volume IS NOT NULL")


def titled(spark: SparkSession, path: str, required: list[str]) -> DataFrame:
    """sheet, row and a text column for each required title, of all sheets whose first row has every one of
    them; other sheets are left out."""
    rows = workbooks(spark, path)
    heads = rows.where("row = 1").select("path", "sheet", F.map_from_entries(F.transform(F.map_entries("cells"), lambda e: F.struct(F.trim(e["value"]).alias("key"), e["key"].alias("value")))).alias("at"))
    heads = heads.where(F.size(F.array_except(F.array(*map(F.lit, required)), F.map_keys("at"))) == 0)
    body = rows.where("row > 1").join(heads, ["path", "sheet"])
    return body.select("path", "sheet", "row", *[F.try_element_at("cells", F.try_element_at("at", F.lit(t))).alias(t) for t in required])


def station_series(spark: SparkSession, path: str) -> DataFrame:
    """station (the sheet), ts, level, flow, sediment: year, month and day in A to C stand where they change and
    are carried down; D is the time of day in any of its forms, 24:00 the day's end. Rows without a flow are
    left out; several rows of one time are their mean."""
    rows = workbooks(spark, path).where("row > 1")
    rows = rows.withColumns({"y": carried(numeric("A")), "m": carried(numeric("B")), "d": carried(numeric("C")), "_t": cell("D")})
    day = F.make_date(F.col("y").cast("int"), F.col("m").cast("int"), F.col("d").cast("int"))
    ts = (F.unix_date(day).cast("long") * 86_400 + F.coalesce(clock("_t"), F.lit(0).cast("long"))).alias("s")
    rows = rows.select(F.col("sheet").alias("station"), ts, numeric("E").alias("level"), numeric("F").alias("flow"), numeric("G").alias("sediment")).where("s IS NOT NULL AND flow > 0")
    g = rows.groupBy("station", "s").agg(*[F.avg(c).alias(c) for c in ("level", "flow", "sediment")])
    return g.select("station", F.expr("TIMESTAMP_NTZ '1970-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, 0, s)").alias("ts"), "level", "flow", "sediment")


def paired_profiles(spark: SparkSession, path: str) -> DataFrame:
    """day, x, z: surveys side by side, each with its date above a pair of columns of distances and heights.
    Heights of one distance are their mean."""
    rows = workbooks(spark, path)
    cells = rows.select("path", "sheet", "row", F.explode("cells").alias("column", "value"))
    place = F.aggregate(F.split("column", ""), F.lit(0), lambda n, c: F.when(c == "", n).otherwise(n * 26 + F.ascii(c) - 64))
    cells = cells.withColumn("k", place)
    dates = cells.where("row = 1").select("path", "sheet", F.col("k").alias("x_at"), dated(F.col("value")).alias("day")).where("day IS NOT NULL")
    body = cells.where("row > 2").withColumn("n", F.trim("value").try_cast("double")).where("n IS NOT NULL").select("path", "sheet", "row", "k", "n")
    x = body.join(dates, (body["path"] == dates["path"]) & (body["sheet"] == dates["sheet"]) & (body["k"] == dates["x_at"])).select(body["path"], body["sheet"], "row", (F.col("k") + 1).alias("k"), "day", F.col("n").alias("x"))
    z = body.withColumnRenamed("n", "z")
    return x.join(z, ["path", "sheet", "row", "k"]).groupBy("day", "x").agg(F.avg("z").alias("z"))


def verticals(spark: SparkSession, path: str) -> DataFrame:
    """day, station, start, stage, depth, velocity: date, station and start distance in A to C are carried down
    over the verticals below them; a vertical's point velocities are averaged over its depths."""
    rows = workbooks(spark, path).where("row > 1")
    rows = rows.withColumns({"day": carried(dated(cell("A"))), "station": carried(F.trim(cell("B"))), "start": carried(numeric("C"))})
    rows = rows.select("day", "station", "start", numeric("D").alias("stage"), numeric("E").alias("depth"), numeric("F").alias("point"), numeric("G").alias("velocity")).where("day IS NOT NULL AND start IS NOT NULL")
    return rows.groupBy("day", "station", "start").agg(F.first("stage", ignorenulls=True).alias("stage"), F.max("depth").alias("depth"), F.count("velocity").alias("points"), F.avg("velocity").alias("velocity"))


def samples(spark: SparkSession, path: str, parts: int, low: float = 85.0, high: float = 105.0) -> DataFrame:
    """artifact, kind, weathered, sample, parts, total, valid: the sheet "artifacts" (id, kind, weathering) joined
    to the sheet "samples" (id, parts), whose ids begin with their artifact's two figures. Missing parts are 0."""
    rows = workbooks(spark, path).where("row > 1")
    artifacts = rows.where("sheet = 'artifacts'").select(F.lpad(F.regexp_extract(cell("A"), r"^(\d+)", 1), 2, "0").alias("artifact"), F.trim(cell("B")).alias("kind"), F.trim(cell("C")).alias("weathered"))
    names = [chr(66 + i) for i in range(parts)]
    values = F.array(*[F.coalesce(numeric(c), F.lit(0.0)) for c in names])
    found = rows.where("sheet = 'samples'").select(F.trim(cell("A")).alias("sample"), F.regexp_extract(cell("A"), r"^\s*(\d\d)", 1).alias("artifact"), values.alias("parts"))
    found = found.withColumn("total", F.aggregate("parts", F.lit(0.0), lambda a, v: a + v))
    return found.join(artifacts, "artifact", "left").select("artifact", "kind", "weathered", "sample", "parts", "total", F.col("total").between(low, high).alias("valid"))


def centres(spark: SparkSession, path: str) -> DataFrame:
    """row, x, y of a sheet with two columns of coordinates; an error if a row has but one of them, or none."""
    rows = workbooks(spark, path).where("row > 1").select("row", numeric("A").alias("x"), numeric("B").alias("y"))
    if rows.where("x IS NULL OR y IS NULL").limit(1).count():
        raise ValueError(f"{path} has rows without two finite coordinates")
    return rows

