"""Panels: complete calendars, and what is read from and mended in them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def complete(rows: DataFrame, by: list[str], day: str, value: str) -> DataFrame:
    """A row for each key and day between the first and the last day of the table; 0 where none was."""
    # a single row of bounds; the grid has as many rows as the panel itself
    span = rows.agg(F.min(day).alias("_a"), F.max(day).alias("_b"))
    grid = rows.select(*by).distinct().join(F.broadcast(span)).select(*by, F.explode(F.sequence("_a", "_b")).alias(day))
    return grid.join(rows, [*by, day], "left").select(*by, day, F.coalesce(value, F.lit(0).cast(rows.schema[value].dataType)).alias(value))


def nearest_delta(day: str, dates: list[str]) -> Column:
    """Days since the nearest of the dates (the earlier one on ties)."""
    deltas = [F.struct(F.abs(F.datediff(day, F.lit(d).cast("date"))).alias("k"), F.lit(i).alias("i"), F.datediff(day, F.lit(d).cast("date")).alias("d")) for i, d in enumerate(sorted(dates))]
    return (F.least(*deltas) if len(deltas) > 1 else deltas[0])["d"]


def calendar(days: DataFrame, day: str, holidays: list[str]) -> DataFrame:
    d = F.col(day)
    angle = 2 * F.pi() * F.dayofyear(d) / F.lit(365.25)
    return days.select(
        day,
        F.year(d).alias("year"),
        F.month(d).alias("month"),
        F.dayofmonth(d).alias("day_of_month"),
        F.weekday(d).alias("weekday"),
        F.weekofyear(d).alias("week"),
        F.dayofyear(d).alias("day_of_year"),
        (d == F.trunc(d, "MM")).alias("month_start"),
        (d == F.last_day(d)).alias("month_end"),
        nearest_delta(day, holidays).alias("holiday_delta"),
        (F.abs(nearest_delta(day, holidays)) <= 7).alias("near_holiday"),
        F.round(F.sin(angle), 6).alias("season_sin"),
        F.round(F.cos(angle), 6).alias("season_cos"),
    )


def shutdowns(years: DataFrame, by: list[str], year: str, total: str, least: float, below: float) -> DataFrame:
    """Keys whose total is below a share of the year before's, which had at least `least`."""
    before = F.coalesce(F.lag(total).over(Window.partitionBy(*by).orderBy(year)), F.lit(0.0))
    ratio = F.col(total) / (F.col("before") + 1e-9)
    rows = years.withColumn("before", before).where((F.col("before") >= least) & (ratio < below))
    return rows.select(*by, year, "before", total, F.round(ratio, 6).alias("ratio"))


def dips(months: DataFrame, by: list[str], month: str, total: str, least: float, below: float, sides: float) -> DataFrame:
    """Months at most `below` of the median of the two before and the two after, both of whose nearer ones
    have `sides` of it at least. The first and last two months of a key are not judged."""
    own = Window.partitionBy(*by).orderBy(month)
    near = [F.lag(total, 2).over(own), F.lag(total).over(own), F.lead(total).over(own), F.lead(total, 2).over(own)]
    rows = months.withColumns(dict(zip(["_a", "_b", "_c", "_d"], near))).where("_a IS NOT NULL AND _d IS NOT NULL")
    inner = F.array_sort(F.array("_a", "_b", "_c", "_d"))
    rows = rows.withColumn("base", (inner[1] + inner[2]) / 2)
    found = (F.col("base") >= least) & (F.col(total) <= below * F.col("base")) & (F.col("_b") >= sides * F.col("base")) & (F.col("_c") >= sides * F.col("base"))
    return rows.where(found).select(*by, month, total, "base")


def reshaped(panel: DataFrame, by: list[str], day: str, value: str, first: str, last: str) -> DataFrame:
    """The days of a month, first..last, with `corrected`: the mean of the same days of the month before and
    after (the last day of shorter months; where only one is in the panel, that one), scaled to the median
    of the totals of the two months before and the two after. All zero: spread evenly."""
    start = F.trunc(F.lit(first).cast("date"), "MM")
    target = panel.where(F.col(day).between(F.lit(first).cast("date"), F.lit(last).cast("date")))
    around = panel.select(*by, F.col(day).alias("_d"), F.col(value).alias("_v"))
    rows = target.withColumns({"_p": F.add_months(day, -1), "_n": F.add_months(day, 1)})
    rows = rows.join(around.withColumnsRenamed({"_d": "_p", "_v": "_before"}), [*by, "_p"], "left").join(around.withColumnsRenamed({"_d": "_n", "_v": "_after"}), [*by, "_n"], "left")
    months = panel.where(F.trunc(day, "MM").isin([F.add_months(start, k) for k in (-2, -1, 1, 2)]))
    level = months.groupBy(*by, F.trunc(day, "MM").alias("_m")).agg(F.sum(value).alias("_t")).groupBy(*by).agg(F.median("_t").alias("_level"))  # of four months
    own = Window.partitionBy(*by)
    shape = F.coalesce((F.col("_before") + F.col("_after")) / 2, "_before", "_after", F.lit(0.0))
    whole = F.sum("_shape").over(own)
    part = F.when(whole > 0, F.col("_shape") * F.col("_level") / F.nullif(whole, F.lit(0.0))).otherwise(F.col("_level") / F.count(F.lit(1)).over(own))
    return rows.join(level, by).withColumn("_shape", shape).withColumn("corrected", part).select(*by, day, value, "corrected")


def holiday_aligned(panel: DataFrame, by: list[str], day: str, value: str, older: str, source: str, target: str, excluded: DataFrame, ahead: int = 21, after: int = 9, low: float = 0.8, high: float = 1.3) -> DataFrame:
    """Days around a target festival from the same days around the source one, times the growth between
    the older and the source festival's windows, clipped. Keys of `excluded` don't count for the growth;
    without any volume in the older window it is 1."""
    at = lambda d: F.lit(d).cast("date")
    inside = lambda d: F.col(day).between(F.date_sub(at(d), ahead), F.date_add(at(d), after))
    counted = panel.join(excluded.select(*by).distinct(), by, "left_anti")
    sums = counted.agg(F.sum(F.when(inside(source), F.col(value))).alias("_now"), F.sum(F.when(inside(older), F.col(value))).alias("_old"))
    growth = F.least(F.lit(high), F.greatest(F.lit(low), F.when(F.col("_old") > 0, F.col("_now") / F.nullif(F.col("_old"), F.lit(0.0))).otherwise(1.0)))
    rows = panel.where(inside(source)).select(*by, F.date_add(at(target), F.datediff(day, at(source))).alias(day), F.col(value).alias("source_volume"))
    return rows.join(F.broadcast(sums)).select(*by, day, "source_volume", (F.col("source_volume") * growth).alias("corrected"))
