"""Windows over whole groups and over order: ranks, scales, runs, neighbours."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def percent_rank_average(value: str | Column, *by: str) -> Column:
    """Rank of a value as a share of its group, ties averaged (not SQL's percent_rank)."""
    value = F.col(value) if isinstance(value, str) else value
    own = Window.partitionBy(*by)
    return (F.rank().over(own.orderBy(value)) + (F.count(F.lit(1)).over(own.partitionBy(*by, value)) - 1) / F.lit(2.0)) / F.count(F.lit(1)).over(own)


def scaled(value: str, *by: str) -> Column:
    """From 0 to 1 between the least and the largest value; 0 if all are equal."""
    own = Window.partitionBy(*by)
    low, high = F.min(value).over(own), F.max(value).over(own)
    return F.when(high > low, (F.col(value) - low) / (high - low)).otherwise(F.lit(0.0))


def standardised(value: str, *by: str) -> Column:
    """Distance from nothing in sample standard deviations; a spread of 0 or none counts as 1."""
    spread = F.stddev_samp(value).over(Window.partitionBy(*by))
    return F.col(value) / F.when(spread > 0, spread).otherwise(F.lit(1.0))


def share(value: str, *by: str) -> Column:
    return F.col(value) / F.sum(value).over(Window.partitionBy(*by))


def lagged(df: DataFrame, value: str, by: list[str], order: str, lags: list[int]) -> DataFrame:
    own = Window.partitionBy(*by).orderBy(order)
    return df.withColumns({f"{value}_lag{k}": F.lag(value, k).over(own) for k in lags})


def rolled(df: DataFrame, value: str, by: list[str], order: str, widths: list[int]) -> DataFrame:
    """Mean, largest value and share of positive ones of the `width` rows before a row (or as many as there
    are); what is before the first row counts as not positive."""
    own = Window.partitionBy(*by).orderBy(order)
    out = {}
    for w in widths:
        frame = own.rowsBetween(-w, -1)
        out[f"{value}_mean{w}"] = F.avg(value).over(frame)
        out[f"{value}_max{w}"] = F.max(value).over(frame)
        out[f"{value}_pos{w}"] = F.coalesce(F.avg((F.col(value) > 0).cast("double")).over(frame), F.lit(0.0))
    return df.withColumns(out)


def full_frame_mean(value: str, by: list[str], order: str, lo: int, hi: int) -> Column:
    """Mean over a frame of rows, null unless the frame is full."""
    frame = Window.partitionBy(*by).orderBy(order).rowsBetween(lo, hi)
    return F.when(F.count(value).over(frame) == hi - lo + 1, F.avg(value).over(frame))


def runs(df: DataFrame, by: list[str], position: str, keep: Column) -> DataFrame:
    """Runs of rows for which `keep` holds at positions one after another: by, first, last, length."""
    kept = df.where(keep)
    island = F.col(position) - F.row_number().over(Window.partitionBy(*by).orderBy(position))
    return kept.withColumn("_island", island).groupBy(*by, "_island").agg(F.min(position).alias("first"), F.max(position).alias("last"), F.count(F.lit(1)).alias("length")).drop("_island")


def half_gaps(x: str, by: list[str]) -> Column:
    """The width that a point of a section stands for: half the way to each neighbour."""
    own = Window.partitionBy(*by).orderBy(x)
    back, ahead = F.col(x) - F.lag(x).over(own), F.lead(x).over(own) - F.col(x)
    return (F.coalesce(back, F.lit(0.0)) + F.coalesce(ahead, F.lit(0.0))) / 2


def adjusted_p(df: DataFrame, p: str, by: list[str], out: str) -> DataFrame:
    """Benjamini-Hochberg: p * m / rank, and the least of that from the largest p down."""
    own = Window.partitionBy(*by).orderBy(p)
    ranked = df.withColumn("_k", F.row_number().over(own)).withColumn("_m", F.count(F.lit(1)).over(Window.partitionBy(*by)))
    down = Window.partitionBy(*by).orderBy(F.desc("_k")).rowsBetween(Window.unboundedPreceding, 0)
    return ranked.withColumn(out, F.least(F.lit(1.0), F.min(F.col(p) * F.col("_m") / F.col("_k")).over(down))).drop("_k", "_m")


def first_of_each(df: DataFrame, by: list[str], *order: Column) -> DataFrame:
    """One row of each key, the first by a total order."""
    return df.withColumn("_k", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where("_k = 1").drop("_k")


def top_of_each(df: DataFrame, by: list[str], n: int, *order: Column, rank: str = "rank") -> DataFrame:
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col(rank) <= n)


RANGES = 1024  #: into which the values between a group's least and largest are dealt


def running(df: DataFrame, by: list[str], value: str, weight: str | None = None) -> DataFrame:
    """by..., value, n, below, total: of each distinct value how many rows have it, a smaller one, and any (with
    `weight`, the sums of the rows' weights). Null values are left out. Sums run over RANGES ranges of values and within each range, so that no
    task sorts a group's all rows; equal rows are summed up before they are shuffled."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg((F.sum(weight) if weight else F.count(F.lit(1))).alias("n"))
    span = counts.groupBy(*by).agg(F.min(value).cast("double").alias("_a"), F.max(value).cast("double").alias("_b"))
    rows = counts.join(span, by) if by else counts.join(F.broadcast(span))
    part = F.when(F.col("_b") > F.col("_a"), F.least(F.lit(RANGES - 1), F.floor((F.col(value) - F.col("_a")) / (F.col("_b") - F.col("_a")) * RANGES))).otherwise(0)
    rows = rows.withColumn("_r", part).drop("_a", "_b")
    sums = rows.groupBy(*by, "_r").agg(F.sum("n").alias("_n"))
    own = Window.partitionBy(*by)
    # RANGES rows of a group at most
    sums = sums.withColumns({"_base": F.coalesce(F.sum("_n").over(own.orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), "total": F.sum("_n").over(own)}).drop("_n")
    inside = Window.partitionBy(*by, "_r").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_in", F.coalesce(F.sum("n").over(inside), F.lit(0)))
    return rows.join(sums, [*by, "_r"]).select(*by, value, "n", (F.col("_base") + F.col("_in")).alias("below"), "total")


def percent_ranks(df: DataFrame, value: str, out: str, *by: str) -> DataFrame:
    """df with the rank of each value as a share of its group, ties averaged, as percent_rank_average() tells
    it; rows without a value have none."""
    r = running(df, list(by), value).select(*by, value, ((F.col("below") + (F.col("n") + 1) / F.lit(2.0)) / F.col("total")).alias(out))
    return df.join(r, [*by, value], "left")


def quantiles(df: DataFrame, by: list[str], value: str, wanted: dict[str, float]) -> DataFrame:
    """by..., and each wanted quantile of the values, exact, on the line between neighbouring values."""
    r = running(df, by, value)

    def at(p: float) -> Column:
        h = (F.col("total") - 1) * F.lit(float(p))
        lo, hi = F.floor(h), F.ceil(h)
        one = lambda k: F.max(F.when((F.col("below") <= k) & (k < F.col("below") + F.col("n")), F.col(value).cast("double")))
        a, b = one(lo), one(hi)
        return a + (b - a) * F.max(h - lo)

    return r.groupBy(*by).agg(*[at(p).alias(name) for name, p in wanted.items()])


def weighted_quantiles(df: DataFrame, by: list[str], value: str, weight: str, wanted: dict[str, float]) -> DataFrame:
    """by..., and for each wanted share the least value up to which that share of all weight lies."""
    r = running(df, by, value, weight)
    at = lambda p: F.min(F.when((F.col("below") + F.col("n")) / F.col("total") >= p - 1e-9, F.col(value)))
    return r.groupBy(*by).agg(*[at(p).alias(name) for name, p in wanted.items()])
