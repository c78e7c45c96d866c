"""Cross-sections: interpolation on a common grid, change between surveys, shape."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def intervals(points: DataFrame, by: list[str], x: str, z: str) -> DataFrame:
    """by..., x0, z0, x1, z1, m0, m1, last: neighbouring points with monotone (Fritsch-Carlson) slopes."""
    own = Window.partitionBy(*by).orderBy(x)
    rows = points.select(*by, F.col(x).alias("x"), F.col(z).alias("z"))
    rows = rows.withColumns({"hb": F.col("x") - F.lag("x").over(own), "h": F.lead("x").over(own) - F.col("x"), "db": (F.col("z") - F.lag("z").over(own)) / (F.col("x") - F.lag("x").over(own)), "d": (F.lead("z").over(own) - F.col("z")) / (F.lead("x").over(own) - F.col("x"))})
    rows = rows.withColumns({"h2": F.lead("h").over(own), "d2": F.lead("d").over(own), "hb2": F.lag("hb").over(own), "db2": F.lag("db").over(own)})

    def end(h: str, d: str, h2: str, d2: str) -> Column:
        m = ((2 * F.col(h) + F.col(h2)) * F.col(d) - F.col(h) * F.col(d2)) / (F.col(h) + F.col(h2))
        flat = F.signum(m) != F.signum(d)
        steep = (F.signum(d) != F.signum(d2)) & (F.abs(m) > 3 * F.abs(d))
        return F.when(F.col(d2).isNull(), F.col(d)).when(flat, 0.0).when(steep, 3 * F.col(d)).otherwise(m)

    w1, w2 = 2 * F.col("h") + F.col("hb"), F.col("h") + 2 * F.col("hb")
    inner = F.when(F.col("db") * F.col("d") <= 0, 0.0).otherwise((w1 + w2) / (w1 / F.nullif("db", F.lit(0.0)) + w2 / F.nullif("d", F.lit(0.0))))
    rows = rows.withColumn("m", F.when(F.col("hb").isNull(), end("h", "d", "h2", "d2")).when(F.col("h").isNull(), end("hb", "db", "hb2", "db2")).otherwise(inner))
    rows = rows.withColumns({"x1": F.lead("x").over(own), "z1": F.lead("z").over(own), "m1": F.lead("m").over(own), "last": F.lead("x", 2).over(own).isNull()})
    return rows.where("x1 IS NOT NULL").select(*by, F.col("x").alias("x0"), F.col("z").alias("z0"), "x1", "z1", F.col("m").alias("m0"), "m1", "last")


def on_grid(points: DataFrame, by: list[str], x: str, z: str, step: float) -> DataFrame:
    """by..., k, x, linear, monotone: both interpolations at multiples k of the step, within each section's
    range. Each interval makes its own grid points."""
    rows = intervals(points, by, x, z)
    a = F.ceil(F.col("x0") / step)
    b = F.when(F.col("last"), F.floor(F.col("x1") / step)).otherwise(F.ceil(F.col("x1") / step) - 1)
    rows = rows.withColumns({"_a": a, "_b": b}).where("_a <= _b").withColumn("k", F.explode(F.sequence("_a", "_b")))
    h = F.col("x1") - F.col("x0")
    t = (F.col("k") * step - F.col("x0")) / h
    t2, t3 = t * t, t * t * t
    linear = F.col("z0") + (F.col("z1") - F.col("z0")) * t
    cubic = (2 * t3 - 3 * t2 + 1) * F.col("z0") + (t3 - 2 * t2 + t) * h * F.col("m0") + (3 * t2 - 2 * t3) * F.col("z1") + (t3 - t2) * h * F.col("m1")
    return rows.select(*by, "k", (F.col("k") * step).alias("x"), linear.alias("linear"), cubic.alias("monotone"))


def changes(grid: DataFrame, survey: str, value: str, step: float) -> DataFrame:
    """survey, before, net, deposition, erosion, top, bottom: areas between each survey and the one before it
    on their common grid points, by trapezoids. Only neighbours on the grid are joined."""
    own = Window.partitionBy("k").orderBy(survey)
    rows = grid.select("k", survey, F.col(value).alias("z"), F.lag(value).over(own).alias("z_before"), F.lag(survey).over(own).alias("before")).where("before IS NOT NULL")
    rows = rows.withColumn("delta", F.col("z") - F.col("z_before"))
    along = Window.partitionBy(survey, "before").orderBy("k")
    rows = rows.withColumn("next", F.when(F.lead("k").over(along) == F.col("k") + 1, F.lead("delta").over(along)))
    up, down = (lambda c: F.greatest(F.col(c), F.lit(0.0))), (lambda c: F.greatest(-F.col(c), F.lit(0.0)))
    area = lambda f: F.sum(F.when(F.col("next").isNotNull(), (f("delta") + f("next")) / 2 * step).otherwise(0.0))
    return rows.groupBy(survey, "before").agg(area(F.col).alias("net"), area(up).alias("deposition"), area(down).alias("erosion"), F.max("delta").alias("top"), F.min("delta").alias("bottom"), F.count(F.lit(1)).alias("n"))
