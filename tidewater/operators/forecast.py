"""Forecasts, their errors, calibration and intervals."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def errors(actual: str, predicted: str) -> list[Column]:
    """Aggregates mae, rmse, wape, smape, r2."""
    a, p = F.col(actual), F.col(predicted)
    e = p - a
    spread = F.sum(a * a) - F.sum(a) * F.sum(a) / F.count(F.lit(1))
    return [
        F.avg(F.abs(e)).alias("mae"),
        F.sqrt(F.avg(e * e)).alias("rmse"),
        F.try_divide(F.sum(F.abs(e)), F.sum(a)).alias("wape"),
        F.avg(F.when(a + p > 0, F.try_divide(2 * F.abs(e), a + p)).otherwise(F.lit(0.0))).alias("smape"),
        (1 - F.try_divide(F.sum(e * e), spread)).alias("r2"),
    ]


def calibrated(rows: DataFrame, by: list[str], base: str, target: str) -> DataFrame:
    """Shares of the base, rounded half to even, of the whole target; the first largest one takes what
    rounding left. A row for each key: the keys are one group of a bounded size."""
    own = Window.partitionBy()
    part = F.rint(F.col(base) * F.sum(target).over(own) / (F.sum(base).over(own) + 1e-9)).cast("long")
    rows = rows.withColumn("_part", part).withColumn("_whole", F.rint(F.sum(target).over(own)).cast("long"))
    first = F.row_number().over(own.orderBy(F.desc("_part"), *by)) == 1
    return rows.select(*by, (F.col("_part") + F.when(first, F.col("_whole") - F.sum("_part").over(own)).otherwise(0)).alias("calibrated"))


def recursive(panel: DataFrame, by: list[str], day: str, value: str, ahead: int, history: int = 56) -> DataFrame:
    """`ahead` days after the last one of each key: half the mean of the same weekdays of four weeks, half
    the mean of a week, forecast days included; at most 1.2 times the largest value.

    Only the last `history` days and the largest value of a key go to its task."""
    own = Window.partitionBy(*by)
    last = panel.withColumn("_k", F.row_number().over(own.orderBy(F.desc(day)))).withColumn("_top", F.max(value).over(own)).where(F.col("_k") <= history)

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(day)
        x = rows[value].tolist()
        cap = 1.2 * float(rows["_top"].iloc[0])
        for _ in range(ahead):
            week = x[-7::-7][:4]
            x.append(min(cap, 0.5 * float(np.mean(week)) + 0.5 * float(np.mean(x[-7:]))))
        start = pd.Timestamp(rows[day].iloc[-1])
        out = pd.DataFrame({c: [k] * ahead for c, k in zip(by, key)})
        out["step"] = range(1, ahead + 1)
        out[day] = [(start + pd.Timedelta(days=i)).date() for i in range(1, ahead + 1)]
        out["forecast"] = np.round(x[-ahead:], 6)
        return out

    kinds = ", ".join(f"{c} {panel.schema[c].dataType.simpleString()}" for c in by)
    return last.select(*by, day, value, "_top").groupBy(*by).applyInPandas(run, f"{kinds}, step int, {day} date, forecast double")


def conformal(residuals: DataFrame, residual: str, by: list[str], levels: list[float]) -> DataFrame:
    """Radii of intervals: quantiles of the absolute residuals."""
    return residuals.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *[F.percentile(F.abs(residual), p).alias(f"radius{round(100 * p)}") for p in levels])


def grey(series: DataFrame, by: list[str], order: str, value: str, ahead: int) -> DataFrame:
    """GM(1,1): a, b of x(k) + a z(k) = b by least squares over closed-form sums, z the mean of neighbouring
    cumulative sums; and the forecasts that follow."""
    own = Window.partitionBy(*by).orderBy(order)
    cum = F.sum(value).over(own.rowsBetween(Window.unboundedPreceding, 0))
    rows = series.withColumn("_k", F.row_number().over(own)).withColumn("_c", cum)
    rows = rows.withColumn("_z", -(F.col("_c") + F.lag("_c").over(own)) / 2)
    fit = rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.regr_slope(F.when(F.col("_k") > 1, F.col(value)), F.col("_z")).alias("a"),
        F.regr_intercept(F.when(F.col("_k") > 1, F.col(value)), F.col("_z")).alias("b"),
        F.min_by(value, order).alias("first"),
    )
    steps = fit.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(ahead))))
    e = lambda k: F.exp(-F.col("a") * k)
    x = (F.col("first") - F.col("b") / F.col("a")) * (e(F.col("n") + F.col("step") - 1) - e(F.col("n") + F.col("step") - 2))
    return steps.where("a <> 0").select(*by, "n", "a", "b", "step", x.alias("forecast"))
