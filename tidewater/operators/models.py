"""Linear and logistic models from sums over all rows: what reaches the driver is a square of the number of
features, whatever the number of rows is."""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass
class Linear:
    names: list[str]
    coef: np.ndarray  #: the constant first
    errors: np.ndarray | None = None

    def column(self) -> Column:
        return linear(self.names, self.coef)

    def table(self, spark: SparkSession) -> DataFrame:
        rows = [(n, float(c), None if self.errors is None else float(e)) for n, c, e in zip(["(constant)", *self.names], self.coef, self.errors if self.errors is not None else self.coef)]
        return spark.createDataFrame(rows, "term string, coef double, std_error double")


def linear(names: list[str], coef: np.ndarray) -> Column:
    return reduce(Column.__add__, [F.lit(float(b)) * F.col(n) for n, b in zip(names, coef[1:])], F.lit(float(coef[0])))


def sigmoid(z: Column) -> Column:
    return 1 / (1 + F.exp(-F.least(F.lit(35.0), F.greatest(F.lit(-35.0), z))))


def gram(df: DataFrame, names: list[str], weight: Column | None = None, target: Column | None = None) -> tuple[np.ndarray, np.ndarray, int]:
    """Sums of weighted products of the features (a constant first) with each other and with the target."""
    x = [F.lit(1.0), *[F.col(n).cast("double") for n in names]]
    w = F.lit(1.0) if weight is None else weight
    k = len(x)
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    sums = [F.sum(w * x[i] * x[j]).alias(f"g{i}_{j}") for i, j in pairs]
    sums += [F.sum(x[i] * (F.lit(0.0) if target is None else target)).alias(f"t{i}") for i in range(k)]
    r = df.agg(F.count(F.lit(1)).alias("n"), *sums).first()
    g = np.zeros((k, k))
    for i, j in pairs:
        g[i, j] = g[j, i] = r[f"g{i}_{j}"] or 0.0
    return g, np.array([r[f"t{i}"] or 0.0 for i in range(k)]), r["n"]


def ridge(df: DataFrame, names: list[str], y: str, penalty: float = 0.0) -> Linear:
    """Least squares; the constant is not held back."""
    g, t, _ = gram(df, names, target=F.col(y).cast("double"))
    return Linear(names, np.linalg.solve(g + penalty * np.diag([0.0, *[1.0] * len(names)]), t))


def smearing(df: DataFrame, model: Linear, y: str) -> float:
    """Duan's factor for a model of logs: the mean of the residuals' exponentials."""
    return df.agg(F.avg(F.exp(F.col(y) - model.column()))).first()[0]


def logistic(df: DataFrame, names: list[str], y: str, penalty: float = 0.0, firth: bool = False, rounds: int = 25, floor: dict[str, float] | None = None) -> Linear:
    """Newton's steps over sums. firth: with half the log of the information's determinant as a penalty, which
    keeps separated data finite. floor: least coefficients of some features."""
    b = np.zeros(len(names) + 1)
    held = penalty * np.diag([0.0, *[1.0] * len(names)])
    low = np.array([-np.inf, *[(floor or {}).get(n, -np.inf) for n in names]])
    x = [F.lit(1.0), *[F.col(n).cast("double") for n in names]]
    for _ in range(rounds):
        p = sigmoid(linear(names, b))
        if firth:
            info, _, _ = gram(df, names, weight=p * (1 - p))
            inv = np.linalg.inv(info + held + 1e-12 * np.eye(len(b)))
            lever = p * (1 - p) * reduce(Column.__add__, [F.lit(float(inv[i, j])) * x[i] * x[j] for i in range(len(x)) for j in range(len(x))])
            _, score, _ = gram(df, names, target=F.col(y) - p + lever * (0.5 - p))
        else:
            info, score, _ = gram(df, names, weight=p * (1 - p), target=F.col(y) - p)
        full = info + held + 1e-12 * np.eye(len(b))
        step = np.linalg.solve(full, score - held @ b)
        step *= min(1.0, 5.0 / max(1e-12, np.abs(step).max()))
        new = np.maximum(b + step, low)
        done = np.abs(new - b).max() < 1e-9
        b = new
        if done:
            break
    return Linear(names, b, np.sqrt(np.diag(np.linalg.inv(full))))


def principal(df: DataFrame, parts: str, size: int, keep: int = 2) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Means, directions (each with its largest entry positive) and shares of variance of an array column."""
    names = [f"_p{i}" for i in range(size)]
    wide = df.select(*[F.element_at(parts, i + 1).alias(n) for i, n in enumerate(names)])
    g, _, n = gram(wide, names)
    mean = g[0, 1:] / n
    cov = g[1:, 1:] / n - np.outer(mean, mean)
    values, vectors = np.linalg.eigh(cov)
    order = np.argsort(values)[::-1]
    vectors = vectors[:, order[:keep]].T
    vectors *= np.sign(vectors[np.arange(keep), np.abs(vectors).argmax(1)])[:, None]
    return mean, vectors, values[order[:keep]] / values.sum()


def wilson(hits: Column, n: Column, z: float = 1.959963984540054) -> tuple[Column, Column]:
    """The bounds of Wilson's interval of a share."""
    p = hits / n
    middle = p + z * z / (2 * n)
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
    return (middle - half) / (1 + z * z / n), (middle + half) / (1 + z * z / n)


def chi_square(table: DataFrame, a: str, b: str, n: str) -> DataFrame:
    """chi2, dof, n, cramers_v of a table of counts (a row for each pair that is there)."""
    from pyspark.sql import Window

    rows = table.select(a, b, n, F.sum(n).over(Window.partitionBy(a)).alias("ra"), F.sum(n).over(Window.partitionBy(b)).alias("rb"))
    s = rows.agg(F.sum(F.col(n) * F.col(n) / (F.col("ra") * F.col("rb"))).alias("s"), F.sum(n).alias("n"), F.count_distinct(a).alias("ka"), F.count_distinct(b).alias("kb"))
    # sum of n^2 / (ra rb) is 1 + chi2 / N, pairs that are not there included
    chi2 = F.col("n") * (F.col("s") - 1)
    return s.select(chi2.alias("chi2"), ((F.col("ka") - 1) * (F.col("kb") - 1)).alias("dof"), "n", F.sqrt(chi2 / F.nullif(F.col("n") * (F.least("ka", "kb") - 1), F.lit(0))).alias("cramers_v"))


def ranked_auc(df: DataFrame, score: str, y: str) -> DataFrame:
    """auc (ties count half), brier, log_loss, accuracy. Ranks come from sums over distinct scores, dealt by
    ranges of the score, so that no task sorts all rows."""
    from pyspark.sql import Window

    counts = df.groupBy(F.col(score).alias("s")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(y).cast("long")).alias("pos"))
    # running sums in two levels: within 1024 ranges of the score, and over the ranges
    ranges = counts.withColumn("r", F.floor(F.col("s") * 1024))
    sums = ranges.groupBy("r").agg(F.sum(F.col("n") - F.col("pos")).alias("neg"))
    before = sums.select("r", F.coalesce(F.sum("neg").over(Window.orderBy("r").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    own = Window.partitionBy("r").orderBy("s").rowsBetween(Window.unboundedPreceding, -1)
    rows = ranges.join(F.broadcast(before), "r").withColumn("below", F.col("base") + F.coalesce(F.sum(F.col("n") - F.col("pos")).over(own), F.lit(0)))
    wins = F.sum(F.col("pos") * (F.col("below") + (F.col("n") - F.col("pos")) / 2))
    auc = rows.agg((wins / F.nullif(F.sum("pos") * F.sum(F.col("n") - F.col("pos")), F.lit(0))).alias("auc"))
    p = F.least(F.lit(1 - 1e-12), F.greatest(F.lit(1e-12), F.col(score)))
    loss = df.agg(F.avg(F.pow(F.col(score) - F.col(y), F.lit(2))).alias("brier"), (-F.avg(F.col(y) * F.log(p) + (1 - F.col(y)) * F.log(1 - p))).alias("log_loss"), F.avg(((F.col(score) >= 0.5).cast("int") == F.col(y)).cast("double")).alias("accuracy"))
    return auc.join(F.broadcast(loss))
