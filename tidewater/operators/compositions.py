"""Compositions: closure, log-ratios, groups, and what tells groups apart."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EPS = 0.01  #: the count that stands for an absent part, in %


def let(value: Column, use) -> Column:
    """use(value) with the value computed once for all its uses within."""
    return F.transform(F.array(value), use)[0]


def total(parts: str | Column) -> Column:
    return F.aggregate(parts, F.lit(0.0), lambda a, v: a + v)


def closed(parts: str | Column, whole: float = 100.0) -> Column:
    parts = F.col(parts) if isinstance(parts, str) else parts
    return let(parts, lambda x: let(total(x), lambda t: F.transform(x, lambda v: whole * v / t)))


def clr(parts: str, before_closure: bool = True) -> Column:
    """Centred log-ratios. The pseudocount is added before closure, or after it."""
    x = closed(F.transform(parts, lambda v: v + EPS)) if before_closure else F.transform(closed(parts), lambda v: v + EPS)
    logs = F.transform(x, lambda v: F.log(v))
    return let(logs, lambda l: let(total(l) / F.size(l), lambda m: F.transform(l, lambda v: v - m)))


def from_clr(values: str | Column) -> Column:
    return closed(F.transform(values, lambda v: F.exp(v)))


def squared(a: str | Column, b: str | Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, v: s + v)


def long(df: DataFrame, values: str, *keep: str) -> DataFrame:
    """A row for each part: keep..., part (from 1), v."""
    return df.select(*keep, F.posexplode(values)).select(*keep, (F.col("pos") + 1).alias("part"), F.col("col").alias("v"))


def pairs(rows: DataFrame, values: str, size: int, *by: str) -> DataFrame:
    """Correlations of all pairs of parts i < j: by..., i, j, n, r (0 where a part doesn't vary), in one pass
    over the rows."""
    cols = [F.element_at(values, i + 1) for i in range(size)]
    sums = [F.sum(cols[i]).alias(f"s{i}") for i in range(size)] + [F.sum(cols[i] * cols[j]).alias(f"q{i}_{j}") for i in range(size) for j in range(i, size)]
    s = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *sums)

    def r(i, j):
        c = lambda a, b: F.col(f"q{a}_{b}") - F.col(f"s{a}") * F.col(f"s{b}") / F.col("n")
        var = c(i, i) * c(j, j)
        return F.struct(F.lit(i + 1).alias("i"), F.lit(j + 1).alias("j"), F.when(var > 1e-18, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), c(i, j) / F.sqrt(var)))).otherwise(0.0).alias("r"))

    return s.select(*by, "n", F.explode(F.array(*[r(i, j) for i in range(size) for j in range(i + 1, size)])).alias("p")).select(*by, "n", "p.*")


def best_threshold(df: DataFrame, score: str, y: str, *by: str) -> DataFrame:
    """by..., threshold, youden, accuracy: the cut between neighbouring values (or beyond the ends) with the
    best sum of sensitivity and specificity, then accuracy, then the least cut. Positive is what is at or
    above it."""
    own = Window.partitionBy(*by)
    counts = df.groupBy(*by, score).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(y).cast("long")).alias("pos"))
    order = own.orderBy(score)
    up_to = order.rowsBetween(Window.unboundedPreceding, -1)
    rows = counts.withColumns({"tp0": F.sum("pos").over(own), "n0": F.sum("n").over(own), "fn": F.coalesce(F.sum("pos").over(up_to), F.lit(0)), "below": F.coalesce(F.sum("n").over(up_to), F.lit(0)), "before": F.lag(score).over(order), "last": F.lead(score).over(order).isNull()})
    cut = F.coalesce((F.col("before") + F.col(score)) / 2, F.col(score) - 1e-9)
    at = rows.select(*by, cut.alias("threshold"), "tp0", "n0", "fn", "below")
    end = rows.where("last").select(*by, (F.col(score) + 1e-9).alias("threshold"), "tp0", "n0", F.col("tp0").alias("fn"), F.col("n0").alias("below"))
    both = at.unionByName(end)
    tn = F.col("below") - F.col("fn")
    sens = (F.col("tp0") - F.col("fn")) / F.nullif(F.col("tp0"), F.lit(0))
    spec = tn / F.nullif(F.col("n0") - F.col("tp0"), F.lit(0))
    both = both.withColumns({"youden": F.round(F.coalesce(sens, F.lit(0.0)) + F.coalesce(spec, F.lit(0.0)) - 1, 9), "accuracy": F.round((F.col("tp0") - F.col("fn") + tn) / F.col("n0"), 9)})
    best = both.groupBy(*by).agg(F.max(F.struct("youden", "accuracy", (-F.col("threshold")).alias("t"))).alias("b"))
    return best.select(*by, (-F.col("b.t")).alias("threshold"), "b.youden", "b.accuracy")


def tiled(rows: DataFrame, count: int, id: str, *columns: Column | str) -> DataFrame:
    """s, t: arrays of structs, every row's struct meeting every other one's in one of the tiles; so many blocks there
    are, a few dozen however many rows, so that a row is shuffled that often and not once for each block of a size."""
    tiles = max(1, min(count, 24), math.ceil(count / 200))
    blocks = rows.groupBy(F.pmod(F.xxhash64(id), F.lit(tiles)).cast("int").alias("b")).agg(F.collect_list(F.struct(*columns)).alias("s"))
    other = blocks.select(F.col("b").alias("o"), F.col("s").alias("t"))
    pairs = blocks.withColumn("o", F.explode(F.sequence(F.lit(0), F.lit(tiles - 1)))).repartition(min(tiles * tiles, 144), "b", "o")
    return pairs.join(other.withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(tiles - 1)))).repartition(min(tiles * tiles, 144), "b", "o"), ["b", "o"]).select("s", "t")


def silhouettes(rows: DataFrame, id: str, group: str, values: str, each: int = 256) -> DataFrame:
    """id, group, silhouette under Euclidean distances. By definition every row meets every other one: rows
    are dealt to tiles, and a task adds up the distances between two of them by products of matrices, so that what
    is shuffled are tiles and sums, not pairs of rows."""
    kinds = [rows.schema[c].dataType.simpleString() for c in (id, group)]
    pairs = tiled(rows, max(1, -(-rows.count() // each)), id, F.col(id).alias("id"), F.col(group).alias("g"), F.col(values).alias("v"))

    def run(batches):
        for b in batches:
            for k in range(b.num_rows):
                s, t = (b.column(c).slice(k, 1).flatten() for c in ("s", "t"))
                if not len(s) or not len(t):
                    continue
                x, y = (v.field("v").flatten().to_numpy().reshape(len(v), -1) for v in (s, t))
                groups, at = np.unique(t.field("g").to_numpy(zero_copy_only=False), return_inverse=True)
                one = (at[:, None] == np.arange(len(groups))[None, :]).astype(np.float64)
                xx, yy, sums, step = (x * x).sum(1), (y * y).sum(1), np.empty((len(x), len(groups))), max(1, 1_000_000 // len(y))
                for lo in range(0, len(x), step):
                    scale = xx[lo : lo + step, None] + yy[None, :]
                    d = scale - 2 * x[lo : lo + step] @ y.T
                    # of rows so near that the product has few digits left, from their differences
                    i, j = np.nonzero(d < 1e-6 * scale)
                    for p in range(0, len(i), 1_000_000):
                        e = x[lo + i[p : p + 1_000_000]] - y[j[p : p + 1_000_000]]
                        d[i[p : p + 1_000_000], j[p : p + 1_000_000]] = (e * e).sum(1)
                    sums[lo : lo + step] = np.sqrt(d, out=d) @ one
                for q, g in enumerate(groups):
                    yield pa.RecordBatch.from_arrays([s.field("id"), s.field("g"), pa.array([g.item()] * len(s), s.field("g").type), pa.array(sums[:, q].copy()), pa.array([int(one[:, q].sum())] * len(s), pa.int64())], names=["id", "g", "k", "d", "n"])

    sums = pairs.mapInArrow(run, f"id {kinds[0]}, g {kinds[1]}, k {kinds[1]}, d double, n long").groupBy("id", "g", "k").agg(F.sum("d").alias("d"), F.sum("n").alias("n"))
    own = F.col("g") == F.col("k")
    mean = F.when(own & (F.col("n") == 1), 0.0).otherwise(F.col("d") / (F.col("n") - own.cast("int")))
    s = sums.withColumn("m", mean).groupBy("id", "g").agg(F.max(F.when(own, F.col("m"))).alias("a"), F.min(F.when(~own, F.col("m"))).alias("b"))
    return s.select(F.col("id").alias(id), F.col("g").alias(group), ((F.col("b") - F.col("a")) / F.greatest("a", "b")).alias("silhouette"))
