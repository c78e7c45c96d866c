"""Choices under constraints, as rounds and sums over rows instead of a solver."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewater.sources.shared import dropped, written


def matched(pairs: DataFrame, i: str, j: str, *order: Column, rounds: int = 200) -> DataFrame:
    """The pairs that a greedy matching takes in a total order: a pair that is the first one of both its ends
    is taken, all others of these ends go, and so on until none is left. Each round is two aggregations."""
    rest = written(pairs.select(i, j, F.struct(*[o.alias(f"_{k}") for k, o in enumerate(order)], F.col(i), F.col(j)).alias("_o")), "pairs")
    taken = []
    for _ in range(rounds):
        if not rest.limit(1).count():
            break
        ends = rest.select(F.explode(F.array(i, j)).alias("_e"), "_o").groupBy("_e").agg(F.min("_o").alias("_best"))
        a, b = ends.withColumnsRenamed({"_e": i, "_best": "_a"}), ends.withColumnsRenamed({"_e": j, "_best": "_b"})
        now = written(rest.join(a, i).join(b, j).where("_a = _o AND _b = _o").select(i, j, "_o"), "taken")
        taken.append(now.select(i, j))
        used = now.select(F.explode(F.array(i, j)).alias("_e"))
        last, rest = rest, written(rest.join(used, rest[i] == used["_e"], "left_anti").join(used, rest[j] == used["_e"], "left_anti"), "pairs")
        dropped(last)
    else:
        raise RuntimeError("the matching did not settle")
    return reduce(DataFrame.unionByName, taken) if taken else pairs.select(i, j).limit(0)


def independent(nodes: DataFrame, conflicts: DataFrame, id: str, *order: Column, rounds: int = 200) -> DataFrame:
    """The nodes that a greedy selection in a total order keeps when conflicting ones (pairs a, b, both ways)
    may not stay together: a node before all its undecided neighbours stays, its neighbours go."""
    rest = written(nodes.select(id, F.struct(*[o.alias(f"_{k}") for k, o in enumerate(order)], F.col(id)).alias("_o")), "nodes")
    edges = conflicts.select(F.col("a").alias(id), F.col("b").alias("_n")).where(F.col(id) != F.col("_n"))
    kept = []
    for _ in range(rounds):
        if not rest.limit(1).count():
            break
        other = rest.select(F.col(id).alias("_n"), F.col("_o").alias("_p"))
        first = edges.join(other, "_n").groupBy(id).agg(F.min("_p").alias("_first"))
        now = written(rest.join(first, id, "left").where("_first IS NULL OR _o < _first").select(id), "kept")
        kept.append(now)
        gone = edges.join(now, id).select(F.col("_n").alias(id)).distinct()
        last, rest = rest, written(rest.join(now, id, "left_anti").join(gone, id, "left_anti"), "nodes")
        dropped(last)
    else:
        raise RuntimeError("the selection did not settle")
    return reduce(DataFrame.unionByName, kept) if kept else nodes.select(id).limit(0)


def priced_choice(options: DataFrame, key: str, option: str, gain: str, cost: str, budget: float, prices: list[float]) -> DataFrame:
    """key, option, gain, cost: of each key the option of most gain less its price for cost, at the least
    price that keeps the budget (Lagrange's bound for choosing one option of each). A key's options, few for each,
    are an array, and a price's best one is found in its row: only options are shuffled, and sums for each price.
    Nothing comes back where no price does."""
    keys = options.groupBy(key).agg(F.collect_list(F.struct(F.col(gain).alias("g"), F.col(cost).alias("c"), F.col(option).alias("o"))).alias("_all"))
    keys = written(keys.repartition(options.sparkSession.sparkContext.defaultParallelism), "options")  # a row costs much

    def best(price: Column) -> Column:
        value = lambda s: F.struct(F.round(s["g"] - price * s["c"], 9).alias("v"), (-s["c"]).alias("c"), (-s["o"]).alias("o"), s["g"].alias("g"))
        return F.array_max(F.transform("_all", value))

    tried = keys.select(F.explode(F.array(*map(F.lit, sorted(prices)))).alias("price"), "_all").select("price", best(F.col("price")).alias("b"))
    least = tried.groupBy("price").agg(F.sum(-F.col("b.c")).alias("total")).where(F.round("total", 6) <= budget).agg(F.min("price").alias("price"))  # one row
    found = keys.join(F.broadcast(least.where("price IS NOT NULL"))).select("price", key, best(F.col("price")).alias("b"))
    return found.select("price", key, (-F.col("b.o")).alias(option), F.col("b.g").alias(gain), (-F.col("b.c")).alias(cost))


def ridge_by(df: DataFrame, by: list[str], names: list[str], y: str, penalty: float) -> DataFrame:
    """by..., coef (the constant first): closed-form ridge of each group from its sums. What is solved has a
    row for each group, of the square of the number of features."""
    x = [F.lit(1.0), *[F.col(n).cast("double") for n in names]]
    k = len(x)
    sums = [F.sum(a * b).alias(f"g{i}_{j}") for i, a in enumerate(x) for j, b in enumerate(x) if i <= j]
    sums += [F.sum(a * F.col(y)).alias(f"t{i}") for i, a in enumerate(x)]
    grams = df.groupBy(*by).agg(*sums)

    def solve(batches):
        for pdf in batches:
            coefs = []
            for r in pdf.itertuples(index=False):
                d = r._asdict()
                g = np.array([[d[f"g{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)], float)
                t = np.array([d[f"t{i}"] for i in range(k)], float)
                coefs.append(np.linalg.solve(g + penalty * np.diag([0.0, *[1.0] * (k - 1)]) + 1e-12 * np.eye(k), t).tolist())
            yield pdf[by].assign(coef=pd.Series(coefs, dtype=object))

    kinds = ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c in by)
    return grams.mapInPandas(solve, f"{kinds}, coef array<double>")


def predicted(names: list[str]) -> Column:
    return reduce(Column.__add__, [F.col("coef")[i + 1] * F.col(n) for i, n in enumerate(names)], F.col("coef")[0])
