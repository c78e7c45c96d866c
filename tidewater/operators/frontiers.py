"""Choices period by period whose sums have limits: frontiers of what no other choice beats.

A stretch of periods has the choices that are not beaten, for each setting that it may begin after and end
with. Two stretches side by side make one: whatever the first ends with is what the second begins after.
That is associative, so that stretches are put together two by two, in as many rounds as the logarithm of
their number, each group by itself.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LESS = ["cost", "error", "gap"]  #: the less the better: cost and error add up, of gaps the largest counts
COLUMNS = ["before", "after", *LESS, "captured", "choices"]


def unbeaten(x: np.ndarray) -> np.ndarray:
    """Rows that no other is at least as good as in all columns (the less the better) and better in one; of equal
    rows the first stays. Rows are taken in order, so that only earlier ones can beat a row."""
    order = np.lexsort(x.T[::-1])
    kept: list[int] = []
    held = np.empty((0, x.shape[1]))
    for i in order.tolist():
        if not len(held) or not (held <= x[i]).all(1).any():
            kept.append(i)
            held = np.concatenate([held, x[i][None, :]])
    return np.array(sorted(kept), np.int64)


def measures(f: pd.DataFrame) -> np.ndarray:
    return np.column_stack([*(f[c] for c in LESS), -f["captured"]]).astype(float)


def pruned(f: pd.DataFrame) -> pd.DataFrame:
    parts = [g.iloc[unbeaten(measures(g))] for _, g in f.sort_values(["before", "after", "choices"], kind="stable").groupby(["before", "after"], sort=True)]
    return pd.concat(parts, ignore_index=True) if parts else f


def joined(first: pd.DataFrame, second: pd.DataFrame) -> pd.DataFrame:
    """The stretch of two that follow each other."""
    both = first.merge(second, left_on="after", right_on="before", suffixes=("_1", "_2"))
    return pruned(
        pd.DataFrame(
            {
                "before": both["before_1"],
                "after": both["after_2"],
                "cost": both["cost_1"] + both["cost_2"],
                "error": both["error_1"] + both["error_2"],
                "gap": np.maximum(both["gap_1"], both["gap_2"]),
                "captured": both["captured_1"] + both["captured_2"],
                "choices": both["choices_1"] + "|" + both["choices_2"],
            }
        )
    )


def frontier(options: DataFrame, by: list[str], period: str) -> DataFrame:
    """by..., before, after, cost, error, gap, captured, choices: the unbeaten ways through all periods. options have
    a row for each group, period (whole numbers from 0 without gaps) and choice, with those columns; `before`
    and `after` are settings: a choice can only follow one that ends with what it begins after. A task holds the
    unbeaten ways of two stretches of one group."""
    kinds = ", ".join(f"{c} {options.schema[c].dataType.simpleString()}" for c in [*by, period, *COLUMNS])

    def merged(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        halves = [g[COLUMNS] for _, g in pdf.sort_values(period).groupby(period, sort=True)]
        out = joined(*halves) if len(halves) == 2 else pruned(halves[0])
        for c, v in zip(by, key):
            out[c] = v
        out[period] = int(pdf[period].min()) // 2
        return out[[*by, period, *COLUMNS]]

    rows = options.select(*by, period, *COLUMNS)
    last = options.agg(F.max(period)).first()[0]
    for _ in range(max(1, int(last or 0).bit_length())):
        rows = rows.withColumn("_half", F.floor(F.col(period) / 2)).groupBy(*by, "_half").applyInPandas(lambda key, pdf: merged(key[:-1], pdf), kinds)
    return rows.drop(period)


def limited(ways: DataFrame, by: list[str], limits: DataFrame) -> DataFrame:
    """by..., the limits (error_limit, gap_limit, captured_least) and the cheapest way within them, of equal costs
    the one of less error, then the first by its choices; nulls where there is none. Limits are a fixed list."""
    met = ways.join(F.broadcast(limits), by) if set(by) <= set(limits.columns) else ways.crossJoin(F.broadcast(limits))
    fits = (F.col("error") <= F.col("error_limit") + 1e-9) & (F.col("gap") <= F.col("gap_limit")) & (F.col("captured") >= F.col("captured_least") - 1e-9)
    order = F.struct("cost", "error", "choices", "gap", "captured")
    names = [c for c in limits.columns if c not in by]
    best = met.groupBy(*by, *names).agg(F.min(F.when(fits, order)).alias("w"))
    return best.select(*by, *names, F.col("w").isNotNull().alias("feasible"), "w.cost", "w.error", "w.gap", "w.captured", "w.choices")
