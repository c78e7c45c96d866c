"""The interval of a series' integral where much of it is modelled: residuals come in blocks of time.

Each observation has a weight in the integral, so that a total is a sum. Time is cut into blocks; in a draw each
block with modelled values takes the residuals of a random block of as much time from those that begin with a
measurement, each value the residual nearest in time within the block. What a block comes to under the residuals
of another is found once for each two that some draw brings together, and a draw is a sum of such numbers. A series'
observations lie together as arrays for that; neither such twos nor what they meet are rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.operators import ordered
from tidewater.operators.resampling import place
from tidewater.sources.shared import written

HOUR = 3_600_000_000


def weighted(rows: DataFrame, by: list[str], start: int, end: int) -> DataFrame:
    """rows (t in microseconds) with w: the seconds that a value stands for on the lines between it and its
    neighbours; the first and last values are held to the ends of the span."""
    rows = ordered.adjacent(rows.withColumn("_day", F.floor(F.col("t") / (24 * HOUR))), by, "t", "_day").drop("_day")
    half = lambda a, b: (F.col(b) - F.col(a)) / 2e6
    before = F.coalesce(half("_before", "t"), (F.col("t") - start) / 1e6)
    after = F.coalesce(half("t", "_after"), (end - F.col("t")) / 1e6)
    return rows.withColumn("w", before + after).drop("_before", "_after")


def sources(h: np.ndarray, blocks: np.ndarray, draws: int) -> np.ndarray:
    """Which of `blocks` source blocks each target (down) takes in each draw (across)."""
    return place(h, np.arange(1, draws + 1)).astype(np.int64) % blocks[:, None]


def drawn(name: str, hours: int, start: int, end: int, missing: dict[str, np.ndarray], residual: dict[str, np.ndarray], held: tuple[float, float], draws: int, blocks: int = 2_000, most: int = 1 << 20) -> np.ndarray | None:
    """The modelled sum of each draw, from one series' missing values (t, w: weight times flow, line) and residuals (t, e),
    both in the order of t; None without missing values or sources. `most` values at once are met."""
    t, rt, width = missing["t"], residual["t"], hours * HOUR
    count = int(np.searchsorted(rt, end - width, "right"))  # those that begin a whole block
    if not count or not len(t):
        return None
    at = (t - start) % width
    block, first, size = np.unique((t - start) // width, return_index=True, return_counts=True)
    stop = np.searchsorted(rt, rt[:count] + width, "left")
    total = np.zeros(draws)
    for k in range(0, len(block), blocks):
        own, n, begin = block[k : k + blocks], size[k : k + blocks], first[k : k + blocks]
        h = np.array([int(hashlib.md5(f"{name}/{hours}/{b}".encode()).hexdigest()[:12], 16) & 0xFFFFFFFF for b in own.tolist()], np.int64)
        code = np.arange(len(own))[:, None] * count + sources(h, np.full(len(own), count), draws)
        if count <= 4 * draws:
            there = np.zeros(len(own) * count, bool)
            there[code] = True
            pairs, place_ = np.flatnonzero(there), (np.cumsum(there) - 1)[code]
        else:
            pairs, place_ = np.unique(code, return_inverse=True)
            place_ = place_.reshape(code.shape)
        row, source = np.divmod(pairs, count)
        ends = np.cumsum(n[row])
        sums = np.empty(len(pairs))
        lo = 0
        while lo < len(pairs):
            hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + most, "right")))
            m = n[row[lo:hi]]
            heads = np.cumsum(m) - m
            p = np.repeat(np.arange(lo, hi), m)
            q = np.arange(len(p)) + np.repeat(begin[row[lo:hi]] - heads, m)
            src = source[p]
            then = rt[src] + at[q]
            right = np.searchsorted(rt, then, "left")
            inside = right < stop[src]
            after, before = np.minimum(right, len(rt) - 1), np.maximum(right - 1, 0)
            later = (right <= src) | inside & (rt[after] - then < then - rt[before])  # of equally near ones the earlier
            e = residual["e"][np.where(later, after, before)]
            sums[lo:hi] = np.add.reduceat(missing["w"][q] * np.minimum(held[1], np.maximum(held[0], np.exp(missing["line"][q] + e))), heads)
            lo = hi
        total += sums[place_].sum(0)
    return total


def intervals(rows: DataFrame, key: str, start: int, end: int, hours: list[int], draws: int) -> DataFrame:
    """key, hours, draws, base, median, low, high of the integral of flow times y over the span (microseconds). rows
    have the key, t (unlike within a key), flow and y, null where it is to be modelled: by the line of logs of y on
    those of flow, within the least and largest y. Keys with fewer than three values of y, without a spread of flow
    or with no value that begins a whole block have no row. A key's rows lie in one task, as arrays; of what they are
    drawn together at most a million values at once."""
    kind = rows.schema[key].dataType.simpleString()
    x = F.log("flow")
    rows = written(weighted(rows.select(F.col(key).alias("key"), "t", "flow", "y"), ["key"], start, end), "integral-rows", compression="zstd")
    known = rows.where("y > 0 AND flow > 0")
    fit = known.groupBy("key").agg(F.regr_slope(F.log("y"), x).alias("b"), F.regr_intercept(F.log("y"), x).alias("a"), F.min("y").alias("least"), F.max("y").alias("most"), F.count(F.lit(1)).alias("n"), F.var_pop(x).alias("spread"))
    fit = fit.where("n >= 3 AND spread > 1e-12").drop("n", "spread")
    # a key costs much
    rows = rows.where("flow > 0").repartition(4 * rows.sparkSession.sparkContext.defaultParallelism, "key").join(fit, "key").withColumn("line", F.col("a") + F.col("b") * x)
    held = F.least("most", F.greatest("least", F.exp("line")))
    weight = F.col("w") * F.col("flow")
    sure = F.coalesce(F.sum(F.when(F.col("y") > 0, weight * F.col("y"))), F.lit(0.0)).alias("sure")
    modelled = F.coalesce(F.sum(F.when(F.col("y").isNull(), weight * held)), F.lit(0.0)).alias("modelled")
    missing = F.array_sort(F.collect_list(F.when(F.col("y").isNull(), F.struct("t", weight.alias("w"), "line")))).alias("missing")
    residual = F.array_sort(F.collect_list(F.when(F.col("y") > 0, F.struct("t", (F.log("y") - F.col("line")).alias("e"))))).alias("residual")
    keys = rows.groupBy("key").agg(F.first("least").alias("least"), F.first("most").alias("most"), sure, modelled, missing, residual).withColumn("name", F.col("key").cast("string"))

    def told(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            series = {c: (b.column(c).offsets.to_numpy(), {f: b.column(c).values.field(f).to_numpy() for f in fields}) for c, fields in (("missing", ("t", "w", "line")), ("residual", ("t", "e")))}
            at, out = [], []
            for k, (name, least, most) in enumerate(zip(*(b.column(c).to_pylist() for c in ("name", "least", "most")))):
                own = [{f: v[o[k] : o[k + 1]] for f, v in values.items()} for o, values in series.values()]
                for n in hours:
                    total = drawn(name, n, start, end, *own, (least, most), draws)
                    if total is not None:
                        low, middle, high = np.quantile(total, [0.025, 0.5, 0.975])
                        at.append(k)
                        out.append((n, middle, low, high))
            columns = [b.column(c).take(pa.array(at, pa.int64())) for c in ("key", "sure", "modelled")]
            told_ = [pa.array([r[c] for r in out], t) for c, t in enumerate((pa.int32(), pa.float64(), pa.float64(), pa.float64()))]
            yield pa.RecordBatch.from_arrays([*columns, *told_], names=["key", "sure", "modelled", "hours", "median", "low", "high"])

    out = keys.mapInArrow(told, f"key {kind}, sure double, modelled double, hours int, median double, low double, high double")
    return out.select(F.col("key").alias(key), "hours", F.lit(draws).alias("draws"), (F.col("sure") + F.col("modelled")).alias("base"), *[(F.col("sure") + F.col(c)).alias(c) for c in ("median", "low", "high")])
