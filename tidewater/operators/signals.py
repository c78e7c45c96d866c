"""Daily series: changes, events, cycles, triggers and bootstraps."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewater.operators.ranks import full_frame_mean


def abrupt(days: DataFrame, by: list[str], day: str, values: list[str], width: int) -> DataFrame:
    """For each day the mean log of `width` days from it on less that of the days before, in sample standard
    deviations of that contrast; the largest is the score, and its value the main one."""
    rows = days.withColumns({f"_l_{v}": F.log1p(v) for v in values})
    rows = rows.withColumns({f"_c_{v}": full_frame_mean(f"_l_{v}", by, day, 0, width - 1) - full_frame_mean(f"_l_{v}", by, day, -width, -1) for v in values})
    own = Window.partitionBy(*by)
    spread = {v: F.stddev_samp(f"_c_{v}").over(own) for v in values}
    rows = rows.withColumns({f"{v}_z": F.col(f"_c_{v}") / F.when(spread[v] > 0, spread[v]).otherwise(F.lit(1.0)) for v in values})
    rows = rows.where(" AND ".join(f"{v}_z IS NOT NULL" for v in values))
    score = F.greatest(*[F.abs(f"{v}_z") for v in values]) if len(values) > 1 else F.abs(f"{values[0]}_z")
    main = F.coalesce(*[F.when(F.abs(f"{v}_z") == F.col("score"), F.lit(v)) for v in values])
    return rows.withColumn("score", score).withColumn("main", main).select(*by, day, *[f"{v}_z" for v in values], "score", "main")


def spaced(ordered: Column, gap: Column, most: int) -> Column:
    """Of an array of structs (below, the negative score; day) in order those that are `gap` days from all taken
    before them, `most` at most."""
    free = lambda taken, x: (F.size(taken) < most) & F.forall(taken, lambda t: F.abs(F.datediff(x["day"], t["day"])) >= gap)
    return F.aggregate(ordered, F.slice(ordered, 1, 0), lambda taken, x: F.when(free(taken, x), F.concat(taken, F.array(x))).otherwise(taken))


def selected(scores: DataFrame, by: list[str], day: str, threshold: float, gap: int, most: int) -> DataFrame:
    """The highest scores of each key that are `gap` days apart, at most `most` of them. Each pick depends on
    all before it, so a key's days above the threshold are one group; they are as many as days at most."""
    return selected_settings(scores.withColumns({"threshold": F.lit(float(threshold)), "gap": F.lit(gap)}), by, day, most).drop("threshold", "gap")


def selected_settings(scores: DataFrame, by: list[str], day: str, most: int) -> DataFrame:
    """by..., threshold, gap, day, score: the same for each threshold and gap that the rows have as columns."""

    keys = [*by, "threshold", "gap"]
    rows = scores.where(F.col("score") >= F.col("threshold")).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("below"), F.col(day).alias("day")))).alias("_o"))
    picked = rows.select(*keys, F.explode(spaced(F.col("_o"), F.col("gap"), most)).alias("_p"))
    return picked.select(*keys, F.col("_p.day").alias(day), (-F.col("_p.below")).alias("score"))


def autocorrelation(days: DataFrame, by: list[str], day: str, value: str, lags: list[int]) -> DataFrame:
    own = Window.partitionBy(*by).orderBy(day)
    rows = days.withColumns({f"_b{k}": F.lag(value, k).over(own) for k in lags})
    pairs = rows.select(*by, F.col(value).alias("a"), F.explode(F.array(*[F.struct(F.lit(k).alias("lag"), F.col(f"_b{k}").alias("b")) for k in lags])).alias("p"))
    return pairs.where("p.b IS NOT NULL").groupBy(*by, F.col("p.lag").alias("lag")).agg(F.count(F.lit(1)).alias("n"), F.corr("a", "p.b").alias("r"))


def periodogram(days: DataFrame, by: list[str], day: str, value: str) -> DataFrame:
    """Power of each full number of cycles over a key's days, of the log, without its line, under a Hann
    window. Every day meets every number of cycles: a year's days are bounded."""
    own = Window.partitionBy(*by)
    rows = days.withColumn("y", F.log1p(value)).withColumn("i", F.row_number().over(own.orderBy(day)) - 1).withColumn("n", F.count(F.lit(1)).over(own))
    line = F.regr_intercept("y", F.col("i")).over(own) + F.regr_slope("y", F.col("i")).over(own) * F.col("i")
    rows = rows.withColumn("y", (F.col("y") - line) * (0.5 - 0.5 * F.cos(2 * F.pi() * F.col("i") / (F.col("n") - 1))))
    rows = rows.where("n >= 4").withColumn("k", F.explode(F.sequence(F.lit(1), (F.col("n") / 2).cast("int"))))
    angle = 2 * F.pi() * F.col("k") * F.col("i") / F.col("n")
    sums = rows.groupBy(*by, "k", "n").agg(F.sum(F.col("y") * F.cos(angle)).alias("c"), F.sum(F.col("y") * F.sin(angle)).alias("s"))
    return sums.select(*by, F.col("k").cast("int").alias("cycles"), (F.col("n") / F.col("k")).alias("period"), (F.col("c") * F.col("c") + F.col("s") * F.col("s")).alias("power"))


def triggered(days: DataFrame, by: list[str], day: str, value: str, interval: int, threshold: Column, scale: float, ahead: int = 2) -> DataFrame:
    """A sampling schedule: every `interval`-th day, and the `ahead` days after a jump of the log by
    `threshold` scales, whatever month they are in. The threshold is that of the day of the jump."""
    own = Window.partitionBy(*by).orderBy(day)
    jump = F.abs(F.log1p(value) - F.lag(F.log1p(F.col(value))).over(own)) / F.lit(scale)
    rows = days.withColumn("jump", F.coalesce(jump, F.lit(0.0))).withColumn("trigger", F.col("jump") >= threshold)
    base = F.pmod(F.datediff(day, F.min(day).over(Window.partitionBy(*by))), F.lit(interval)) == 0
    followed = F.coalesce(F.max("trigger").over(own.rowsBetween(-ahead, -1)), F.lit(False))
    rows = rows.withColumns({"planned": base, "followed": followed})
    return rows.select(*by, day, "jump", "trigger", "planned", "followed", (F.col("planned") | F.col("followed")).alias("sampled"), (F.col("followed") & ~F.col("planned")).alias("extra"))


POOL = 4_096  #: blocks of a key that are held as an array


def block_totals(blocks: DataFrame, by: list[str], value: str, draws: int, slots: int, seed: int = 1, most: int = POOL) -> DataFrame:
    """Totals of `slots` blocks drawn with replacement from each key's pool, `draws` times, and their 95 %
    interval. Draws come from hashes: the same in every run. A pool of up to `most` blocks is an array and is drawn
    from in its row; only larger pools, of which there are few for as many rows, have a row for each block that a
    draw takes."""
    pool = blocks.select(*by, F.col(value).alias("_v"), F.xxhash64(value, F.lit(seed)).alias("_h"))
    sizes = pool.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))
    few = sizes.where(F.col("_n") <= most).select(*by)
    small = pool.join(few, by).groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("_h", "_v"))), lambda s: s["_v"]).alias("_p"))
    place = lambda n, d, s: F.pmod(F.xxhash64(*by, d, s, F.lit(seed)), n).cast("int")
    one = lambda d: F.aggregate(F.sequence(F.lit(1), F.lit(slots)), F.lit(0.0), lambda t, s: t + F.coalesce(F.get("_p", place(F.size("_p").cast("long"), d, s)), F.lit(0.0)))
    small = small.select(*by, F.array_sort(F.transform(F.sequence(F.lit(1), F.lit(draws)), one)).alias("_t"))

    large = sizes.where(F.col("_n") > most)
    own = Window.partitionBy(*by).orderBy("_h", "_v")
    ranked = pool.join(large, by).withColumn("_i", F.row_number().over(own) - 1)
    wanted = large.withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(draws)))).withColumn("slot", F.explode(F.sequence(F.lit(1), F.lit(slots))))
    # the same block drawn often by one draw counts once, with a weight
    wanted = wanted.withColumn("_i", place(F.col("_n"), F.col("draw"), F.col("slot"))).groupBy(*by, "draw", "_i").agg(F.count(F.lit(1)).alias("_w"))
    totals = wanted.join(ranked.select(*by, "_i", "_v"), [*by, "_i"]).groupBy(*by, "draw").agg(F.sum(F.col("_v") * F.col("_w")).alias("_t"))
    totals = small.unionByName(totals.groupBy(*by).agg(F.array_sort(F.collect_list("_t")).alias("_t")))  # `draws` numbers a key

    def quantile(p: float) -> Column:
        at = (draws - 1) * p
        low, high = math.floor(at), math.ceil(at)
        return F.get("_t", F.lit(low)) if low == high else (high - at) * F.get("_t", F.lit(low)) + (at - low) * F.get("_t", F.lit(high))

    return totals.select(*by, (F.aggregate("_t", F.lit(0.0), lambda a, x: a + x) / draws).alias("mean"), quantile(0.025).alias("low"), quantile(0.975).alias("high"))
