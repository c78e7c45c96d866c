"""Ward's hierarchy over all rows: in each round all pairs of clusters that are each other's nearest merge.

Merging two clusters never brings a third nearer to them than it was to one of the two, so that the rounds
merge the same pairs as one merge after another does, cheapest first. In many dimensions no grid tells clusters
apart, so that whoever looks for the nearest meets all, as tiles by products of matrices; only tiles and each tile's
nearest are shuffled. In the first round all look, later those that are new or whose nearest has merged.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.sources.shared import dropped, written

ROUNDS = 200
FEW = 8192  #: clusters that one task merges to the end
TILE = 50_000_000  #: pairs of clusters in a tile, as long as there are few tiles


def met(searched: DataFrame, clusters: DataFrame, some: int, count: int) -> DataFrame:
    """s, t: blocks of the searched clusters and of all, every one of these meeting every one of those in one tile. So
    many tiles there are as their pairs need, some hundreds at most, and few rows are shuffled for them."""
    tiles = max(1.0, min(576.0, some * count / TILE))
    down = max(1, min(576, round(math.sqrt(tiles * some / count))))
    across = max(1, math.ceil(tiles / down))

    def blocks(rows: DataFrame, own: str, other: str, parts: int, others: int, name: str) -> DataFrame:
        rows = rows.groupBy(F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int").alias(own)).agg(F.collect_list(F.struct("id", "n", "c")).alias(name))
        return rows.withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(others - 1)))).repartition(min(down * across, 144), "b", "o")

    return blocks(searched, "b", "o", down, across, "s").join(blocks(clusters, "o", "b", across, down, "t"), ["b", "o"]).select("s", "t")


def least(ids: np.ndarray, n: np.ndarray, x: np.ndarray, oids: np.ndarray, m: np.ndarray, y: np.ndarray, rows: int = 512, columns: int = 1024) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cost, a and b (the lesser and the greater id) of each cluster's nearest other one; of equal costs the pair of
    least ids; without another one the cost is infinite. Single-precision products of matrices, with a bound of their
    error, tell which can be nearest, and only of these the cost is summed up in full, the same from either side."""
    down, across = np.lexsort((ids, n)), np.lexsort((oids, m))  # most blocks are of one size then
    oids, m, y = oids[across], m[across], y[across]
    cost, first, second = np.full(len(ids), np.inf), np.zeros(len(ids), np.int64), np.zeros(len(ids), np.int64)
    middle = y.mean(0)
    by_id = np.argsort(oids)
    at = by_id[np.minimum(np.searchsorted(oids, ids, sorter=by_id), len(oids) - 1)]
    at = np.where(oids[at] == ids, at, -1)  # a cluster's own column
    u, v = x - middle, y - middle
    unit = math.sqrt(max(float((u * u).sum(1).max()), float((v * v).sum(1).max()))) or 1.0
    u, v = u / unit, v / unit
    uu, vv = (u * u).sum(1), (v * v).sum(1)
    left = np.column_stack([-2 * u, uu, np.ones(len(u))]).astype(np.float32)
    right = np.ascontiguousarray(np.column_stack([v, np.ones(len(v)), vv]).astype(np.float32).T)
    room, parts = np.empty(rows * columns, np.float32), np.empty(rows * columns, np.float32)
    for lo in range(0, len(ids), rows):
        r = down[lo : lo + rows]
        own, sizes = left[r], n[r]
        for co in range(0, len(oids), columns):
            mm = m[co : co + columns]
            d = np.matmul(own, right[:, co : co + columns], out=room[: len(r) * len(mm)].reshape(len(r), len(mm)))
            if sizes[0] == sizes[-1] and mm[0] == mm[-1]:
                w = np.float32(1 / (1 / sizes[0] + 1 / mm[0]))
            else:
                part = parts[: d.size].reshape(d.shape)
                np.add((1 / sizes).astype(np.float32)[:, None], (1 / mm).astype(np.float32)[None, :], out=part)
                np.divide(d, part, out=d)
                w = np.float32(1)
            i = np.flatnonzero((at[r] >= co) & (at[r] < co + len(mm)))
            d[i, at[r[i]] - co] = np.inf
            # what a product, and what is made of it here, can be wrong by at most
            slack = (x.shape[1] + 10) * 2.0**-23 * (uu[r] + vv[co : co + columns].max()) / (1 / sizes + 1 / mm.max())
            low, known = d.min(1) * float(w), cost[r] / unit**2
            i = np.flatnonzero((low <= known + slack) & (low < np.inf))
            if not len(i):
                continue
            most = np.minimum(low[i] + 2 * slack[i], known[i] * (1 + 1e-9) + slack[i])
            k, j = np.nonzero(d[i] * float(w) <= most[:, None])
            i, j = r[i[k]], j + co
            exact = np.zeros(len(i))
            for c in range(x.shape[1]):
                e = x[i, c] - y[j, c]
                exact += e * e
            i, exact = np.append(i, r), np.append(n[i] * m[j] / (n[i] + m[j]) * exact, cost[r])
            a, b = np.append(np.minimum(ids[i[: len(j)]], oids[j]), first[r]), np.append(np.maximum(ids[i[: len(j)]], oids[j]), second[r])
            order = np.lexsort((b, a, exact, i))
            order = order[np.unique(i[order], return_index=True)[1]]
            cost[i[order]], first[i[order]], second[i[order]] = exact[order], a[order], b[order]
    return cost, first, second


def nearest(searched: DataFrame, clusters: DataFrame, some: int, count: int) -> DataFrame:
    """id, a, b, cost: for each searched cluster (id, n, c) the pair of ids with the nearest other one of all clusters
    and its cost; of equal costs the pair of least ids. `some` and `count` tell how many there are of either."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                one, other = (
                    (v.field("id").to_numpy(), v.field("n").to_numpy().astype(np.float64), v.field("c").flatten().to_numpy().reshape(len(v), -1)) for v in (batch.column(c).slice(k, 1).flatten() for c in ("s", "t"))
                )
                cost, a, b = least(*one, *other)
                any_ = np.flatnonzero(cost < np.inf)
                yield pa.RecordBatch.from_arrays([pa.array(v[any_]) for v in (one[0], cost, a, b)], names=["id", "cost", "a", "b"])

    found = met(searched, clusters, some, count).mapInArrow(run, "id long, cost double, a long, b long")
    return found.groupBy("id").agg(F.min(F.struct("cost", "a", "b")).alias("e")).select("id", "e.a", "e.b", "e.cost")


def finished(clusters: DataFrame) -> DataFrame:
    """a, b, cost, size: the rounds of at most FEW clusters (id, n, c), in one task: what is left of any table."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [(b.column("id").to_numpy(), b.column("n").to_numpy().astype(np.float64), b.column("c").flatten().to_numpy().reshape(b.num_rows, -1)) for b in batches if b.num_rows]
        if not parts:
            return
        ids, n, x = (np.concatenate(v) for v in zip(*parts, strict=True))
        order = np.argsort(ids)
        ids, n, x = ids[order], n[order], x[order]
        cost, a, b = least(ids, n, x, ids, n, x)
        whole = True
        while len(ids) > 1:
            at, to = np.searchsorted(ids, a), np.searchsorted(ids, b)
            i = np.flatnonzero((ids == a) & (a[to] == a) & (b[to] == b))
            if not len(i) and not whole:
                whole, (cost, a, b) = True, least(ids, n, x, ids, n, x)
                continue
            j = to[i]
            both = n[i] + n[j]
            yield pa.RecordBatch.from_arrays([pa.array(ids[i]), pa.array(ids[j]), pa.array(cost[i]), pa.array(both.astype(np.int64))], names=["a", "b", "cost", "size"])
            x[i], n[i] = (x[i] * n[i, None] + x[j] * n[j, None]) / both[:, None], both
            gone, keep = np.zeros(len(ids), bool), np.ones(len(ids), bool)
            gone[i], gone[j], keep[j] = True, True, False
            look = np.flatnonzero((gone | gone[at] | gone[to])[keep])
            ids, n, x, cost, a, b = (v[keep] for v in (ids, n, x, cost, a, b))
            whole = len(look) == len(ids)
            if len(ids) > 1:
                cost[look], a[look], b[look] = least(ids[look], n[look], x[look], ids, n, x)

    return clusters.repartition(1).mapInArrow(run, "a long, b long, cost double, size long")


def ward(rows: DataFrame, id: str, values: str) -> DataFrame:
    """a, b, cost, size: all merges. A cluster has the least id of its rows; b joins a. In the order of their costs
    they are those of one merge after another. Ids are whole numbers and unique; without two rows there are none."""
    size = len(rows.select(values).first()[0]) if rows.limit(1).count() else 0
    if size < 1:
        return rows.sparkSession.createDataFrame([], "a long, b long, cost double, size long")
    start = rows.select(F.col(id).cast("long").alias("id"), F.lit(1).cast("long").alias("n"), F.col(values).alias("c"))
    nothing = [F.lit(None).cast(t).alias(c) for c, t in (("a", "long"), ("b", "long"), ("cost", "double"))]
    alive, merges, before = written(start.select("*", *nothing), "ward", compression="zstd"), [], 0
    for _ in range(ROUNDS):
        count, known = alive.agg(F.count(F.lit(1)), F.count("a")).first()
        if count <= FEW:
            break
        if count == before:  # costs that rounding alone tells apart: all look again, and the least of all merges
            alive, known = alive.select("id", "n", "c", *nothing), 0
        before = count
        # the nearest stays the nearest until one of the two merges, as no other comes nearer
        new = nearest(alive.where("a IS NULL").select("id", "n", "c"), alive.select("id", "n", "c"), count - known, count)
        found = written(alive.where("a IS NOT NULL").select("id", "a", "b", "cost").unionByName(new), "ward-nearest", compression="zstd")
        both = found.groupBy("a", "b").agg(F.count(F.lit(1)).alias("k"), F.first("cost").alias("cost")).where("k = 2")
        one, two = (alive.select(F.col("id").alias(s), F.col("n").alias(f"n{s}"), F.col("c").alias(f"c{s}")) for s in ("a", "b"))
        joined = both.join(one, "a").join(two, "b")
        n = F.col("na") + F.col("nb")
        centre = F.transform(F.zip_with(F.transform("ca", lambda v: v * F.col("na")), F.transform("cb", lambda v: v * F.col("nb")), lambda x, y: x + y), lambda v: v / n)
        merged = written(joined.select("a", "b", "cost", n.alias("n"), centre.alias("c")), "ward-merged", compression="zstd")
        merges.append(merged)
        gone = merged.select(F.explode(F.array("a", "b")).alias("id"))
        rest = alive.select("id", "n", "c").join(found, "id").join(gone, "id", "left_anti").withColumn("other", F.col("a") + F.col("b") - F.col("id"))
        rest = rest.join(gone.select(F.col("id").alias("other"), F.lit(True).alias("lost")), "other", "left")
        rest = rest.select("id", "n", "c", *[F.when(F.col("lost").isNull(), F.col(c)).alias(c) for c in ("a", "b", "cost")])
        last, alive = alive, written(rest.unionByName(merged.select(F.col("a").alias("id"), "n", "c", *nothing)), "ward", compression="zstd")
        dropped(found, *[last] * hasattr(last, "written_at"))
    else:
        raise RuntimeError(f"not one cluster after {ROUNDS} rounds")
    out = finished(alive.select("id", "n", "c"))
    for m in merges:
        out = out.unionByName(m.select("a", "b", "cost", F.col("n").alias("size")))
    return out


def cut(rows: DataFrame, id: str, merges: DataFrame, clusters: int) -> DataFrame:
    """id, cluster: what the cheapest merges leave when so many clusters are left; a cluster has its least id. A
    cluster's id is that of its own first row, so that each id joins another one once at most."""
    kept = merges.orderBy("cost", "a", "b").limit(max(0, rows.count() - clusters)).select(F.col("b").alias("id"), F.col("a").alias("to"))
    place = written(rows.select(F.col(id).cast("long").alias("id")).join(kept, "id", "left").select("id", F.coalesce("to", "id").alias("to")), "ward-cut")
    for _ in range(64):  # pointers double: a chain of any length ends in its logarithm's rounds
        step = place.select(F.col("id").alias("to"), F.col("to").alias("next"))
        new = written(place.join(step, "to").select("id", F.col("next").alias("to"), (F.col("next") != F.col("to")).alias("moved")), "ward-cut")
        moved = new.where("moved").limit(1).count()
        dropped(place)
        place = new.drop("moved")
        place.written_at = new.written_at
        if not moved:
            break
    return place.select("id", F.col("to").alias("cluster"))
