"""k-means with many starts, numbers of clusters and weighted draws in one pass a round.

Rows are dealt to all cores once and stay there: a pass takes a block of rows against the centres of some models
at a time as products of matrices, and what leaves a task are sums for each centre. The driver holds centres,
never rows.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.operators.resampling import place, row_number
from tidewater.sources.shared import written

BLOCK = 512  #: rows of a product
ROUNDS = 100
SEEDING = 3  #: rounds in which rows are drawn as candidates for seeds
MODELS = 64  #: models that a block of rows meets at a time
MERGED = 16  #: tasks whose sums one task adds up
DRAWN = 12  #: candidates that a round draws for a start, on average


@dataclass
class Model:
    """Centres of one start; the rows of a draw above 0 have weights, how often each is drawn."""

    centres: np.ndarray
    start: int = 0
    draw: int = 0
    cost: float = math.inf
    sizes: np.ndarray = field(default_factory=lambda: np.zeros(0))
    done: bool = False

    @property
    def k(self) -> int:
        return len(self.centres)


def kept(rows: DataFrame, id: str, values: str) -> DataFrame:
    """id, h, v as a table that all passes read, in a file for each core: a pass has as many tasks as the table has
    files, however few the input had; h names a row in draws."""
    own = rows.select(F.col(id).alias("id"), row_number(id).alias("h"), F.col(values).alias("v"))
    return written(own.repartition(rows.sparkSession.sparkContext.defaultParallelism), "cluster-rows", compression="zstd")


@functools.cache
def _steps() -> list[int]:
    """Numbers of a row from which on they stand for one more copy of it: a Poisson variable of mean 1."""
    at = np.ceil(np.cumsum([math.exp(-1) / math.factorial(i) for i in range(13)]) * (1 << 32))
    return [int(a) for a in at if a < 1 << 32]


def weights(h: np.ndarray, draws: np.ndarray) -> np.ndarray:
    """How often each row (down) is in each draw (across); draw 0 has every row once."""
    u = place(h, draws)
    copies = np.zeros(u.shape, np.uint8)
    for a in _steps():
        copies += u >= np.uint32(a)
    copies[:, draws == 0] = 1
    return copies.astype(np.float64)


def _passed(rows: DataFrame, work: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray], merge: Callable[[np.ndarray, np.ndarray], np.ndarray] = np.add) -> np.ndarray | None:
    """work(ids, h, v) of all blocks, merged within tasks and then over them."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = None
        for whole in batches:
            for lo in range(0, whole.num_rows, BLOCK):
                b = whole.slice(lo, BLOCK)
                own = work(b.column("id").to_numpy(), b.column("h").to_numpy(), b.column("v").flatten().to_numpy().reshape(b.num_rows, -1))
                out = own if out is None else merge(out, own)
        if out is not None:
            yield pa.RecordBatch.from_arrays([pa.array([out.tobytes()], pa.binary()), pa.array([list(out.shape)], pa.list_(pa.int64()))], names=["data", "shape"])

    def joined(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = None
        for b in batches:
            for data, shape in zip(b.column("data"), b.column("shape").to_pylist(), strict=True):
                own = np.frombuffer(data.as_buffer(), np.float64).reshape(shape)
                out = own if out is None else merge(out, own)
        if out is not None:
            yield pa.RecordBatch.from_arrays([pa.array([out.tobytes()], pa.binary()), pa.array([list(out.shape)], pa.list_(pa.int64()))], names=["data", "shape"])

    kind = "data binary, shape array<long>"
    # a shuffle and not coalesce(), which would run the work itself in that few tasks
    found = rows.mapInArrow(run, kind)
    n = rows.rdd.getNumPartitions() // MERGED
    found = (found.repartition(n).mapInArrow(joined, kind) if n > 1 else found).repartition(1).mapInArrow(joined, kind).collect()
    return np.frombuffer(found[0].data, np.float64).reshape(found[0].shape) if found else None


def squared(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances of rows (down) to centres (across)."""
    return ((x[:, None, :] - centres[None, :, :]) ** 2).sum(2) if len(centres) * x.size < 4_000_000 else np.maximum((x * x).sum(1)[:, None] - 2 * x @ centres.T + (centres * centres).sum(1)[None, :], 0.0)


def _updated(rows: DataFrame, models: list[Model]) -> list[tuple[np.ndarray, np.ndarray, float]]:
    """Of each model: its clusters' weights, their sums, and the cost."""
    numbers, draw = np.unique([m.draw for m in models], return_inverse=True)
    most, size = max(m.k for m in models), models[0].centres.shape[1]
    # for products with (x, 1): squared distances less x's own square; centres that a model lacks are nowhere near
    flat = np.zeros((most, len(models), size + 1))
    flat[:, :, size] = np.inf
    for i, m in enumerate(models):
        flat[: m.k, i, :size] = -2 * m.centres
        flat[: m.k, i, size] = (m.centres * m.centres).sum(1)
    parts = [(lo, min(lo + MODELS, len(models)), max(m.k for m in models[lo : lo + MODELS])) for lo in range(0, len(models), MODELS)]

    def work(id: np.ndarray, h: np.ndarray, x: np.ndarray) -> np.ndarray:
        one = np.concatenate([x, np.ones((len(x), 1))], axis=1)
        across, own = np.ascontiguousarray(one.T), (x * x).sum(1)
        w = np.ascontiguousarray(weights(h, numbers).T) if numbers.any() else None
        out = np.zeros((len(models), most * (size + 1) + 1))
        for lo, hi, k in parts:
            least = flat[0, lo:hi] @ across
            label = np.zeros(least.shape, np.uint8)
            for j in range(1, k):
                d = flat[j, lo:hi] @ across
                np.maximum(label, (d < least).view(np.uint8) * np.uint8(j), out=label)  # j is above all labels so far
                np.minimum(least, d, out=least)
            least = np.maximum(least + own, 0.0)
            often = None if w is None else w[draw[lo:hi]]
            for j in range(k):
                mine = (label == j).astype(np.float64) if often is None else often * (label == j)
                out[lo:hi, j * (size + 1) : (j + 1) * (size + 1)] = mine @ one
            out[lo:hi, -1] = least.sum(1) if often is None else (often * least).sum(1)
        return out

    found = _passed(rows, work)
    sums = found[:, :-1].reshape(len(models), most, size + 1)
    return [(sums[i, : m.k, size], sums[i, : m.k, :size], float(found[i, -1])) for i, m in enumerate(models)]


def _furthest(rows: DataFrame, models: list[Model]) -> np.ndarray:
    """Of each model the row furthest from its centre; of rows as far as each other the least identifier's."""
    draws = np.array([m.draw for m in models])

    def work(id: np.ndarray, h: np.ndarray, x: np.ndarray) -> np.ndarray:
        w, order = weights(h, draws), np.argsort(id, kind="stable")
        out = np.zeros((len(models), 2 + x.shape[1]))
        for i, m in enumerate(models):
            there = np.where(w[:, i] > 0, squared(x, m.centres).min(1), -1.0)
            far = order[there[order].argmax()]
            out[i, 0], out[i, 1], out[i, 2:] = there[far], id[far].astype(np.int64).view(np.float64), x[far]
        return out

    def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        ids = lambda t: np.ascontiguousarray(t[:, 1]).view(np.int64)
        first = (a[:, 0] > b[:, 0]) | (a[:, 0] == b[:, 0]) & (ids(a) <= ids(b))
        return np.where(first[:, None], a, b)

    return _passed(rows, work, merge)[:, 2:]


def refined(rows: DataFrame, models: list[Model], rounds: int = ROUNDS) -> list[Model]:
    """Lloyd's rounds for all models at once. A cluster without rows takes the row furthest from its centre; of
    several such clusters one a round does. Models that don't change any more are left out of later rounds."""
    for _ in range(rounds):
        going = [m for m in models if not m.done]
        if not going:
            break
        found = _updated(rows, going)
        empty = [i for i, (n, _, _) in enumerate(found) if (n == 0).any()]
        far = dict(zip(empty, _furthest(rows, [going[i] for i in empty]), strict=True)) if empty else {}
        for i, (m, (n, sums, cost)) in enumerate(zip(going, found, strict=True)):
            new = np.where(n[:, None] > 0, sums / np.maximum(n, 1e-300)[:, None], m.centres)
            if i in far:
                new[int((n == 0).argmax())] = far[i]
            m.done = np.allclose(new, m.centres, rtol=0, atol=1e-10)
            m.centres, m.cost, m.sizes = (m.centres if m.done else new), cost, n
    return models


def plus_plus(points: np.ndarray, n: np.ndarray, k: int, start: int) -> np.ndarray:
    """k of weighted points, each drawn by its squared distance to those before."""
    rng = np.random.default_rng([11, start, k])
    chosen = [points[rng.choice(len(points), p=n / n.sum())]]
    while len(chosen) < k:
        p = n * squared(points, np.array(chosen)).min(1)
        chosen.append(points[rng.choice(len(points), p=p / p.sum()) if p.sum() > 1e-12 else rng.choice(len(points))])
    return np.array(chosen)


def seeds(rows: DataFrame, ks: Iterable[int], starts: int) -> list[Model]:
    """Seeds for each number of clusters and start, by oversampling: each start begins with the row of the least
    number; in SEEDING rounds rows are drawn by their squared distance to the start's candidates, all starts in
    one pass; candidates have the weight of the rows nearest to them, and seeds are drawn from them."""
    numbers = np.arange(starts) * (SEEDING + 1) + 1

    def first(id: np.ndarray, h: np.ndarray, x: np.ndarray) -> np.ndarray:
        u = place(h, numbers)
        at = u.argmin(0)
        return np.concatenate([u[at, np.arange(starts)][:, None], x[at]], axis=1).astype(np.float64)

    found = _passed(rows, first, lambda a, b: np.where((a[:, :1] <= b[:, :1]), a, b))
    if found is None:
        raise ValueError("no rows to cluster")
    candidates = [found[[s], 1:] for s in range(starts)]

    def nearest(x: np.ndarray, sets: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        centres, own = np.concatenate(sets), (x * x).sum(1)
        d, lo = (centres * centres).sum(1)[None, :] - 2 * x @ centres.T, 0
        for c in sets:
            at = d[:, lo : lo + len(c)].argmin(1)
            yield at, np.maximum(d[np.arange(len(x)), lo + at] + own, 0.0)
            lo += len(c)

    for r in range(SEEDING):
        sets = list(candidates)
        cost = _passed(rows, lambda id, h, x: np.array([d.sum() for _, d in nearest(x, sets)]))

        def drawn(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in (whole.slice(lo, BLOCK) for whole in batches for lo in range(0, whole.num_rows, BLOCK)):
                h, x = b.column("h").to_numpy(), b.column("v").flatten().to_numpy().reshape(b.num_rows, -1)
                u = place(h, numbers + r + 1) / float(1 << 32)
                for s, (_, d) in enumerate(nearest(x, sets)):
                    at = np.flatnonzero(u[:, s] * cost[s] < DRAWN * d)
                    if len(at):
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), s), pa.int32()), b.column("id").take(pa.array(at)).cast(pa.int64()), b.column("v").take(pa.array(at))], names=["start", "id", "v"])

        # about DRAWN rows a start, whatever the table's size
        for row in rows.mapInArrow(drawn, "start int, id long, v array<double>").orderBy("start", "id").collect():
            candidates[row.start] = np.concatenate([candidates[row.start], [row.v]])
    sets = list(candidates)
    most = max(map(len, sets))
    n = _passed(rows, lambda id, h, x: np.array([np.bincount(at, minlength=most) for at, _ in nearest(x, sets)], np.float64))
    return [Model(plus_plus(c, n[s, : len(c)], k, s), s) for k in ks for s, c in enumerate(candidates)]


def best(models: list[Model]) -> dict[tuple[int, int], Model]:
    """The model of the least cost for each draw and number of clusters; its centres in their own order."""
    out: dict[tuple[int, int], Model] = {}
    for m in sorted(models, key=lambda m: (m.draw, m.k, m.cost, m.start)):
        out.setdefault((m.draw, m.k), m)
    for m in out.values():
        order = np.lexsort(m.centres.T[::-1])
        m.centres, m.sizes = m.centres[order], m.sizes[order]
    return out


def measures(rows: DataFrame, models: list[Model]) -> list[float]:
    """The mean silhouette of each model under squared distances, for which sums over clusters are enough."""
    sums = _sums(rows, models)

    def work(id: np.ndarray, h: np.ndarray, x: np.ndarray) -> np.ndarray:
        own = (x * x).sum(1)[:, None]
        out = np.zeros(len(models))
        for i, (m, s) in enumerate(zip(models, sums, strict=True)):
            n, total, squares = s[:, 0], s[:, 1:-1], s[:, -1]
            label = squared(x, m.centres).argmin(1)
            d = np.maximum(n[None, :] * own - 2 * x @ total.T + squares[None, :], 0.0)
            mine = np.arange(m.k)[None, :] == label[:, None]
            mean = d / np.maximum(np.where(mine, n[None, :] - 1, n[None, :]), 1e-300)
            a = np.where(n[label] > 1, mean[np.arange(len(x)), label], 0.0)
            b = np.where(mine | (n[None, :] == 0), np.inf, mean).min(1)
            both = np.maximum(a, b)
            out[i] = np.where(np.isfinite(b) & (both > 1e-12), (b - a) / np.where(both > 1e-12, both, 1.0), 0.0).sum()
        return out

    n = sums[0][:, 0].sum() if sums else 0
    return (_passed(rows, work) / n).tolist() if models else []


def _sums(rows: DataFrame, models: list[Model]) -> list[np.ndarray]:
    most = max((m.k for m in models), default=0)

    def work(id: np.ndarray, h: np.ndarray, x: np.ndarray) -> np.ndarray:
        wide = np.concatenate([np.ones((len(x), 1)), x, (x * x).sum(1)[:, None]], axis=1)
        out = np.zeros((len(models), most, wide.shape[1]))
        for i, m in enumerate(models):
            label = squared(x, m.centres).argmin(1)
            out[i, : m.k] = (label[None, :] == np.arange(m.k)[:, None]).astype(np.float64) @ wide
        return out

    found = _passed(rows, work)
    return [found[i, : m.k] for i, m in enumerate(models)]


def chosen(rows: DataFrame, ks: Iterable[int], starts: int = 20, least: int = 2) -> tuple[Model, list[dict]]:
    """The model of the best silhouette among the best ones of each number of clusters, and what speaks for each:
    k, cost, silhouette, least size. Models whose clusters all have `least` rows come first."""
    found = [m for _, m in sorted(best(refined(rows, seeds(rows, ks, starts))).items())]
    told = [{"k": m.k, "cost": m.cost, "silhouette": s, "least": int(m.sizes.min())} for m, s in zip(found, measures(rows, found), strict=True)]
    first = max(range(len(found)), key=lambda i: (told[i]["least"] >= least, round(told[i]["silhouette"], 12), told[i]["least"]))
    return found[first], told


def labelled(rows: DataFrame, model: Model) -> DataFrame:
    """id, cluster (from 1 on): of the nearest centre."""
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b.column("v").flatten().to_numpy().reshape(b.num_rows, -1)
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(squared(x, model.centres).argmin(1) + 1, pa.int32())], names=["id", "cluster"])

    return rows.mapInArrow(run, f"id {kind}, cluster int")


def matched(cost: np.ndarray) -> np.ndarray:
    """For each row of a square of costs its column in the assignment of the least sum (shortest augmenting
    paths with potentials)."""
    n = len(cost)
    u, v, owner = np.zeros(n + 1), np.zeros(n + 1), np.full(n + 1, -1)
    for row in range(n):
        owner[n], column = row, n
        least, before, seen = np.full(n, np.inf), np.full(n, -1), np.zeros(n + 1, bool)
        while owner[column] >= 0:
            seen[column] = True
            free = ~seen[:n]
            step = cost[owner[column]] - u[owner[column]] - v[:n]
            better = free & (step < least)
            least[better], before[better] = step[better], column
            at = int(np.where(free, least, np.inf).argmin())
            delta = least[at]
            u[owner[seen]] += delta
            v[seen] -= delta
            least[free] -= delta
            column = at
        while column != n:
            owner[column] = owner[before[column]]
            column = int(before[column])
    out = np.empty(n, np.int64)
    out[owner[:n]] = np.arange(n)
    return out


def stability(rows: DataFrame, model: Model, models: list[Model], draws: int) -> DataFrame:
    """id, cluster, seen, same: in how many of the draws (of as many rows, some more often) a row is, and in how
    many of them its cluster is the one that it has in `model`. A draw is clustered from the seeds of `models`, all
    draws and seeds in one pass a round; its best clusters are matched to the model's by the least sum of
    squared distances."""
    again = refined(rows, [Model(m.centres.copy(), m.start, d) for d in range(1, draws + 1) for m in models])
    found = [m for _, m in sorted(best(again).items())]
    to = np.array([matched(squared(m.centres, model.centres)) for m in found])
    flat, numbers, k = np.concatenate([m.centres for m in found]), np.arange(1, draws + 1), model.k
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, BLOCK):
                b = whole.slice(lo, BLOCK)
                x = b.column("v").flatten().to_numpy().reshape(b.num_rows, -1)
                own = squared(x, model.centres).argmin(1)
                label = squared(x, flat).reshape(len(x), draws, k).argmin(2)
                there = weights(b.column("h").to_numpy(), numbers) > 0
                same = there & (to[np.arange(draws)[None, :], label] == own[:, None])
                yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(own + 1, pa.int32()), *(pa.array(t.sum(1), pa.int32()) for t in (there, same))], names=["id", "cluster", "seen", "same"])

    return rows.mapInArrow(run, f"id {kind}, cluster int, seen int, same int")
