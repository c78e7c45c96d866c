"""Random subsets of an exact size, thousands of draws at once.

A draw orders all rows by a number made from the row's identifier and the draw's, the same in every run, and
takes the first so many. Rows are never multiplied by draws: a block of rows and all draws are a matrix of
bits, and what is summed over each draw's rows is a product of matrices. How far a draw goes is found from
counts over ranges of its numbers, near where the last row taken must lie; only the rows of one narrow range
are put in order.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewater.functions.digests import digest, digest_sql
from tidewater.sources.shared import written

# A step that spreads draws, and the factor of a mixing of 32 bits.
STEP, FACTOR = 2654435769, 73244475
BITS = 32
RANGES = 256  #: ranges of a draw's numbers that are counted
DRAWS = 250  #: draws that are summed in one array
ROWS = 2_000  #: rows of a block


def place(rows: np.ndarray, draws: np.ndarray) -> np.ndarray:
    """The number of each draw (across) for each row (down), from 32-bit identifiers of rows."""
    x = (rows.astype(np.uint64)[:, None] + draws.astype(np.uint64)[None, :] * np.uint64(STEP)).astype(np.uint32)
    for _ in range(2):
        x ^= x >> np.uint32(16)
        x *= np.uint32(FACTOR)
    x ^= x >> np.uint32(16)
    return x


def place_sql(row: str, draw: str) -> str:
    """The same of a row's identifier (see row_sql) and a draw in SQL."""
    x = f"(({row} + ({draw}) * {STEP}) % {1 << BITS})"
    for _ in range(2):
        x = f"((xor({x}, {x} >> 16) * {FACTOR}) % {1 << BITS})"
    return f"xor({x}, {x} >> 16)"


def row_number(id: str | Column) -> Column:
    return F.pmod(digest(F.col(id) if isinstance(id, str) else id), F.lit(1 << BITS))


def row_sql(id: str) -> str:
    return f"({digest_sql(id)} % {1 << BITS})"


def added_up(parts: DataFrame, kind: str = "<f8") -> DataFrame:
    """key, data: the sum of the arrays of each key. Tasks that made them have added up their own rows."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for key, data in zip(b.column("key").to_pylist(), b.column("data"), strict=True):
                own = np.frombuffer(data.as_buffer(), kind)
                sums[key] = sums[key] + own if key in sums else own
        for key, x in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([key], pa.int32()), pa.array([x.tobytes()], pa.binary())], names=["key", "data"])

    return parts.select("key", "data").repartition("key").mapInArrow(run, "key int, data binary")


def _blocks(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Rows, their numbers and their values, in blocks of ROWS."""
    for whole in batches:
        for lo in range(0, whole.num_rows, ROWS):
            b = whole.slice(lo, ROWS)
            values = b.column("v").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
            yield b, b.column("h").to_numpy(), values


def _counted(rows: DataFrame, draws: int, low: int, width: int) -> DataFrame:
    """key, data: how many numbers of each draw of a block of draws lie below `low`, in each of RANGES ranges of
    `width` from there, and beyond."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((draws, RANGES + 2), np.int64)
        for _, h, _ in _blocks(batches):
            for d in range(0, draws, DRAWS):
                at = np.arange(d, min(draws, d + DRAWS))
                r = np.clip((place(h, at + 1).astype(np.int64) - low) // width + 1, 0, RANGES + 1)
                sums[at] += np.bincount(((at - d)[None, :] * (RANGES + 2) + r).ravel(), minlength=len(at) * (RANGES + 2)).reshape(len(at), -1)
        for d in range(0, draws, DRAWS):
            yield pa.RecordBatch.from_arrays([pa.array([d // DRAWS], pa.int32()), pa.array([sums[d : d + DRAWS].tobytes()], pa.binary())], names=["key", "data"])

    return added_up(rows.mapInArrow(run, "key int, data binary"), "<i8")


def _edges(rows: DataFrame, n: int, size: int, draws: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Of each draw where the range begins that has the last row taken, how many rows lie before it, and the
    ranges' width. The first look is at eight standard deviations around where that row must lie; a draw whose
    row is not there takes a look at everything."""
    p = size / n
    near = 8 * math.sqrt(p * (1 - p) / n) + 2 / n
    for low, high in ((max(0.0, p - near), min(1.0, p + near)), (0.0, 1.0)):
        low, high = int(low * (1 << BITS)), math.ceil(high * (1 << BITS))
        width = max(1, -(-(high - low) // RANGES))
        counts = np.zeros((draws, RANGES + 2), np.int64)
        for r in _counted(rows, draws, low, width).collect():  # draws times RANGES numbers, whatever the table's size
            counts[r.key * DRAWS : (r.key + 1) * DRAWS] = np.frombuffer(r.data, "<i8").reshape(-1, RANGES + 2)
        before = np.cumsum(counts, axis=1)
        at = (before < size).sum(axis=1)  # the first range with so many rows up to its end
        if ((at > 0) & (at <= RANGES)).all():
            return low + (at - 1) * width, before[np.arange(draws), at - 1], width
    raise AssertionError("every row lies in some range")


def squares(x: np.ndarray) -> np.ndarray:
    """The values of each row, then the product of each with itself and those after it."""
    return np.concatenate([x, *(x[:, [i]] * x[:, i:] for i in range(x.shape[1]))], axis=1)


def subset_sums(rows: DataFrame, id: str, values: str, size: int, draws: int, expand: Callable[[np.ndarray], np.ndarray] | None = None) -> DataFrame:
    """draw, sums: for each of the draws from 1 on, the sums of the values (an array column, or what `expand`
    makes of a block's matrix of it) over a random subset of exactly `size` rows. Rows of one number come in the
    order of `id`, which must be unique. What is shuffled are sums of each task and a few rows a draw."""
    kept = rows.select(F.col(id).alias("id"), row_number(id).alias("h"), F.col(values).alias("v"))
    n = rows.count()
    if not 0 < size < n:
        raise ValueError("a subset has more than no rows and fewer than all")
    edge, before, width = _edges(kept, n, size, draws)
    expand = expand or (lambda x: x)
    kind = rows.schema[id].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = None
        nothing = lambda n, t: pa.nulls(n, t)
        for b, h, values in _blocks(batches):
            x = expand(values)
            sums = np.zeros((draws, x.shape[1])) if sums is None else sums
            for d in range(0, draws, DRAWS):
                at = np.arange(d, min(draws, d + DRAWS))
                u = place(h, at + 1)
                sums[at] += (u < edge[at].astype(np.uint64)).T.astype(np.float64) @ x
                row, draw = np.nonzero((u >= edge[at].astype(np.uint64)) & (u < (edge[at] + width).astype(np.uint64)))
                if len(row):
                    yield pa.RecordBatch.from_arrays(
                        [nothing(len(row), pa.int32()), nothing(len(row), pa.binary()), pa.array(at[draw] + 1, pa.int32()), pa.array(u[row, draw], pa.int64()), b.column("id").take(pa.array(row)), b.column("v").take(pa.array(row))],
                        names=["key", "data", "draw", "u", "id", "v"],
                    )
        for d in range(0, draws if sums is not None else 0, DRAWS):
            yield pa.RecordBatch.from_arrays(
                [pa.array([d // DRAWS], pa.int32()), pa.array([sums[d : d + DRAWS].tobytes()], pa.binary()), nothing(1, pa.int32()), nothing(1, pa.int64()), nothing(1, b.schema.field("id").type), nothing(1, b.schema.field("v").type)],
                names=["key", "data", "draw", "u", "id", "v"],
            )

    parts = written(kept.mapInArrow(run, f"key int, data binary, draw int, u long, id {kind}, v array<double>"), "subset-sums", compression="zstd")
    spark = rows.sparkSession
    left = F.broadcast(spark.createDataFrame([(d + 1, int(size - before[d])) for d in range(draws)], "draw int, left long"))  # a row for each draw
    order = Window.partitionBy("draw").orderBy("u", "id")
    last = parts.where("draw is not null").withColumn("k", F.row_number().over(order)).join(left, "draw").where("k <= left").select("draw", "v")

    def few(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            draw, x = b.column("draw").to_numpy() - 1, expand(b.column("v").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1))
            for key in np.unique(draw // DRAWS).tolist():
                own = sums.setdefault(key, np.zeros((min(DRAWS, draws - key * DRAWS), x.shape[1])))
                np.add.at(own, draw[draw // DRAWS == key] - key * DRAWS, x[draw // DRAWS == key])
        for key, x in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([key], pa.int32()), pa.array([x.tobytes()], pa.binary())], names=["key", "data"])

    def told(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for key, data in zip(b.column("key").to_pylist(), b.column("data"), strict=True):
                x = np.frombuffer(data.as_buffer(), "<f8").reshape(min(DRAWS, draws - key * DRAWS), -1)
                yield pa.RecordBatch.from_arrays([pa.array(key * DRAWS + 1 + np.arange(len(x)), pa.int32()), pa.array(x.tolist(), pa.list_(pa.float64()))], names=["draw", "sums"])

    both = parts.where("key is not null").select("key", "data").unionByName(last.mapInArrow(few, "key int, data binary"))
    return added_up(both).mapInArrow(told, "draw int, sums array<double>")


def share_beyond(draws: DataFrame, made: Column, observed: Column, *by: str) -> DataFrame:
    """by..., p: how often what the draws made is as large as what was observed, itself counted."""
    return draws.groupBy(*by).agg(((F.count_if(made >= observed - 1e-12) + 1) / (F.count(F.lit(1)) + 1)).alias("p"))


def correlations(sums: np.ndarray, n: np.ndarray | int, size: int) -> np.ndarray:
    """Correlations of all pairs i < j of `size` values, a row for each row of sums as squares() orders them;
    0 where a value doesn't vary."""
    first = size + np.concatenate([[0], np.cumsum(np.arange(size, 1, -1))])
    i, j = np.triu_indices(size, 1)
    n = np.asarray(n, float).reshape(-1, 1) if np.ndim(n) else float(n)
    mean = sums[:, :size]
    var = sums[:, first] - mean * mean / n
    cov = sums[:, first[i] + (j - i)] - mean[:, i] * mean[:, j] / n
    scale = var[:, i] * var[:, j]
    return np.where(scale > 1e-18, np.clip(cov / np.sqrt(np.where(scale > 1e-18, scale, 1.0)), -1.0, 1.0), 0.0)
