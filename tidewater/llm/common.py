"""What the operators of this subpackage share: reading, shared files, Arrow columns as arrays."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from tidewater.sources.shared import WIDE, dropped, written

__all__ = ["WIDE", "dropped", "written"]  # steps are tables in the shared folder

FIRST = -(1 << 63)  #: the place of null ids in the order of ids
M1, M2, M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def free(name: str, *tables: DataFrame) -> str:
    """A column name that none of the tables has."""
    taken = {c.lower() for df in tables for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def keyed(docs: DataFrame, id: str, text: str) -> tuple[DataFrame, bool]:
    """doc, tie, _row of each row: doc and tie tell texts apart and order them. doc is the id (null: before
    all others), tie a hash of the text where an id has several rows; whether there are such ids is told
    too. _row has the row's own columns. Ids must be whole numbers; an error tells of others."""
    if not isinstance(docs.schema[id].dataType, IntegralType):
        raise TypeError(f"{id} must be a whole number, not {docs.schema[id].dataType.simpleString()}")
    repeated = bool(docs.groupBy(id).count().where(F.col(id).isNull() | (F.col("count") > 1)).limit(1).count())
    tie = F.xxhash64(F.coalesce(F.col(text), F.lit(""))) if repeated else F.lit(0).cast("long")
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    return docs.select(F.coalesce(F.col(id).cast("long"), F.lit(FIRST)).alias("doc"), tie.alias("tie"), row.alias("_row")), repeated


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts end to end, and the offsets of each text; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    width = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, width, len(column) + 1 + column.offset)[column.offset :].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, offsets - offsets[0]


def blocks(offsets: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose bytes are at most `most` in all, or of one row that is longer."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + most, "right")) - 1)
        yield lo, min(hi, n)
        lo = hi


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (splitmix finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * M2
    x = (x ^ (x >> np.uint64(27))) * M3
    return x ^ (x >> np.uint64(31))


_PLACE = mixed((np.arange(1, 65537, dtype=np.uint64)) * M1) | np.uint64(1)


def places(at: np.ndarray) -> np.ndarray:
    """An odd multiplier for each position within a piece."""
    out = _PLACE[at & 0xFFFF]
    return out * mixed((at >> 16).astype(np.uint64) + M1) if len(at) and int(at.max()) > 0xFFFF else out


def piece_hashes(values: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """One 64-bit hash for each piece starts[i] : starts[i] + lengths[i] (all of at least one value, in
    order, not overlapping) of `values`, which are mixed 64-bit values."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    at = np.arange(len(values), dtype=np.int64)
    at -= np.repeat(starts, np.diff(np.append(starts, len(values)))) if starts[0] == 0 else np.concatenate([np.zeros(starts[0], np.int64), np.repeat(starts, np.diff(np.append(starts, len(values))))])
    terms = values * places(at)
    ends = starts + lengths
    if not np.array_equal(ends[:-1], starts[1:]) or ends[-1] != len(values):
        edges = np.empty(2 * len(starts), np.int64)
        edges[0::2], edges[1::2] = starts, ends
        sums = np.add.reduceat(np.append(terms, np.uint64(0)), edges)[0::2]
    else:
        sums = np.add.reduceat(terms, starts)
    return mixed(sums + lengths.astype(np.uint64) * M1)


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def batch_of(schema: pa.Schema, columns: Iterable) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, (pa.Array,)) else pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def grouped(batches: Iterable[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[tuple, pa.Table]]:
    """Runs of equal keys over sorted batches, one table each; only one run is held at a time."""
    held: list[pa.RecordBatch] = []
    key = None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(batch.schema.get_field_index(k)) for k in keys]
        change = np.zeros(batch.num_rows, bool)
        for c in cols:
            a = c.to_numpy(zero_copy_only=False)
            change[1:] |= a[1:] != a[:-1]
        cuts = [0, *np.flatnonzero(change).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            k = tuple(c[a].as_py() for c in cols)
            if held and k != key:
                yield key, pa.Table.from_batches(held)
                held = []
            key = k
            held.append(batch.slice(a, b - a))
    if held:
        yield key, pa.Table.from_batches(held)
