"""Removal of byte strings that a corpus has earlier, by buckets of suffixes that are refined.

Suffixes get the bucket of their first byte. A bucket's identifier and that of the suffix as many bytes on
make the identifier for twice as many bytes, so that five refinements give buckets of 32-byte strings, and
identifiers 32 bytes on refine these to buckets of `length` bytes. Identifiers are 64-bit hashes, equal for
equal strings wherever they stand, so that buckets of all texts agree without a sort over all texts.

Not every suffix has to be sorted. Of the 32-byte buckets within each `length`-byte string, the least
identifier's suffix stands for the string (its anchor); equal strings have equal anchors. Strings next to
each other with one anchor are a run. Runs are sorted by what all their strings share (first the anchor's
bucket) and then by the identifier of all their bytes:

- a run that comes again is settled at once: all its strings come again;
- a run that is alone with its shared bytes is done;
- the others are refined: first into runs of at most STEP strings, which share more bytes, then into
  single strings. What is left to refine gets rare fast.

Runs count as the same where two identifiers of 64 bits are equal, that of the shared bytes and that of all
bytes: only runs of one bucket are compared, so that a wrong match takes as many pairs within buckets as a
64-bit number has values.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewater.llm.common import M1, blocks, keyed, mixed, utf8, written

STEP = 8  #: strings in a refined run
GRAM = 32  #: bytes of the buckets that anchors are taken from
BLOCK = 1_000_000


@functools.cache
def _first_buckets() -> np.ndarray:
    return mixed(np.arange(1, 257, dtype=np.uint64) * M1)


@functools.cache
def _factors(level: int) -> tuple[np.uint64, np.uint64]:
    a, b = mixed(np.array([2 * level + 1, 2 * level + 2], np.uint64) * M1) | np.uint64(1)
    return a, b


def refined(a: np.ndarray, b: np.ndarray, level: int) -> np.ndarray:
    """Identifiers from those of the same suffixes and of later offsets."""
    x, y = _factors(level)
    out = a * x + b * y
    out ^= out >> np.uint64(32)
    out *= y
    out ^= out >> np.uint64(29)
    return out


class Buckets:
    """Bucket identifiers of all suffixes of some texts end to end, by their first GRAM bytes."""

    def __init__(self, raw: np.ndarray, length: int):
        self.length, width, self.levels, ids = length, 1, 0, _first_buckets()[raw]
        while width < GRAM:
            self.levels += 1
            ids = refined(ids[:-width], ids[width:], self.levels) if len(ids) > width else ids[:0]
            width *= 2
        self.grams = ids

    def strings(self, at: np.ndarray, length: int | None = None) -> np.ndarray:
        """Identifiers of the strings of `length` bytes that start at `at`, refined by the buckets GRAM
        bytes on, as often as the length asks for."""
        length, ids, level = length or self.length, self.grams[at], self.levels
        for offset in [*range(GRAM, length - GRAM, GRAM), length - GRAM]:
            level += 1
            ids = refined(ids, self.grams[at + offset], level)
        return ids


def anchors(grams: np.ndarray, size: int, starts: np.ndarray, ends: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First string, last string and anchor of each run of strings of `length` bytes with one anchor.
    starts and ends: of the texts, in bytes; strings lie within a text."""
    span = length - GRAM + 1  # grams in a string
    n = len(grams) - span + 1
    if n <= 0:
        return (np.zeros(0, np.int64),) * 3
    # the upper bits of the identifier, then the place: the least is the leftmost of the least ones
    low = np.uint64(size.bit_length())
    least = grams >> low << low | np.arange(len(grams), dtype=np.uint64)
    width = 1
    while width * 2 <= span:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    least = np.minimum(least[: len(least) - (span - width)], least[span - width :]) if span > width else least
    anchor = (least & ((np.uint64(1) << low) - np.uint64(1))).astype(np.int64)
    valid = np.zeros(n + 1, np.int64)
    long = ends - starts >= length
    np.add.at(valid, starts[long], 1)
    np.add.at(valid, np.minimum(ends[long] - length + 1, n), -1)
    valid = np.cumsum(valid)[:-1] > 0
    new = valid.copy()
    new[1:] &= (anchor[1:] != anchor[:-1]) | ~valid[:-1]
    fresh = np.zeros(n + 1, bool)
    fresh[starts[long]] = True
    new |= fresh[:-1] & valid
    first = np.flatnonzero(new)
    last = np.flatnonzero(valid & np.append(new[1:] | ~valid[1:], True))
    return first, last, anchor[first]


def described(raw: np.ndarray, offsets: np.ndarray, length: int) -> list[np.ndarray]:
    """Text, first string (bytes from the text's start), strings, bytes from the first string to the
    anchor, identifier of the shared bytes and of all bytes, of all runs."""
    buckets = Buckets(raw, length)
    first, last, anchor = anchors(buckets.grams, len(raw), offsets[:-1], offsets[1:], length)
    if not len(first):
        return [np.zeros(0, np.int64) for _ in range(6)]
    text = np.searchsorted(offsets, first, "right") - 1
    n, shift = last - first + 1, anchor - first
    return [text, first - offsets[text], n, shift, buckets.grams[anchor].view(np.int64), whole(buckets, first, n, shift)]


def whole(buckets: Buckets, first: np.ndarray, n: np.ndarray, shift: np.ndarray) -> np.ndarray:
    """Identifiers of all bytes of runs: of their first and last strings, which overlap, and their places
    by the anchor."""
    ids = refined(buckets.strings(first), buckets.strings(first + n - 1), 60)
    return mixed(ids + mixed((n + 65536 * shift).astype(np.uint64) + M1)).view(np.int64)


def halved(raw: np.ndarray, offsets: np.ndarray, length: int, text: np.ndarray, at: np.ndarray, n: np.ndarray, shift: np.ndarray) -> list[np.ndarray]:
    """The parts of runs whose strings begin in one of the fields of STEP bytes counted from the anchor,
    as described() gives runs. What the strings of a field share are `length` - STEP + 1 bytes."""
    lo, hi = (shift - n + 1) // STEP, shift // STEP  # fields of the last and of the first string
    k = hi - lo + 1
    of = np.repeat(np.arange(len(n)), k)
    field = np.repeat(hi, k) - (np.arange(int(k.sum())) - np.repeat(np.cumsum(k) - k, k))
    begin = np.minimum(shift[of], field * STEP + STEP - 1)
    end = np.maximum(shift[of] - n[of] + 1, field * STEP)
    anchor = offsets[text[of]] + at[of] + shift[of]
    first, count = anchor - begin, begin - end + 1
    buckets = Buckets(raw, length)
    shared = mixed(buckets.strings(anchor - field * STEP, length - STEP + 1) + mixed(field.astype(np.uint64) + M1)).view(np.int64)
    return [text[of], first - offsets[text[of]], count, begin, shared, whole(buckets, first, count, begin)]


def singled(raw: np.ndarray, offsets: np.ndarray, length: int, text: np.ndarray, at: np.ndarray, n: np.ndarray, shift: np.ndarray) -> list[np.ndarray]:
    """The single strings of runs, as described() gives runs."""
    of = np.repeat(np.arange(len(n)), n)
    k = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
    first = offsets[text[of]] + at[of] + k
    buckets = Buckets(raw, length)
    one = np.ones(len(of), np.int64)
    shared = buckets.grams[first + (length - GRAM) // 2].view(np.int64)
    return [text[of], at[of] + k, one, 0 * one, mixed(shared.view(np.uint64) ^ buckets.strings(first)).view(np.int64), whole(buckets, first, one, 0 * one)]


#: Kinds of rows: a run to be sorted; a mark where a batch has several runs that share their bytes; a run
#: that comes again; a run to be refined.
RUN, MARK, AGAIN, REFINE = 0, 1, 2, 3
#: n, shift and kind of a row are shuffled as one number: from the bits N on, from the bits SHIFT on, below.
ROWS = "shared long, whole long, doc long, tie long, at long, packed long"
N, SHIFT = 32, 2


def _rows(kind, shared, ident, doc, tie, at, n, shift) -> pa.RecordBatch:
    packed = np.asarray(n, np.int64) << N | np.asarray(shift, np.int64) << SHIFT | kind
    cols = [shared, ident, doc, tie, at, packed]
    return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c), pa.int64()) for c in cols], names=["shared", "whole", "doc", "tie", "at", "packed"])


def _batch(doc: np.ndarray, tie: np.ndarray, runs: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    """What a batch sends on: of equal runs the first, for them all; where several share their bytes, a
    mark for all of these, which are to be refined in any case. So each batch sends one row at most for
    the same shared bytes."""
    text, at, n, shift, shared, ident = runs
    by = np.lexsort((tie, doc))
    place = np.empty(len(doc), np.int64)  # in the order of texts; repeated rows are one text
    place[by] = np.cumsum(np.append(0, (doc[by][1:] != doc[by][:-1]) | (tie[by][1:] != tie[by][:-1])))
    order = np.lexsort((at, place[text], ident, shared))
    text, at, n, shift, shared, ident = (x[order] for x in (text, at, n, shift, shared, ident))
    fresh, first = np.ones(len(text), bool), np.ones(len(text), bool)
    fresh[1:] = shared[1:] != shared[:-1]
    first[1:] = fresh[1:] | (ident[1:] != ident[:-1])
    several = (np.bincount(np.cumsum(fresh) - 1, first) > 1)[np.cumsum(fresh) - 1]
    head = np.flatnonzero(first)[np.cumsum(first) - 1]
    again = (place[text] != place[text][head]) | (at != at[head])
    d, t = doc[text], tie[text]

    def spread(mask: np.ndarray) -> np.ndarray:
        return mixed(d[mask].view(np.uint64) + M1).view(np.int64)

    # runs that come again and touch are put together
    p, x, y = place[text][again], at[again], at[again] + n[again]
    by = np.lexsort((x, p))
    p, x, y = p[by], x[by], y[by]
    new = np.ones(len(p), bool)
    # of a text, the runs in order don't overlap
    new[1:] = (p[1:] != p[:-1]) | (x[1:] > y[:-1])
    k = np.flatnonzero(new)
    if len(k):
        at2, n2 = x[k], np.maximum.reduceat(y, k) - x[k]
        d2, t2 = d[again][by][k], t[again][by][k]
        yield _rows(AGAIN, mixed(d2.view(np.uint64) + M1).view(np.int64), t2, d2, t2, at2, n2, 0 * n2)
    one, many = first & ~several, first & several
    yield _rows(RUN, shared[one], ident[one], d[one], t[one], at[one], n[one], shift[one])
    yield _rows(REFINE, spread(many), ident[many], d[many], t[many], at[many], n[many], shift[many])
    marks = shared[many & fresh]
    none = np.zeros(len(marks), np.int64)
    yield _rows(MARK, marks, none, none, none, none, none, none)


def settled(rows: DataFrame) -> DataFrame:
    """doc, tie, at, n, shift of the rows of kind AGAIN and REFINE after all batches' runs are sorted."""
    word = F.col("packed")
    fields = {"kind": word.bitwiseAND(F.lit((1 << SHIFT) - 1)), "n": F.shiftright(word, N), "shift": F.shiftright(word, SHIFT).bitwiseAND(F.lit((1 << N - SHIFT) - 1))}
    # dealt here, so that the numbers are taken apart behind the shuffle
    rows = rows.repartition("shared").select("shared", "whole", "doc", "tie", "at", *[c.cast("int").alias(k) for k, c in fields.items()])
    own = F.col("kind") == RUN
    bucket = Window.partitionBy("shared")
    run = F.when(own, F.col("whole"))
    several = (F.max((F.col("kind") == MARK).cast("int")).over(bucket) == 1) | (F.min(run).over(bucket) != F.max(run).over(bucket))
    place = F.struct("doc", "tie", "at")
    least = F.min(F.when(own, place)).over(Window.partitionBy("shared", "whole"))
    rows = rows.withColumns({"several": F.coalesce(several, F.lit(False)), "again": place != least})
    kind = F.when(own & F.col("again"), AGAIN).when(own & F.col("several"), REFINE).when(F.col("kind") >= AGAIN, F.col("kind"))
    return rows.withColumn("kind", kind).where(F.col("kind").isNotNull()).select("kind", "doc", "tie", "at", "n", "shift")


def sorted_runs(docs: DataFrame, length: int) -> DataFrame:
    """settled() of all runs of all texts."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = utf8(batch.column(2))
            found = []
            for lo, hi in blocks(offsets, BLOCK):
                x = described(raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], length)
                x[0] = x[0] + lo
                found.append(x)
            if found:
                yield from _batch(batch.column(0).to_numpy(), batch.column(1).to_numpy(), [np.concatenate(c) for c in zip(*found, strict=True)])

    return settled(docs.select("doc", "tie", "text").mapInArrow(run, ROWS))


def refined_runs(docs: DataFrame, runs: DataFrame, length: int, parts) -> DataFrame:
    """settled() of the parts (halved or singled) of the runs that are to be refined."""
    wanted = runs.where(F.col("kind") == REFINE).groupBy("doc", "tie").agg(F.collect_list(F.struct("at", "n", "shift")).alias("runs"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = utf8(batch.column(2))
            lists, at, n, shift = _lists(batch.column(3))
            found = []
            for lo, hi in blocks(offsets, BLOCK):
                a, b = int(lists[lo]), int(lists[hi])
                text = np.repeat(np.arange(hi - lo), np.diff(lists[lo : hi + 1]))
                x = parts(raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], length, text, at[a:b], n[a:b], shift[a:b])
                x[0] = x[0] + lo
                found.append(x)
            if found:
                yield from _batch(batch.column(0).to_numpy(), batch.column(1).to_numpy(), [np.concatenate(c) for c in zip(*found, strict=True)])

    rows = docs.join(wanted, ["doc", "tie"]).select("doc", "tie", "text", "runs")
    return settled(rows.mapInArrow(run, ROWS))


def _lists(column: pa.ListArray) -> tuple[np.ndarray, ...]:
    """Offsets of the lists of structs, and the fields' values end to end as long integers."""
    counts = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten()
    fields = [f.to_numpy(zero_copy_only=False).astype(np.int64) for f in flat.flatten()]
    return (np.concatenate([[0], np.cumsum(counts)]), *fields)


def repeats(docs: DataFrame, length: int = 100) -> DataFrame:
    """doc, tie, spans: of each text that has some, the runs (at, n) of strings of `length` bytes that
    start earlier too: in a text before it, or in the same text further ahead. docs: doc, tie, text."""
    if length < 2 * GRAM:
        raise ValueError(f"strings have {2 * GRAM} bytes at least")
    runs = written(sorted_runs(docs, length), "suffix-runs")
    fields = written(refined_runs(docs, runs, length, halved), "suffix-fields")
    strings = written(refined_runs(docs, fields, length, singled), "suffix-strings")
    found = [x.where(F.col("kind") == AGAIN).select("doc", "tie", "at", "n") for x in (runs, fields, strings)]
    return found[0].unionByName(found[1]).unionByName(found[2]).groupBy("doc", "tie").agg(F.collect_list(F.struct("at", "n")).alias("spans"))


def _cut(raw: np.ndarray, at: np.ndarray, n: np.ndarray, length: int) -> tuple[bytes, int, int]:
    """What is left of a text, the bytes removed, and the removed runs of bytes."""
    if not len(at):
        return raw.tobytes(), 0, 0
    edge = np.zeros(len(raw) + 1, np.int64)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + n - 1 + length, -1)
    gone = np.cumsum(edge)[:-1] > 0
    return raw[~gone].tobytes(), int(gone.sum()), int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())


def remove_repeats(docs: DataFrame, text: str = "text", id: str = "doc_id", length: int = 100, columns: bool = False) -> DataFrame:
    """Without `columns`: id, n_bytes, n_removed, n_spans, kept_sha256 of each row. With them: docs with
    what is left as their text; a code point that lost some of its bytes goes altogether.

    Every byte is removed that a string of `length` bytes covers which starts earlier too, in a text of
    smaller id or in the same text; all strings are judged on the input. Texts shorter than `length` stay
    whole. Null text counts as empty (and stays null among `columns`). Null ids come before all others.
    Rows of one id are ordered by a hash of their text; equal ones are one text, so that each gets what
    the first would get alone."""
    keys, _ = keyed(docs, id, text)
    own = F.col("_row").getField(text)
    mine = keys.select("doc", "tie", own.alias("text"))
    spans = repeats(mine, length)
    rest = [c for c in docs.columns if c != text] if columns else [id]
    rows = keys.select("doc", "tie", own.alias("_text"), F.struct(*[F.col("_row").getField(c).alias(c) for c in rest]).alias("_rest")).join(spans, ["doc", "tie"], "left")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = utf8(batch.column(0))
            lists, *fields = _lists(batch.column(1))
            at, n = fields or (np.zeros(0, np.int64),) * 2
            got = [_cut(raw[offsets[i] : offsets[i + 1]], at[lists[i] : lists[i + 1]], n[lists[i] : lists[i + 1]], length) for i in range(batch.num_rows)]
            if columns:
                missing = batch.column(0).is_null().to_pylist()
                yield pa.RecordBatch.from_arrays([pa.array([None if m else g[0].decode(errors="ignore") for g, m in zip(got, missing, strict=True)], pa.string()), batch.column(2)], names=["_text", "_rest"])
            else:
                cols = [pa.array(np.diff(offsets)), pa.array([g[1] for g in got], pa.int64()), pa.array([g[2] for g in got], pa.int64()), pa.array([hashlib.sha256(g[0]).hexdigest() for g in got], pa.string())]
                yield pa.RecordBatch.from_arrays([*cols, batch.column(2)], names=["n_bytes", "n_removed", "n_spans", "kept_sha256", "_rest"])

    kept = rows.select("_text", "spans", "_rest")
    kind = kept.schema["_rest"].dataType.simpleString()
    if columns:
        out = kept.mapInArrow(run, f"_text string, _rest {kind}")
        return out.select(*[(F.col("_text") if c == text else F.col("_rest").getField(c)).alias(c) for c in docs.columns])
    out = kept.mapInArrow(run, f"n_bytes long, n_removed long, n_spans long, kept_sha256 string, _rest {kind}")
    return out.select(F.col("_rest").getField(id).alias(id), "n_bytes", "n_removed", "n_spans", "kept_sha256")
