"""Packing of token ids into fixed windows whose sources keep the corpus's proportions.

Each source is a queue of tokens. The queues are cut into blocks of windows by exact integer shares, so
that every block holds each source in proportion and the fraction that is left carries on to the next
block, wherever that one is worked on. Within a block, deficit round-robin fills each window from the
queues and carries the deficits from window to window. Sources that are due fewer than two tokens a block
stand in one queue, one after another, as no window could hold their shares.
"""

from __future__ import annotations

import functools
import json
import zlib
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewater.llm.common import blocks, grouped, utf8, written
from tidewater.llm.pretokens import PieceVocabulary, byte_letters

# Fixed value: the pre-token pattern of byte_bpe_50k.json.
BYTE_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
BLOCK = 1_000_000
BUCKETS = 1024  #: in which sources are summed up

_LOADED: dict[str, ByteVocabulary] = {}


class ByteVocabulary(PieceVocabulary):
    """A byte-level vocabulary whose pre-tokens are merged by the ranks that its ids are."""

    def __init__(self, path: str):
        super().__init__(path, keep_space=True, pattern=BYTE_PATTERN)
        import tiktoken

        letters = {c: b for b, c in byte_letters().items()}
        with open(path, encoding="utf-8") as f:
            vocab = json.load(f)["model"]["vocab"]
        ranks = {bytes(letters[c] for c in piece): i for piece, i in vocab.items() if piece not in self.special}
        self.encoding = tiktoken.Encoding("ranks", pat_str=BYTE_PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.width = np.uint16 if max(vocab.values()) < 65536 else np.uint32

    def ids(self, piece: str) -> list[int]:
        return self.encoding._encode_single_piece(piece)

    def encode(self, texts: list[str], end: int) -> tuple[np.ndarray, np.ndarray]:
        """All ids, each text closed by `end`, and the offsets of the texts."""
        segments, owner, specials = self.segments(texts)
        cp, starts, lengths, joined, offsets = self.pieces(segments)
        counts = np.zeros(0, np.int64)
        ids = np.zeros(0, np.int64)
        if len(starts):
            kinds, lists = self.distinct(cp, starts, lengths, joined, lambda piece: array("I", self.ids(piece)).tobytes())
            per_kind = np.fromiter(map(len, lists), np.int64, len(lists)) // 4
            flat = np.frombuffer(b"".join(lists), np.uint32)
            counts = per_kind[kinds]
            begins = np.cumsum(per_kind) - per_kind
            ids = flat[np.repeat(begins[kinds] - (np.cumsum(counts) - counts), counts) + np.arange(int(counts.sum()))]
        per_segment = np.bincount(np.searchsorted(offsets, starts, "right") - 1, counts, len(segments)).astype(np.int64)
        segment_ends = np.cumsum(per_segment)
        per_text = np.bincount(owner, per_segment, len(texts)).astype(np.int64)
        ends = np.cumsum(per_text)
        put = [(i, 0, int(segment_ends[s]), t) for i, s, t in specials] + [(i, 1, e, end) for i, e in enumerate(ends.tolist())] if specials else None
        if put:
            put.sort(key=lambda x: x[:2])
            ids = np.insert(ids, [p[2] for p in put], [p[3] for p in put])
            per_text += np.bincount([i for i, _, _ in specials], minlength=len(texts))
        else:
            ids = np.insert(ids, ends, end)
        return ids.astype(self.width), np.concatenate([[0], np.cumsum(per_text + 1)])


def vocabulary(path: str) -> ByteVocabulary:
    if path not in _LOADED:
        _LOADED[path] = ByteVocabulary(path)
    return _LOADED[path]


def tokenised(docs: DataFrame, path: str, end: int) -> DataFrame:
    """id, queue, part, at, n, ids: the ids of each text and its place among the rows of its queue in
    its part of the table."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path)
        part = TaskContext.get().partitionId()
        seen: dict[str, int] = {}
        for batch in batches:
            column = batch.column(2)
            _, offsets = utf8(column)
            for lo, hi in blocks(offsets, BLOCK):
                ids, ends = v.encode([t or "" for t in column.slice(lo, hi - lo).to_pylist()], end)
                raw, width = memoryview(ids.view(np.uint8)), ids.dtype.itemsize
                n = np.diff(ends)
                queues = batch.column(1).slice(lo, hi - lo)
                at = []
                for q, k in zip(queues.to_pylist(), n.tolist(), strict=True):
                    at.append(seen.get(q, 0))
                    seen[q] = at[-1] + k
                data = pa.BinaryArray.from_buffers(pa.binary(), hi - lo, [None, pa.py_buffer((ends * width).astype(np.int32)), pa.py_buffer(raw)])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), queues, pa.array(np.full(hi - lo, part, np.int32)), pa.array(at, pa.int64()), pa.array(n), data], names=["id", "queue", "part", "at", "n", "ids"])

    kind = docs.schema["id"].dataType.simpleString()
    return docs.select("id", "queue", "text").mapInArrow(run, f"id {kind}, queue string, part int, at long, n long, ids binary")


class Lane:
    """Where the blocks of `size` tokens cut a queue that has the tokens before : end of the corpus's `all`
    when all queues are laid end to end. The cuts of all queues add up to whole blocks; the last block has
    what is left. A queue's cuts ascend if it is due two tokens a block or is the last one."""

    def __init__(self, before: int, end: int, all: int, size: int):
        self.before, self.end, self.all, self.size = before, end, all, size
        self.count = max(1, all // size)

    def edge(self, block: int) -> int:
        if block >= self.count:
            return self.end - self.before
        return block * self.size * self.end // self.all - block * self.size * self.before // self.all

    def block_at(self, token: int) -> int:
        """The last block that begins at or before this token of the queue."""
        b = min(self.count - 1, token * self.all // (self.size * (self.end - self.before)))
        while b > 0 and self.edge(b) > token:
            b -= 1
        while b + 1 < self.count and self.edge(b + 1) <= token:
            b += 1
        return b


def lanes(sums: DataFrame, all: int, block: int) -> DataFrame:
    """queue, part, before, end, base, tail: the place of each source's queue among all tokens, and of what a
    part of the table has of it within the queue. sums: queue, part, n. Queues are ordered by a hash, those
    of the tail last; sums run within the hash's buckets first, so that no task sees all sources."""
    queues = sums.groupBy("queue").agg(F.sum("n").alias("n"))
    tail = F.col("n").cast("decimal(38,0)") * F.lit(block) < F.lit(2 * all).cast("decimal(38,0)")
    queues = queues.withColumns({"tail": tail, "bucket": F.pmod(F.xxhash64("queue"), F.lit(BUCKETS)).cast("int")})
    buckets = queues.groupBy("tail", "bucket").agg(F.sum("n").alias("_n"))
    ahead = lambda by: Window.partitionBy(*by[0]).orderBy(*by[1]).rowsBetween(Window.unboundedPreceding, -1)
    # 2 * BUCKETS rows at most
    buckets = buckets.withColumn("_base", F.coalesce(F.sum("_n").over(ahead(([], ["tail", "bucket"]))), F.lit(0))).drop("_n")
    placed = queues.withColumn("_own", F.coalesce(F.sum("n").over(ahead((["tail", "bucket"], ["queue"]))), F.lit(0)))
    placed = placed.join(F.broadcast(buckets), ["tail", "bucket"]).withColumn("at", F.col("_base") + F.col("_own"))
    first = buckets.agg(F.min(F.when(F.col("tail"), F.col("_base"))).alias("_tail"))  # one row
    placed = placed.join(F.broadcast(first)).select("queue", "tail", F.when(F.col("tail"), F.col("_tail")).otherwise(F.col("at")).alias("before"), F.when(F.col("tail"), F.lit(all)).otherwise(F.col("at") + F.col("n")).alias("end"), "at")
    parts = sums.withColumn("_in", F.coalesce(F.sum("n").over(ahead((["queue"], ["part"]))), F.lit(0)))
    return parts.join(placed, "queue").select("queue", "part", "tail", "before", "end", (F.col("at") - F.col("before") + F.col("_in")).alias("base"))


def fill(queues: dict[str, list], windows: list[int], piece: int) -> Iterator[tuple[int, int, object, int, int]]:
    """Deficit round-robin: (window, offset, item, from, to) of each piece. queues: lists of (item,
    length), whose lengths are those of the windows in all. A queue whose turn it is and that is owed
    tokens gives what it is owed or `piece` tokens, whichever is more, unless its text or the window
    ends first; what it gave too much is taken off its next turns. Where no queue is owed tokens, the one
    that lacks least to it gives. Queues begin with a debt below `piece`, told by a hash of their names, so
    that many small ones do not all give at once."""
    names = sorted(queues)
    total = sum(windows)
    share = {q: sum(n for _, n in queues[q]) for q in names}
    owed = {q: -(zlib.crc32(q.encode()) % 1000 * min(piece, share[q]) * total // 1000) for q in names}  # times total
    head = dict.fromkeys(names, 0)
    done = dict.fromkeys(names, 0)
    turn = 0
    for w, size in enumerate(windows):
        for q in names:
            owed[q] += size * share[q]
        room, idle = size, 0
        while room:
            if idle >= len(names):
                turn = max((k for k, q in enumerate(names) if head[q] < len(queues[q])), key=lambda k: owed[names[k]])
            q = names[turn]
            if head[q] < len(queues[q]) and (owed[q] > 0 or idle >= len(names)):
                item, n = queues[q][head[q]]
                a = done[q]
                take = min(n - a, room, max(piece, -(-owed[q] // total)))
                yield w, size - room, item, a, a + take
                owed[q] -= take * total
                room -= take
                idle = 0
                if a + take == n:
                    head[q] += 1
                    done[q] = 0
                else:
                    done[q] = a + take
                if owed[q] > 0 and room:
                    continue
            else:
                idle += 1
            turn = (turn + 1) % len(names)


def windows_of(total: int, size: int) -> list[int]:
    """Full windows, and powers of two for the rest."""
    rest = total % size
    return [size] * (total // size) + [1 << k for k in reversed(range(rest.bit_length())) if rest >> k & 1]


def pack(docs: DataFrame, path: str, text: str = "text", id: str = "doc_id", source: str = "source", size: int = 2048, piece: int = 256, windows: int = 64, end: int = 1) -> DataFrame:
    """Pieces of texts in sequences of `size` ids: id, start, length, ids_crc32, doc_tokens, sequence_id,
    offset, source_queue.

    Null text counts as empty (its closing id is packed), null source is a source of its own. Repeated
    rows and null ids are packed row by row; other columns are not read. Texts of any length are cut where
    a block or a window ends. Only the last block's last sequences are shorter than `size`: powers of two,
    so that nothing is padded. No rows: no pieces. There may be any number of sources, each of them with the
    share of the corpus that it has; source_queue is the piece's source."""
    rows = docs.select(F.col(id).alias("id"), F.when(F.col(source).isNull(), F.lit("")).otherwise(F.concat(F.lit("="), F.col(source))).alias("queue"), F.col(text).alias("text"))
    width = vocabulary(path).width
    kind = rows.schema["id"].dataType.simpleString()
    tokens = written(tokenised(rows, path, end), "packing-ids", compression="zstd")
    sums = tokens.groupBy("queue", "part").agg(F.sum("n").alias("n"))
    total = tokens.agg(F.sum("n")).first()[0]
    out = f"{id} {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, source_queue string"
    if not total:
        return docs.sparkSession.createDataFrame([], out)
    block = windows * size
    # as a table of its own, so that Spark knows its size before it plans the join and, while it is small,
    # does not shuffle the ids for it
    base = written(lanes(sums, total, block), "packing-base")
    placed = tokens.join(base, ["queue", "part"]).select("id", "queue", "tail", "before", "end", (F.col("base") + F.col("at")).alias("at"), "n", "ids")

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, known = width().itemsize, {}
        kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), None, pa.int64(), pa.int64(), pa.binary()]
        for batch in batches:
            kinds[4] = batch.schema.field(0).type
            rows, data = [], batch.column(7)
            for i, (own, q, tail, before, end, at, n) in enumerate(zip(*(batch.column(k).to_pylist() for k in range(7)), strict=True)):
                if (before, end) not in known:
                    if len(known) > 10_000:
                        known.clear()
                    known[before, end] = Lane(before, end, total, block)
                lane = known[before, end]
                b, g = lane.block_at(at), at
                while g < at + n:
                    to = min(at + n, lane.edge(b + 1))
                    if to > g:
                        rows.append((b, "" if tail else f"={q}", q, g, own, g - at, n, data[i].as_buffer()[(g - at) * w : (to - at) * w].to_pybytes()))
                        g = to
                    b += 1
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True) if rows else [[]] * 8, kinds, strict=True)], names=["block", "lane", "queue", "at", "id", "start", "n", "ids"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (block,), table in grouped(batches, ["block"]):
            queues: dict[str, list] = {}
            cols = [table.column(c).to_pylist() for c in ("lane", "queue", "id", "start", "n", "ids")]
            for lane, q, i, start, n, data in zip(*cols, strict=True):
                ids = np.frombuffer(data, width).astype("<u4")
                queues.setdefault(lane, []).append(((q, i, start, n, memoryview(ids.view(np.uint8))), len(ids)))
            here = sum(n for x in queues.values() for _, n in x)
            out = [
                (i, start + a, b - a, zlib.crc32(raw[4 * a : 4 * b]), n, block * windows + w, offset, q[1:] if q else None)
                for w, offset, (q, i, start, n, raw), a, b in fill(queues, windows_of(here, size), piece)
            ]
            kinds = [table.schema.field("id").type, *[pa.int64()] * 6, pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), kinds, strict=True)], names=[id, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "source_queue"])

    cuts = placed.mapInArrow(cut, f"block long, lane string, queue string, at long, id {kind}, start long, n long, ids binary")
    return cuts.repartition("block").sortWithinPartitions("block", "lane", "at").mapInArrow(run, out)
