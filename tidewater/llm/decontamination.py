"""Benchmark decontamination with an FM-index for each shard of the training texts.

A shard is some whole texts as one sequence of words, with a separator after each text. Its index knows
nothing of any benchmark: the shard's distinct words, a wavelet matrix of the Burrows-Wheeler transform of
the sequence of their numbers, and text positions for a sample of the rows. Test phrases are searched
backwards, one word a step, through ranks in the wavelet matrix; all phrases of a block go together. What is
found is located by walking to a row whose position is kept, and the places found merge to spans.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType

from tidewater.llm.common import blocks, dropped, free, utf8, written
from tidewater.llm.tokens import ALNUM, distinct_words, pattern_words, word_spans

SHARD = 6_000_000  #: bytes of text in a shard: about 150 MB of arrays while its index is made
SAMPLE = 16  #: every so many positions of the text are kept
PHRASES = 200_000  #: test phrases that are searched in one pass over the shards

INDEX = "shard long, ids array<{kind}>, n_words array<int>, words array<string>, size int, separators int, bits binary, counts binary, marks binary, samples binary"


def suffix_order(text: np.ndarray) -> np.ndarray:
    """The order of the suffixes of numbers from 0 on, each 0 being an end unlike every other (ends are less
    than all else, the earlier less): the first symbols by one sort, the rest by doubling among equals."""
    ends = text == 0
    n_ends = int(ends.sum())
    rank = text + (n_ends - 1)
    rank[ends] = np.arange(n_ends)
    bits = max(1, int(rank.max()).bit_length())
    depth = 63 // bits
    key = np.zeros(len(text), np.int64)
    for k in range(depth):
        key <<= bits
        key[: max(0, len(text) - k)] |= rank[k:]
    order = np.argsort(key)
    key = key[order]
    fresh = np.append(True, key[1:] != key[:-1])
    at = np.flatnonzero(fresh)
    rank = np.empty(len(text), np.int64)
    rank[order] = np.repeat(at, np.diff(np.append(at, len(text))))
    open_ = np.flatnonzero(~(fresh & np.append(fresh[1:], True)))  # rows that share their key with another
    while len(open_):
        place = order[open_]
        own, later = rank[place], rank[place + depth]
        new = np.lexsort((later, own))
        order[open_] = place = place[new]
        own, later = own[new], later[new]
        fresh = np.append(True, (own[1:] != own[:-1]) | (later[1:] != later[:-1]))
        head = np.flatnonzero(fresh)
        rank[place] = open_[np.repeat(head, np.diff(np.append(head, len(open_))))]
        open_ = open_[~(fresh & np.append(fresh[1:], True))]
        depth *= 2
    return order


def packed(bits: np.ndarray) -> np.ndarray:
    """Bits in 64-bit numbers, the first bit lowest, with one number of none at the end."""
    out = np.zeros(8 * (len(bits) // 64 + 1), np.uint8)
    some = np.packbits(bits, bitorder="little")
    out[: len(some)] = some
    return out.view(np.uint64)


@dataclass
class Ranked:
    """A vector of bits that tells how many are set before each place."""

    words: np.ndarray

    def __post_init__(self):
        self.before = np.cumsum(np.append(0, np.bitwise_count(self.words)[:-1].astype(np.int64)))

    def rank(self, at: np.ndarray) -> np.ndarray:
        low = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[at >> 6] + np.bitwise_count(self.words[at >> 6] & low)

    def has(self, at: np.ndarray) -> np.ndarray:
        return (self.words[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) == 1


class Index:
    """The FM-index of one shard, from what made() has kept of it."""

    def __init__(self, size: int, bits: bytes, counts: bytes, marks: bytes, samples: bytes):
        self.size, self.counts = size, np.frombuffer(counts, np.int32).astype(np.int64)
        rows = np.frombuffer(bits, np.uint64).reshape(-1, size // 64 + 1)
        self.levels = [Ranked(r) for r in rows]
        self.zeros = [size - int(x.before[-1]) - int(np.bitwise_count(x.words[-1])) for x in self.levels]
        self.marks, self.samples = Ranked(np.frombuffer(marks, np.uint64)), np.frombuffer(samples, np.int32)

    @staticmethod
    def made(text: np.ndarray) -> tuple[bytes, bytes, bytes, bytes]:
        """bits, counts, marks and samples of a sequence of numbers whose last is 0."""
        order = suffix_order(text)
        column = text[order - 1]
        start = text[order - 1] == 0  # nothing stands before it in its text, so that no walk goes on from there
        kept = start | (order % SAMPLE == 0)
        levels = []
        for k in range(max(1, int(text.max()).bit_length()))[::-1]:
            bit = (column >> k) & 1 == 1
            levels.append(packed(bit))
            column = np.concatenate([column[~bit], column[bit]])
        before = np.append(0, np.cumsum(np.bincount(text)))
        return np.concatenate(levels).tobytes(), before.astype(np.int32).tobytes(), packed(kept).tobytes(), order[kept].astype(np.int32).tobytes()

    def before(self, symbol: np.ndarray, *at: np.ndarray) -> list[np.ndarray]:
        """How many rows before each place have the symbol in the transform's column."""
        at = [np.zeros(len(symbol), np.int64), *at]
        for k, (level, zeros) in enumerate(zip(self.levels, self.zeros, strict=True)):
            one = (symbol >> (len(self.levels) - 1 - k)) & 1 == 1
            ranks = [level.rank(x) for x in at]
            at = [np.where(one, zeros + r, x - r) for x, r in zip(at, ranks, strict=True)]
        return [x - at[0] for x in at[1:]]

    def symbols(self, at: np.ndarray) -> np.ndarray:
        out = np.zeros(len(at), np.int64)
        for level, zeros in zip(self.levels, self.zeros, strict=True):
            one, r = level.has(at), level.rank(at)
            out = out << 1 | one
            at = np.where(one, zeros + r, at - r)
        return out

    def search(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of phrases of symbols from 1 on (a row each, the last `lengths` of its columns): those that occur,
        and the ranges of the rows that begin with them."""
        alive = np.arange(len(phrases))
        low, high = np.zeros(len(alive), np.int64), np.full(len(alive), self.size)
        for k in range(phrases.shape[1]):
            going = lengths[alive] > k
            symbol = phrases[alive[going], phrases.shape[1] - 1 - k]
            a, b = self.before(symbol, low[going], high[going])
            low[going], high[going] = self.counts[symbol] + a, self.counts[symbol] + b
            some = low < high
            alive, low, high = alive[some], low[some], high[some]
        return alive, low, high

    def located(self, rows: np.ndarray) -> np.ndarray:
        """The position in the text of each row."""
        out, steps, open_ = np.empty(len(rows), np.int64), 0, np.arange(len(rows))
        while len(open_):
            kept = self.marks.has(rows)
            out[open_[kept]] = self.samples[self.marks.rank(rows[kept])] + steps
            rows, open_, steps = rows[~kept], open_[~kept], steps + 1
            if len(open_):
                symbol = self.symbols(rows)
                rows = self.counts[symbol] + self.before(symbol, rows)[0]
        return out


def index(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """The FM-indexes of all rows' whole texts, a row for each shard of at most SHARD bytes, or of one text that
    is longer. Null and empty texts have no words and stand in their shard like others."""
    kind = docs.schema[id].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = TaskContext.get().partitionId() << 33
        for batch in batches:
            raw, offsets = utf8(batch.column(1))
            for lo, hi in blocks(offsets, SHARD):
                own = raw[offsets[lo] : offsets[hi]]
                starts, lengths, n = word_spans(own, offsets[lo : hi + 1] - offsets[lo], ALNUM)
                codes, words = distinct_words(own, starts, lengths)
                ends = np.cumsum(n) + np.arange(hi - lo)
                sequence = np.zeros(len(codes) + hi - lo, np.int64)
                filled = np.ones(len(sequence), bool)
                filled[ends] = False
                sequence[filled] = codes + 1
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([shard], pa.int64()),
                        pa.ListArray.from_arrays(pa.array([0, hi - lo], pa.int32()), batch.column(0).slice(lo, hi - lo)),
                        pa.array([n], pa.list_(pa.int32())),
                        pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words),
                        pa.array([len(sequence)], pa.int32()),
                        pa.array([hi - lo], pa.int32()),
                        *(pa.array([x], pa.binary()) for x in Index.made(sequence)),
                    ],
                    names=["shard", "ids", "n_words", "words", "size", "separators", "bits", "counts", "marks", "samples"],
                )
                shard += 1

    return docs.select(F.col(f"`{id}`"), F.col(f"`{text}`")).mapInArrow(run, INDEX.format(kind=kind))


def phrases(benchmark: DataFrame, id: str = "item_id", text: str = "text", width: int = 10) -> DataFrame:
    """phrase, items: the distinct windows of `width` consecutive words of the items' texts, and the ids of the
    items that have each. An item of fewer words is one window, one without words has none."""
    words = benchmark.select(F.col(f"`{id}`").alias("item"), F.expr(pattern_words(f"coalesce(`{text}`, '')")).alias("w")).where("size(w) > 0")
    windows = words.select("item", F.explode(F.expr(f"transform(sequence(1, greatest(1, size(w) - {width - 1})), i -> slice(w, i, {width}))")).alias("phrase"))
    return windows.groupBy("phrase").agg(F.sort_array(F.collect_set("item")).alias("items"))


def _pass(rows: list, width: int) -> tuple[pa.Array, np.ndarray, np.ndarray, list]:
    """Distinct words, phrases by their numbers (from the right), lengths and items of one pass."""
    known: dict[str, int] = {}
    numbers = np.full((len(rows), width), -1, np.int64)
    for k, r in enumerate(rows):
        numbers[k, width - len(r.phrase) :] = [known.setdefault(w, len(known)) for w in r.phrase]
    return pa.array([*known], pa.string()), numbers, np.array([len(r.phrase) for r in rows], np.int64), [r["items"] for r in rows]


def _found(one: dict, words: pa.Array, numbers: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(phrase, position) of every occurrence in a shard."""
    symbol = pc.fill_null(pc.index_in(words, value_set=one["words"]), -1).to_numpy().astype(np.int64) + 1
    own = np.where(numbers >= 0, symbol[numbers], 0)
    alive = np.flatnonzero(((own > 0) | (numbers < 0)).all(axis=1))
    if not len(alive):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    fm = Index(*(one[k] for k in ("size", "bits", "counts", "marks", "samples")))
    which, low, high = fm.search(own[alive], lengths[alive])
    n = high - low
    rows = np.repeat(low - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
    return np.repeat(alive[which], n), fm.located(rows)


def _runs(covered: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.diff(np.concatenate([[0], covered.astype(np.int8), [0]]))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def _lists(offsets: np.ndarray, values: pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)


SPANS = "array<struct<start:int,end:int>>"
FOUND = "shard long, at int, id {kind}, n_words int, spans " + SPANS + ", items array<{item}>"


def _searched(shards: DataFrame, rows: list, width: int, item: DataType) -> DataFrame:
    """shard, at (the place in it), id, n_words, spans, items of all texts of the shards, by one pass's phrases."""
    words, numbers, lengths, items = _pass(rows, width)
    each = [i for x in items for i in x]
    distinct = {x: k for k, x in enumerate(dict.fromkeys(each))}
    named = pa.array([*distinct], to_arrow_type(item))
    of = np.array([distinct[i] for i in each], np.int64)
    first = np.cumsum([0, *map(len, items)])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                one = {c: batch.column(c)[k].as_py() for c in ("size", "bits", "counts", "marks", "samples")}
                one["words"] = batch.column("words").slice(k, 1).flatten()
                ids, n_words = (batch.column(c).slice(k, 1).flatten() for c in ("ids", "n_words"))
                ends = np.cumsum(n_words.to_numpy().astype(np.int64) + 1)
                begin = ends - n_words.to_numpy() - 1
                phrase, at = _found(one, words, numbers, lengths)
                change = np.zeros(one["size"] + 1, np.int64)
                np.add.at(change, at, 1)
                np.add.at(change, at + lengths[phrase], -1)
                start, end = _runs(np.cumsum(change)[:-1] > 0)
                text = np.searchsorted(ends, start, "right")
                place = pa.StructArray.from_arrays([pa.array(start - begin[text], pa.int32()), pa.array(end - begin[text], pa.int32())], ["start", "end"])
                pair = np.unique(np.searchsorted(ends, at, "right") * len(items) + phrase)
                owner, which = np.divmod(pair, max(1, len(items)))
                n = first[which + 1] - first[which]
                flat = of[np.repeat(first[which] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]
                owner, flat = np.divmod(np.unique(np.repeat(owner, n) * len(named) + flat), max(1, len(named)))
                edges = np.arange(len(ids) + 1)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(ids), batch.column("shard")[k].as_py()), pa.int64()),
                        pa.array(np.arange(len(ids)), pa.int32()),
                        ids,
                        n_words,
                        _lists(np.searchsorted(text, edges), place),
                        _lists(np.searchsorted(owner, edges), named.take(pa.array(flat, pa.int64()))),
                    ],
                    names=["shard", "at", "id", "n_words", "spans", "items"],
                )

    kind = shards.schema["ids"].dataType.elementType.simpleString()
    return shards.mapInArrow(run, FOUND.format(kind=kind, item=item.simpleString()))


def _both(one: DataFrame, other: DataFrame) -> DataFrame:
    """What two passes have found, by the text's place: spans merged, items of either."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            spans = []
            for x, y in zip(b.column("spans").to_pylist(), b.column("more_spans").to_pylist(), strict=True):
                own: list[dict] = []
                for s in sorted([*x, *y], key=lambda s: s["start"]):
                    if own and s["start"] <= own[-1]["end"]:
                        own[-1]["end"] = max(own[-1]["end"], s["end"])
                    else:
                        own.append(dict(s))
                spans.append(own)
            items = [[*dict.fromkeys([*x, *y])] for x, y in zip(b.column("items").to_pylist(), b.column("more_items").to_pylist(), strict=True)]
            kept = [b.column(c) for c in ("shard", "at", "id", "n_words")]
            yield pa.RecordBatch.from_arrays(
                [*kept, pa.array(spans, b.schema.field("spans").type), pa.array(items, b.schema.field("items").type)], names=["shard", "at", "id", "n_words", "spans", "items"]
            )

    more = other.select("shard", "at", F.col("spans").alias("more_spans"), F.col("items").alias("more_items"))
    kind, item = (one.schema[c].dataType for c in ("id", "items"))
    return one.join(more, ["shard", "at"]).mapInArrow(run, FOUND.format(kind=kind.simpleString(), item=item.elementType.simpleString()))


def search(shards: DataFrame, windows: DataFrame, width: int = 10, most: int = PHRASES) -> DataFrame:
    """id, n_words, spans, items of every text in the index: its words, the spans of words that occurrences of
    the phrases cover (start, end; merged, in order) and the items they are of.

    About `most` phrases are searched in one pass, so that no task holds a large benchmark; a benchmark of
    more takes more passes over the index, and what they find is merged text by text."""
    item = windows.schema["items"].dataType.elementType
    passes = -(-windows.count() // most)
    if passes <= 1:
        return _searched(shards, windows.collect(), width, item).drop("shard", "at")
    shards = written(shards, "fm-index", compression="zstd")
    windows = written(windows.withColumn("pass", F.pmod(F.xxhash64("phrase"), F.lit(passes))), "phrases")
    out = None
    for k in range(passes):
        part = _searched(shards, windows.where(F.col("pass") == k).drop("pass").collect(), width, item)
        before, out = out, written(part if out is None else _both(out, part), "fm-found", compression="zstd")
        if before is not None:
            dropped(before)
    dropped(shards, windows)
    return out.drop("shard", "at")


def contamination(docs: DataFrame, benchmark: DataFrame, width: int = 10, id: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """id, n_words, spans, items of each row of docs: where its words are those of `width` consecutive words of
    an item (of a shorter item all its words), and of which items.

    Words are runs of digits, letters and what is beyond ASCII, A-Z as a-z. Null and empty texts have no words
    and no spans; texts are indexed whole at any length. Repeated rows, null ids and rows of one id each give a
    row. Items of one text are all told; an item without an id covers words, but isn't named. Without docs
    there are no rows; without items no spans. Other columns are not read, whatever their names."""
    found = search(index(docs, id, text), phrases(benchmark, item, item_text, width), width)
    return found.withColumnRenamed("id", id)


def cut(docs: DataFrame, found: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs, with the spans of `found` (one row for each id, none of them null) taken out of their texts, from
    the first letter of a span's first word to the last of its last. Texts without spans stay as they are."""
    own = docs.join(found.where("size(spans) > 0").select(F.col(id), F.col("spans").alias(at := free("_spans", docs))), id, "left")
    texts, spans = own.columns.index(text), own.columns.index(at)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = b.column(texts).to_pylist()
            for k, own in enumerate(b.column(spans).to_pylist()):
                if own:
                    data = out[k].encode()
                    starts, lengths, _ = word_spans(np.frombuffer(data, np.uint8), np.array([0, len(data)]), ALNUM)
                    edges = [0, *(int(x) for s in own for x in (starts[s["start"]], starts[s["end"] - 1] + lengths[s["end"] - 1])), len(data)]
                    out[k] = b"".join(data[a:z] for a, z in zip(edges[::2], edges[1::2], strict=True)).decode()
            columns = [pa.array(out, b.schema.field(texts).type) if k == texts else c for k, c in enumerate(b.columns) if k != spans]
            yield pa.RecordBatch.from_arrays(columns, names=[n for n in b.schema.names if n != at])

    return own.mapInArrow(run, own.drop(at).schema).select(*[F.col(f"`{c}`") for c in docs.columns])
