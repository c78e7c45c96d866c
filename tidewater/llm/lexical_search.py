"""Ranked lexical search, score at a time over postings ordered by their impact.

Texts are kept block by block: the distinct terms of a block, and of each term the texts that have it and how
often. What a posting adds to a score, its impact, is a whole number. The postings of an item's terms stand in
groups of equal impact and are taken in descending order, whatever term they are of. After each step a text's
score lies between what it has got and that plus the next impacts of the terms it has not met; texts that can
no longer come among the first k are left, and once no text can join, the scores of the others are completed.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tidewater.llm.common import FIRST, WIDE, blocks, utf8, written
from tidewater.llm.tokens import ALNUM, distinct_words, pattern_words, word_spans

BLOCK = 3_000_000  #: bytes of text in a block of postings
TERMS = 500_000  #: terms of items that are ranked in one pass
STEP = 512  #: postings of the first step; each later one doubles what was taken
EXACT = 1 << 53  #: sums of whole numbers below this are exact in doubles
#: A block is a row of megabytes: row groups of the table of postings hold few, however much a task reads.
GROUPS = {"parquet.block.size": str(4 << 20), "parquet.page.size.row.check.min": "1", "parquet.page.size.row.check.max": "1"}


def added(index: np.ndarray, values: np.ndarray, size: int) -> np.ndarray:
    """The sum of the values of each index, exactly."""
    if values.sum(dtype=np.float64) < EXACT:
        return np.bincount(index, values, size).astype(np.int64)
    out = np.zeros(size, np.int64)
    np.add.at(out, index, values)
    return out


def packed(x: np.ndarray) -> bytes:
    """Counts as bytes in the least width that holds them all, which comes first."""
    width = next(w for w in (1, 2, 4) if not len(x) or w == 4 or int(x.max()) < 1 << 8 * w)
    return bytes([width]) + x.astype(f"<u{width}").tobytes()


def unpacked(value: pa.Scalar) -> np.ndarray:
    raw = value.as_buffer()
    return np.frombuffer(raw, f"<u{raw[0]}", offset=1).astype(np.int64)


def postings(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each block of texts: its ids (a null id as the least number) and their numbers of terms; its
    distinct terms, how many of its texts have each (`df`), and of each term in turn the places of these texts
    and how often they have it."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = utf8(batch.column(1))
            for lo, hi in blocks(offsets, BLOCK):
                own = raw[offsets[lo] : offsets[hi]]
                starts, lengths, n = word_spans(own, offsets[lo : hi + 1] - offsets[lo], ALNUM)
                codes, terms = distinct_words(own, starts, lengths)
                pair, times = np.unique(codes * (hi - lo) + np.repeat(np.arange(hi - lo), n), return_counts=True)
                term, place = np.divmod(pair, hi - lo)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.ListArray.from_arrays(pa.array([0, hi - lo], pa.int32()), batch.column(0).slice(lo, hi - lo)),
                        pa.array([n], pa.list_(pa.int64())),
                        pa.ListArray.from_arrays(pa.array([0, len(terms)], pa.int32()), terms),
                        pa.array([np.bincount(term, minlength=len(terms))], pa.list_(pa.int32())),
                        pa.array([packed(place)], pa.binary()),
                        pa.array([packed(times)], pa.binary()),
                    ],
                    names=["ids", "lengths", "terms", "df", "places", "times"],
                )

    own = docs.select(F.coalesce(F.col(f"`{id}`").cast("long"), F.lit(FIRST)), F.col(f"`{text}`"))
    return own.mapInArrow(run, "ids array<long>, lengths array<long>, terms array<string>, df array<int>, places binary, times binary")


def best(impact: np.ndarray, place: np.ndarray, term: np.ndarray, ids: np.ndarray, k: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and scores of all texts that can be among the first k by (score descending, id), and perhaps of
    others; none below `least`, a score that k texts elsewhere have. Postings are given in descending impact;
    texts of a score of 0 are none."""
    if not len(impact):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    size, n_terms, done, step = len(ids), int(term.max()) + 1, 0, STEP
    group_end = np.append(np.flatnonzero(impact[1:] != impact[:-1]) + 1, len(impact))
    by_term = np.argsort(term, kind="stable")
    ends = np.searchsorted(term[by_term], np.arange(n_terms), "right")
    score, met = np.zeros(size, np.int64), np.zeros(size, np.int64)
    while True:
        to = int(group_end[np.searchsorted(group_end, min(done + step, len(impact)))])
        score += added(place[done:to], impact[done:to], size)
        done, step = to, 2 * step
        if done == len(impact):
            found = np.flatnonzero(score >= max(least, 1))
            return found, score[found]
        # a term's next impact is that of its first posting not taken
        taken = np.bincount(term[:done], minlength=n_terms)
        at = np.append(0, ends)[:-1] + taken
        following = np.where(at < ends, impact[by_term[np.minimum(at, len(by_term) - 1)]], 0)
        met = added(place[:done], following[term[:done]], size)
        rest = int(following.sum())
        bound = max(least, int(np.partition(score, size - k)[size - k]) if size >= k else 0, 1)
        if rest < bound:
            break
    open_ = score + (rest - met) >= bound
    late = open_[place[done:]]
    score += added(place[done:][late], impact[done:][late], size)
    found = np.flatnonzero(open_ & (score >= max(least, 1)))
    return found, score[found]


class Best:
    """The first k texts of an item so far."""

    def __init__(self, k: int):
        self.k, self.score, self.id = k, np.zeros(0, np.int64), np.zeros(0, np.int64)

    @property
    def least(self) -> int:
        return int(self.score[-1]) if len(self.score) == self.k else 0

    def add(self, score: np.ndarray, id: np.ndarray) -> None:
        score, id = np.append(self.score, score), np.append(self.id, id)
        order = np.lexsort((id, -score))[: self.k]
        self.score, self.id = score[order], id[order]


def _ranked(blocks: DataFrame, queries: list, n_texts: int, n_terms: int, k: int, item) -> DataFrame:
    """part, item, id, score: the first k texts of each item among the blocks of each task."""
    known: dict[str, int] = {}
    number = np.array([known.setdefault(q.term, len(known)) for q in queries], np.int64)
    weight = np.zeros(len(known), np.int64)
    weight[number] = [q.w for q in queries]
    items = {x: i for i, x in enumerate(dict.fromkeys(q.item for q in queries))}
    owner = np.array([items[q.item] for q in queries], np.int64)
    order = np.argsort(owner, kind="stable")
    own_terms = np.split(number[order], np.cumsum(np.bincount(owner, minlength=len(items)))[:-1]) if len(items) else []
    terms, names = pa.array([*known], pa.string()), pa.array([*items], to_arrow_type(item))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = [Best(k) for _ in own_terms]
        for batch in batches:
            for r in range(batch.num_rows):
                ids, lengths, df = (batch.column(c).slice(r, 1).flatten().to_numpy().astype(np.int64) for c in ("ids", "lengths", "df"))
                place, times = (unpacked(batch.column(c)[r]) for c in ("places", "times"))
                at = pc.fill_null(pc.index_in(terms, value_set=batch.column("terms").slice(r, 1).flatten()), -1).to_numpy()
                some = np.flatnonzero(at >= 0)  # the items' terms that the block has
                n = np.zeros(len(terms), np.int64)
                n[some] = df[at[some]]
                begin = np.append(0, np.cumsum(n))
                from_ = (np.cumsum(df) - df)[at[some]]
                pick = np.repeat(from_ - begin[:-1][some], n[some]) + np.arange(int(begin[-1]))
                place, times = place[pick], times[pick]
                m = 50 + (50 * lengths * n_texts) // max(1, n_terms)
                impact = np.repeat(weight, n) * ((1_000_000_000 * times) // (1000 * times + 20 * m[place]))
                # each term's list in descending impact
                by = np.lexsort((-impact, np.repeat(np.arange(len(terms)), n)))
                impact, place = impact[by], place[by]
                for i, own in enumerate(own_terms):
                    own = own[n[own] > 0]
                    size = n[own]
                    pick = np.repeat(begin[own] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
                    slot = np.repeat(np.arange(len(own)), size)
                    down = np.argsort(-impact[pick], kind="stable")
                    found, score = best(impact[pick][down], place[pick][down], slot[down], ids, k, first[i].least)
                    first[i].add(score, ids[found])
        n = [len(x.id) for x in first]
        if sum(n):
            item_at = pa.array(np.repeat(np.arange(len(n)), n), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(sum(n), TaskContext.get().partitionId()), pa.int32()), names.take(item_at), *(pa.array(np.concatenate([getattr(x, c) for x in first]), pa.int64()) for c in ("id", "score"))],
                names=["part", "item", "id", "score"],
            )

    return blocks.mapInArrow(run, f"part int, item {item.simpleString()}, id long, score long")


def ranked(docs: DataFrame, items: DataFrame, k: int = 50, id: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", most: int = TERMS) -> DataFrame:
    """item, rank, id, score: the k texts of docs with the highest scores above 0 for each item, equal scores by
    ascending id.

    Terms are runs of digits, letters and what is beyond ASCII, A-Z as a-z. Null and empty texts have none and are
    found by no item; texts are counted whole at any length. Each row of docs is a text of its own, rows of one id
    too; a null id comes before all others and is given as null. Rows of one item_id are one item with the terms of
    all its rows. Without docs or items there are no rows. Other columns are not read, whatever their names.

    At most about `most` terms of items are held in a task; more items take more passes over the postings. A task
    holds one block at a time of those it reads."""
    blocks = written(postings(docs, id, text), "postings", compression="zstd", **GROUPS)
    sums = blocks.select(F.expr("size(filter(lengths, x -> x > 0))").alias("n"), F.expr("aggregate(lengths, 0L, (s, x) -> s + x)").alias("l")).agg(F.sum("n").alias("n"), F.sum("l").alias("l")).first()
    n, l = sums.n or 0, sums.l or 0
    wanted = items.select(F.col(f"`{item}`").alias("item"), F.explode(F.expr(pattern_words(f"`{item_text}`"))).alias("term")).distinct()
    df = blocks.select(F.explode(F.arrays_zip("terms", "df")).alias("x")).select("x.terms", "x.df")
    df = df.join(wanted.select(F.col("term").alias("terms")).distinct(), "terms").groupBy("terms").agg(F.sum("df").alias("df"))
    weights = df.select(F.col("terms").alias("term"), F.floor(F.lit(1000) * F.log((F.lit(2 * n + 2)) / (2 * F.col("df") + 1))).cast("long").alias("w"))
    queries = written(wanted.join(weights, "term"), "search-terms", conf=WIDE)
    passes = max(1, -(-queries.count() // most))
    kind = items.schema[item].dataType
    of = lambda p: queries.where(F.pmod(F.xxhash64("item"), F.lit(passes)) == p).collect()
    parts = [written(_ranked(blocks, of(p), n, l, k, kind), "search-best", conf=WIDE) for p in range(passes)]
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    # first among the tasks of one bucket, then among all: no task gets an item's rows of all tasks
    for keys in (["item", F.pmod("part", F.lit(64))], ["item"]):
        rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("score"), "id"))).where(F.col("rank") <= k)
    given = F.when(F.col("id") != FIRST, F.col("id")).cast(docs.schema[id].dataType)
    return rows.select(F.col("item").alias(item), "rank", given.alias(id), "score")
