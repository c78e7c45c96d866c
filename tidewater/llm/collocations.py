"""Phrase collocations from suffix automata, one for each shard and language.

A shard's automaton is that of all its pieces of text, over words, as far as substrings of at most three words
need it. Its states are classes of substrings that end at the same places; a state's count is how many places
these are, and its suffix link leads to the longest of its suffixes that ends at more. The links are a tree,
that of the pieces read backwards, so the states come from one sort of all places by the words that end
there. Each state is told once, for its longest substring and, if its class has it, the suffix of two words;
counts are added over all shards where the suffix link leads, so that what a phrase of three words covers of
its suffix shows there, and that of its prefix by a join.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewater.llm.common import blocks, utf8, written
from tidewater.llm.tokens import BREAK, INSIDE, distinct_words, word_spans

SHARD = 10_000_000  #: bytes of text of one language in a shard
PART = 3_000_000  #: bytes that are worked on at once
HOT = 1_000  #: a word of more than one in so many of a table's words has an identifier below 0
SALTS = 64  #: parts of a pair of two such words, and of a language's phrases
#: Exact: squares of numbers of 16 digits times a million have 38 digits.
SCORE = "cast(a as decimal(16,0)) * cast(a as decimal(16,0)) * 1000000BD div (cast({} as decimal(19,0)) * cast({} as decimal(19,0)))"


def _narrow(x: np.ndarray) -> bytes:
    return x.astype("<u4").tobytes()


def shards(docs: DataFrame, lang: str = "lang", text: str = "text") -> DataFrame:
    """shard, lang, n, words, counts, sequence: the texts of a language in a batch, as numbers from 1 on of the
    distinct words, and 0 between pieces; how often each word occurs, and all words."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = TaskContext.get().partitionId() << 33
        for batch in batches:
            langs = batch.column(0).dictionary_encode()
            code = langs.indices.to_numpy()
            for which, name in enumerate(langs.dictionary.to_pylist()):
                column = batch.column(1).filter(pa.array(code == which))
                raw, offsets = utf8(column)
                for lo, hi in blocks(offsets, SHARD):
                    known: dict[str, int] = {}
                    sequences, counts = [], np.zeros(0, np.int64)
                    for a, b in blocks(offsets[lo : hi + 1], PART):
                        own = raw[offsets[lo + a] : offsets[lo + b]]
                        starts, lengths, n = word_spans(own, offsets[lo + a : lo + b + 1] - offsets[lo + a], INSIDE)
                        codes, words = distinct_words(own, starts, lengths)
                        number = np.array([known.setdefault(w, len(known) + 1) for w in words.to_pylist()], np.int64)
                        if not len(codes):
                            continue
                        breaks = np.cumsum(BREAK[own])[starts]
                        fresh = np.append(False, breaks[1:] != breaks[:-1])
                        fresh[np.minimum(np.cumsum(n)[:-1], len(fresh) - 1)[np.cumsum(n)[:-1] < len(fresh)]] = True
                        fresh[0] = True
                        sequence = np.zeros(len(codes) + int(fresh.sum()), np.int64)
                        sequence[np.arange(len(codes)) + np.cumsum(fresh)] = number[codes]
                        sequences.append(sequence)
                        counts = np.append(counts, np.zeros(len(known) + 1 - len(counts), np.int64))
                        counts += np.bincount(sequence, minlength=len(counts))
                    all_ = np.concatenate([*sequences, np.zeros(1, np.int64)])
                    counts = counts[1:]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([shard], pa.int64()),
                            pa.array([name], pa.string()),
                            pa.array([int(counts.sum())], pa.int64()),
                            pa.array([[*known]], pa.list_(pa.string())),
                            pa.array([counts], pa.list_(pa.int64())),
                            pa.array([_narrow(all_)], pa.binary()),
                        ],
                        names=["shard", "lang", "n", "words", "counts", "sequence"],
                    )
                    shard += 1

    own = docs.select(F.coalesce(F.col(f"`{lang}`"), F.lit("und")), F.col(f"`{text}`"))
    return own.mapInArrow(run, "shard long, lang string, n long, words array<string>, counts array<long>, sequence binary")


class Automaton(NamedTuple):
    """States of the automaton of a sequence whose parts are closed by 0, without its initial state: the state
    that a state's suffix link leads to (-1: the initial one), the length of its longest substring, at how many
    places its substrings end, and one of these places. A state's substrings are the suffixes of its longest
    that are longer than the longest of its link."""

    link: np.ndarray
    length: np.ndarray
    count: np.ndarray
    place: np.ndarray

    @staticmethod
    def of(sequence: np.ndarray, depth: int = 3) -> Automaton:
        """Of substrings of at most `depth` symbols."""
        kind = np.int32 if len(sequence) < 1 << 31 else np.int64
        ends = np.flatnonzero(sequence).astype(kind)
        symbols, alive = [], np.ones(len(ends), bool)
        for k in range(depth):  # the last symbol first; 0 where the part began later
            symbol = np.where(alive & (ends >= k), sequence[np.maximum(ends - k, 0)], sequence.dtype.type(0))
            alive &= symbol > 0
            symbols.append(symbol)
        bits = max(1, int(sequence.max(initial=0)).bit_length())
        if depth * bits < 64:
            key = symbols[0].astype(np.int64)
            for x in symbols[1:]:
                key = key << bits | x
            order = np.argsort(key).astype(kind)
            del key
        else:
            order = np.lexsort(symbols[::-1]).astype(kind)
        ends = ends[order]
        groups, new = [], np.zeros(len(ends), bool)  # of each depth: the first place in order, and how many places
        new[:1] = True
        for x in symbols:
            x = x[order]
            new[1:] |= x[1:] != x[:-1]
            every = np.flatnonzero(new).astype(kind)
            real = x[every] > 0
            groups.append((every[real], np.diff(np.append(every, kind(len(ends))))[real]))
        del symbols, alive
        made, parent, columns = 0, np.full(len(ends), -1, kind), []
        for d, (first, size) in enumerate(groups):
            if d + 1 < depth:  # a group that one below it equals is no state: the one below is longer
                below = np.zeros(len(ends), kind)
                below[groups[d + 1][0]] = groups[d + 1][1]
                own = below[first] != size
                first, size = first[own], size[own]
            columns.append((parent[first], np.full(len(first), d + 1, np.int8), size, ends[first]))
            rows = np.repeat((first - (np.cumsum(size) - size)).astype(kind), size) + np.arange(int(size.sum()), dtype=kind)
            parent[rows] = np.repeat((made + np.arange(len(first))).astype(kind), size)
            made += len(first)
        return Automaton(*map(np.concatenate, zip(*columns, strict=True)))

    def shortest(self) -> np.ndarray:
        """The length of each state's shortest substring."""
        return np.where(self.link >= 0, self.length[self.link], np.int8(0)) + np.int8(1)


def phrases(known: DataFrame) -> DataFrame:
    """a, b, c, n, pair of each state of two words (a and n are 0) or three, by shard: identifiers of its longest
    substring's words, its count, and the count again where it is its last two words' state too. Rows of known:
    a shard's sequence, and the identifier of each of its words (`each`; 0 for words that no phrase told has,
    which part the pieces as their ends do)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                sequence = np.frombuffer(batch.column(0)[k].as_buffer(), np.uint32)
                ids = np.append(0, batch.column(1).slice(k, 1).flatten().to_numpy(zero_copy_only=False).astype(np.int64))
                dense = np.cumsum(ids != 0, dtype=np.int32) * (ids != 0)
                states = Automaton.of(dense[sequence])
                more = np.flatnonzero(states.length >= 2)
                pair = states.shortest() <= 2
                for lo in range(0, len(more), 500_000):
                    at = more[lo : lo + 500_000]
                    place, n = states.place[at], states.count[at]
                    third = np.where(states.length[at] == 3, ids[sequence[np.maximum(place - 2, 0)]], 0)
                    columns = (third, ids[sequence[place - 1]], ids[sequence[place]], np.where(third != 0, n, 0), np.where(pair[at], n, 0))
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns], names=["a", "b", "c", "n", "pair"])

    return known.mapInArrow(run, "a long, b long, c long, n long, pair long")


def collocations(docs: DataFrame, least: int = 10, first: int = 2000, cover: int = 50, lang: str = "lang", text: str = "text") -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: of each language the `first` phrases of two or three words by score,
    then a, then phrase (bytes). a is how often the phrase occurs, l and r how often the parts of its lowest-scoring
    cut, n how many words its language has. Phrases occur `least` times at least; one that a longer phrase, told
    itself or not, contains in at least `cover` percent of its places is left out.

    Null and empty texts have no words; a null language is `und`. Texts are read whole at any length; each row
    counts, repeated ones too. Without phrases there are no rows. Other columns are not read, whatever their names."""
    cut = written(shards(docs, lang, text), "phrase-shards", compression="zstd")
    totals = cut.groupBy("lang").agg(F.sum("n").alias("n"))
    words = cut.select("shard", "lang", F.posexplode(F.arrays_zip("words", "counts")).alias("at", "x")).select("shard", "lang", "at", F.col("x.words").alias("word"), F.col("x.counts").alias("k"))
    total = cut.agg(F.sum("n")).first()[0] or 0
    often = words.groupBy("lang", "word").agg(F.sum("k").alias("f")).where(F.col("f") >= least)
    # identifiers are the table's from here on: it is written once
    often = often.withColumn("id", F.monotonically_increasing_id() + 1).withColumn("id", F.when(F.col("f") * HOT > total, -F.col("id")).otherwise(F.col("id")))
    often = written(often, "phrase-words", compression="zstd")
    each = words.select("shard", "lang", "at", "word").join(often.select("lang", "word", "id"), ["lang", "word"], "left")
    each = each.groupBy("shard").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", F.coalesce("id", F.lit(0)).alias("id")))), lambda x: x["id"]).alias("each"))
    each = written(each, "phrase-numbers", compression="zstd")
    told = phrases(cut.join(each, "shard").select("sequence", "each"))
    # a phrase of three goes where its suffix of two does; pairs of two very frequent words in parts by the third.
    # Both uses of the sums read the same columns and filter by sums alone, so that there is one shuffle.
    salt = F.when((F.col("b") < 0) & (F.col("c") < 0), 1 + F.pmod(F.xxhash64("a"), F.lit(SALTS))).otherwise(0)
    told = told.withColumn("salt", salt).repartition("b", "c", "salt").groupBy("b", "c", "salt", "a").agg(F.sum("n").alias("n"), F.sum("pair").alias("pair"))
    three = F.col("n") >= least
    pairs = told.groupBy("b", "c", "salt").agg(F.sum("pair").alias("n"), F.max(F.when(three, F.col("n"))).alias("most")).where((F.col("salt") != 0) | (F.col("n") >= least))
    rows = written(told.where(three).select("a", "b", "c", "n", F.col("pair").alias("most")).unionByName(pairs.select(F.lit(0).cast("long").alias("a"), "b", "c", "n", "most")), "phrase-counts", compression="zstd")
    triples = rows.where("a != 0").drop("most")
    pairs = rows.where("a = 0").groupBy("b", "c").agg(F.sum("n").alias("n"), F.max("most").alias("most")).where(F.col("n") >= least)
    prefixes = triples.groupBy(F.col("a").alias("b"), F.col("b").alias("c")).agg(F.max("n").alias("more"))
    pairs = written(pairs.join(prefixes, ["b", "c"], "left"), "phrase-pairs", compression="zstd")
    name = lambda c: often.select(F.col("id").alias(c), F.col("lang").alias(f"lang_{c}"), F.col("word").alias(f"word_{c}"), F.col("f").alias(f"f_{c}"))
    kept = pairs.where((F.coalesce(F.greatest("most", "more"), F.lit(0)) * 100) < F.col("n") * cover)
    two = kept.join(name("b"), "b").join(name("c"), "c").select(
        F.col("lang_b").alias("lang"), F.concat_ws(" ", "word_b", "word_c").alias("phrase"), F.col("n").alias("a"), F.col("f_b").alias("l"), F.col("f_c").alias("r"), F.lit(None).cast("long").alias("l2"), F.lit(None).cast("long").alias("r2")
    )
    of = lambda x, y, z: pairs.select(F.col("b").alias(x), F.col("c").alias(y), F.col("n").alias(z))
    triple = triples.join(of("a", "b", "ab"), ["a", "b"]).join(of("b", "c", "bc"), ["b", "c"]).join(name("a"), "a").join(name("b").drop("lang_b"), "b").join(name("c").drop("lang_c"), "c")
    triple = triple.select(
        F.col("lang_a").alias("lang"), F.concat_ws(" ", "word_a", "word_b", "word_c").alias("phrase"), F.col("n").alias("a"), F.col("f_a").alias("l"), F.col("bc").alias("r"), F.col("ab").alias("l2"), F.col("f_c").alias("r2")
    )
    both = two.unionByName(triple).withColumns({"s1": F.expr(SCORE.format("l", "r")), "s2": F.expr(SCORE.format("l2", "r2"))})
    other = F.col("s2") < F.col("s1")
    both = both.select(
        "lang", "phrase", "a", F.when(other, F.col("l2")).otherwise(F.col("l")).alias("l"), F.when(other, F.col("r2")).otherwise(F.col("r")).alias("r"), F.when(other, F.col("s2")).otherwise(F.col("s1")).alias("score")
    )
    # first within parts of a language, then in all of it: no task gets all phrases of one
    for keys in (["lang", F.pmod(F.xxhash64("phrase"), F.lit(SALTS))], ["lang"]):
        order = Window.partitionBy(*keys).orderBy(F.desc("score"), F.desc("a"), "phrase")
        both = both.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= first)
    return both.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
