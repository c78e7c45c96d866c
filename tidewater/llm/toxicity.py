"""Toxic spans by a linear-chain conditional random field over words.

Labels are of whole texts, so words are labelled first: those of toxic texts are marked if half their
occurrences there, or a beginning's, are more than clean texts and chance account for. The field learns
weights of all word forms and beginnings that stand in some toxic texts, from all words. How much it is held
back, and what counts as chance, is chosen by folds of the texts that it learns from. Its marginals
(forward-backward) give a probability for each word; their sum and largest one make a text's score, and words
more likely toxic than not give the offending offsets.
"""

from __future__ import annotations

import functools
import pickle
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewater.llm.common import M1, M2, blocks, dropped, mixed, piece_hashes, utf8, written
from tidewater.llm.pretokens import LETTER, classes, code_points, spans

BEGINNINGS = (3, 4, 5, 6, 7, 8)  #: lengths of word beginnings that are features, besides whole words
LEAST = 3  #: toxic texts that a feature stands in
PENALTIES = (0.1, 0.3, 1.0)  #: on half the squares of the field's weights: tried on the texts to learn from
SLACKS = (1.0, 2.0)  #: standard deviations of a count that are not held for a sign: tried likewise
FOLDS = 3
TRIED = (600, 300)  #: clean and toxic texts at most that penalties and slacks are tried on
WINDOW = 256  #: words of a text that the field learns from as one chain
BATCH = 150_000  #: words that the field learns from at once: some 15 MB of arrays
PART = 250_000  #: code points that features are found in at once: some 25 MB of arrays
BLOCK = 500_000  #: bytes scored at once: some 50 MB of arrays


@functools.cache
def folded() -> np.ndarray:
    """The lower-case form of each code point that has one of one code point."""
    out = np.arange(0x110000, dtype=np.uint32)
    for c in range(0x20000):
        low = chr(c).lower()
        if len(low) == 1:
            out[c] = ord(low)
    return out


@dataclass
class Words:
    """The words (runs of letters) of some texts: their text, place in it and length in code points, and
    a row of feature hashes for each."""

    text: np.ndarray
    at: np.ndarray
    length: np.ndarray
    features: np.ndarray
    counts: np.ndarray  #: words of each text


def words_of(texts: list[str]) -> Words:
    cp, offsets = code_points(texts)
    starts, lengths = spans(cp, offsets, keep_space=False)
    letter = classes()[cp[starts]] == LETTER if len(starts) else np.zeros(0, bool)
    starts, lengths = starts[letter], lengths[letter]
    values = (folded()[cp].astype(np.uint64) + np.uint64(1)) * M1
    values ^= values >> np.uint64(29)
    values *= M2
    text = np.searchsorted(offsets, starts, "right") - 1
    rows = [piece_hashes(values, starts, lengths)]
    for k in BEGINNINGS:
        h = piece_hashes(values, starts, np.minimum(lengths, k))
        rows.append(np.where(lengths > k, mixed(h + np.uint64(k)), np.uint64(0)))  # 0: no such feature
    return Words(text, starts - offsets[text], lengths, np.stack(rows, 1), np.bincount(text, minlength=len(texts)))


def in_parts(texts: list[str]) -> Iterator[Words]:
    """words_of() of texts of some PART code points in all at a time."""
    ends = np.concatenate([[0], np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))])
    for lo, hi in blocks(ends, PART):
        yield words_of(texts[lo:hi])


@dataclass
class Field:
    """A chain of two states. keys: known features, ascending; weights: of each in the toxic state;
    moves: log-potentials of the steps 0-1, 1-0, 1-1 (0-0 is 0); score: of a text from its marginals."""

    keys: np.ndarray
    weights: np.ndarray
    bias: float = -6.0
    moves: np.ndarray = field(default_factory=lambda: np.zeros(3))
    score: np.ndarray = field(default_factory=lambda: np.array([-3.0, 0.0, 0.0]))

    def known(self, features: np.ndarray) -> np.ndarray:
        """The numbers from 1 of known features, 0 of others."""
        if not len(self.keys):
            return np.zeros(features.shape, np.int64)
        maybe = np.zeros(1 << 16, bool)
        maybe[self.keys & np.uint64(0xFFFF)] = True
        out = np.zeros(features.size, np.int64)
        at = np.flatnonzero(maybe[features.ravel() & np.uint64(0xFFFF)])
        asked = features.ravel()[at]
        k = np.minimum(np.searchsorted(self.keys, asked), len(self.keys) - 1)
        out[at] = np.where(self.keys[k] == asked, k + 1, 0)
        return out.reshape(features.shape)

    def emissions(self, known: np.ndarray) -> np.ndarray:
        weights, out = np.append(0.0, self.weights), np.full(len(known), float(self.bias))
        for column in known.T:
            out += weights[column]
        return out


def marginals(emissions: np.ndarray, counts: np.ndarray, moves: np.ndarray, pairs: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
    """The probability of state 1 of each word of texts end to end, and with `pairs` the expected numbers
    of the steps 0-1, 1-0, 1-1. All texts take a step at once; what is carried are the odds of state 1.

    Forward odds of a word: those of its predecessor through the steps, times its own. Backward odds: the
    same from the text's end, without its own. Their product are the marginal odds."""
    begin = np.cumsum(counts) - counts
    order = np.argsort(-counts, kind="stable")
    counts, begin = counts[order], begin[order]
    t01, t10, t11 = np.exp(moves)
    odds = np.exp(np.clip(emissions, -40, 40))
    forward, backward = np.empty_like(odds), np.ones_like(odds)
    longest = int(counts[0]) if len(counts) else 0
    alive = np.searchsorted(-counts, -np.arange(1, longest + 1), "right")
    a = np.zeros(0)
    for t in range(longest):
        at = begin[: alive[t]] + t
        if t:
            a = a[: alive[t]]
            a = odds[at] * (t01 + t11 * a) / (1 + t10 * a)
        else:
            a = odds[at]
        np.clip(a, 1e-30, 1e30, out=a)
        forward[at] = a
    b = np.zeros(0)
    for t in range(longest - 2, -1, -1):
        n = alive[t + 1]
        if len(b) < n:
            b = np.append(b, np.ones(n - len(b)))
        at = begin[:n] + t
        c = odds[at + 1] * b
        b = np.clip((t10 + t11 * c) / (1 + t01 * c), 1e-30, 1e30)
        backward[at] = b
    both = forward * backward
    p = both / (1 + both)
    if not pairs:
        return p, None
    inner = np.ones(len(odds), bool)  # words with a successor
    inner[(begin + counts - 1)[counts > 0]] = False
    i = np.flatnonzero(inner)
    c = odds[i + 1] * backward[i + 1]
    w = np.stack([np.ones(len(i)), t01 * c, t10 * forward[i], t11 * forward[i] * c])
    return p, (w / w.sum(0)).sum(1)[1:]


def summaries(p: np.ndarray, text: np.ndarray, texts: int) -> np.ndarray:
    """Of each text: 1, the log-odds of its likeliest word, and the log of the words expected toxic."""
    top = np.full(texts, 1e-9)
    np.maximum.at(top, text, p)
    top = np.clip(top, 1e-9, 1 - 1e-9)
    total = np.bincount(text, p, texts)
    return np.stack([np.ones(texts), np.log(top / (1 - top)), np.log1p(total)], 1)


def frequent(texts: list[str], least: int) -> np.ndarray:
    """Features that stand in at least `least` of the texts, ascending."""
    kinds: list[list[np.ndarray]] = [[] for _ in range(1 + len(BEGINNINGS))]
    for words in in_parts(texts):
        for column, found in zip(words.features.T, kinds, strict=True):
            real = column != 0
            h, text = column[real], words.text[real]
            order = np.lexsort((text, h))
            h, text = h[order], text[order]
            once = np.ones(len(h), bool)
            once[1:] = (h[1:] != h[:-1]) | (text[1:] != text[:-1])
            found.append(h[once])
    out = []
    for found in kinds:  # each kind of feature
        h, n = np.unique(np.concatenate(found), return_counts=True)
        out.append(h[n >= least])
    return np.unique(np.concatenate(out))


def typed(texts: list[str], model: Field) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The known features of each distinct word (the first row: of words without one), the number of its
    row for each word of the texts, and the words of each text."""
    hashes, rows, of, counts = [], [], [], []
    for words in in_parts(texts):
        h, first, back = np.unique(words.features[:, 0], return_index=True, return_inverse=True)
        known = model.known(words.features[first]).astype(np.int32)
        hashes.append(np.where(known.any(1), h, np.uint64(0)))
        rows.append(known)
        of.append((back + sum(map(len, hashes[:-1]))).astype(np.int32))
        counts.append(words.counts)
    none = np.zeros((1, 1 + len(BEGINNINGS)), np.int32)
    _, first, back = np.unique(np.concatenate([np.zeros(1, np.uint64), *hashes]), return_index=True, return_inverse=True)
    back = back.astype(np.int32)
    return np.concatenate([none, *rows])[first], np.concatenate([back[1 + o] for o in of]), np.concatenate(counts)


def batches_of(counts: np.ndarray) -> Iterator[np.ndarray]:
    """Numbers of texts, those of like length together, with some BATCH words in each batch."""
    order = np.argsort(counts, kind="stable")
    batch = np.cumsum(counts[order]) // BATCH
    yield from np.split(order, np.flatnonzero(batch[1:] != batch[:-1]) + 1)


def chains(of: np.ndarray, counts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Batches of chains of words: which chains, their words' rows, the place in the batch of each word's chain,
    and the words of each chain."""
    begins = np.cumsum(counts) - counts
    for those in batches_of(counts):
        n = counts[those]
        text = np.repeat(np.arange(len(those)), n)
        yield those, of[np.repeat(begins[those], n) + np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n)], text, n


def windows_of(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words of each window of WINDOW words at most, and the text that it is of."""
    n = np.maximum(1, -(-counts // WINDOW))
    text = np.repeat(np.arange(len(counts)), n)
    first = np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n)
    return np.minimum(WINDOW, counts[text] - first * WINDOW), text


def excess(rows: np.ndarray, of: np.ndarray, text: np.ndarray, y: np.ndarray, size: int, slack: float) -> np.ndarray:
    """For each row of features 1 if at least half a feature's occurrences in toxic texts are beyond its rate
    in clean ones and chance, or else 0. A word's repeats in one text count as log2(1 + n)."""
    pair, n = np.unique(text.astype(np.int64) * len(rows) + of, return_counts=True)
    n, one = np.log2(1.0 + n), y[pair // len(rows)] == 1
    sums = []
    for those in (~one, one):
        each = np.bincount(pair[those] % len(rows), n[those], len(rows))
        sums.append((np.bincount(rows.ravel(), np.repeat(each, rows.shape[1]), size + 1), each.sum()))
    (clean, all_clean), (there, all_there) = sums
    ratio = all_there / max(1.0, all_clean)
    share = (there - slack * np.sqrt(there) - (clean + 1) * ratio) / np.maximum(there, 1.0)
    share[0] = 0.0
    return (share[rows].max(1) >= 0.5).astype(np.float64)


def fit(texts: list[str], toxic: list[int], penalty: float = PENALTIES[1], slack: float = SLACKS[0], rounds: int = 80) -> Field:
    """The field from texts and their labels. Without texts of both kinds, or features of toxic texts, every
    text gets the share of toxic ones as its score. The field learns from windows of texts, so that a long text
    takes no more steps than a short one; scores are of whole texts."""
    y = np.array(toxic, np.float64)
    share = float(np.clip(y.mean() if len(y) else 0.05, 0.01, 0.99))
    model = Field(np.zeros(0, np.uint64), np.zeros(0), score=np.array([np.log(share / (1 - share)), 0.0, 0.0]))
    if not 0 < y.sum() < len(y):
        return model
    model.keys = frequent([t for t, one in zip(texts, toxic, strict=True) if one], LEAST)
    if not len(model.keys):
        return model
    size = len(model.keys)
    rows, of, word_counts = typed(texts, model)
    marks = excess(rows, of, np.repeat(np.arange(len(texts), dtype=np.int32), word_counts), y, size, slack)
    parts, wanted, steps = [], np.zeros(len(rows)), np.zeros(3)
    window_counts, owner = windows_of(word_counts)
    for those, kinds, text, counts in chains(of, window_counts):
        label = marks[kinds] * y[owner[those]][text]
        wanted += np.bincount(kinds, label, len(rows))
        inner = text[1:] == text[:-1]
        l0, l1 = label[:-1][inner], label[1:][inner]
        steps += [((1 - l0) * l1).sum(), (l0 * (1 - l1)).sum(), (l0 * l1).sum()]
        parts.append((kinds, counts))
    x = np.concatenate([np.ones(size), [-4.0], np.zeros(3)])
    m, v = np.zeros_like(x), np.zeros_like(x)
    for k in range(1, rounds + 1):
        model.weights, model.bias, model.moves = x[:size], float(x[size]), x[size + 1 :]
        e = model.emissions(rows)
        errors, moved = wanted.copy(), steps.copy()
        for kinds, counts in parts:
            p, there = marginals(e[kinds], counts, model.moves, pairs=True)
            errors -= np.bincount(kinds, p, len(rows))
            moved -= there
        g = np.bincount(rows.ravel(), np.repeat(errors, rows.shape[1]), size + 1)[1:]
        g = np.concatenate([g, [errors.sum()], moved]) - penalty * x
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        x = x + 0.3 * (1 - k / (rounds + 1)) * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-8)
    model.weights, model.bias, model.moves = x[:size], float(x[size]), x[size + 1 :]
    e, z = model.emissions(rows), np.zeros((len(texts), 3))
    for those, kinds, text, counts in chains(of, word_counts):
        p, _ = marginals(e[kinds], counts, model.moves)
        z[those] = summaries(p, text, len(those))
    model.score = _logistic(z, y)
    return model


def _logistic(z: np.ndarray, y: np.ndarray, penalty: float = 0.05, rounds: int = 30) -> np.ndarray:
    """Weights by Newton steps; the constant is not held back."""
    w = np.zeros(z.shape[1])
    held = np.diag([1e-6, *[penalty] * (z.shape[1] - 1)])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + held, z.T @ (y - p) - held @ w)
        w = w + step * min(1.0, 4.0 / max(1e-9, np.abs(step).max()))
    return w


def scored(texts: list[str], model: Field) -> tuple[np.ndarray, list[list[dict]]]:
    """The score of each text and its offending offsets: begin and end, in code points, of the words more
    likely toxic than not; neighbours put together."""
    words = words_of(texts)
    p, _ = marginals(model.emissions(model.known(words.features)), words.counts, model.moves)
    z = summaries(p, words.text, len(texts))
    score = 1 / (1 + np.exp(-np.clip(z @ model.score, -30, 30)))
    out: list[list[dict]] = [[] for _ in texts]
    last = -2
    for i in np.flatnonzero(p >= 0.5).tolist():
        own = out[words.text[i]]
        end = int(words.at[i] + words.length[i])
        if own and last == i - 1:
            own[-1]["end"] = end
        else:
            own.append({"begin": int(words.at[i]), "end": end})
        last = i
    return score, out


def loss(texts: list[str], toxic: list[int], fold: int, penalty: float, slack: float) -> float:
    """The mean log-loss of one fold's texts under a field fitted to the others. Folds take every FOLDS-th text of
    each kind."""
    y = np.array(toxic)
    place = np.empty(len(y), np.int64)
    for v in (0, 1):
        place[y == v] = np.arange((y == v).sum())
    there = place % FOLDS == fold
    model = fit([t for t, out in zip(texts, there) if not out], y[~there].tolist(), penalty, slack, rounds=40)
    total = 0.0
    for t, v in ((t, v) for t, v, out in zip(texts, toxic, there) if out):
        p = min(1 - 1e-6, max(1e-6, float(scored([t], model)[0][0])))
        total -= np.log(p if v else 1 - p)
    return total / max(1, int(there.sum()))


def held_out(id: Column) -> Column:
    """Rows that nothing is learned from; a null id is not one of them."""
    return F.coalesce(F.crc32(id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame, text: str, id: str, label: str, most: tuple[int, int], longest: int) -> DataFrame:
    """id, text, label of at most `most` labelled texts that are clean and toxic, by a hash of their ids,
    none of them held out and none longer than `longest` bytes."""
    known = labels.where(F.col(id).isNotNull() & F.col(label).isNotNull() & ~held_out(F.col(id)))
    known = known.groupBy(id).agg(F.max(label).alias("_label"))
    rows = docs.where(F.octet_length(F.coalesce(F.col(text), F.lit(""))) <= longest).select(F.col(id).alias("_id"))
    lists = []
    for value in (0, 1):
        of = known.where(F.col("_label") == value).join(rows, F.col(id) == F.col("_id"), "left_semi")
        lists.append(of.orderBy(F.xxhash64(id), id).limit(most[value]))
    chosen = F.broadcast(lists[0].unionByName(lists[1]).select(F.col(id).alias("_id"), "_label"))  # sum(most) rows at most
    own = docs.select(F.col(id).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return own.join(chosen, F.col("id") == F.col("_id")).select("id", "text", F.col("_label").alias("label"))


def tried(rows: DataFrame) -> tuple[float, float]:
    """The penalty and slack of the least loss over FOLDS folds of the texts to learn from, of at most TRIED of
    them: each fold and choice is a task. Of equal losses the larger ones; the middle penalty
    and the least slack where a fold would have no toxic text."""
    number = F.row_number().over(Window.partitionBy("label").orderBy(F.xxhash64("text"), "id"))  # of a bounded sample
    few = rows.withColumn("_n", number).where(F.col("_n") <= F.when(F.col("label") == 1, TRIED[1]).otherwise(TRIED[0])).select("text", "label", "_n")
    grid = [(f, p, s) for p in PENALTIES for s in SLACKS for f in range(FOLDS)]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: dict[int, list] = {}
        for b in batches:
            for k, *row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                own.setdefault(k, []).append(row)
        for k, found in own.items():
            found.sort(key=lambda r: (r[1], r[2], r[0]))
            toxic = [r[1] for r in found]
            x = loss([r[0] for r in found], toxic, *grid[k]) if min(sum(toxic), len(toxic) - sum(toxic)) >= FOLDS else float("nan")
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([x])], names=["k", "loss"])

    each = few.select(F.explode(F.sequence(F.lit(0), F.lit(len(grid) - 1))).alias("k"), "text", "label", "_n").repartition(len(grid), "k").mapInArrow(run, "k int, loss double").collect()
    sums: dict[tuple[float, float], float] = {}
    for r in each:
        sums[grid[r.k][1:]] = sums.get(grid[r.k][1:], 0.0) + r.loss
    if not sums or any(np.isnan(x) for x in sums.values()):
        return PENALTIES[1], SLACKS[0]
    return min(sums, key=lambda c: (round(sums[c], 9), -c[0], -c[1]))


def trained(docs: DataFrame, labels: DataFrame, text: str = "text", id: str = "doc_id", label: str = "toxic", most: tuple[int, int] = (3000, 1000), longest: int = 20_000) -> Field:
    """The field fitted to a sample of at most `most` clean and toxic labelled texts of `longest` bytes at
    most, in one task: 80 MB of texts and some 200 MB of arrays there in any case; its penalty and slack are
    tried on folds of the same sample. The driver gets the field alone, about 1 MB. Texts to be scored are
    scored whole, whatever their length."""
    rows = written(sample(docs, labels, text, id, label, most, longest).select("id", "text", F.col("label").cast("int").alias("label")), "toxicity-sample")
    penalty, slack = tried(rows)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted({row for b in batches for row in zip(*(c.to_pylist() for c in b.columns), strict=True)})
        model = fit([r[1] for r in rows], [r[2] for r in rows], penalty, slack)
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], names=["field"])

    found = rows.repartition(1).mapInArrow(run, "field binary").collect()
    dropped(rows)
    return pickle.loads(found[0]["field"]) if found else fit([], [])


def toxicity(docs: DataFrame, model: Field, text: str = "text", id: str = "doc_id", threshold: float = 0.7) -> DataFrame:
    """id, held_out, score, predicted, spans of each row; spans: begin and end of offending words.

    Null text counts as empty; a text without words has the score of no evidence. Null and repeated ids
    give a row each. Nothing but the text goes into a score; other columns are not read."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    span = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(1)
            _, offsets = utf8(column)
            for lo, hi in blocks(offsets, BLOCK):
                score, found = scored([t or "" for t in column.slice(lo, hi - lo).to_pylist()], shared.value)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(score), pa.array(found, span)], names=["id", "score", "spans"])

    kind = docs.schema[id].dataType.simpleString()
    rows = docs.select(F.col(id).alias("id"), F.col(text).alias("text")).mapInArrow(run, f"id {kind}, score double, spans array<struct<begin:long,end:long>>")
    return rows.select(F.col("id").alias(id), held_out(F.col("id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "spans")


def clean(docs: DataFrame, model: Field, text: str = "text", threshold: float = 0.7) -> DataFrame:
    """docs without the rows whose score is `threshold` or more; all columns are kept as they are. Null
    text counts as empty."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    place = docs.columns.index(text)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(place)
            _, offsets = utf8(column)
            for lo, hi in blocks(offsets, BLOCK):
                score, _ = scored([t or "" for t in column.slice(lo, hi - lo).to_pylist()], shared.value)
                yield batch.slice(lo, hi - lo).filter(pa.array(score < threshold))

    return docs.mapInArrow(run, docs.schema)
