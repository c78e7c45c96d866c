"""Token counts of whole texts without materialised ids.

Texts are kept as frequencies of pre-tokens, block by block: of each text which of the block's distinct
pre-tokens it has and how often. The distinct pre-tokens of all blocks are one table; each is cut into pieces
once and their number is joined back to the blocks that have it, where frequencies times numbers are summed.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.llm.common import blocks, dropped, utf8, written
from tidewater.llm.pretokens import PieceVocabulary

# Fixed value: the pre-token pattern of word_bpe_49k.json.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
BLOCK = 8_000_000  #: bytes of text whose pre-tokens are kept together
PART = 1_000_000  #: bytes of them that are worked on at once: some 100 MB of arrays

_LOADED: dict[str, PieceVocabulary] = {}


def vocabulary(path: str) -> PieceVocabulary:
    """One vocabulary for each worker process."""
    if path not in _LOADED:
        _LOADED[path] = PieceVocabulary(path, keep_space=False, pattern=WORD_PATTERN)
    return _LOADED[path]


def _narrow(x: np.ndarray) -> bytes:
    """Numbers from 0 on in as many bytes each as the largest one takes."""
    return x.astype("<u1" if not len(x) or x.max() < 1 << 8 else "<u2" if x.max() < 1 << 16 else "<u4").tobytes()


def _wide(data: memoryview, n: int) -> np.ndarray:
    return np.frombuffer(data, f"<u{len(data) // n}").astype(np.int64) if n else np.zeros(0, np.int64)


def frequencies(docs: DataFrame, path: str) -> DataFrame:
    """A row for each block of texts: block, its number; ids, n_bytes, specials (special strings) and kinds (how
    many distinct pre-tokens) of its texts; of each such pre-token its number among the block's `pieces`, as the
    step from the text's one before, and how often the text has it."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, block = vocabulary(path), TaskContext.get().partitionId() << 33
        for batch in batches:
            column = batch.column(1)
            _, offsets = utf8(column)
            for lo, hi in blocks(offsets, BLOCK):
                known: dict[str, int] = {}
                specials, kinds, steps, times = [], [], [], []
                for a, b in blocks(offsets[lo : hi + 1], PART):
                    texts = [t or "" for t in column.slice(lo + a, b - a).to_pylist()]
                    segments, owner, found = v.segments(texts)
                    cp, starts, lengths, joined, ends = v.pieces(segments)
                    codes, pieces = v.kinds(cp, starts, lengths, joined)
                    own = np.array([known.setdefault(p, len(known)) for p in pieces], np.int64)
                    text = owner[np.searchsorted(ends, starts, "right") - 1] if len(starts) else np.zeros(0, np.int64)
                    pair, n = np.unique(text << 32 | own[codes] if len(starts) else text, return_counts=True)
                    number, fresh = pair & 0xFFFFFFFF, np.ones(len(pair), bool)
                    fresh[1:] = pair[1:] >> 32 != pair[:-1] >> 32
                    steps.append(np.where(fresh, number, np.diff(number, prepend=0)))
                    times.append(n)
                    kinds.append(np.bincount(pair >> 32, minlength=len(texts)))
                    specials.append(np.bincount([i for i, _, _ in found], minlength=len(texts)))
                one = [
                    pa.array([block], pa.int64()),
                    pa.ListArray.from_arrays(pa.array([0, hi - lo], pa.int32()), batch.column(0).slice(lo, hi - lo)),
                    *(pa.array([x], pa.list_(pa.int64())) for x in (np.diff(offsets[lo : hi + 1]), np.concatenate(specials), np.concatenate(kinds))),
                    *(pa.array([_narrow(np.concatenate(x))], pa.binary()) for x in (steps, times)),
                    pa.array([[*known]], pa.list_(pa.string())),
                ]
                yield pa.RecordBatch.from_arrays(one, names=["block", "ids", "n_bytes", "specials", "kinds", "steps", "times", "pieces"])
                block += 1

    kind = docs.schema["id"].dataType.simpleString()
    return docs.mapInArrow(run, f"block long, ids array<{kind}>, n_bytes array<long>, specials array<long>, kinds array<long>, steps binary, times binary, pieces array<string>")


def counted(pieces: DataFrame, path: str) -> DataFrame:
    """piece, n: of distinct pre-tokens, how many pieces of the vocabulary each is."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(v.ids(p)) for p in batch.column(0).to_pylist()], pa.int32())], names=["piece", "n"])

    return pieces.mapInArrow(run, "piece string, n int")


def token_counts(docs: DataFrame, path: str, text: str = "text", id: str = "doc_id", limit: int = 2048) -> DataFrame:
    """id, n_bytes, n_tokens, over_limit of each row, by the vocabulary at `path`.

    Null text counts as empty: 0 bytes and 0 tokens. Repeated rows and null ids give a row each, an empty
    table gives none; a text of any length is counted whole, in a block of its own if it is longer than one.
    Other columns are not read, whatever their names. Special strings inside a text are one token each.

    A pre-token that all texts have is joined once for each block, not for each text."""
    kept = written(frequencies(docs.select(F.col(id).alias("id"), F.col(text).alias("text")), path), "token-blocks", compression="zstd")
    pieces = kept.select("block", F.posexplode("pieces").alias("at", "piece"))
    counts = written(counted(pieces.select("piece").distinct(), path), "token-pieces", compression="zstd")
    numbers = pieces.join(counts, "piece")
    # as many numbers as a block has distinct pre-tokens; place and number are shuffled as one
    packed = F.shiftleft(F.col("at").cast("long"), 32) + F.col("n")
    numbers = numbers.groupBy("block").agg(F.transform(F.array_sort(F.collect_list(packed)), lambda x: x.bitwiseAND(F.lit(0xFFFFFFFF).cast("long")).cast("int")).alias("each"))
    numbers = written(numbers, "token-numbers", compression="zstd")
    dropped(counts)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                ids, n_bytes, specials, kinds = (batch.column(c).slice(k, 1).flatten() for c in range(4))
                kinds = kinds.to_numpy()
                text = np.repeat(np.arange(len(ids)), kinds)
                steps, times = (_wide(batch.column(c)[k].as_buffer(), len(text)) for c in (4, 5))
                each = batch.column(6).slice(k, 1).flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                sums = np.concatenate([[0], np.cumsum(steps)])
                number = sums[1:] - sums[np.cumsum(kinds) - kinds][text]
                n = np.bincount(text, each[number] * times, len(ids)).astype(np.int64) if len(text) else np.zeros(len(ids), np.int64)
                yield pa.RecordBatch.from_arrays([ids, n_bytes, pa.array(n + specials.to_numpy())], names=["id", "n_bytes", "n_tokens"])

    kind = docs.schema[id].dataType.simpleString()
    joined = kept.join(numbers, "block", "left").select("ids", "n_bytes", "specials", "kinds", "steps", "times", "each")
    rows = joined.mapInArrow(run, f"id {kind}, n_bytes long, n_tokens long")
    return rows.select(F.col("id").alias(id), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
