"""Words of many texts at once: where they stand, and the number of each among the distinct ones."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from tidewater.llm.common import M1, mixed, piece_hashes


def _bytes(*parts: int | range) -> np.ndarray:
    out = np.zeros(256, bool)
    for p in parts:
        out[list(p) if isinstance(p, range) else p] = True
    return out


#: Digits, letters and what is beyond ASCII.
ALNUM = _bytes(range(48, 58), range(65, 91), range(97, 123), range(128, 256))
#: What ends a piece of text, and what stands in no word besides.
BREAK = _bytes(*map(ord, ".,;:!?"), range(10, 14))
INSIDE = ~(BREAK | _bytes(32, 9))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
VALUES = mixed((LOWER.astype(np.uint64) + np.uint64(1)) * M1)


def word_spans(raw: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and length of each maximal run of `inside` bytes, and the number of words of each text. raw is
    the texts' bytes end to end; no word reaches into the next text."""
    texts = len(offsets) - 1
    if not len(raw):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(texts, np.int64)
    word = inside[raw]
    first = np.zeros(len(raw) + 1, bool)
    first[offsets] = True
    start, end = word.copy(), word.copy()
    start[1:] &= ~word[:-1] | first[1:-1]
    end[:-1] &= ~word[1:] | first[1:-1]
    starts = np.flatnonzero(start)
    return starts, np.flatnonzero(end) + 1 - starts, np.diff(np.searchsorted(starts, offsets))


def distinct_words(raw: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """The number of each word (A-Z as a-z) among the distinct words, and these. Words are grouped by 64-bit
    hashes and then compared byte by byte: where two words have one hash, they are told apart by their text."""
    import pandas as pd

    if not len(starts):
        return np.zeros(0, np.int64), pa.array([], pa.string())
    low = LOWER[raw]
    codes, kinds = pd.factorize(piece_hashes(VALUES[raw], starts, lengths))
    first = np.empty(len(kinds), np.int64)
    first[codes[::-1]] = np.arange(len(codes) - 1, -1, -1)
    same = np.array_equal(lengths, lengths[first][codes])
    if same:
        before = np.cumsum(lengths) - lengths
        own = low[np.repeat(starts - before, lengths) + np.arange(int(before[-1] + lengths[-1]))]
        same = np.array_equal(own, low[np.repeat(starts[first][codes] - before, lengths) + np.arange(len(own))])
    if not same:
        data = low.tobytes()
        codes, texts = pd.factorize(np.array([data[a : a + n].decode() for a, n in zip(starts.tolist(), lengths.tolist(), strict=True)], object))
        return codes, pa.array(texts.tolist(), pa.string())
    n = lengths[first]
    ends = np.cumsum(n)
    data = low[np.repeat(starts[first] - (ends - n), n) + np.arange(int(ends[-1]))]
    return codes, pa.StringArray.from_buffers(len(n), pa.py_buffer(np.append(0, ends).astype(np.int32)), pa.py_buffer(data))


def pattern_words(column: str) -> str:
    """SQL: the words of ALNUM bytes of a text column, A-Z as a-z."""
    low = f"translate({column}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return rf"regexp_extract_all({low}, r'([^\x00-\x2F\x3A-\x60\x7B-\x7F]+)', 1)"
