"""Words of texts and their shingles as 64-bit hashes, over arrays of bytes."""

from __future__ import annotations

import functools

import numpy as np

from tidewater.llm.common import M1, mixed, piece_hashes

SEPARATORS = (32, *range(9, 14))


@functools.cache
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Whether a byte separates words, and the value of each byte, A-Z as a-z."""
    space = np.zeros(256, bool)
    space[list(SEPARATORS)] = True
    lower = np.arange(256, dtype=np.uint64)
    lower[65:91] += np.uint64(32)
    return space, mixed((lower + np.uint64(1)) * M1)


def words(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each word and the text that it is in."""
    if not len(raw):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    space, values = _tables()
    inside = ~space[raw]
    start, end = inside.copy(), np.ones(len(raw), bool)
    first = np.zeros(len(raw) + 1, bool)
    first[offsets] = True
    start[1:] &= ~inside[:-1] | first[1:-1]
    end[:-1] = ~inside[1:] | first[1:-1]
    starts = np.flatnonzero(start)
    lengths = np.flatnonzero(end & inside) + 1 - starts
    return piece_hashes(values[raw], starts, lengths), np.searchsorted(offsets, starts, "right") - 1


def shingle_sets(raw: np.ndarray, offsets: np.ndarray, width: int = 5) -> list[np.ndarray]:
    """The distinct shingles of `width` words of each text, in ascending order; of a text with fewer
    words their whole sequence, of one without words nothing."""
    h, text = words(raw, offsets)
    counts = np.bincount(text, minlength=len(offsets) - 1)
    edges = np.concatenate([[0], np.cumsum(counts)]).tolist()
    factors = mixed(np.arange(1, width + 1, dtype=np.uint64) * M1) | np.uint64(1)
    n = max(0, len(h) - width + 1)
    sums = np.zeros(n, np.uint64)
    for k in range(width):
        sums += h[k : k + n] * factors[k]
    sums = mixed(sums)
    out = []
    for a, b in zip(edges, edges[1:], strict=False):
        if b - a >= width:
            own = np.sort(sums[a : b - width + 1])
            out.append(own[np.append(True, own[1:] != own[:-1])])
        elif b > a:
            out.append(mixed(np.array([int((h[a:b] * factors[: b - a]).sum()) ^ (b - a) << 56], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def set_marks(found: np.ndarray) -> tuple[int, int]:
    """Two signed 64-bit hashes of a set."""
    if not len(found):
        return 0, 0
    a = mixed(found).sum() + np.uint64(len(found))
    b = mixed(found ^ M1).sum()
    x, y = mixed(np.array([a, b], np.uint64)).view(np.int64).tolist()
    return x, y
