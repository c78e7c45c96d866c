"""Pre-tokens of byte-pair tokenizers found over arrays of code points, and their pieces counted or
encoded once for each distinct pre-token of a batch."""

from __future__ import annotations

import functools
import os
import re
import sys
import unicodedata

import numpy as np

from tidewater.llm.common import M1, M2, piece_hashes

OTHER, LETTER, NUMBER, SPACE = 0, 1, 2, 3
# The code points that \s stands for.
WHITE = [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
# The contractions that the patterns of both vocabularies split off.
CONTRACTION = re.compile(r"'(?:s|t|re|ve|m|ll|d)")


@functools.cache
def classes() -> np.ndarray:
    out = np.zeros(sys.maxunicode + 1, np.uint8)
    for c in range(sys.maxunicode + 1):
        kind = unicodedata.category(chr(c))[0]
        if kind == "L":
            out[c] = LETTER
        elif kind == "N":
            out[c] = NUMBER
    out[WHITE] = SPACE
    return out


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    return np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32), np.concatenate([[0], np.cumsum(lengths)])


def spans(cp: np.ndarray, offsets: np.ndarray, keep_space: bool) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the pre-tokens of texts without contractions.

    keep_space: a blank joins the run of one class that follows it, other white space stands alone;
    otherwise white space is dropped and each number character stands alone."""
    n = len(cp)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    kind = classes()[cp]
    full = offsets[:-1] < offsets[1:]
    first = np.zeros(n, bool)
    first[offsets[:-1][full]] = True
    space = kind == SPACE
    new = first.copy()
    new[1:] |= kind[1:] != kind[:-1]
    if keep_space:
        before_word = np.zeros(n, bool)
        before_word[:-1] = ~space[1:] & ~first[1:]
        start = space & (new | before_word)
        glued = np.zeros(n, bool)
        glued[1:] = (cp[:-1] == 32) & ~first[1:]
        start |= ~space & new & ~glued
        at = np.flatnonzero(start)
        return at, np.diff(np.append(at, n))
    at = np.flatnonzero(new | (kind == NUMBER))
    length = np.diff(np.append(at, n))
    word = ~space[at]
    return at[word], length[word]


def hashes(cp: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    values = (cp.astype(np.uint64) + np.uint64(1)) * M1
    values ^= values >> np.uint64(29)
    values *= M2
    return piece_hashes(values, starts, lengths)


@functools.cache
def byte_letters() -> dict[int, str]:
    """The printable stand-in of each byte in byte-level vocabularies, as a table for str.translate:
    printable Latin-1 characters stand for themselves, the other bytes follow from 256 on in order."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {**{b: chr(b) for b in own}, **{b: chr(256 + i) for i, b in enumerate(rest)}}


class PieceVocabulary:
    """A tokenizer of the `tokenizers` library with the result for each distinct pre-token kept.

    At most `keep` results are held in a worker; beyond that they are dropped and found again."""

    def __init__(self, path: str, keep_space: bool, pattern: str, keep: int = 400_000):
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.keep_space, self.pattern, self.keep = keep_space, regex.compile(pattern), keep
        self.special = {t.content: i for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        self.split_special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")")
        self.hint = os.path.commonprefix([*self.special])  # what a text with a special string has in any case
        self.plain = self.tokenizer.normalizer is None
        self.known: dict[int, object] = {}

    def normal(self, text: str) -> str:
        if self.plain or text.isascii():
            return text if self.plain else text.lower()
        if "Σ" in text:  # str.lower() looks at the word's end for this letter alone
            return self.tokenizer.normalizer.normalize_str(text)
        return unicodedata.normalize("NFC", text).lower()

    def ids(self, piece: str) -> list[int]:
        table = byte_letters()
        return [t.id for t in self.model.tokenize("".join([table[b] for b in piece.encode()]))]

    def segments(self, texts: list[str]) -> tuple[list[str], np.ndarray, list[tuple[int, int, int]]]:
        """Normalised segments between special strings, the text of each, and (text, segment after
        which it stands, id) of each special string."""
        out, owner, specials = [], [], []
        for i, text in enumerate(texts):
            if not self.special or self.hint not in text or not self.split_special.search(text):
                out.append(self.normal(text))
                owner.append(i)
                continue
            for part in self.split_special.split(text):
                if part in self.special:
                    specials.append((i, len(out) - 1, self.special[part]))
                else:
                    out.append(self.normal(part))
                    owner.append(i)
        return out, np.array(owner, np.int64), specials

    def pieces(self, segments: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, str, np.ndarray]:
        """Code points, starts and lengths of all pre-tokens, the joined text and the segments' offsets."""
        cp, offsets = code_points(segments)
        starts, lengths = spans(cp, offsets, self.keep_space)
        odd = [i for i, s in enumerate(segments) if "'" in s and CONTRACTION.search(s)]
        if odd:
            keep = ~np.isin(np.searchsorted(offsets, starts, "right") - 1, odd)
            more = [(offsets[i] + m.start(), m.end() - m.start()) for i in odd for m in self.pattern.finditer(segments[i])]
            more = np.array(more, np.int64).reshape(-1, 2)
            starts, lengths = np.concatenate([starts[keep], more[:, 0]]), np.concatenate([lengths[keep], more[:, 1]])
            order = np.argsort(starts, kind="stable")
            starts, lengths = starts[order], lengths[order]
        return cp, starts, lengths, "".join(segments), offsets

    def distinct(self, cp: np.ndarray, starts: np.ndarray, lengths: np.ndarray, joined: str, result) -> tuple[np.ndarray, list]:
        """The number of each pre-token's distinct kind, and result(piece) of each kind."""
        import pandas as pd

        codes, kinds = pd.factorize(hashes(cp, starts, lengths))
        first = np.empty(len(kinds), np.int64)
        first[codes[::-1]] = np.arange(len(codes) - 1, -1, -1)
        if len(self.known) > self.keep:
            self.known = {}
        known, out = self.known, []
        for h, a, n in zip(kinds.tolist(), starts[first].tolist(), lengths[first].tolist(), strict=True):
            r = known.get(h)
            if r is None:
                r = known[h] = result(joined[a : a + n])
            out.append(r)
        return codes, out

    def kinds(self, cp: np.ndarray, starts: np.ndarray, lengths: np.ndarray, joined: str) -> tuple[np.ndarray, list[str]]:
        """The number of each pre-token's distinct kind, and the kinds' texts. Kinds are told apart by 64-bit
        hashes; that pre-tokens of one hash have the same text is checked."""
        import pandas as pd

        codes, found = pd.factorize(hashes(cp, starts, lengths))
        first = np.empty(len(found), np.int64)
        first[codes[::-1]] = np.arange(len(codes) - 1, -1, -1)
        own, model = lengths, first[codes]
        same = np.array_equal(own, lengths[model])
        if same:
            at = np.repeat(starts - (np.cumsum(own) - own), own) + np.arange(int(own.sum()))
            same = np.array_equal(cp[at], cp[at + np.repeat(starts[model] - starts, own)])
        if not same:
            codes, texts = pd.factorize(np.array([joined[a : a + n] for a, n in zip(starts.tolist(), lengths.tolist(), strict=True)], object))
            return codes, texts.tolist()
        return codes, [joined[a : a + n] for a, n in zip(starts[first].tolist(), lengths[first].tolist(), strict=True)]
