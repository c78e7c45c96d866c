import re

import numpy as np
import pyarrow as pa

from tidewater.llm import tokens
from tidewater.llm.common import utf8

TEXTS = ["", None, "A b,a", "É é 12x", " \t\n", "x", "y", "ab. AB ab"]


def test_words_and_their_numbers(monkeypatch):
    raw, offsets = utf8(pa.array(TEXTS))
    for hashed in (tokens.piece_hashes, lambda v, s, n: n.astype("u8")):  # hashes that tell words apart, and that don't
        monkeypatch.setattr(tokens, "piece_hashes", hashed)
        for inside, pattern in ((tokens.ALNUM, r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"), (tokens.INSIDE, r"[^\x20\x09.,;:!?\x0A-\x0D]+")):
            starts, lengths, n = tokens.word_spans(raw, offsets, inside)
            codes, words = tokens.distinct_words(raw, starts, lengths)
            want = [re.findall(pattern, (t or "").translate({i: i + 32 for i in range(65, 91)})) for t in TEXTS]
            assert n.tolist() == [*map(len, want)] and [words[c].as_py() for c in codes] == [w for x in want for w in x]
            assert len(set(words.to_pylist())) == len(words)


def test_no_texts():
    raw, offsets = utf8(pa.array([], pa.string()))
    assert [len(x) for x in tokens.word_spans(raw, offsets, tokens.ALNUM)] == [0, 0, 0]
    assert len(tokens.distinct_words(raw, *[np.zeros(0, np.int64)] * 2)[1]) == 0
