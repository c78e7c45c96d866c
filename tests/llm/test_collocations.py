import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from oracle import same
from tidewater.llm import collocations as m
from tidewater.llm import queries
from tidewater.llm.collocations import Automaton, collocations


def plain(rows, least, first, cover):
    f = defaultdict(Counter)
    for lang, text in rows:
        low = (text or "").translate({i: i + 32 for i in range(65, 91)})
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            for n in (1, 2, 3):
                f["und" if lang is None else lang].update(tuple(w[i : i + n]) for i in range(len(w) - n + 1))
    out = []
    for lang, c in f.items():
        own = {p: a for p, a in c.items() if len(p) > 1 and a >= least}
        told = []
        for p, a in own.items():
            if any(len(q) > len(p) and 100 * b >= cover * a and p in [q[:-1], q[1:]] for q, b in own.items()):
                continue
            score, k = min((1_000_000 * a * a // (c[p[:k]] * c[p[k:]]), k) for k in range(1, len(p)))
            told.append((-score, -a, " ".join(p).encode(), c[p[:k]], c[p[k:]]))
        n = sum(x for p, x in c.items() if len(p) == 1)
        out += [(lang, r, p.decode(), -a, l, rr, n, -s) for r, (s, a, p, l, rr) in enumerate(sorted(told)[:first], 1)]
    return sorted(out)


def rows(df):
    return sorted(map(tuple, df.collect()))


TEXTS = [("en", "a b c a b c, a b. x y"), ("en", "A B\tc a b\nz b c d b c d"), ("de", "a b a b"), (None, "q q q q q! q q"), ("und", "q q"), ("en", None), ("fr", ""), ("en", "x Y x y x y é x y. x y"), ("es", " \t\n")]


@pytest.mark.parametrize(("least", "first", "cover"), [(1, 2000, 50), (2, 3, 50), (2, 2000, 100), (3, 2000, 1)])
def test_phrases_are_those_of_a_loop(spark, monkeypatch, least, first, cover):
    """Nulls, empty texts, overlaps, ties, repeated rows; pairs of very frequent words in parts."""
    df = spark.createDataFrame(TEXTS + TEXTS[:2], "lang string, text string").selectExpr("*", "1 n", "'x' phrase", "'w' word", "2 shard")
    assert rows(collocations(df.repartition(3), least, first, cover)) == plain(TEXTS + TEXTS[:2], least, first, cover)
    assert m.HOT * max(Counter(w for _, t in TEXTS for w in (t or "").split()).values()) > 30
    monkeypatch.setattr(m, "HOT", 1)  # none is
    assert rows(collocations(df, least, first, cover)) == plain(TEXTS + TEXTS[:2], least, first, cover)


def test_no_rows(spark):
    df = spark.createDataFrame(TEXTS, "lang string, text string")
    assert rows(collocations(df.limit(0))) == [] == rows(collocations(df))


def test_small_shards_and_a_long_text(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("lang", "text")
    docs = docs.unionByName(spark.createDataFrame([("en", "the long text, of the long text " * 20_000)], "lang string, text string"))
    want = plain(docs.collect(), 5, 300, 50)
    monkeypatch.setattr(m, "SHARD", 100_000)
    monkeypatch.setattr(m, "PART", 10_000)
    assert rows(collocations(docs, 5, 300)) == want


@pytest.mark.parametrize("wide", [False, True])
def test_automaton_has_all_substrings_and_their_places(wide):
    """A state's substrings end at the same places; each substring is in one state; its link is the longest of its suffixes in another."""
    rng = np.random.default_rng(2)
    for symbols, depth in ((1, 3), (2, 3), (3, 4), (9, 3)):
        s = rng.integers(0, symbols + 1, 300) * ((1 << 22) if wide else 1)
        s[-1] = 0
        ends = defaultdict(set)
        for i in range(len(s)):
            for n in range(1, depth + 1):
                x = s[i - n + 1 : i + 1] if i - n + 1 >= 0 else s[:0]
                if len(x) == n and (x > 0).all():
                    ends[tuple(x.tolist())].add(i)
        a = Automaton.of(s, depth)
        longest = [tuple(s[p - n + 1 : p + 1].tolist()) for p, n in zip(a.place, a.length)]
        seen = []
        for k, x in enumerate(longest):
            own = [x[len(x) - n :] for n in range(int(a.shortest()[k]), len(x) + 1)]
            assert all(ends[y] == ends[x] for y in own) and len(ends[x]) == a.count[k]
            assert a.link[k] == (-1 if len(own[0]) == 1 else longest.index(own[0][1:]))
            seen += own
        assert sorted(seen) == sorted(ends)


def test_exact_scores_beyond_64_bits(spark):
    """The expression of the score, at counts whose products need 38 digits."""
    a, l, r = 3_037_000_500_123, 3_037_000_500_999, 9_000_000_000_001
    q = "cast(a as decimal(16,0)) * cast(a as decimal(16,0)) * 1000000BD div (cast(l as decimal(19,0)) * cast(r as decimal(19,0)))"
    assert m.SCORE.format("l", "r") == q
    assert spark.sql(f"select {q} x from values ({a}L, {l}L, {r}L) t(a, l, r)").first().x == 1_000_000 * a * a // (l * r)


def test_query_as_its_sql(spark):
    same(queries.op12_collocations(spark, "/root/testdata/sf0.001"), queries.OP12_SQL, "/root/testdata/sf0.001")
