import hashlib
import re

import numpy as np
import pytest

from oracle import same
from tidewater.llm import decontamination as m
from tidewater.llm import queries


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate({i: i + 32 for i in range(65, 91)}))


def plain(docs, items, width):
    """(id, n_words, spans, items) by looking for every window in every text."""
    windows = {}
    for i, t in items:
        w = words(t)
        for k in range(max(1, len(w) - width + 1)) if w else ():
            windows.setdefault(tuple(w[k : k + width]), set()).add(i)
    out = []
    for d, t in docs:
        w = words(t)
        hit, own = [False] * (len(w) + 1), set()
        for x, who in windows.items():
            for k in range(len(w) - len(x) + 1):
                if w[k] == x[0] and tuple(w[k : k + len(x)]) == x:
                    hit[k : k + len(x)] = [True] * len(x)
                    own |= who
        edges = [k for k in range(len(w) + 1) if hit[k] != (k > 0 and hit[k - 1])]
        out.append((d, len(w), [*zip(edges[::2], edges[1::2])], sorted(own - {None})))
    return sorted(out, key=str)


def rows(df):
    return sorted(((r[0], r.n_words, [(s.start, s.end) for s in r.spans], sorted(r["items"])) for r in df.collect()), key=str)


ITEMS = [(1, "One two three four"), (2, "four five"), (3, None), (None, "six SIX six"), (5, "!!"), (5, "seven é8"), (7, "one TWO three four"), (8, "x x x x x x x")]
DOCS = ["one two, three four five", "two three four one", "", None, "six six six six six", "seven. É8 seven é8", "x " * 50, "x x x x x x " * 3 + "y", "four", "four five four five", "one two three one two three four", "zzz", "x " * 50]


@pytest.mark.parametrize("width", [1, 2, 3, 10])
def test_spans_are_those_of_a_loop(spark, width):
    docs = [(i, t) for i, t in enumerate(DOCS)] + [(None, DOCS[0]), (3, "six six six")]
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "'a' spans", "'b' ids", "1 shard")
    items = spark.createDataFrame(ITEMS, "item_id long, text string").selectExpr("*", "0 phrase")
    want = plain(docs, ITEMS, width)
    assert rows(m.contamination(df.repartition(3), items, width)) == want
    shards = m.index(df)
    assert rows(m.search(shards, m.phrases(items, width=width), width, most=2).withColumnRenamed("id", "doc_id")) == want


def test_no_rows(spark):
    df, items = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string"), spark.createDataFrame(ITEMS, "item_id long, text string")
    assert rows(m.contamination(df.limit(0), items)) == []
    assert rows(m.contamination(df, items.limit(0))) == [(1, 2, [], []), (2, 0, [], [])]


def test_small_shards_and_a_long_text(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    items = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").select("item_id", "text")
    docs = docs.unionByName(spark.createDataFrame([(9999, "lorem " * 50_000 + items.first().text)], "doc_id long, text string"))
    want = plain(docs.collect(), items.collect(), 10)
    assert sum(bool(s) for _, _, s, _ in want) > 3
    for size in (6_000_000, 30_000):
        monkeypatch.setattr(m, "SHARD", size)
        assert rows(m.contamination(docs, items)) == want


def test_spans_are_cut(spark):
    docs = spark.createDataFrame([(1, "Say: one, TWO three four! Yes.", 5), (2, "none of it", 6), (3, None, 7), (4, "é one two three four", 8)], "doc_id long, text string, spans long")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = m.cut(docs, m.contamination(docs, items)).orderBy("doc_id").collect()
    assert [tuple(r) for r in got] == [(1, "Say: ! Yes.", 5), (2, "none of it", 6), (3, None, 7), (4, "é ", 8)]


def test_suffixes_are_in_order():
    rng = np.random.default_rng(3)
    for symbols, n in ((1, 70), (2, 200), (50, 500), (3, 1)):
        t = rng.integers(0, symbols + 1, n)
        t[-1] = 0
        t = np.concatenate([t, t, t])
        end = np.flatnonzero(t == 0)
        want = sorted(range(len(t)), key=lambda i: [*t[i : end[np.searchsorted(end, i)]].tolist(), -1, i] if t[i] else [-1, i])
        ends = {int(e): k for k, e in enumerate(end)}
        key = lambda i: [*t[i : end[np.searchsorted(end, i)]].tolist(), ends[int(end[np.searchsorted(end, i)])] - len(t)]
        assert m.suffix_order(t).tolist() == sorted(range(len(t)), key=key) and len(want) == len(t)


def test_index_counts_and_locates_every_substring():
    rng = np.random.default_rng(5)
    for symbols in (1, 3, 40):
        t = rng.integers(0, symbols + 1, 700)
        t[-1] = 0
        fm = m.Index(len(t), *m.Index.made(t))
        places = {}
        for n in (1, 2, 4):
            for i in range(len(t) - n + 1):
                if (t[i : i + n] > 0).all():
                    places.setdefault(tuple(t[i : i + n].tolist()), []).append(i)
        asked = [*places, (symbols, symbols + 0, 1, 1)]
        table, lengths = np.zeros((len(asked), 4), np.int64), np.array([len(p) for p in asked])
        for k, p in enumerate(asked):
            table[k, 4 - len(p) :] = p
        which, low, high = fm.search(table, lengths)
        for k, a, b in zip(which, low, high):
            assert sorted(fm.located(np.arange(a, b)).tolist()) == places[asked[k]]
        assert {asked[k] for k in which} == set(places)


def test_query_as_its_sql(spark):
    same(queries.op13_decontamination(spark, "/root/testdata/sf0.001"), queries.OP13_SQL, "/root/testdata/sf0.001")
    none = [r for r in queries.op13_decontamination(spark, "/root/testdata/sf0.001").collect() if not r.n_items]
    assert none and {r.items_sha256 for r in none} == {hashlib.sha256(b"").hexdigest()}
