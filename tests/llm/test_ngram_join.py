import random
import re
import sys
from pathlib import Path

import numpy as np
import pytest

sys.path.insert(0, str(Path(__file__).parent))
from oracle import same

from tidewater.llm import ngram_join
from tidewater.llm.components import connected_components
from tidewater.llm.ngram_join import PrefixTree, near_duplicates, numbered
from tidewater.llm.queries import OP6_SQL, op6_ngram_join

SF = "/root/testdata/sf0.001"


def grams(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({i: i + 32 for i in range(65, 91)}))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute(rows):
    sets = [grams(r.text) for r in rows]
    n = len(rows)
    link = [[i != j and bool(sets[i]) and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]) for j in range(n)] for i in range(n)]
    part = list(range(n))
    for i in range(n):
        for j in range(n):
            if link[i][j]:
                old, new = part[j], part[i]
                part = [new if p == old else p for p in part]
    out = []
    for i, r in enumerate(rows):
        ids = [rows[j].doc_id for j in range(n) if part[j] == part[i] and rows[j].doc_id is not None]
        out.append((r.doc_id, len(sets[i]), min(ids) if ids else None, sum(link[i])))
    return sorted(out, key=str)


def test_against_sql(spark):
    same(op6_ngram_join(spark, SF), OP6_SQL, SF)


def made(seed, n=90):
    rng = random.Random(seed)
    base = [[f"w{rng.randrange(400)}" for _ in range(rng.choice([5, 7, 8, 12, 40, 60]))] for _ in range(6)]
    rows = []
    for i in range(n):
        words = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 1, 2, 3])):
            words[rng.randrange(len(words))] = f"x{rng.randrange(9)}"
        rows.append((i, rng.choice([" ", "\n", " \t"]).join(words), 1))
    return rows + [(200, "one two", 1), (201, "One  two ", 1), (202, "", 1), (203, None, 1), (None, rows[0][1], 1), (5, rows[9][1] + " tail", 1), (5, rows[5][1], 1)]


@pytest.mark.parametrize("sets", [512, 7])
def test_against_brute_force(spark, monkeypatch, sets):
    monkeypatch.setattr(ngram_join, "SETS", sets)
    for seed in (1, 2):
        docs = spark.createDataFrame(made(seed), "doc_id long, text string, node int").repartition(3)
        assert sorted(map(tuple, near_duplicates(docs).collect()), key=str) == brute(docs.collect())


def test_many_near_copies(spark, monkeypatch):
    """5,000 near copies of one text, all different: links and component are right, and no set is sent on more
    often than its cluster has blocks."""
    rng = random.Random(6)
    base = [f"w{rng.randrange(3000)}" for _ in range(120)]
    rows = []
    for i in range(5000):
        words = list(base)
        words[3 + i % 100] = f"x{i}"
        rows.append((i, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    sent = []
    real = ngram_join.written

    def counted(df, label, **options):
        out = real(df, label, **options)
        if label == "ngram-clusters":
            sent.append(out.agg({"parts": "max"}).first()[0])
        return out

    monkeypatch.setattr(ngram_join, "written", counted)
    found = near_duplicates(docs).collect()
    # each differs from another in two words at most: ten of 116 shingles on either side
    assert {r.component_id for r in found} == {0} and {r.n_links for r in found} == {4999}
    assert sent == [-(-5000 // ngram_join.SETS)] and sent[0] <= ngram_join.SENDS


def test_odd_rows(spark, odd_docs):
    assert sorted(map(tuple, near_duplicates(odd_docs).collect()), key=str) == brute(odd_docs.collect())
    assert near_duplicates(odd_docs.limit(0)).collect() == []


def test_tree_finds_all_links_and_leaves_branches():
    rng = np.random.default_rng(2)
    base = np.arange(60, dtype=np.uint64)
    sets = [np.unique(np.concatenate([rng.choice(base, rng.integers(1, 60), replace=False), rng.integers(100, 140, rng.integers(0, 8)).astype(np.uint64)])) for _ in range(150)]
    sets = list({s.tobytes(): s for s in sets}.values())
    own, tokens = numbered(sets, np.zeros(ngram_join.BUCKETS, np.uint32))
    got = {(int(q), i) for who, i in PrefixTree(own).walk(own, tokens) for q in who}
    want = {(i, j) for i, a in enumerate(sets) for j, b in enumerate(sets) if 9 * len(np.intersect1d(a, b)) >= 4 * (len(a) + len(b))}
    assert got == want and len(want) > len(sets)


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 7), (50, 51), (51, 50), (60, 60)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys([*range(41), 100], 0), 50: 50, 51: 50}
    assert connected_components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_linked_sets_share_a_signature():
    import numpy as np

    from tidewater.llm.ngram_join import signatures

    rng = np.random.default_rng(5)
    for _ in range(1500):
        n = int(rng.choice([rng.integers(4, 130), rng.integers(60, 700), 2000]))
        pool = np.unique(rng.integers(0, 1 << 63, 2 * n, dtype=np.uint64))
        a, rest = pool[rng.permutation(len(pool))[:n]], None
        lost = int(rng.integers(0, n // 5 + 1))
        rest = np.setdiff1d(pool, a)
        more = max(0, min(len(rest), int((n - lost) / 0.8 + 1e-9) - n))
        b = np.concatenate([a[lost:], rest[:more]])
        common, both = len(np.intersect1d(a, b)), len(np.union1d(a, b))
        if 100 * common < 80 * both:
            continue
        weight = dict(zip(pool.tolist(), rng.integers(1, 9000, len(pool)).tolist()))
        found = [np.concatenate(signatures(s, np.array([weight[int(g)] for g in s], np.int64))) for s in (np.sort(a), np.sort(b))]
        assert len(np.intersect1d(*found)), (n, len(b), common)
