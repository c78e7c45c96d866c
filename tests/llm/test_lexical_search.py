import glob
import math
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from oracle import same
from tidewater.llm import lexical_search, queries
from tidewater.llm.lexical_search import best, ranked
from tidewater.sources import shared


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate({i: i + 32 for i in range(65, 91)}))


def plain(docs, items, k):
    """(item, rank, id, score) by scoring every document."""
    counts = [(i, Counter(terms(t))) for i, t in docs]
    n_texts, n_terms = sum(bool(c) for _, c in counts), sum(sum(c.values()) for _, c in counts)
    df = Counter(w for _, c in counts for w in c)
    out, wanted = [], defaultdict(set)
    for i, t in items:
        wanted[i] |= set(terms(t))
    for i, own in wanted.items():
        scores = []
        for d, c in counts:
            m = 50 + (50 * sum(c.values()) * n_texts) // max(1, n_terms)
            s = sum(math.floor(1000 * math.log((2 * n_texts + 2) / (2 * df[w] + 1))) * ((1_000_000_000 * c[w]) // (1000 * c[w] + 20 * m)) for w in own if w in c)
            scores += [(-s, d is not None, d or 0)] if s > 0 else []
        out += [(i, r, d if known else None, -s) for r, (s, known, d) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=str)


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.mark.parametrize("k", [1, 3, 50])
def test_ranks_are_those_of_a_loop(spark, odd_docs, k):
    """Nulls, ties, repeated rows and ids, long texts, items without terms and items of several rows."""
    docs = odd_docs.unionByName(spark.createDataFrame([(100 + i % 40, f"Word x{i % 7} y{i % 3} " * (1 + i % 5) + "é_1", None, None, None, None, None) for i in range(200)], odd_docs.schema))
    items = [(1, "word X1 y2 É"), (2, None), (3, "..."), (None, "a 12 word"), (5, "x2 x3"), (5, "y0"), (6, "nothing here")]
    df = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "'t' term", "1 rank")
    got = rows(ranked(docs.repartition(5), df, k))
    assert got == plain([(r.doc_id, r.text) for r in docs.collect()], items, k)


def test_no_rows(spark, odd_docs):
    items = spark.createDataFrame([(1, "word")], "item_id long, text string")
    assert rows(ranked(odd_docs.limit(0), items)) == [] == rows(ranked(odd_docs, items.limit(0)))


def test_passes_and_small_blocks(spark, monkeypatch):
    """Items in several passes, and texts in many blocks, whose scores must beat those of the blocks before."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    items = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    want = rows(ranked(docs, items, 5))
    assert want == plain(docs.select("doc_id", "text").collect(), items.select("item_id", "text").collect(), 5)
    assert rows(ranked(docs, items, 5, most=200)) == want
    one = docs.coalesce(1)
    monkeypatch.setattr(lexical_search, "BLOCK", 20_000)
    blocks = lexical_search.postings(one)
    assert blocks.count() > 10 and rows(ranked(one, items, 5)) == want


def test_blocks_are_read_one_at_a_time(spark, monkeypatch):
    """Row groups of the postings hold few blocks and a worker's batch one, though one task reads all of them."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").coalesce(1)
    items = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    want, groups, told = rows(ranked(docs, items, 5)), [], []

    def spied(df, label, conf=None, **options):
        if label == "search-best":
            sizes = df.sparkSession.read.parquet(tables[0].written_at).coalesce(1).select("df").mapInArrow(lambda batches: (pa.RecordBatch.from_arrays([pa.array([b.num_rows])], names=["n"]) for b in batches), "n long")
            told.extend(r.n for r in shared.written(sizes, "batches", conf=conf).collect())
        out = shared.written(df, label, conf=conf, **options)
        if label == "postings":
            tables.append(out)
            files = [pq.ParquetFile(f).metadata for f in glob.glob(f"{out.written_at.removeprefix('file:')}/*.parquet")]
            groups.extend(f.row_group(g).num_rows for f in files for g in range(f.num_row_groups))
        return out

    tables = []
    monkeypatch.setattr(lexical_search, "BLOCK", 20_000)
    monkeypatch.setitem(lexical_search.GROUPS, "parquet.block.size", "20000")
    monkeypatch.setattr(lexical_search, "written", spied)
    before = {k: spark.conf.get(k) for k in shared.WIDE}
    assert rows(ranked(docs, items, 5)) == want
    assert sum(groups) > 10 and max(groups) <= 2 and told == [1] * sum(groups)
    assert {k: spark.conf.get(k) for k in shared.WIDE} == before


def test_counts_keep_their_values():
    for x in ([], [0], [255], [256, 1], [65535], [65536], [(1 << 31) - 1, 3]):
        raw = lexical_search.packed(np.array(x, np.int64))
        assert lexical_search.unpacked(pa.array([raw], pa.binary())[0]).tolist() == x


def test_early_stop_keeps_the_first_k():
    """Random postings, more than a step of them: what is found holds the first k, with whole scores."""
    rng = np.random.default_rng(4)
    for k, terms_, texts in ((1, 2, 900), (10, 5, 2000), (50, 12, 3000), (5000, 4, 100)):
        pairs = np.unique(rng.integers(0, terms_ * texts, 3 * texts))
        term, place = np.divmod(pairs, texts)
        weight = 2.0 ** -np.arange(terms_) * 1000
        impact = (weight[term] * rng.random(len(term)) ** 3).astype(np.int64)
        down = np.argsort(-impact, kind="stable")
        term, place, impact = term[down], place[down], impact[down]
        want = np.bincount(place, impact, texts).astype(np.int64)
        first = sorted(((-s, i) for i, s in enumerate(want.tolist()) if s > 0))[:k]
        for least in (0, -first[len(first) // 2][0]):
            found, score = best(impact, place, term, np.arange(texts), k, least)
            assert np.array_equal(score, want[found])
            got = sorted(zip((-score).tolist(), found.tolist()))[:k]
            assert got == [x for x in first if -x[0] >= least][: len(got)] and len(got) == sum(-s >= least for s, _ in first)


def test_query_as_its_sql(spark):
    same(queries.op11_lexical_search(spark, "/root/testdata/sf0.001"), queries.OP11_SQL, "/root/testdata/sf0.001")
