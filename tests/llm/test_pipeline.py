import sys
import zlib
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

sys.path.insert(0, str(Path(__file__).parent))
import corpus_pipeline
from plain import components, plain_removed
from tidewater.llm import ngram_join, toxicity
from tidewater.llm.common import read

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return read(spark, SF, "documents")


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_toxicity_stage(spark):
    sf = "/root/testdata/sf0.01"  # smaller tables have too few labels to learn from
    docs = read(spark, sf, "documents")
    model = toxicity.trained(docs, read(spark, sf, "labels"))
    got = corpus_pipeline.drop_toxic(spark, docs, sf)
    assert got.columns == docs.columns
    texts = [r["text"] or "" for r in docs.collect()]
    score, _ = toxicity.scored(texts, model)
    want = [tuple(r) for r, s in zip(docs.collect(), score) if s < 0.7]
    assert rows(got) == sorted(want, key=str)
    assert 0 < len(want) < len(texts)


def test_near_duplicate_stage(spark, docs):
    got = corpus_pipeline.drop_near_duplicates(spark, docs, SF)
    assert got.schema.names == docs.columns
    own = [tuple(r) for r in docs.collect()]
    least = components({r[0]: r[1] for r in own})
    assert rows(got) == sorted([r for r in own if least[r[0]] == r[0]], key=str)


def test_one_of_each_with_odd_rows(spark):
    a, b = "one two three four five six seven", "other words than those of the first text"
    data = [(5, a, "x"), (3, a, "y"), (5, b, "z"), (5, b, "w"), (None, b, "v"), (None, None, "u"), (7, "", "t"), (8, "", "s")]
    df = spark.createDataFrame(data, "doc_id long, text string, doc string")
    got = ngram_join.one_of_each(df)
    assert got.columns == ["doc_id", "text", "doc"]
    found = rows(got.select("doc_id", "text"))
    assert found == sorted([(3, a), (None, b), (None, None), (7, ""), (8, "")], key=str)
    assert ngram_join.one_of_each(df.limit(0)).count() == 0


def test_suffix_stage(spark, docs):
    some = docs.where("doc_id < 120")  # all of a small fixture
    got = {r["doc_id"]: r for r in corpus_pipeline.drop_repeated_passages(spark, some, SF).collect()}
    want = plain_removed([(r["doc_id"], r["text"]) for r in some.collect()])
    assert got.keys() == want.keys()
    for k, left in want.items():
        assert got[k]["text"] == left
        assert got[k]["n_chars"] == len(left)


def test_whole_pipeline(spark, docs):
    """All stages in a row against a chain of plain ones over the same documents."""
    model = toxicity.trained(docs, read(spark, SF, "labels"))
    left = {r["doc_id"]: r["text"] for r in docs.collect()}
    score, _ = toxicity.scored([t or "" for t in left.values()], model)
    left = {k: t for (k, t), s in zip(left.items(), score, strict=True) if s < 0.7}
    least = components(left)
    left = plain_removed([(k, t) for k, t in left.items() if least[k] == k])
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = {k: [*tokenizer.encode(t, add_special_tokens=False).ids, 1] for k, t in left.items()}
    pieces = {}
    for r in corpus_pipeline.run(spark, SF).collect():
        pieces.setdefault(r["doc_id"], []).append((r["start"], r["length"], r["doc_tokens"], r["ids_crc32"]))
    assert pieces.keys() == want.keys()
    for k, ids in want.items():
        at = 0
        for start, length, total, crc in sorted(pieces[k]):
            assert start == at and total == len(ids)
            at += length
            assert crc == zlib.crc32(np.array(ids[start:at], "<u4").tobytes())
        assert at == len(ids)


def test_stages_take_odd_rows(spark, odd_docs):
    now = odd_docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, SF)
        assert now.columns == odd_docs.columns
    assert now.count() > 0
    assert corpus_pipeline.pack_sequences(spark, now, SF).count() > 0


def test_stages_take_empty_tables(spark, odd_docs):
    now = odd_docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        now = stage(spark, now, SF)
        assert now.count() == 0
        if "text" not in now.columns:
            break
