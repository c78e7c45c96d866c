import public_tokenizers
from tokenizers import Tokenizer

from tidewater.llm.token_counts import token_counts

PATH = public_tokenizers.path("word_bpe_49k.json")


def test_counts_are_the_librarys(spark, odd_docs):
    t = Tokenizer.from_file(PATH)
    got = sorted(token_counts(odd_docs, PATH, limit=10).collect(), key=str)
    want = sorted(((r.doc_id, len((r.text or "").encode()), n := len(t.encode(r.text or "", add_special_tokens=False).ids), n > 10) for r in odd_docs.collect()), key=lambda x: str(x))
    assert sorted(map(tuple, got), key=str) == want


def test_no_rows(spark, odd_docs):
    assert token_counts(odd_docs.limit(0), PATH).collect() == []


def test_a_whole_table_against_the_library(spark):
    t = Tokenizer.from_file(PATH)
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").repartition(5)
    rows = docs.select("doc_id", "text").collect()
    ids = t.encode_batch([r.text or "" for r in rows], add_special_tokens=False)
    want = {r.doc_id: len(e.ids) for r, e in zip(rows, ids, strict=True)}
    assert {r.doc_id: r.n_tokens for r in token_counts(docs, PATH).collect()} == want


def test_small_blocks_and_equal_hashes(spark, odd_docs, monkeypatch):
    """Blocks of a text or two, and hashes that can't tell pre-tokens apart: the same counts."""
    from tidewater.llm import pretokens, token_counts as m

    want = sorted(map(tuple, token_counts(odd_docs, PATH).collect()), key=str)
    v = m.PieceVocabulary(PATH, keep_space=False, pattern=m.WORD_PATTERN)
    cp, starts, lengths, joined, _ = v.pieces(["one two one six 12 one"])
    codes, kinds = v.kinds(cp, starts, lengths, joined)
    monkeypatch.setattr(pretokens, "hashes", lambda cp, starts, lengths: lengths.astype("u8"))
    for c, k in ((codes, kinds), v.kinds(cp, starts, lengths, joined)):
        assert [k[i] for i in c] == ["one", "two", "one", "six", "1", "2", "one"] and len(set(k)) == len(k)
    blocks = m.frequencies(odd_docs.select("doc_id", "text").toDF("id", "text").repartition(3), PATH).collect()
    assert sum(len(b.ids) for b in blocks) == odd_docs.count() and len({b.block for b in blocks}) == len(blocks)
    assert sorted(map(tuple, token_counts(odd_docs.repartition(7), PATH).collect()), key=str) == want
