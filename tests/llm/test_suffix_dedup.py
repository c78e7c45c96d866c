import hashlib
import random
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))
from oracle import same

from tidewater.llm.queries import OP3_SQL, op3_suffix_dedup
from tidewater.llm.suffix_dedup import remove_repeats

SF = "/root/testdata/sf0.001"


def brute(rows, length=100):
    """By a set of all strings seen. Rows of unlike ids."""
    seen, out = set(), {}
    for doc_id, text in sorted(rows, key=lambda r: r[0]):
        b = (text or "").encode()
        gone = [False] * len(b)
        for p in range(len(b) - length + 1):
            s = b[p : p + length]
            if s in seen:
                gone[p : p + length] = [True] * length
            seen.add(s)
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out[doc_id] = (len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


def made(seed, n=60):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randrange(2, 9)))
    passages = [" ".join(word() for _ in range(rng.choice([9, 16, 22, 40]))) for _ in range(9)]
    texts = []
    for _ in range(n):
        parts = []
        for _ in range(rng.randrange(0, 6)):
            p = rng.choice(passages) if rng.random() < 0.6 else " ".join(word() for _ in range(rng.randrange(1, 60)))
            a = rng.randrange(len(p)) if rng.random() < 0.4 else 0
            parts.append(p[a : a + rng.choice([90, 99, 100, 101, 102, 108, 130, 500])])
        texts.append(rng.choice(["", " ", "\n"]).join(parts))
    texts += [texts[3], texts[3], "a" * 350, "a" * 99, "a" * 101, "ab" * 90, None, "", passages[0] + "x" * 400 + passages[0]]
    return list(enumerate(texts))


def test_against_sql(spark):
    same(op3_suffix_dedup(spark, SF), OP3_SQL, SF)


@pytest.mark.parametrize("parts", [1, 7])
@pytest.mark.parametrize("length", [100, 64, 131])
def test_against_a_set_of_all_strings(spark, parts, length):
    for seed in (1, 2):
        rows = made(seed + 10 * length)
        docs = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, tie int").repartition(parts, "doc_id")
        got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in remove_repeats(docs, length=length).collect()}
        assert got == brute(rows, length)
        assert length != 100 or sum(v[1] > 0 for v in got.values()) > 10


def test_repeated_and_null_ids(spark):
    a, b = "x" * 50 + "".join(map(str, range(200))), "other " * 3 + "".join(map(str, range(150)))
    docs = spark.createDataFrame([(1, a), (1, a), (None, a[20:]), (1, b), (2, a), (3, None), (4, "")], "doc_id long, text string")
    got = sorted(map(tuple, remove_repeats(docs).collect()), key=str)
    rows = [r for r in got if r[0] == 1 and r[1] == len(a)]
    assert len(got) == 7 and len(rows) == 2 and rows[0] == rows[1]
    assert [r for r in got if r[0] is None][0][2] == 0 and [r for r in got if r[0] == 2][0][2] == len(a)
    assert all(r[2] == 0 for r in got if r[0] in (3, 4))
    assert remove_repeats(docs.limit(0)).collect() == []


def test_texts_are_cut(spark, odd_docs):
    docs = odd_docs.withColumnRenamed("id", "spans")
    got = remove_repeats(docs, columns=True)
    assert got.columns == docs.columns and got.count() == docs.count()
    rows = {r.doc_id: r.text for r in got.collect()}
    assert len(rows[6]) < 110 and rows[7] == "" and rows[1] is None and rows[5] == "ΑΣ ΣΑ İx <|startoftext|>Y é ÀÉ"
