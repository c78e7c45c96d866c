import hashlib

import numpy as np
import pyarrow as pa

from tidewater.llm.common import utf8
from tidewater.llm.fingerprints import LEAST, LOOSE, MOST, NORMAL, STRICT, WINDOW, compare_edited, fingerprints, gear, likeness


def prints(texts):
    return fingerprints(*utf8(pa.array(texts)))


def plain_chunks(b: bytes) -> list[bytes]:
    """The same chunks by a loop over bytes."""
    out, start, i, g = [], 0, 0, [int(x) for x in gear()]
    while i < len(b):
        i += 1
        n = i - start
        h = sum(g[b[i - 1 - k]] << k for k in range(min(WINDOW, i))) & 0xFFFFFFFF
        strict, loose = h >> (32 - STRICT) == 0, h >> (32 - LOOSE) == 0
        last = len(b) - start <= LEAST
        if not last and (LEAST <= n <= NORMAL and strict or n > NORMAL and loose or n == MOST) or i == len(b):
            out.append(b[start:i])
            start = i
    return out


def test_chunks_are_those_of_a_loop_over_bytes():
    rng = np.random.default_rng(5)
    for n in (0, 1, 15, 16, 17, 40, 300, 5000):
        text = "".join(chr(97 + c) for c in rng.integers(0, 26, n)) + "ab" * (n // 4)
        import xxhash

        want = np.unique(np.array([xxhash.xxh3_64_intdigest(c) >> 16 << 16 | len(c) for c in plain_chunks(text.encode())], np.uint64))
        assert np.array_equal(prints(["xyz" * 9, text])[1], want), n


def test_a_shift_changes_few_chunks():
    rng = np.random.default_rng(7)
    text = " ".join("".join(chr(97 + c) for c in rng.integers(0, 26, 6)) for _ in range(2000))
    a, b, c = prints([text, "shifted " + text, text[: len(text) // 2]])
    assert likeness(a, b) > 0.95 and likeness(c, a) > 0.95 and 0.4 < likeness(a, c) < 0.6


def brute(rows):
    rows = sorted(rows, key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.text or ""))
    out = []
    for k, r in enumerate(rows):
        t, u = r.text or "", rows[(k + 1) % len(rows)].text or ""
        cut = len(t) // 2
        e = t[: len(t) - cut] + u[:cut]
        p, q, n = prints([t, e, u])
        out.append((r.doc_id, len(t), hashlib.sha256(e.encode()).hexdigest(), round(likeness(p, q), 9), round(likeness(p, n), 9)))
    return sorted(out, key=str)


def test_rows_are_compared_with_their_edit_and_the_next(spark, odd_docs):
    for docs in (odd_docs, odd_docs.limit(0), odd_docs.where("doc_id = 2"), spark.read.parquet("/root/testdata/sf0.001/documents.parquet")):
        got = compare_edited(docs).collect()
        assert sorted(((r.doc_id, r.n_chars, r.edited_sha256, round(r.near_edited, 9), round(r.near_next, 9)) for r in got), key=str) == brute(docs.collect())


def test_many_buckets_give_the_same(spark, monkeypatch):
    import tidewater.llm.fingerprints as m

    from pyspark.sql import functions as F

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").repartition(5)
    docs = docs.withColumn("doc_id", F.when(F.col("doc_id") % 9 > 0, F.col("doc_id") - F.col("doc_id") % 4))  # nulls and repeats
    monkeypatch.setattr(m.in_order, "__defaults__", (7, 1 << 20, 20))
    got = compare_edited(docs).collect()
    assert sorted(((r.doc_id, r.n_chars, r.edited_sha256, round(r.near_edited, 9), round(r.near_next, 9)) for r in got), key=str) == brute(docs.collect())
