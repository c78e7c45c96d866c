import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from tidewater.llm.packing import Lane, fill, pack, windows_of

PATH = public_tokenizers.path("byte_bpe_50k.json")


def checked(rows, docs, size):
    t = Tokenizer.from_file(PATH)
    want = defaultdict(list)
    for r in docs:
        want[r.doc_id].append(t.encode(r.text or "", add_special_tokens=False).ids + [1])
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append((r.offset, r.length))
    for x in sequences.values():
        at = 0
        for offset, length in sorted(x):
            assert offset == at
            at += length
        assert at == size or at & (at - 1) == 0
    assert sum(n for x in sequences.values() for _, n in x) == sum(len(i) for x in want.values() for i in x)
    # of repeated ids too, all pieces together are those of the rows
    for doc_id, ids in want.items():
        assert sorted(r.start for r in pieces[doc_id]).count(0) == len(ids)
        assert sum(r.length for r in pieces[doc_id]) == sum(map(len, ids))
        if len({tuple(x) for x in ids}) == 1:
            for r in pieces[doc_id]:
                assert r.ids_crc32 == zlib.crc32(np.array(ids[0][r.start : r.start + r.length], "<u4").tobytes())
        if len(ids) == 1:
            at = 0
            for r in sorted(pieces[doc_id], key=lambda r: r.start):
                assert r.start == at and r.doc_tokens == len(ids[0])
                assert r.ids_crc32 == zlib.crc32(np.array(ids[0][at : at + r.length], "<u4").tobytes())
                at += r.length
            assert at == len(ids[0])
    return sequences


def test_odd_rows(spark, odd_docs):
    checked(pack(odd_docs, PATH, size=64, piece=8, windows=2).collect(), odd_docs.collect(), 64)


def test_documents_keep_proportions(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = pack(docs, PATH, windows=8).collect()
    sequences = checked(rows, docs.collect(), 2048)
    full = {s for s, x in sequences.items() if sum(n for _, n in x) == 2048}
    total = sum(r.length for r in rows)
    share = defaultdict(int)
    for r in rows:
        share[r.source_queue] += r.length / total
    inside = defaultdict(lambda: defaultdict(int))
    for r in rows:
        inside[r.sequence_id][r.source_queue] += r.length
    for q in share:
        ran = 0.0
        for s in sorted(full):
            ran += inside[s][q] - 2048 * share[q]
            assert abs(ran) < 2 * 2048


def test_lanes_cut_every_queue_once():
    size = 1024
    for totals in ([100_003, 5_000, 7], [4, 3], [70_000, 2_000, 1_500, 1, 0][:4], [1023, 1], [2048]):
        every, at, found = sum(totals), 0, []
        for n in totals:
            found.append(Lane(at, at + n, every, size))
            at += n
        for lane, n in zip(found, totals, strict=True):
            edges = [lane.edge(b) for b in range(lane.count + 1)]
            assert edges[0] == 0 and edges[-1] == n and edges == sorted(edges)
            for token in (0, n // 2, n - 1):
                b = lane.block_at(token)
                assert edges[b] <= token < edges[b + 1]
        for b in range(found[0].count - 1):
            assert sum(x.edge(b + 1) - x.edge(b) for x in found) == size


def test_a_thousand_sources_keep_their_shares(spark):
    """Sources of like sizes, one of a third of all, and many of a text or two; windows follow the corpus."""
    rows = [(i, f"text {i} of its own " * 12, "hot" if i % 3 == 0 else f"s{i % 997}") for i in range(3000)] + [(9000 + i, "a few words", f"rare{i}") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    got = pack(docs, PATH, size=256, piece=16, windows=16).collect()
    sequences = checked(got, docs.collect(), 256)
    names = {r[0]: r[2] for r in rows}
    assert all(r.source_queue == names[r.doc_id] for r in got)
    total = sum(r.length for r in got)
    hot = sum(r.length for r in got if r.source_queue == "hot") / total
    ran = 0.0
    for s in sorted(s for s, x in sequences.items() if sum(n for _, n in x) == 256):
        ran += sum(r.length for r in got if r.sequence_id == s and r.source_queue == "hot") - 256 * hot
        assert abs(ran) < 2 * 256


def plain_fill(queues, windows, piece):
    """Deficit round-robin by whole fractions, a token at a time."""
    from fractions import Fraction

    names, total = sorted(queues), sum(windows)
    left = {q: [(item, k) for item, n in queues[q] for k in range(n)] for q in names}
    sizes = {q: len(left[q]) for q in names}
    ends = {q: {(item, n - 1) for item, n in queues[q]} for q in names}
    owed = {q: Fraction(-(zlib.crc32(q.encode()) % 1000 * min(piece, sizes[q]) * total // 1000), total) for q in names}
    turn, out = 0, []
    for w, size in enumerate(windows):
        for q in names:
            owed[q] += Fraction(size * sizes[q], total)
        row, idle = [], 0
        while len(row) < size:
            if idle >= len(names):  # nobody is owed any: the one that lacks least
                turn = names.index(max((q for q in names if left[q]), key=lambda q: owed[q]))
            q = names[turn]
            if left[q] and (owed[q] > 0 or idle >= len(names)):
                idle, want = 0, max(piece, -(-owed[q] // 1))
                for _ in range(int(want)):
                    token = left[q].pop(0)
                    row.append(token)
                    owed[q] -= 1
                    if len(row) == size or token in ends[q]:
                        break
                if owed[q] > 0 and len(row) < size:
                    continue
            else:
                idle += 1
            turn = (turn + 1) % len(names)
        out.append(row)
    return out


def test_fill_against_a_plain_version():
    import random

    for seed in range(20):
        rng = random.Random(seed)
        queues = {q: [(f"{q}{i}", rng.choice([1, 3, 10, 40])) for i in range(rng.randrange(1, 9))] for q in "abcd"[: rng.randrange(1, 5)]}
        windows = windows_of(sum(n for x in queues.values() for _, n in x), 32)
        got = [[None] * n for n in windows]
        for w, offset, item, a, b in fill(queues, windows, 4):
            got[w][offset : offset + b - a] = [(item, k) for k in range(a, b)]
        assert got == plain_fill(queues, windows, 4)


def test_rest_is_powers_of_two():
    assert windows_of(2048 * 2 + 13, 2048) == [2048, 2048, 8, 4, 1]


def test_no_rows(spark, odd_docs):
    assert pack(odd_docs.limit(0), PATH).collect() == []
