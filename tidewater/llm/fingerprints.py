"""Content-defined chunks of texts, and sets of chunk digests that measure containment."""

from __future__ import annotations

import base64
import functools
import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.llm.common import M1, blocks, mixed, utf8

WINDOW = 16  #: bytes that decide whether a chunk ends
LEAST, NORMAL, MOST = 16, 48, 1024  #: bytes of a chunk
STRICT, LOOSE = 7, 5  #: bits that must be zero before and after NORMAL bytes
BLOCK = 1_000_000


@functools.cache
def gear() -> np.ndarray:
    """A random 32-bit value for each byte."""
    return (mixed(np.arange(1, 257, dtype=np.uint64) * M1) >> np.uint64(32)).astype(np.uint32)


def gear_hashes(raw: np.ndarray) -> np.ndarray:
    """At each byte, the gear hash of the WINDOW bytes that end there: each older byte's value is
    shifted left once more. Sums over 2, 4, 8, 16 bytes follow from each other."""
    h, width = gear()[raw], 1
    while width < WINDOW:
        h[width:] += h[:-width] << np.uint32(width)
        width *= 2
    return h


def chunk_ends(strict: list[int], loose: list[int], start: int, end: int) -> list[int]:
    """Ends of the chunks of the bytes start : end. Chunks end after the first strict candidate, from
    NORMAL bytes on after the first loose one, at MOST bytes in any case (normalised chunking)."""
    from bisect import bisect_left

    out, i, j = [], bisect_left(strict, start), bisect_left(loose, start)
    while end - start > LEAST:
        i = bisect_left(strict, start + LEAST - 1, i)
        if i < len(strict) and strict[i] < start + NORMAL and strict[i] < end:
            cut = strict[i] + 1
        else:
            j = bisect_left(loose, start + NORMAL, j)
            cut = min(end, start + MOST)
            if j < len(loose) and loose[j] < cut:
                cut = loose[j] + 1
        out.append(cut)
        start = cut
    if start < end:
        out.append(end)
    return out


def fingerprints(raw: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """The fingerprint of each text: its distinct chunks, each 48 bits of digest and 16 bits of length,
    in ascending order."""
    h = gear_hashes(raw)
    loose = np.flatnonzero(h >> np.uint32(32 - LOOSE) == 0)
    strict = loose[h[loose] >> np.uint32(32 - STRICT) == 0].tolist()
    loose = loose.tolist()
    view, digest, out = memoryview(raw), xxhash.xxh3_64_intdigest, []
    edges = offsets.tolist()
    for a, b in zip(edges, edges[1:], strict=False):
        ends = chunk_ends(strict, loose, a, b)
        chunks, start = [], a
        for end in ends:
            chunks.append((digest(view[start:end]) >> 16 << 16) | (end - start))
            start = end
        out.append(np.unique(np.array(chunks, np.uint64)))
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """The share of a's distinct chunks, weighted by their lengths, that b has too; 1 of two empty ones."""
    if not len(a):
        return float(not len(b))
    weight = a & np.uint64(0xFFFF)
    return float(weight[np.isin(a, b, assume_unique=True)].sum() / weight.sum())


def written(fingerprint: np.ndarray) -> str:
    return base64.b64encode(fingerprint.astype("<u8").tobytes()).decode()


def in_order(docs: DataFrame, rows_each: int = 512, most: int = 1 << 20, each: int = 20) -> DataFrame:
    """bucket, extra, id, text: the rows dealt to buckets of neighbouring ids. A bucket ends with a copy
    (extra = 1) of the row that comes after its last one, in the last bucket of the first row of all, so
    that each bucket is worked on alone. Rows are ordered by id, nulls first, then by text.

    Buckets have some `rows_each` rows, or as many more as keep them to about `most`. They begin at ids of
    a sample by hash with some `each` ids for a bucket: the driver gets 8 bytes for each of these, 160 MB
    at most, and each task 8 bytes for each bucket."""
    null = F.col("id").isNull()
    facts = docs.agg(F.count("id").alias("n"), F.min("id").alias("least"), F.count_if(null).alias("nulls"), F.min(F.when(null, F.col("text"))).alias("text")).first()
    count = min(most, max(1, facts["n"] // rows_each))
    edges = np.zeros(0, np.int64)
    if count > 1:
        part = max(1, facts["n"] // (each * count))
        found = docs.where(~null & (F.pmod(F.xxhash64("id"), F.lit(part)) == 0)).select(F.col("id").cast("long").alias("id")).toArrow()["id"].to_numpy()
        found = np.sort(found)
        edges = np.unique(found[np.arange(1, count) * len(found) // count]) if len(found) else edges
        edges = edges[edges > facts["least"]]
    # a bucket's first id is its edge; 1 is the bucket of the least id, 0 that of nulls
    firsts, last = np.append(facts["least"] if facts["n"] else 0, edges), 1 + len(edges) if facts["n"] else 0
    shared = docs.sparkSession.sparkContext.broadcast((edges, firsts))

    @F.arrow_udf("array<long>")
    def places(ids: pa.Array, texts: pa.Array) -> pa.Array:
        edges, firsts = shared.value
        null = ids.is_null().to_numpy(zero_copy_only=False)
        known = ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        own = np.where(null, 0, np.searchsorted(edges, known, "right") + 1)
        first = ~null & (firsts[np.maximum(own - 1, 0)] == known)
        before = np.where(own > 1, own - 1, 0 if facts["nulls"] else last)
        out = [[a, b] if one else [a] for a, b, one in zip(own.tolist(), before.tolist(), first.tolist(), strict=True)]
        for i in np.flatnonzero(null).tolist():
            if texts[i].as_py() == facts["text"]:
                out[i] = [0, last]
        return pa.array(out, pa.list_(pa.int64()))

    only_null = F.when(null, F.col("text"))  # texts are looked at where the id is null alone
    dealt = docs.select("id", "text", F.posexplode(places("id", only_null)).alias("extra", "bucket"))
    return dealt.select("bucket", "extra", "id", "text").repartition("bucket").sortWithinPartitions("bucket", "extra", "id", "text")


def compare_edited(docs: DataFrame, text: str = "text", id: str = "doc_id") -> DataFrame:
    """Fingerprints of each text and of its edit, whose last half is replaced by the start of the next
    text in ascending id: id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited,
    near_next (the shares of the text's chunks that the edit and the next text have).

    Null text counts as empty; two empty texts are alike (1), an empty one and another are not (0). Texts
    of any length are taken whole, one at a time where they are long. Null ids come first and repeated ids
    follow each other by text, a row each; a single row is its own next one. An empty table gives no rows.
    Other columns are not read, whatever their names."""
    rows = docs.select(F.col(id).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    names = [id, "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def made(ids: list, texts: list[str], same: list[bool], own: list[bool]) -> pa.RecordBatch:
        """Of all rows but the last, which is only the next of the one before it."""
        raw, offsets = utf8(pa.array(texts, pa.large_string()))
        marks = fingerprints(raw, offsets)
        chosen = [i for i in range(len(texts) - 1) if own[i] and same[i + 1]]
        edits = [texts[i][: len(texts[i]) - len(texts[i]) // 2] + texts[i + 1][: len(texts[i]) // 2] for i in chosen]
        edited = fingerprints(*utf8(pa.array(edits, pa.large_string())))
        cols = [
            [ids[i] for i in chosen],
            [len(texts[i]) for i in chosen],
            [hashlib.sha256(e.encode()).hexdigest() for e in edits],
            [written(marks[i]) for i in chosen],
            [written(e) for e in edited],
            [likeness(marks[i], e) for i, e in zip(chosen, edited, strict=True)],
            [likeness(marks[i], marks[i + 1]) for i in chosen],
        ]
        types = [pa.int64() if kind == "bigint" else None, pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=names)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[list, list, list, list] = ([], [], [], [])
        for batch in batches:
            _, offsets = utf8(batch.column(3))
            for lo, hi in blocks(offsets, BLOCK):
                buckets, extra, ids, texts = (held[k] + batch.column(k).slice(lo, hi - lo).to_pylist() for k in range(4))
                same = [False] + [a == b for a, b in zip(buckets, buckets[1:], strict=False)]
                yield made(ids, texts, same, [not x for x in extra])
                held = (buckets[-1:], extra[-1:], ids[-1:], texts[-1:])

    return in_order(rows).mapInArrow(run, f"{id} {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
