"""Texts kept as lossless WebP samples, and features computed from what is read back."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.llm.common import blocks, utf8, written
from tidewater.llm.webp import decode_many, encode_texts, shape_of

ROW = 192  #: samples of a row of pixels; payloads are padded to it
FILL = 32
ENCODE, DECODE = 1_000_000, 12_000_000  #: bytes worked on at once: some 150 MB of arrays


def padded(n: int) -> int:
    """A positive multiple of ROW that holds n bytes."""
    return max(1, -(-n // ROW)) * ROW


def payloads(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Samples of the images of texts end to end, the offsets of the images, and the payloads' sizes."""
    n = np.diff(offsets)
    sizes = np.array([padded(k) for k in n.tolist()], np.int64)
    room = np.array([3 * w * h for w, h in map(shape_of, sizes.tolist())], np.int64)
    at = np.concatenate([[0], np.cumsum(room)])
    out = np.full(int(at[-1]), FILL, np.uint8)
    out[np.repeat(at[:-1] - offsets[:-1], n) + np.arange(len(raw))] = raw
    return out, at, sizes


def to_media(docs: DataFrame, text: str, media: str = "media") -> DataFrame:
    """docs with the text's UTF-8 bytes as a lossless WebP in `media`, and its sizes in `media_n_bytes`
    and `media_payload`, in place of the text. Null text counts as empty. Equal texts have equal files. A
    text of more than 805 million bytes is an error: the format has no larger images. An empty table gives
    no rows; other columns are kept, but for those of the three names."""
    rest = [c for c in docs.columns if c not in (text, media, "media_n_bytes", "media_payload")]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = utf8(batch.column(len(rest)))
            for lo, hi in blocks(offsets, ENCODE):
                samples, at, sizes = payloads(raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                files = encode_texts(samples, at)
                kept = [batch.column(i).slice(lo, hi - lo) for i in range(len(rest))]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(files, pa.binary()), pa.array(np.diff(offsets[lo : hi + 1])), pa.array(sizes)], names=[*rest, media, "media_n_bytes", "media_payload"])

    kept = docs.select(*rest, F.col(text).alias("_text"))
    return kept.mapInArrow(run, ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in rest), f"`{media}` binary, media_n_bytes long, media_payload long"]))


def features(pixels: np.ndarray) -> str:
    """Size, means and spreads of the channels, and edges: mean steps along rows and columns."""
    rgb = pixels[..., :3].astype(np.float32)
    across = np.abs(np.diff(rgb, axis=1)).mean()
    down = np.abs(np.diff(rgb, axis=0)).mean() if len(rgb) > 1 else 0.0
    stats = [*rgb.mean((0, 1)), *rgb.std((0, 1)), across, down]
    return f"{pixels.shape[1]}x{pixels.shape[0]};" + ",".join(f"{x:.3f}" for x in stats)


def from_media(rows: DataFrame, id: str, media: str = "media") -> DataFrame:
    """id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature: of the
    pixels decoded from `media`, as to_media() gives it."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.concatenate([[0], np.cumsum(batch.column(2).to_numpy())])
            for lo, hi in blocks(sizes, DECODE):
                files = batch.column(3).slice(lo, hi - lo).to_pylist()
                n = batch.column(2).slice(lo, hi - lo).to_pylist()
                images = decode_many(files)
                got = [image[..., :3].tobytes()[:k] for image, k in zip(images, n, strict=True)]
                cols = [
                    batch.column(0).slice(lo, hi - lo),
                    batch.column(1).slice(lo, hi - lo),
                    pa.array([len(b) for b in got], pa.int64()),
                    pa.array([hashlib.sha256(b).hexdigest() for b in got]),
                    pa.array([zlib.crc32(b[-16:]) for b in got], pa.int64()),
                    pa.array([len(f) for f in files], pa.int64()),
                    pa.array([hashlib.sha256(f).hexdigest() for f in files]),
                    pa.array([features(image) for image in images]),
                ]
                yield pa.RecordBatch.from_arrays(cols, names=["id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    kind = rows.schema[id].dataType.simpleString()
    found = rows.select(F.col(id).alias("id"), "media_n_bytes", "media_payload", media).mapInArrow(run, f"id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
    return found.withColumnRenamed("id", id)


def media_round_trip(docs: DataFrame, text: str = "text", id: str = "doc_id") -> DataFrame:
    """What from_media() tells of each row's text after it was written as WebP to the shared folder and
    read again. Null text counts as empty; null and repeated ids give a row each, an empty table none; a
    text of any length up to to_media()'s most is one image. Other columns are not read."""
    stored = written(to_media(docs.select(F.col(id).alias("id"), F.col(text).alias("text")), "text"), "media", compression="zstd")
    return from_media(stored, "id").withColumnRenamed("id", id)
