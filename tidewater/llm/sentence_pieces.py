"""SentencePiece encoding and decoding with a byte-pair model, by suffix arrays over batches of text.

White space is a visible mark, and no piece has the mark after another character, so that a text falls into
chunks (marks and the characters up to the next mark) that are encoded alone. The chunks of a batch that
were not met before are put end to end and indexed by a suffix array; every piece is searched in it, all by
one binary search, and each place where it occurs is an edge from its beginning to its end. Edges are sorted
by position and relaxed, longest first: a prefix of a chunk has one encoding, which ends in one piece, and an
edge extends the encoding of its beginning's prefix if the model, given that last piece and the edge's alone,
keeps the two. That holds for one edge into each position, so that a position is reached once, and the path
to the chunk's end is the model's own: merges inside the pieces come in the same order in the whole chunk,
and one across two pieces would come in the two alone.
"""

from __future__ import annotations

import hashlib
import zlib
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.llm.common import blocks, utf8
from tidewater.llm.pretokens import code_points, hashes

MARK = "▁"
BLOCK = 2_000_000  #: bytes indexed at once: some 150 MB of arrays and lists
BARRIER, OTHER = 1, 2  #: numbers of the end of a chunk and of characters that no piece has; 0 is below all
PACK = 4  #: characters of 16 bits in a 64-bit word

_LOADED: dict[str, PieceModel] = {}


class PieceModel:
    """The pieces of a byte-pair model file, and what was found of chunks and pairs of pieces so far.

    At most `keep` chunks and pairs are held in a worker (some 150 MB); beyond that they are dropped and
    found again."""

    def __init__(self, path: str, keep: int = 600_000):
        from sentencepiece import sentencepiece_model_pb2 as pb

        model = pb.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        spec = model.normalizer_spec
        if model.trainer_spec.model_type != pb.TrainerSpec.BPE or spec.precompiled_charsmap or spec.remove_extra_whitespaces or not spec.escape_whitespaces:
            raise ValueError("a byte-pair model that keeps the text as it is is needed")
        self.prefix = MARK if spec.add_dummy_prefix else ""
        kinds = pb.ModelProto.SentencePiece
        self.bytes = {int(p.piece[3:5], 16): i for i, p in enumerate(model.pieces) if p.type == kinds.BYTE}
        self.unknown = next(i for i, p in enumerate(model.pieces) if p.type == kinds.UNKNOWN)
        surface = {kinds.BYTE: lambda p: bytes([int(p[3:5], 16)]), kinds.UNKNOWN: lambda p: model.trainer_spec.unk_surface.encode(), kinds.CONTROL: lambda p: b""}
        self.surface = [surface.get(p.type, lambda p: p.replace(MARK, " ").encode())(p.piece) for p in model.pieces]
        self.id = {p.piece: i for i, p in enumerate(model.pieces) if p.type == kinds.NORMAL}
        self.score = {p.piece: p.score for p in model.pieces if p.type == kinds.NORMAL}
        if any(MARK in p.lstrip(MARK) for p in self.id):
            raise ValueError("pieces that go on past white space are not known here")
        self.keep, self.known, self.pairs = keep, {}, {}
        alphabet = sorted({c for p in self.id for c in p})
        if not all(c in self.id for c in alphabet):
            raise ValueError("every character of a piece must be a piece")
        self.number = np.full(0x110000, OTHER, np.uint16)
        self.number[[ord(c) for c in alphabet]] = np.arange(OTHER + 1, OTHER + 1 + len(alphabet))
        self.own = [p for p in self.id if self.merged(p) == [p]]  # others end no encoding
        self.lengths = np.array([len(p) for p in self.own], np.int64)
        self.words = -(-int(self.lengths.max()) // PACK)
        wide = np.zeros((len(self.own), self.words * PACK), np.uint16)
        for i, p in enumerate(self.own):
            wide[i, : len(p)] = self.number[[ord(c) for c in p]]
        self.least = _packed(wide)
        wide[np.arange(wide.shape[1]) >= self.lengths[:, None]] = 0xFFFF
        self.most = _packed(wide)

    def merged(self, text: str) -> list[str]:
        """The pieces of a short text: of neighbours whose union is a piece, the best are put together."""
        parts, score = list(text), self.score
        while True:
            found = [(-score[u], k) for k, u in enumerate(map(str.__add__, parts, parts[1:])) if u in score]
            if not found:
                return parts
            k = min(found)[1]
            parts[k : k + 2] = [parts[k] + parts[k + 1]]

    def fits(self, a: int, b: int) -> bool:
        """Whether two of the model's own pieces stay as they are next to each other."""
        x, y = self.own[a], self.own[b]
        r = self.pairs[a * len(self.own) + b] = self.merged(x + y) == [x, y]
        return r

    def edges(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Beginning, end and piece of each occurrence, by beginning and then longest first."""
        n = len(numbers)
        padded = np.concatenate([numbers, np.zeros(self.words * PACK, np.uint16)])
        packed = _packed(np.lib.stride_tricks.sliding_window_view(padded, PACK)[: n + PACK * (self.words - 1)])[:, 0]
        columns = [packed[k * PACK : k * PACK + n] for k in range(self.words)]
        # sorted by PACK characters, then by ranks of twice as many each time, as far as pieces reach
        key, width = columns[0], PACK
        while True:
            array = np.argsort(key)
            if width >= self.words * PACK:
                break
            rank = np.empty(n + width, np.uint64)
            rank[n:] = 0
            rank[array] = np.cumsum(np.diff(key[array], prepend=key[array[0]]) != 0).astype(np.uint64) + np.uint64(1)
            key, width = rank[:n] << np.uint64(32) | rank[width : n + width], 2 * width
        low = _search(array, columns, self.least, strict=True)
        high = _search(array, columns, self.most, strict=False)
        counts = high - low
        piece = np.repeat(np.arange(len(counts)), counts)
        begin = array[np.repeat(low - (np.cumsum(counts) - counts), counts) + np.arange(len(piece))]
        # characters without a piece are edges too: of length 1, and nothing merges with them
        alone = np.flatnonzero(numbers == OTHER)
        begin, piece = np.append(begin, alone), np.append(piece, np.full(len(alone), -1))
        end = begin + np.append(self.lengths, 1)[piece]
        order = np.argsort((begin << 16) + (begin - end))
        return begin[order], end[order], piece[order]

    def relaxed(self, chunks: list[str]) -> list[bytes]:
        """The ids of each chunk, as 32-bit numbers."""
        cp, offsets = code_points([c + "\0" for c in chunks])
        numbers = self.number[cp]
        numbers[offsets[1:] - 1] = BARRIER
        begin, ends, pieces = self.edges(numbers)
        heads = np.searchsorted(begin, np.arange(len(numbers) + 1)).tolist()
        end, piece, n, pairs = ends.tolist(), pieces.tolist(), len(self.own), self.pairs
        met = bytearray(len(numbers) + 1)
        own_ids = [self.id[p] for p in self.own]
        out = []
        for a, e in zip(offsets.tolist(), (offsets[1:] - 1).tolist(), strict=False):
            at, before, i = a, -1, heads[a]
            path: list[int] = []  # edges up to here; what they began with is told by the one before
            while at != e:
                stop = heads[at + 1]
                while i < stop:
                    p = piece[i]
                    if not met[end[i]]:
                        if before < 0 or p < 0:
                            break
                        fits = pairs.get(before * n + p)
                        if self.fits(before, p) if fits is None else fits:
                            break
                    i += 1
                if i < stop:
                    path.append(i)
                    at, before = end[i], p
                    met[at] = 1
                    i = heads[at]
                else:  # nothing goes on from here: the edge before was not the encoding's
                    i = path.pop() + 1
                    before = piece[path[-1]] if path else -1
                    at = end[path[-1]] if path else a
            ids: list[int] = []
            for i in path:
                p = piece[i]
                if p >= 0:
                    ids.append(own_ids[p])
                elif self.bytes:
                    ids += [self.bytes[x] for x in chr(cp[end[i] - 1]).encode()]
                else:
                    ids.append(self.unknown)
            out.append(array("I", ids).tobytes())
        return out

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts end to end, and the offsets of each text's."""
        import pandas as pd

        marked = [self.prefix + t.replace(" ", MARK) if t else "" for t in texts]
        cp, offsets = code_points(marked)
        if not len(cp):
            return np.zeros(0, np.uint32), np.zeros(len(texts) + 1, np.int64)
        mark = cp == ord(MARK)
        new = np.zeros(len(cp), bool)
        new[offsets[:-1][offsets[:-1] < offsets[1:]]] = True
        new[1:] |= mark[1:] & ~mark[:-1]
        starts = np.flatnonzero(new)
        lengths = np.diff(np.append(starts, len(cp)))
        codes, kinds = pd.factorize(hashes(cp, starts, lengths))
        where = np.empty(len(kinds), np.int64)
        where[codes[::-1]] = np.arange(len(codes) - 1, -1, -1)
        if len(self.known) > self.keep:
            self.known = {}
        if len(self.pairs) > self.keep:
            self.pairs = {}
        kinds = kinds.tolist()
        fresh = [k for k, h in enumerate(kinds) if h not in self.known]
        joined = "".join(marked)
        if fresh:
            chunks = [joined[starts[where[k]] : starts[where[k]] + lengths[where[k]]] for k in fresh]
            for k, ids in zip(fresh, self.relaxed(chunks), strict=True):
                self.known[kinds[k]] = ids
        found = [self.known[h] for h in kinds]
        sizes = np.array([len(x) // 4 for x in found], np.int64)
        begins = np.cumsum(sizes) - sizes
        counts = sizes[codes]
        ends = np.cumsum(counts)
        flat = np.frombuffer(b"".join(found), np.uint32)[np.repeat(begins[codes] - (ends - counts), counts) + np.arange(ends[-1])]
        return flat, np.append(0, ends)[np.searchsorted(starts, offsets)]

    def decode(self, ids: Iterable[int]) -> str:
        """The text of ids. Bytes that make no character become replacement characters."""
        text = b"".join(map(self.surface.__getitem__, ids)).decode(errors="replace")
        return text[1:] if self.prefix and text.startswith(" ") else text


def _packed(wide: np.ndarray) -> np.ndarray:
    """Rows of 16-bit numbers as rows of 64-bit words in the same order."""
    out = np.zeros((len(wide), wide.shape[1] // PACK), np.uint64)
    for k in range(PACK):
        out = out << np.uint64(16) | wide[:, k::PACK].astype(np.uint64)
    return out


def _search(array: np.ndarray, columns: list[np.ndarray], wanted: np.ndarray, strict: bool) -> np.ndarray:
    """How many suffixes are below each wanted row (strict), or not above it."""
    low, high = np.zeros(len(wanted), np.int64), np.full(len(wanted), len(array), np.int64)
    while (busy := np.flatnonzero(low < high)).size:
        middle = (low[busy] + high[busy]) // 2
        at = array[middle]
        below = np.zeros(len(busy), bool)
        tied = np.ones(len(busy), bool)
        for k, column in enumerate(columns):
            x, y = column[at], wanted[busy, k]
            below |= tied & (x < y)
            tied &= x == y
        below |= tied & (not strict)
        low[busy[below]] = middle[below] + 1
        high[busy[~below]] = middle[~below]
    return low


def model(path: str) -> PieceModel:
    """One model for each worker process."""
    if path not in _LOADED:
        _LOADED[path] = PieceModel(path)
    return _LOADED[path]


def encode(docs: DataFrame, path: str, text: str = "text", id: str = "doc_id") -> DataFrame:
    """id, n_bytes and ids (of the model at `path`) of each row's whole text.

    Null text counts as empty: no ids. Null and repeated ids give a row each, an empty table none; a text of
    any length is encoded whole, alone if it is longer than a block. Other columns are not read, whatever
    their names. Names of control pieces inside a text are ordinary text."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(path)
        for batch in batches:
            column = batch.column(1)
            _, offsets = utf8(column)
            for lo, hi in blocks(offsets, BLOCK):
                ids, at = m.encode([t or "" for t in column.slice(lo, hi - lo).to_pylist()])
                lists = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(np.diff(offsets[lo : hi + 1])), lists], names=["id", "n_bytes", "ids"])

    kind = docs.schema[id].dataType.simpleString()
    rows = docs.select(F.col(id).alias("id"), F.col(text).alias("text")).mapInArrow(run, f"id {kind}, n_bytes long, ids array<int>")
    return rows.withColumnRenamed("id", id)


def decode(rows: DataFrame, path: str, ids: str = "ids", text: str = "text") -> DataFrame:
    """rows with the decoded text in place of the column of ids; null ids give a null text, empty lists an
    empty one. Repeated rows give a row each, an empty table none; other columns are kept but for `text`."""
    rest = [c for c in rows.columns if c not in (ids, text)]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(path)
        for batch in batches:
            lists = batch.column(len(rest))
            sizes = np.concatenate([[0], np.cumsum(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))])
            for lo, hi in blocks(sizes, BLOCK // 4):
                texts = [None if x is None else m.decode(x) for x in lists.slice(lo, hi - lo).to_pylist()]
                yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(lo, hi - lo) for i in range(len(rest))), pa.array(texts, pa.string())], names=[*rest, text])

    schema = ", ".join([*(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in rest), f"`{text}` string"])
    return rows.select(*rest, ids).mapInArrow(run, schema)


def digests(docs: DataFrame, path: str, text: str = "text", id: str = "doc_id") -> DataFrame:
    """id, n_bytes, n_tokens, ids_crc32 (of the ids as little-endian unsigned 32-bit numbers) and
    decoded_sha256 (of what decoding the ids gives) of each row, as encode() and decode() find them.

    Null text counts as empty: no ids, and what decodes from none. Null and repeated ids give a row each, an
    empty table none; very long texts are whole. Other columns are not read."""

    def sums(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(path)
        for batch in batches:
            lists = batch.column(2)
            n, crc, sha = [], [], []
            for k in range(batch.num_rows):
                ids = lists[k].values.to_numpy(zero_copy_only=False)
                n.append(len(ids))
                crc.append(zlib.crc32(ids.astype("<u4").tobytes()))
                sha.append(hashlib.sha256(m.decode(ids.tolist()).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(crc, pa.int64()), pa.array(sha, pa.string())], names=["id", "n_bytes", "n_tokens", "ids_crc32", "decoded_sha256"])

    kind = docs.schema[id].dataType.simpleString()
    coded = encode(docs, path, text, id).withColumnRenamed(id, "id")
    return coded.mapInArrow(sums, f"id {kind}, n_bytes long, n_tokens long, ids_crc32 long, decoded_sha256 string").withColumnRenamed("id", id)
