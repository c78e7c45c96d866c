"""Similarity self-join of texts by their word n-grams, with prefix trees.

Two sets of Jaccard similarity 0.8 or more differ in a ninth of their sizes at most. So if the n-grams of
both are dealt by hash to more fields than that, some fields hold the same n-grams in both, and of the
fields in any order one of these is among the first ninth and one: the order taken is the least likely
ones first, many and rare n-grams. (Small sets have an n-gram to a field.) Texts tied by such fields form
clusters. The sets of a cluster are put into a prefix tree, common n-grams first, and all sets walk down
the tree together: overlaps found on a shared path hold for all sets below it, and a branch is left as
soon as its sets' remaining lengths can't bring a link any more.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewater.llm.common import M1, blocks, dropped, grouped, keyed, mixed, utf8, written
from tidewater.llm.components import SALTS, connected_components
from tidewater.llm.shingles import set_marks, shingle_sets

BLOCK = 2_000_000
BUCKETS = 1 << 20  #: of the counts by which n-grams are ordered: 4 MB, whatever the input is
PARTS = 64  #: in which the counts are summed
#: A cluster's blocks have about SETS sets, so that no task has many more than others; in clusters of more
#: than SENDS such blocks as many more as keep each set to SENDS copies, up to MOST_SETS. GRAMS: about the most
#: n-grams of a block's sets.
SETS, SENDS, MOST_SETS, GRAMS = 256, 64, 4096, 1 << 21
#: Sets are dealt to fields by classes of size, SMALL * GROWTH ** k and more n-grams. A class has FIELDS
#: fields for each n-gram of its largest sets: some more than the 2/9 in which such sets can differ, so that
#: nearly no set has fewer fields with n-grams than the first ones that are taken.
SMALL, GROWTH, FIELDS = 80, 1.5, 0.28


def least_common(n: int) -> int:
    return (4 * n + 4) // 5


def links(a: int, b: int, common: int) -> bool:
    return 9 * common >= 4 * (a + b)


def described(docs: DataFrame, width: int) -> DataFrame:
    """A row (id, n, f1, f2) for each text, the size and marks of its set; and rows (part, counts): in
    how many texts n-grams of each bucket are."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(BUCKETS, np.uint32)
        names = ["id", "n", "f1", "f2", "part", "counts"]
        kind = None
        for batch in batches:
            kind = batch.schema.field(0).type
            raw, offsets = utf8(batch.column(1))
            for lo, hi in blocks(offsets, BLOCK):
                sets = shingle_sets(raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], width)
                marks = [set_marks(s) for s in sets]
                counts += np.bincount(np.concatenate(sets) & np.uint64(BUCKETS - 1), minlength=BUCKETS).astype(np.uint32) if len(sets) else np.uint32(0)
                k = hi - lo
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, k), pa.array(map(len, sets), pa.int64()), pa.array([m[0] for m in marks], pa.int64()), pa.array([m[1] for m in marks], pa.int64()), pa.nulls(k, pa.int32()), pa.nulls(k, pa.binary())], names=names)
        if kind is not None:
            data = [zlib.compress(c.tobytes(), 1) for c in np.split(counts, PARTS)]
            yield pa.RecordBatch.from_arrays([pa.nulls(PARTS, kind), *(pa.nulls(PARTS, pa.int64()) for _ in range(3)), pa.array(range(PARTS), pa.int32()), pa.array(data, pa.binary())], names=names)

    kind = docs.schema["id"].dataType.simpleString()
    return docs.select("id", "text").mapInArrow(run, f"id {kind}, n long, f1 long, f2 long, part int, counts binary")


def summed(rows: DataFrame) -> np.ndarray:
    """The counts of all buckets: PARTS arrays, summed by Spark and put together here."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (part,), table in grouped(batches, ["part"]):
            total = np.zeros(BUCKETS // PARTS, np.uint64)
            for data in table.column("counts"):
                total += np.frombuffer(zlib.decompress(data.as_buffer()), np.uint32)
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([np.minimum(total, 0xFFFFFFFF).astype(np.uint32).tobytes()], pa.binary())], names=["part", "counts"])

    parts = rows.where(F.col("part").isNotNull()).select("part", "counts").repartition("part").sortWithinPartitions("part").mapInArrow(run, "part int, counts binary").collect()
    out = np.zeros(BUCKETS, np.uint32)
    for r in parts:
        k = r["part"] * (BUCKETS // PARTS)
        out[k : k + BUCKETS // PARTS] = np.frombuffer(r["counts"], np.uint32)
    return out


def size_class(n: int) -> tuple[int, int]:
    """The class of sets of n n-grams, and the least size beyond it."""
    k = 0 if n < SMALL else 1 + int(math.log(n / SMALL) / math.log(GROWTH) + 1e-9)
    while k and n < math.ceil(SMALL * GROWTH ** (k - 1)):
        k -= 1
    while n >= (beyond := math.ceil(SMALL * GROWTH**k)):
        k += 1
    return k, beyond


def signatures(s: np.ndarray, weights: np.ndarray) -> list[np.ndarray]:
    """Hashes of n-grams or fields, of which two sets that link share one. s: a set, ascending; weights:
    of its n-grams, the larger the rarer."""
    n = len(s)
    k, beyond = size_class(n)
    out = []
    for k in (k, k + 1) if 5 * n >= 4 * beyond else (k,):  # the larger one of two sets may be in the next class
        beyond = math.ceil(SMALL * GROWTH**k)
        if k == 0:
            most = n - least_common(n) + 1
            hashes, key = s, weights
        else:
            fields = int(FIELDS * beyond) + 1
            most = (n + min(5 * n // 4, beyond - 1)) // 9 + 1
            field = ((s >> np.uint64(32)) * np.uint64(fields) >> np.uint64(32)).astype(np.int64)
            first = np.flatnonzero(np.append(True, field[1:] != field[:-1]))
            hashes, key = np.add.reduceat(mixed(s ^ M1), first), np.add.reduceat(weights, first)
            if len(first) < most:  # then fields without n-grams, last in the order, are needed too
                empty = np.setdiff1d(np.arange(fields), field[first])
                hashes, key = np.append(hashes, empty.astype(np.uint64)), np.append(key, np.zeros(len(empty), np.int64))
            hashes = mixed(hashes + np.array([k], np.uint64) * M1)
        if most < len(hashes):
            hashes = hashes[np.lexsort((hashes, -key))[:most]]
        out.append(hashes)
    return out


def tied(docs: DataFrame, counts, width: int) -> DataFrame:
    """Edges a, b (marks f1) between texts that share one of their signatures: of each signature, all its
    texts with the one of least mark. Within a batch they are tied at once and the signature is sent on
    once, so that no signature gathers more rows than there are batches."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pandas as pd

        total = np.log2(counts.value.sum(dtype=np.float64) + 2)
        weights = np.rint(1024 * (total - np.log2(counts.value + 1.0))).astype(np.int64)
        for batch in batches:
            raw, offsets = utf8(batch.column(0))
            grams, nodes, seen = [], [], set()
            for lo, hi in blocks(offsets, BLOCK):
                for s in shingle_sets(raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], width):
                    if len(s) < 4:  # links with equal sets alone
                        continue
                    f1, _ = mark = set_marks(s)
                    if mark in seen:
                        continue
                    seen.add(mark)
                    for found in signatures(s, weights[s & np.uint64(BUCKETS - 1)]):
                        grams.append(found)
                        nodes.append(np.full(len(found), f1, np.int64))
            if not grams:
                continue
            gram, node = np.concatenate(grams).view(np.int64), np.concatenate(nodes)
            codes, kinds = pd.factorize(gram)
            order = np.lexsort((node, codes))
            first = np.flatnonzero(np.diff(codes[order], prepend=-1))
            hub = node[order][first]
            other = hub[codes] != node
            ties = np.unique(np.stack([node[other], hub[codes[other]]], 1), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([kinds, ties[:, 0]])), pa.array(np.concatenate([hub, ties[:, 0]])), pa.array(np.concatenate([hub, ties[:, 1]]))], names=["gram", "a", "b"])

    rows = docs.select("text").mapInArrow(run, "gram long, a long, b long")
    own = Window.partitionBy("gram")
    # rows with a = b are a signature's; the others are ties and keep their end
    end = F.when(F.col("a") == F.col("b"), F.min(F.when(F.col("a") == F.col("b"), F.col("a"))).over(own)).otherwise(F.col("b"))
    return rows.select("a", end.alias("b")).where("a != b").distinct()


class PrefixTree:
    """Sets of token numbers (ascending arrays), paths with one way on put together."""

    def __init__(self, sets: list[np.ndarray]):
        order = sorted(range(len(sets)), key=lambda i: sets[i].astype(">u4").tobytes())
        self.nodes: list[tuple] = []  # tokens, depth at their end, sets that end there, children, sizes below
        self.root = self._node([(i, sets[i]) for i in order], 0)

    def _node(self, sets: list[tuple[int, np.ndarray]], depth: int):
        """The node of sorted sets that agree on their first `depth` tokens."""
        a, b = sets[0][1], sets[-1][1]
        n = min(len(a), len(b))
        differ = np.flatnonzero(a[depth:n] != b[depth:n])
        end = depth + int(differ[0]) if len(differ) else n
        ends = [i for i, s in sets if len(s) == end]
        rest = [(i, s) for i, s in sets if len(s) > end]
        children = []
        while rest:
            first = rest[0][1][end]
            k = next((k for k, (_, s) in enumerate(rest) if s[end] != first), len(rest))
            children.append((rest[:k], end))
            rest = rest[k:]
        sizes = [len(s) for _, s in sets]
        return a[depth:end], end, ends, children, min(sizes), max(sizes)

    def walk(self, own: list[np.ndarray], tokens: int) -> Iterator[tuple[np.ndarray, int]]:
        """(numbers of own, a set's number) for own sets that link with a set of the tree."""
        for lo, hi in _chunks(own, tokens):
            n = np.array([len(s) for s in own[lo:hi]], np.int64)
            flat = np.concatenate([s.astype(np.int64) + i * tokens for i, s in enumerate(own[lo:hi])])
            offsets = np.concatenate([[0], np.cumsum(n)])[:-1]
            has = np.zeros((hi - lo, tokens), bool)
            has.ravel()[flat] = True
            stack = [(self.root, np.arange(hi - lo), np.zeros(hi - lo, np.int64))]
            while stack:
                (path, depth, ends, children, least, most), who, common = stack.pop()
                if len(path):
                    common = common + np.count_nonzero(has[who[:, None], path[None, :]], axis=1)
                    size = n[who]
                    passed = np.searchsorted(flat, who * tokens + int(path[-1]), "right") - offsets[who]
                    keep = (5 * most >= 4 * size + 9 * (depth - common)) & (9 * (common + size - passed) >= 4 * (size + least)) & (5 * size >= 4 * least)
                    who, common = who[keep], common[keep]
                if not len(who):
                    continue
                for i in ends:
                    yes = who[9 * common >= 4 * (n[who] + depth)]
                    if len(yes):
                        yield yes + lo, i
                stack += [(self._node(*c), who, common) for c in children]


def _chunks(sets: list[np.ndarray], tokens: int) -> Iterator[tuple[int, int]]:
    step = max(1, 64_000_000 // max(1, tokens))
    for lo in range(0, len(sets), step):
        yield lo, min(len(sets), lo + step)


def numbered(sets: list[np.ndarray], counts: np.ndarray) -> tuple[list[np.ndarray], int]:
    """The sets as ascending numbers of their n-grams in the order that all blocks share: the commonest in
    the corpus first, of equally common ones by their hash."""
    flat = np.concatenate(sets)
    kinds, at = np.unique(flat, return_inverse=True)
    order = np.lexsort((kinds, -counts[kinds & np.uint64(BUCKETS - 1)].astype(np.int64)))
    rank = np.empty(len(kinds), np.uint32)
    rank[order] = np.arange(len(kinds), dtype=np.uint32)
    out, k = [], 0
    for s in sets:
        out.append(np.sort(rank[at[k : k + len(s)]]))
        k += len(s)
    return out, len(kinds)


def joined(sets: list[np.ndarray], weights: np.ndarray, sides: np.ndarray, one: bool, counts: np.ndarray) -> tuple[np.ndarray, list[int]]:
    """For the sets of a block (one), or of sides 0 and 1 of a pair of blocks: the weight of all sets that
    each links with, and the number of a root that linked sets share (-1: no link)."""
    sets, tokens = numbered(sets, counts)
    links, parent = np.zeros(len(sets), np.int64), list(range(len(sets)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    inside = np.arange(len(sets)) if one else np.flatnonzero(sides == 0)
    walking = inside if one else np.flatnonzero(sides == 1)
    if len(inside) and len(walking):
        for who, i in PrefixTree([sets[k] for k in inside]).walk([sets[k] for k in walking], tokens):
            who, i = walking[who], int(inside[i])
            who = who[who != i]
            links[who] += weights[i]
            if not one:
                links[i] += int(weights[who].sum())
            r = root(i)
            for k in who.tolist():
                parent[root(k)] = r
    return links, [root(i) if links[i] else -1 for i in range(len(sets))]


def verified(docs: DataFrame, wanted: DataFrame, counts, width: int) -> DataFrame:
    """node, root, links of the clusters' sets. wanted: id, f1, f2, weight, cluster, parts. A cluster of
    several blocks is joined block by block, each pair of blocks in a group of its own."""
    names = ["cluster", "pair", "one", "side", "node", "weight", "grams"]
    types = [pa.int64(), pa.int64(), pa.bool_(), pa.int32(), pa.string(), pa.int64(), pa.binary()]

    def batch_of(rows: list) -> pa.RecordBatch:
        cols = zip(*rows, strict=True) if rows else [[]] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=names)

    def sets_of(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = utf8(batch.column(0))
            cols = [batch.column(i).to_pylist() for i in range(1, 6)]
            for lo, hi in blocks(offsets, BLOCK // 4):
                rows = []
                for k, s in enumerate(shingle_sets(raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], width), lo):
                    f1, f2, weight, cluster, parts = (c[k] for c in cols)
                    if set_marks(s) != (f1, f2):  # another text of a repeated id
                        continue
                    data, own = s.tobytes(), f2 % parts
                    for other in range(parts):
                        i, j = min(own, other), max(own, other)
                        rows.append((cluster, i * parts + j, i == j, int(own == j), f"{f1}:{f2}", weight, data))
                yield batch_of(rows)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, table in grouped(batches, ["cluster", "pair"]):
            nodes, first = np.unique(np.array(table.column("node").to_pylist(), object), return_index=True)  # a repeated row's set comes again
            table = table.take(first)
            sets = [np.frombuffer(b.as_buffer(), np.uint64) for b in table.column("grams")]
            links, roots = joined(sets, table.column("weight").to_numpy(), table.column("side").to_numpy(), table.column("one")[0].as_py(), counts.value)
            found = [i for i, r in enumerate(roots) if r >= 0]
            yield pa.RecordBatch.from_arrays([pa.array([nodes[i] for i in found], pa.string()), pa.array([nodes[roots[i]] for i in found], pa.string()), pa.array([int(links[i]) for i in found], pa.int64())], names=["node", "root", "links"])

    # the sets to be joined grow with the input: never broadcast, at any size
    rows = docs.join(wanted.hint("merge"), docs["id"].eqNullSafe(wanted["id"])).select("text", "f1", "f2", "weight", "cluster", "parts")
    dealt = rows.mapInArrow(sets_of, "cluster long, pair long, one boolean, side int, node string, weight long, grams binary")
    return dealt.repartition("cluster", "pair").sortWithinPartitions("cluster", "pair").mapInArrow(run, "node string, root string, links long")


def near_duplicates(docs: DataFrame, text: str = "text", id: str = "doc_id", width: int = 5) -> DataFrame:
    """id, n_shingles, component_id, n_links of each row: the size of its set of n-grams, the smallest id
    that links lead to (its own included), and how many other rows it links with.

    Rows link where 100 * common >= 80 * all of their sets' n-grams; rows of equal sets link too. A text
    without words, or a null one, has an empty set and links with nothing. Null and repeated ids give a
    row each; a component of null ids alone has a null component_id. Other columns are not read."""
    rows = docs.select(F.col(id).alias("id"), F.col(text).alias("text"))
    facts = written(described(rows, width), "ngram-sets")
    texts = facts.where(F.col("part").isNull()).select("id", "n", "f1", "f2")
    counts = docs.sparkSession.sparkContext.broadcast(summed(facts))
    classes = written(texts.where("n > 0").groupBy("f1", "f2").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("weight"), F.max("n").alias("n")), "ngram-classes")
    clusters = connected_components(tied(rows, counts, width))
    members = classes.join(clusters.withColumnsRenamed({"node": "f1", "root": "cluster"}), "f1")
    sizes = members.groupBy("cluster").agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("grams")).where("k > 1")
    k = F.col("k")
    parts = F.greatest(F.least(F.lit(SENDS), F.ceil(k / SETS)), F.ceil(k / MOST_SETS), F.ceil(F.col("grams") / GRAMS)).cast("long").alias("parts")
    wanted = written(members.join(sizes.select("cluster", parts), "cluster").select("id", "f1", "f2", "weight", "cluster", "parts"), "ngram-clusters")
    dropped(clusters)
    links = written(verified(rows, wanted, counts, width), "ngram-links")
    dropped(wanted)
    roots = connected_components(links.select(F.col("node").alias("a"), F.col("root").alias("b")))
    sums = links.groupBy("node").agg(F.sum("links").alias("links"))
    nodes = classes.withColumn("node", F.concat_ws(":", "f1", "f2")).join(roots, "node", "left").join(sums, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = nodes.groupBy("root").agg(F.min("id").alias("component_id"))
    # a component's many members are dealt to several tasks
    least = least.withColumn("_salt", F.explode(F.array(*map(F.lit, range(SALTS)))))
    nodes = nodes.withColumn("_salt", F.pmod("f2", F.lit(SALTS)).cast("int"))
    known = nodes.join(least, ["root", "_salt"]).select("f1", "f2", "component_id", (F.col("weight") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    out = texts.join(known, ["f1", "f2"], "left")
    return out.select(F.col("id").alias(id), F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id")).alias("component_id"), F.when(F.col("n") > 0, F.col("n_links")).otherwise(F.lit(0)).alias("n_links"))


def one_of_each(docs: DataFrame, text: str = "text", id: str = "doc_id", width: int = 5) -> DataFrame:
    """docs with one row of each component of near_duplicates(): that of the smallest id. All columns are
    kept as they are.

    Rows without words stay. A null id comes before all others; rows of one id are ordered by a hash of
    their text, and of those with the same text too one stays."""
    rows, repeated = keyed(docs, id, text)
    if repeated:
        rows = rows.dropDuplicates(["doc", "tie"])
    key = F.struct("doc", "tie") if repeated else F.col("doc")
    rows = rows.select(key.alias("_key"), "_row")
    found = near_duplicates(rows.select("_key", F.col("_row").getField(text).alias("_text")), "_text", "_key", width)
    kept = found.where(F.col("_key") == F.col("component_id")).select("_key")
    return rows.join(kept, "_key", "left_semi").select("_row.*")
