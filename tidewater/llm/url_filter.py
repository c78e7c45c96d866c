"""URL rules by a cascade of Bloom filters.

Level 1 holds the listed keys. The keys of the corpus that it takes for listed without their being so make
level 2, the listed keys that level 2 takes for those make level 3, and so on until none is left. Looked up
in turn, the levels tell every key of the corpus exactly, without a join.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.llm.common import M1, M2, free, mixed

#: A rule: (host, path, verdict), the verdict allow or block.
Rule = tuple[str, str, str]
CLASS = 1 << 22  #: about the most rules of one class of hashes, which has a cascade of its own


@dataclass(frozen=True)
class Level:
    """One Bloom filter over 64-bit hashes, which each level salts for itself."""

    bits: int
    hashes: int
    words: np.ndarray
    salt: int

    @staticmethod
    def of(keys: np.ndarray, rate: float, salt: int = 0) -> Level:
        n = max(1, len(keys))
        bits = max(64, math.ceil(-n * math.log(rate) / math.log(2) ** 2))
        level = Level(bits, max(1, round(bits / n * math.log(2))), np.zeros(-(-bits // 64), np.uint64), salt)
        for at in level._at(keys):
            np.bitwise_or.at(level.words, at >> np.uint64(6), np.uint64(1) << (at & np.uint64(63)))
        return level

    def _at(self, keys: np.ndarray):
        keys = mixed(keys ^ np.uint64(self.salt * int(M2) % (1 << 64)))
        step = mixed(keys + M1) | np.uint64(1)
        for k in range(self.hashes):
            yield (keys + np.uint64(k) * step) % np.uint64(self.bits)

    def has(self, keys: np.ndarray) -> np.ndarray:
        out = np.ones(len(keys), bool)
        for at in self._at(keys):
            out &= self.words[at >> np.uint64(6)] >> (at & np.uint64(63)) & np.uint64(1) != 0
        return out


def cascade(listed: np.ndarray, mistaken: np.ndarray, first: Level, rate: float = 0.5) -> list[Level]:
    """The levels after `first`: mistaken are the unlisted keys of the universe that it holds."""
    levels, inside, outside = [first], listed, mistaken
    while len(outside):
        level = Level.of(outside, rate, len(levels))
        levels.append(level)
        inside, outside = outside, inside[level.has(inside)]
        if len(levels) > 64:
            raise ValueError("two keys have the same hashes")
    return levels


def contains(levels: list[Level], keys: np.ndarray) -> np.ndarray:
    """Whether each key of the universe is listed: the number of levels that hold it in turn is odd."""
    depth = np.zeros(len(keys), np.int64)
    alive = np.ones(len(keys), bool)
    for level in levels:
        alive[alive] = level.has(keys[alive])
        depth += alive
    return depth % 2 == 1


@dataclass(frozen=True)
class Cascades:
    """A cascade for each class of hashes, so that no level grows with the whole list."""

    classes: list[list[Level]]

    @staticmethod
    def classed(keys: np.ndarray, count: int) -> list[np.ndarray]:
        of = (mixed(keys ^ M2) % np.uint64(count)).astype(np.int64)
        order = np.argsort(of, kind="stable")
        return np.split(keys[order], np.searchsorted(of[order], np.arange(1, count)))

    def has(self, keys: np.ndarray) -> np.ndarray:
        if len(self.classes) == 1:
            return contains(self.classes[0], keys)
        of = (mixed(keys ^ M2) % np.uint64(len(self.classes))).astype(np.int64)
        out = np.zeros(len(keys), bool)
        for k, levels in enumerate(self.classes):
            own = np.flatnonzero(of == k)
            if len(own):
                out[own] = contains(levels, keys[own])
        return out


def host_of(url: Column) -> Column:
    found = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(found, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def probes(host: Column, path: Column, rules: list[Rule]) -> Column:
    """The keys that a url could be listed by, longest first: its host's last labels, as many as some
    rule's host has, before its path's first characters, as many as some rule's path has."""
    labels = sorted({h.count(".") + 1 for h, _, _ in rules}, reverse=True)
    lengths = sorted({len(p) for _, p, _ in rules}, reverse=True)
    keys = [F.concat(F.substring_index(host, ".", -n), F.substring(path, 1, k) if k else F.lit("")) for n in labels for k in lengths]
    return F.array_distinct(F.array(*keys))


def judge(pages: DataFrame, rules: list[Rule], url: str = "url", default: str = "allow") -> DataFrame:
    """pages with host, path, rule and verdict; columns of those names are replaced.

    A rule fits its host and all subdomains where the path starts with the rule's; the longest host and
    path in all wins, of equals the longer host. Urls that no rule fits get the default verdict and a
    null rule. A null url, or one without "://", has an empty host and path. Every row is kept.

    The universe is every key that some url of `pages` could be listed by. Rules are a list on the
    driver; what is gathered there besides are 8 bytes for each unlisted key that the first level holds,
    which its rate keeps to fewer than there are rules. What is broadcast grows with the list alone, by
    some 40 bits a rule. An empty table gives no rows."""
    spark = pages.sparkSession
    if not rules:
        rows = pages.withColumns({"host": host_of(F.col(url)), "path": path_of(F.col(url))})
        return rows.withColumns({"rule": F.lit(None).cast("string"), "verdict": F.lit(default)})
    kinds = {h + p: v for h, p, v in rules}
    if not {*kinds.values()} <= {"allow", "block"} or len(kinds) < len(rules):
        raise ValueError("each host and path has one rule, to allow or to block")
    list_rows = spark.createDataFrame(pa.table({"key": [*kinds], "block": [v == "block" for v in kinds.values()]}))
    hashed = list_rows.select(F.xxhash64("key").alias("h"), "block").toArrow()
    listed, blocks = hashed["h"].to_numpy().view(np.uint64), hashed["block"].to_numpy(zero_copy_only=False)

    keys = pages.select(F.explode(probes(host_of(F.col(url)), path_of(F.col(url)), rules)).alias("key"))
    universe = keys.agg(F.approx_count_distinct("key").alias("n")).first()["n"]
    count = -(-len(listed) // CLASS)
    rate = min(0.5, len(listed) / (math.sqrt(2) * max(universe, len(listed))))
    firsts = [Level.of(own, rate) for own in Cascades.classed(listed, count)]
    shared = spark.sparkContext.broadcast(Cascades([[level] for level in firsts]))

    @F.arrow_udf("boolean")
    def held(h: pa.Array) -> pa.Array:
        return pa.array(shared.value.has(h.to_numpy(zero_copy_only=False).view(np.uint64)))

    taken = keys.where(held(F.xxhash64("key"))).distinct()
    mistaken = taken.join(list_rows, "key", "left_anti").select(F.xxhash64("key").alias("h")).toArrow()["h"].to_numpy().view(np.uint64)
    parts = zip(Cascades.classed(listed, count), Cascades.classed(mistaken, count), firsts, strict=True)
    levels = spark.sparkContext.broadcast(Cascades([cascade(inside, outside, first) for inside, outside, first in parts]))

    @F.arrow_udf("array<boolean>")
    def known(h: pa.Array) -> pa.Array:
        flat = levels.value.has(h.flatten().to_numpy(zero_copy_only=False).view(np.uint64))
        return pa.ListArray.from_arrays(pa.array(h.offsets.to_numpy() - h.offsets[0].as_py(), pa.int32()), pa.array(flat))

    # among the listed keys, those that block: the universe is the list itself
    of_class = []
    for block, allow in zip(Cascades.classed(listed[blocks], count), Cascades.classed(listed[~blocks], count), strict=True):
        start = Level.of(block, 0.5)
        of_class.append(cascade(block, allow[start.has(allow)], start))
    verdicts = spark.sparkContext.broadcast(Cascades(of_class))

    @F.arrow_udf("boolean")
    def blocked(h: pa.Array) -> pa.Array:
        return pa.array(verdicts.value.has(h.to_numpy(zero_copy_only=False).view(np.uint64)))

    rows = pages.withColumns({"host": host_of(F.col(url)), "path": path_of(F.col(url))})
    asked, listed_too = free("_keys", rows), free("_known", rows)
    rows = rows.withColumn(asked, probes(F.col("host"), F.col("path"), rules))
    rows = rows.withColumn(listed_too, known(F.transform(asked, lambda k: F.xxhash64(k))))
    hit = F.filter(F.zip_with(asked, listed_too, lambda k, x: F.when(x, k)), lambda k: k.isNotNull())
    # of the keys found the longest, and of equal ones that with the longer host
    best = F.array_max(F.transform(hit, lambda k: F.struct(F.length(k).alias("n"), F.length(F.substring_index(k, "/", 1)).alias("host"), k.alias("key"))))
    rows = rows.withColumn("rule", best["key"])
    rule = F.col("rule")
    verdict = F.when(rule.isNotNull() & F.coalesce(blocked(F.xxhash64(rule)), F.lit(False)), "block").when(rule.isNotNull(), "allow").otherwise(default)
    return rows.withColumn("verdict", verdict).drop(asked, listed_too)
