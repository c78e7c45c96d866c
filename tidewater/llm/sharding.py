"""Placement of rows on shards by a permutation-filled lookup table.

Each shard has its own order of preference over the slots of a prime-sized table. Shards take turns, each
claiming the first slot of its order that is free, until the table is full. A row's slot is its key's hash
modulo the table's size. When a shard goes, the slots of the others mostly stay.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.llm.common import free

SLOTS = 65537  #: prime, at least 100 times the shards
HEX = 15  #: hex digits of the key's digest that make its slot


def preference(shard: str, slots: int) -> tuple[int, int]:
    """First slot and step of a shard's order; every step below a prime reaches all slots."""
    digest = hashlib.md5(shard.encode()).hexdigest()
    return int(digest[:16], 16) % slots, int(digest[16:], 16) % (slots - 1) + 1


def filled(shards: list[str], slots: int = SLOTS) -> np.ndarray:
    """The number of the shard that has each slot. Shards take turns in the order of their names, so the
    table doesn't depend on the order they are given in."""
    names = sorted(set(shards))
    if not names:
        raise ValueError("no shards")
    if len(names) * 100 > slots or any(slots % d == 0 for d in range(2, int(slots**0.5) + 1)):
        raise ValueError("the table's size must be prime and 100 times the number of shards at least")
    table = np.full(slots, -1, np.int32)
    orders = []
    for name in names:
        first, step = preference(name, slots)
        orders.append((first + step * np.arange(slots, dtype=np.int64)) % slots)
    at, left = [0] * len(names), slots
    while left:
        for k, order in enumerate(orders):
            while table[order[at[k]]] >= 0:
                at[k] += 1
            table[order[at[k]]] = k
            left -= 1
            if not left:
                break
    return table


def lookup_table(spark: SparkSession, shards: list[str], slots: int = SLOTS) -> DataFrame:
    """slot, shard: one row for each slot."""
    names, table = sorted(set(shards)), filled(shards, slots)
    rows = [(i, names[k]) for i, k in enumerate(table.tolist())]
    return spark.createDataFrame(rows, "slot long, shard string")


def slot_of(key: Column, slots: int = SLOTS) -> Column:
    """The slot of a key: a null key has the slot of an empty one."""
    digest = F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary"))
    return F.pmod(F.conv(F.substring(digest, 1, HEX), 16, 10).cast("long"), F.lit(slots).cast("long"))


def place(df: DataFrame, key: str, shards: list[str], slots: int = SLOTS, shard: str = "shard", slot: str = "slot") -> DataFrame:
    """df's rows with the slot and the shard of their key; columns of df with those names are replaced.

    The table has `slots` rows of some 40 bytes whatever the input is (2.6 MB by default), which is why it
    may be broadcast. Rows of equal keys share a shard; every row is kept, null keys too, and an empty
    table gives no rows."""
    rows, value = df.drop(*(c for c in (slot, shard) if c != key)), free("_key", df)
    rows = rows.withColumn(value, slot_of(F.col(key), slots)).drop(*(c for c in (slot, shard) if c == key)).withColumnRenamed(value, slot)
    table = lookup_table(df.sparkSession, shards, slots).select(F.col("slot").alias(slot), F.col("shard").alias(shard))
    return rows.join(F.broadcast(table), slot)


def write_shards(df: DataFrame, key: str, shards: list[str], path: str, parts: int = 8, **options: str) -> None:
    """Write df with a folder for each shard. A shard's rows are dealt to `parts` tasks by their slot, so
    that no shard waits for one task. Null keys lie with empty ones; an empty table leaves a folder without
    shards."""
    placed = place(df, key, shards)
    placed.repartition(len(set(shards)) * parts, "shard", F.pmod(F.col("slot"), F.lit(parts))).drop("slot").write.partitionBy("shard").options(**options).parquet(path)
