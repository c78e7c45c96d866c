"""Connected components of a graph that is given by its edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from tidewater.llm.common import dropped, written


SALTS = 8  #: tasks that a node's neighbours are dealt to


def _kept(edges: DataFrame) -> tuple[DataFrame, tuple]:
    """Edges as a table, and what tells whether they are the same as another round's: found as they are written."""
    seen = Observation()
    out = written(edges.distinct().observe(seen, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)")).alias("h")), "edges")
    return out, (seen.get.get("n"), seen.get.get("h"))


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """node, root of every node of the edges a, b (of any type with an order; nodes not null): root is
    the component's smallest node, itself for that one.

    Large and small stars take turns until nothing changes: each node's neighbours are tied to its
    smallest one. The smallest is found by partial sums and joined, so that a node with very many
    neighbours is not gathered anywhere; each round's edges are written to the shared folder."""
    now, state = _kept(edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")))
    for _ in range(rounds):
        if not state[0]:
            break
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        # a node's many neighbours are dealt to several tasks, each of which gets the node's smallest one
        least = least.withColumn("s", F.explode(F.array(*map(F.lit, range(SALTS)))))
        salted = both.withColumn("s", F.pmod(F.xxhash64("b"), F.lit(SALTS)).cast("int"))
        large = salted.join(least, ["a", "s"]).where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        ties = large.join(least, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
        before, last = now, state
        now, state = _kept(ties.select("e.*").where("a != b"))
        dropped(before)
        if state == last:
            break
    else:
        raise RuntimeError("the components did not settle")
    out = now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
    out.written_at = now.written_at  # what dropped() deletes
    return out
