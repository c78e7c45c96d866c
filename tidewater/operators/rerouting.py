"""Flows of a closed or busy site on other edges."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _date(d: str):
    return F.lit(d).cast("date")


def _days(first: str, n: int):
    return F.col("day").between(_date(first), F.date_add(_date(first), n - 1))


def capacities(edges: DataFrame, before: str) -> DataFrame:
    return edges.where(F.col("day") < _date(before)).groupBy("origin", "dest").agg(F.max("volume").alias("capacity"))


def candidates(edges: DataFrame, closed: str, first: str, days: int, split: str) -> DataFrame:
    """Flows of the closed site on `days` days, each with every other site that could stand in for it and
    the room that edge has. Sites are a fixed list, so that a flow has a bounded number of candidates."""
    period = edges.where(_days(first, days))
    caps = capacities(edges, split)
    flows = period.where((F.col("origin") == closed) != (F.col("dest") == closed))
    sites = edges.select(F.explode(F.array("origin", "dest")).alias("site")).distinct().where(F.col("site") != closed)
    options = flows.join(F.broadcast(sites), (F.col("site") != F.col("origin")) & (F.col("site") != F.col("dest")))
    inbound = F.col("dest") == closed
    options = options.withColumns({"new_origin": F.when(inbound, F.col("origin")).otherwise(F.col("site")), "new_dest": F.when(inbound, F.col("site")).otherwise(F.col("dest"))})
    used = period.select(F.col("origin").alias("new_origin"), F.col("dest").alias("new_dest"), "day", F.col("volume").alias("_used"))
    largest = F.broadcast(caps.agg(F.max("capacity").alias("_most")))
    rows = options.join(caps.withColumnsRenamed({"origin": "new_origin", "dest": "new_dest"}), ["new_origin", "new_dest"], "left").join(used, ["new_origin", "new_dest", "day"], "left").join(largest)
    rows = rows.withColumn("spare", F.coalesce("capacity", "_most") - F.coalesce("_used", F.lit(0.0)))
    return rows.where("spare > 0").select("origin", "dest", "day", "volume", "site", "new_origin", "new_dest", "spare")


def greedy(options: DataFrame) -> DataFrame:
    """day, origin, dest, new_origin, new_dest, demand, served: the day's largest flows first, each into
    the edges with most room. What is left has no new edge. A day is one group: its flows and candidates
    are bounded by the number of sites squared."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        room = {(r.new_origin, r.new_dest): r.spare for r in rows.itertuples()}
        out = []
        flows = rows[["origin", "dest", "volume"]].drop_duplicates().sort_values(["volume", "origin", "dest"], ascending=[False, True, True])
        for f in flows.itertuples():
            mine = rows[(rows["origin"] == f.origin) & (rows["dest"] == f.dest)]
            left = f.volume
            for o, d in sorted(zip(mine["new_origin"], mine["new_dest"]), key=lambda e: (-room[e], e)):
                take = min(left, room[o, d])
                if take > 0:
                    room[o, d] -= take
                    left -= take
                    out.append((key[0], f.origin, f.dest, o, d, f.volume, take))
            if left > 0:
                out.append((key[0], f.origin, f.dest, None, None, f.volume, left))
        return pd.DataFrame(out, columns=["day", "origin", "dest", "new_origin", "new_dest", "demand", "amount"])

    return options.groupBy("day").applyInPandas(run, "day date, origin string, dest string, new_origin string, new_dest string, demand double, amount double")


def balance(allocation: DataFrame) -> DataFrame:
    """day, demand, served, unserved, balanced."""
    served = F.sum(F.when(F.col("new_origin").isNotNull(), F.col("amount")).otherwise(0.0))
    flows = allocation.groupBy("day", "origin", "dest").agg(F.first("demand").alias("demand"), served.alias("served"), F.sum("amount").alias("total"))
    days = flows.groupBy("day").agg(F.sum("demand").alias("demand"), F.sum("served").alias("served"), F.sum("total").alias("total"))
    return days.select("day", "demand", "served", (F.col("total") - F.col("served")).alias("unserved"), (F.abs(F.col("total") - F.col("demand")) < 1e-6).alias("balanced"))


def staged_sites(nodes: DataFrame, edges: DataFrame, core: int, most: int) -> DataFrame:
    """site, stage, position: the core, then what important edges tie to it, then sites under load; a site
    counts where it comes first. All tables here have a row for each site or pair of sites."""
    top = nodes.orderBy(F.desc("score"), "site").limit(core).select("site")
    marked = edges.join(top.select(F.col("site").alias("origin"), F.lit(True).alias("_o")), "origin", "left").join(top.select(F.col("site").alias("dest"), F.lit(True).alias("_d")), "dest", "left")
    one = marked.where(F.col("_o").isNotNull() != F.col("_d").isNotNull())
    tied = one.select(F.when(F.col("_o").isNotNull(), F.col("dest")).otherwise(F.col("origin")).alias("site"), F.lit(2).alias("stage"), F.row_number().over(Window.orderBy(F.desc("score"), "origin", "dest")).alias("place"))
    loaded = nodes.select("site", F.lit(3).alias("stage"), F.row_number().over(Window.orderBy(F.desc("peak"), "site")).alias("place"))
    staged = top.select("site", F.lit(1).alias("stage"), F.lit(0).alias("place")).unionByName(tied).unionByName(loaded)
    once = staged.groupBy("site").agg(F.min(F.struct("stage", "place")).alias("s")).select("site", "s.*")
    return once.withColumn("position", F.row_number().over(Window.orderBy("stage", "place", "site"))).where(F.col("position") <= most).select("site", "stage", "position")


def diverted(edges: DataFrame, hub: str, first: str, days: int, split: str, sites: DataFrame, top: DataFrame, part: float = 0.2) -> DataFrame:
    """day, origin, dest, planned, amount: `part` of each top edge's volume by way of the hub where both ends
    are chosen sites, in the order of the edges, as far as both new edges and half the hub's room allow. A
    day is one group, of at most as many rows as pairs of sites; sites and top edges are short lists."""
    caps = capacities(edges, split)
    rows = edges.where(_days(first, days)).join(caps, ["origin", "dest"], "left").fillna(0.0, ["capacity"])
    ends = [F.broadcast(sites.select(F.col("site").alias(c), F.lit(True).alias(f"_{c}")).distinct()) for c in ("origin", "dest")]
    rows = rows.join(ends[0], "origin", "left").join(ends[1], "dest", "left").join(F.broadcast(top.select("origin", "dest", F.lit(True).alias("_top"))), ["origin", "dest"], "left")
    chosen = F.col("_origin").isNotNull() & F.col("_dest").isNotNull() & F.col("_top").isNotNull()
    rows = rows.select("day", "origin", "dest", "volume", "capacity", chosen.alias("chosen"))

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        room = {(r.origin, r.dest): max(0.0, r.capacity - r.volume) for r in rows.itertuples()}
        touching = rows[(rows["origin"] == hub) | (rows["dest"] == hub)]
        hub_room = max(0.0, float((touching["capacity"] - touching["volume"]).sum()))
        out = []
        for r in rows[rows["chosen"]].sort_values(["origin", "dest"]).itertuples():
            if hub in (r.origin, r.dest) or r.origin == r.dest:
                continue
            planned = part * r.volume
            amount = min(planned, room.get((r.origin, hub), 0.0), room.get((hub, r.dest), 0.0), hub_room / 2)
            if amount > 0:
                room[r.origin, hub] -= amount
                room[hub, r.dest] -= amount
                hub_room -= 2 * amount
                out.append((key[0], r.origin, r.dest, planned, amount))
        return pd.DataFrame(out, columns=["day", "origin", "dest", "planned", "amount"])

    return rows.groupBy("day").applyInPandas(run, "day date, origin string, dest string, planned double, amount double")


def changes(edges: DataFrame, options: DataFrame, closed: str, day: str) -> DataFrame:
    """status, edges, volume: edges of the day that close, stay active and may open."""
    today = edges.where(F.col("day") == _date(day))
    status = F.when((F.col("origin") == closed) | (F.col("dest") == closed), "closed").otherwise("active")
    new = options.where(F.col("day") == _date(day)).select(F.col("new_origin").alias("origin"), F.col("new_dest").alias("dest")).distinct().join(today, ["origin", "dest"], "left_anti")
    rows = today.select(status.alias("status"), "volume").unionByName(new.select(F.lit("opened").alias("status"), F.lit(0.0).alias("volume")))
    return rows.groupBy("status").agg(F.count(F.lit(1)).alias("edges"), F.sum("volume").alias("volume"))


def drawn(rows: DataFrame, sigmas: list[float], draws: int) -> DataFrame:
    """rows for each sigma and draw with their multiplier: normal around 1, from 0.70 to 1.35. Draws come from
    hashes, the same in every run."""
    grid = rows.withColumn("sigma", F.explode(F.array(*map(F.lit, sigmas)))).withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(draws))))
    u = lambda k: (F.pmod(F.xxhash64("origin", "dest", "day", "sigma", "draw", F.lit(k)), F.lit(1 << 40)) + 1) / F.lit(float((1 << 40) + 1))
    normal = F.sqrt(-2 * F.log(u(1))) * F.cos(2 * F.pi() * u(2))
    return grid.withColumn("multiplier", F.least(F.lit(1.35), F.greatest(F.lit(0.70), 1 + F.col("sigma") * normal)))


def planned_loads(edges: DataFrame, diversion: DataFrame, first: str, days: int, split: str) -> DataFrame:
    """origin, dest, day, volume, capacity, kept (the part of the volume that is not diverted)."""
    rows = edges.where(_days(first, days) & (F.col("volume") > 0)).join(capacities(edges, split).where("capacity > 0"), ["origin", "dest"])
    rows = rows.join(diversion.select("day", "origin", "dest", "amount"), ["day", "origin", "dest"], "left")
    return rows.select("origin", "dest", "day", "volume", "capacity", (1 - F.coalesce("amount", F.lit(0.0)) / F.col("volume")).alias("kept"))


def overload_draws(edges: DataFrame, diversion: DataFrame, first: str, days: int, split: str, sigmas: list[float], draws: int) -> DataFrame:
    """sigma, and before and after the diversion the mean and 95th percentile over the draws of the edge-days
    whose load is above the edge's capacity, and the mean volume above it."""
    grid = drawn(planned_loads(edges, diversion, first, days, split), sigmas, draws)
    load = F.col("volume") * F.col("multiplier")
    over = {"before": load - F.col("capacity"), "after": load * F.col("kept") - F.col("capacity")}
    counts = grid.groupBy("sigma", "draw").agg(*[F.count_if(x > 1e-9).alias(f"n_{k}") for k, x in over.items()], *[F.sum(F.greatest(x, F.lit(0.0))).alias(f"v_{k}") for k, x in over.items()])
    out = [f(k) for k in over for f in (lambda k: F.avg(f"n_{k}").alias(f"{k}_overloads"), lambda k: F.percentile(f"n_{k}", 0.95).alias(f"{k}_p95"), lambda k: F.round(F.avg(f"v_{k}"), 6).alias(f"{k}_excess"))]
    return counts.groupBy("sigma").agg(*out)
