"""Provenance of files and records: coverage, hashes, rules, change logs, reviews."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def coverage(found: DataFrame, declared: DataFrame, key: str) -> DataFrame:
    """key, problem (duplicate, missing, extra) of both sets of keys."""
    twice = declared.groupBy(key).count().where("count > 1").select(key, F.lit("duplicate").alias("problem"))
    missing = declared.select(key).distinct().join(found, key, "left_anti").select(key, F.lit("missing").alias("problem"))
    extra = found.select(key).distinct().join(declared, key, "left_anti").select(key, F.lit("extra").alias("problem"))
    return twice.unionByName(missing).unionByName(extra)


def times(text: str, part: str) -> Column:
    """How often a string is in a text (not overlapping)."""
    gone = F.replace(F.col(text), F.lit(part), F.lit(""))
    return ((F.char_length(text) - F.char_length(gone)) / len(part)).cast("int")


def sections_in_order(docs: DataFrame, id: str, text: str, marks: list[str]) -> DataFrame:
    """id, once, ordered: whether each mark is there exactly once, and in this order."""
    places = [F.instr(F.col(text), m) for m in marks]
    once = [times(text, m) == 1 for m in marks]
    order = [a < b for a, b in zip(places, places[1:])]
    every = lambda cs: F.array_min(F.array(*[c.cast("int") for c in cs])) == 1
    return docs.select(id, F.coalesce(every(once), F.lit(False)).alias("once"), F.coalesce(every(order), F.lit(False)).alias("ordered"))


def tree_hash(files: DataFrame, group: str, path: str, content_hash: str, fan: int = 1024) -> DataFrame:
    """group, files, tree: a hash over all paths and contents of a group in the order of paths. Built as a
    tree: hashes of ranges of `fan` files, then of ranges of those, so that no task joins a group's all
    files into one string."""
    entry = F.concat(F.col(path).cast("string"), F.lit("\0"), F.col(content_hash), F.lit("\0"))
    rows = files.select(group, F.col(path).cast("long").alias("at"), entry.alias("e"), F.lit(1).cast("long").alias("n"))
    for level in range(3):
        bucket = F.floor(F.col("at") / fan) if level < 2 else F.lit(0).cast("long")
        rows = rows.groupBy(group, bucket.alias("at")).agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "e"))), lambda s: s["e"]), ""), 256).alias("e"), F.sum("n").alias("n"))
    return rows.select(group, F.col("n").alias("files"), F.col("e").alias("tree"))


def rule_breaches(log: DataFrame, status: str, path: str, guarded: list[str], exempt: list[str]) -> DataFrame:
    """Changes other than additions of paths under guarded beginnings, but for exempt ones."""
    under = lambda names: F.coalesce(*[F.when(F.startswith(F.col(path), F.lit(n)), True) for n in names], F.lit(False))
    return log.where((F.col(status) != "A") & under(guarded) & ~under(exempt))


def longest_prefix(rows: DataFrame, text: str, rules: dict[str, str], out: str) -> DataFrame:
    """The value of the longest rule that the text begins with; null if none fits. Rules are a short list."""
    hits = [F.when(F.startswith(F.col(text), F.lit(k)), F.lit(rules[k])) for k in sorted(rules, key=lambda k: (-len(k), k))]
    return rows.withColumn(out, F.coalesce(*hits))


def review_state(events: DataFrame, by: list[str], order: list[str], action: str) -> DataFrame:
    """by..., state, changes: approved or rejected by the last such action, pending before; a submission
    after it makes it pending again."""
    kind = F.when(F.col(action) == "approve", "approved").when(F.col(action) == "reject", "rejected").when(F.col(action) == "submit", "pending")
    known = events.withColumn("_kind", kind)
    last = F.max_by("_kind", F.when(F.col("_kind").isNotNull(), F.struct(*order)))
    return known.groupBy(*by).agg(F.coalesce(last, F.lit("pending")).alias("state"), F.count("_kind").alias("changes"))


def template_fields(docs: DataFrame, id: str, text: str) -> DataFrame:
    """id, fields: a map of the lines "- key: value" (the last of a key wins)."""
    lines = F.filter(F.split(F.coalesce(F.col(text), F.lit("")), "\n"), lambda s: s.rlike(r"^- [^:：]+[:：]"))
    entries = F.transform(lines, lambda s: F.struct(F.trim(F.regexp_extract(s, r"^- ([^:：]+)[:：]", 1)).alias("key"), F.trim(F.regexp_extract(s, r"^- [^:：]+[:：](.*)$", 1)).alias("value")))
    kept = F.filter(entries, lambda e, i: F.size(F.filter(F.slice(entries, i + 2, F.greatest(F.lit(1), F.size(entries))), lambda o: o["key"] == e["key"])) == 0)
    return docs.select(id, F.map_from_entries(kept).alias("fields"))


def checks(one_row: DataFrame, named: list[tuple[str, Column, Column]]) -> DataFrame:
    """name, passed, value: a row for each check over a one-row table of aggregates."""
    rows = F.array(*[F.struct(F.lit(n).alias("name"), ok.alias("passed"), v.cast("double").alias("value")) for n, ok, v in named])
    return one_row.select(F.explode(rows).alias("c")).select("c.*")


def gate(table: DataFrame) -> DataFrame:
    """The table of checks, with an error that names the failed ones if there are some."""
    if failed := [r["name"] for r in table.where("NOT passed").select("name").collect()]:
        raise ValueError(f"checks failed: {', '.join(failed)}")
    return table


def safe_path(path: str) -> Column:
    """Relative, without steps upwards, back slashes or drive letters."""
    p = F.col(path)
    return ~p.rlike(r"^(/|[A-Za-z]:)|\\|(^|/)\.\.?(/|$)|//") & (F.char_length(p) > 0)


