"""Results as files: write-once tables, manifests, and small tables as Markdown."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F


def write_once(df: DataFrame, path: str, kind: str = "parquet", **options: str) -> None:
    """An error if there is something at the path."""
    df.write.mode("errorifexists").options(**options).format(kind).save(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").option("header", True).csv(path)


def append_log(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").parquet(path)


def write_counted(df: DataFrame, path: str, kind: str = "parquet", **options: str) -> int:
    """write_once(), and how many rows were written: counted on the way, not by another pass."""
    seen = Observation()
    write_once(df.observe(seen, F.count(F.lit(1)).alias("rows")), path, kind, **options)
    return seen.get["rows"]


def manifest(inputs: DataFrame, code: DataFrame | None = None, rows: dict[str, int] | None = None, **facts: str) -> DataFrame:
    """One row: a JSON text of the inputs (path, size, sha256: a list of files that were declared), how many rows
    each output has, one hash over the code's files (the same columns) by their names and hashes, Spark's version,
    and facts."""
    files = F.array_sort(F.collect_list(F.struct("path", "size", "sha256")))
    counts = F.create_map(*[F.lit(x) for item in sorted((rows or {}).items()) for x in item]) if rows else F.lit(None).cast("map<string,int>")
    body = [files.alias("inputs"), F.count(F.lit(1)).alias("n_inputs"), counts.alias("rows"), F.version().alias("spark")]
    if code is not None:
        each = F.concat_ws("\0", F.element_at(F.split("path", "/"), -1), "sha256")
        code = F.broadcast(code.agg(F.sha2(F.concat_ws("\0", F.array_sort(F.collect_list(each))), 256).alias("_code")))
        inputs, body = inputs.join(code), [*body, F.first("_code").alias("code_sha256")]
    return inputs.agg(F.to_json(F.struct(*body, *[F.lit(v).alias(k) for k, v in facts.items()])).alias("manifest"))


def markdown(df: DataFrame, digits: int = 4) -> DataFrame:
    """A row with a Markdown table of a small result, ordered by its columns."""
    cell = lambda c, kind: F.format_number(c, digits) if kind in ("double", "float") else F.coalesce(F.col(c).cast("string"), F.lit(""))
    line = F.concat(F.lit("| "), F.concat_ws(" | ", *[cell(c, k) for c, k in df.dtypes]), F.lit(" |"))
    head = "| " + " | ".join(df.columns) + " |\n|" + " --- |" * len(df.columns)
    rows = df.select(F.struct(*df.columns).alias("o"), line.alias("l")).agg(F.array_sort(F.collect_list(F.struct("o", "l"))).alias("r"))
    return rows.select(F.concat_ws("\n", F.lit(head), F.transform("r", lambda r: r["l"])).alias("table"))
