"""Files of other kinds as tables: CSV with a byte-order mark, workbooks, GeoJSON, folders, generated points."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Typed CSV with a header; a byte-order mark before the first name is left out by the reader's schema."""
    return spark.read.schema(schema).option("header", True).option("enforceSchema", True).option("mode", "PERMISSIVE").csv(path)


def json_objects(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One object a file, with its path."""
    return spark.read.schema(schema).option("multiLine", True).json(path).withColumn("path", F.col("_metadata.file_path"))


def geojson(spark: SparkSession, path: str) -> DataFrame:
    """name, polygon (number within a multipolygon), rings of each feature."""
    ring = "array<array<array<double>>>"
    schema = "type string, features array<struct<properties:map<string,string>, geometry:struct<type:string, coordinates:string>>>"
    f = spark.read.schema(schema).option("multiLine", True).option("primitivesAsString", True).json(path).select(F.explode("features").alias("f"))
    g = F.col("f.geometry")
    many = F.when(g["type"] == "Polygon", F.array(F.from_json(g["coordinates"], ring))).otherwise(F.from_json(g["coordinates"], f"array<{ring}>"))
    return f.select(F.element_at("f.properties", "name").alias("name"), F.posexplode(many).alias("polygon", "rings"))


def files(spark: SparkSession, path: str) -> DataFrame:
    """path, size, sha256 of every file below a folder; contents are hashed where they are read."""
    b = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return b.select("path", F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"))


def workbooks(spark: SparkSession, path: str) -> DataFrame:
    """path, sheet, number (of the sheet), row, cells (text by column letters) of xlsx files: each file is opened in the task that
    reads it, rows come out in batches. Numbers and dates stay as they are stored."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import io
        import re
        import xml.etree.ElementTree as ET
        import zipfile

        ns = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
        for pdf in batches:
            for at, content in zip(pdf["path"], pdf["content"], strict=True):
                z = zipfile.ZipFile(io.BytesIO(content))
                shared = []
                if "xl/sharedStrings.xml" in z.namelist():
                    shared = ["".join(t.text or "" for t in si.iter(f"{ns}t")) for si in ET.fromstring(z.read("xl/sharedStrings.xml"))]
                names = [s.get("name") for s in ET.fromstring(z.read("xl/workbook.xml")).iter(f"{ns}sheet")]
                sheets = sorted((n for n in z.namelist() if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)), key=lambda n: int(re.search(r"\d+", n.rsplit("/", 1)[1])[0]))
                for place, (name, sheet) in enumerate(zip(names, sheets), 1):
                    out = []
                    for r in ET.fromstring(z.read(sheet)).iter(f"{ns}row"):
                        cells = {}
                        for c in r.iter(f"{ns}c"):
                            v = c.find(f"{ns}v")
                            text = "".join(t.text or "" for t in c.iter(f"{ns}t")) if c.get("t") == "inlineStr" else v.text if v is not None else None
                            if text is not None:
                                cells[re.match(r"[A-Z]+", c.get("r"))[0]] = shared[int(text)] if c.get("t") == "s" else text
                        out.append((at, name, place, int(r.get("r")), cells))
                        if len(out) == 5000:
                            yield pd.DataFrame(out, columns=["path", "sheet", "number", "row", "cells"])
                            out = []
                    if out:
                        yield pd.DataFrame(out, columns=["path", "sheet", "number", "row", "cells"])

    b = spark.read.format("binaryFile").option("pathGlobFilter", "*.xlsx").option("recursiveFileLookup", True).load(path).select("path", "content")
    return b.mapInPandas(rows, "path string, sheet string, number int, row int, cells map<string,string>")


def clock(cell: str) -> Column:
    """Seconds of the day of a time cell: a part of a day, or hours and minutes; 24:00 is the day's end."""
    c = F.trim(F.col(cell))
    part = c.try_cast("double")
    hours = F.regexp_extract(c, r"^(\d{1,2}):(\d{2})", 1).try_cast("int") * 3600 + F.regexp_extract(c, r"^(\d{1,2}):(\d{2})", 2).try_cast("int") * 60
    return F.when(part.isNotNull() & (part <= 1), F.rint(part * 86400).cast("long")).otherwise(hours.cast("long"))


def number(cell: str) -> Column:
    """A finite number from text, or null."""
    v = F.trim(F.col(cell)).try_cast("double")
    return F.when(~F.isnan(v) & (F.abs(v) < float("inf")), v)


def calendar(spark: SparkSession, first: str, last: str, step: str = "1 day") -> DataFrame:
    return spark.range(1).select(F.explode(F.expr(f"sequence(TIMESTAMP_NTZ '{first}', TIMESTAMP_NTZ '{last}', INTERVAL {step})")).alias("ts"))


def grid(spark: SparkSession, **values: list) -> DataFrame:
    """Every combination of some parameters' values."""
    out = spark.range(1)
    for name, v in values.items():
        out = out.withColumn(name, F.explode(F.array(*map(F.lit, v))))
    return out.drop("id")


def sobol(spark: SparkSession, n: int) -> DataFrame:
    """i, u, v: the first n points of the two-dimensional Sobol sequence, from the bits of Gray codes. The
    first axis reverses the bits; the second one's direction numbers come from its recurrence."""
    bits = max(1, (max(n - 1, 1)).bit_length())
    directions = [1]
    for _ in range(bits - 1):
        directions.append(directions[-1] ^ directions[-1] << 1)
    gray = F.col("i").bitwiseXOR(F.shiftright("i", 1))
    on = lambda k: F.shiftright(gray, k).bitwiseAND(F.lit(1)) == 1
    x, y = F.lit(0).cast("long"), F.lit(0).cast("long")
    for k in range(bits):
        x = F.when(on(k), x.bitwiseXOR(F.lit(1 << (bits - 1 - k)).cast("long"))).otherwise(x)
        y = F.when(on(k), y.bitwiseXOR(F.lit(directions[k] << (bits - 1 - k)).cast("long"))).otherwise(y)
    return spark.range(n).withColumnRenamed("id", "i").select("i", (x / float(1 << bits)).alias("u"), (y / float(1 << bits)).alias("v"))
