import hashlib
import json
import zipfile

import numpy as np
from pyspark.sql import functions as F

from tidewater.sources import files, sinks


def test_csv_with_a_mark_and_json(spark, tmp_path):
    (tmp_path / "a.csv").write_text("﻿day,flow\n2024-01-01,1.5\n2024-01-02,\n", encoding="utf-8")
    rows = files.csv(spark, str(tmp_path / "a.csv"), "day date, flow double").collect()
    assert [str(r["day"]) for r in rows] == ["2024-01-01", "2024-01-02"] and rows[1]["flow"] is None
    (tmp_path / "m.json").write_text(json.dumps({"package_id": "p", "n": 2}))
    assert files.json_objects(spark, str(tmp_path / "m.json"), "package_id string, n int").first()["n"] == 2


def test_geojson(spark, tmp_path):
    square = [[[0, 0], [1, 0], [1, 1], [0, 0]]]
    data = {"type": "FeatureCollection", "features": [{"type": "Feature", "properties": {"name": "a"}, "geometry": {"type": "Polygon", "coordinates": square}}, {"type": "Feature", "properties": {"name": "b"}, "geometry": {"type": "MultiPolygon", "coordinates": [square, square]}}]}
    (tmp_path / "g.json").write_text(json.dumps(data))
    got = sorted((r["name"], r["polygon"], r["rings"]) for r in files.geojson(spark, str(tmp_path / "g.json")).collect())
    assert [g[:2] for g in got] == [("a", 0), ("b", 0), ("b", 1)] and got[0][2] == [[[0.0, 0.0], [1.0, 0.0], [1.0, 1.0], [0.0, 0.0]]]


def test_workbook(spark, tmp_path):
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    with zipfile.ZipFile(tmp_path / "w.xlsx", "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {ns}><sheets><sheet name="one" sheetId="1"/><sheet name="two" sheetId="2"/></sheets></workbook>')
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><t>name</t></si><si><r><t>a</t></r><r><t>b</t></r></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {ns}><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c></row><row r="3"><c r="B3" t="s"><v>1</v></c><c r="C3"><v>2.5</v></c></row></sheetData></worksheet>')
        z.writestr("xl/worksheets/sheet2.xml", f'<worksheet {ns}><sheetData><row r="1"><c r="A1" t="inlineStr"><is><t>x</t></is></c></row></sheetData></worksheet>')
    got = sorted((r["sheet"], r["row"], r["cells"]) for r in files.workbooks(spark, str(tmp_path)).collect())
    assert got == [("one", 1, {"A": "name"}), ("one", 3, {"B": "ab", "C": "2.5"}), ("two", 1, {"A": "x"})]


def test_cells(spark):
    df = spark.createDataFrame([(" 43.27 ", "0.5"), ("NaN", "24:00"), ("not-a-number", "8:30"), (None, None)], "v string, t string")
    assert [r[0] for r in df.select(files.number("v")).collect()] == [43.27, None, None, None]
    assert [r[0] for r in df.select(files.clock("t")).collect()] == [43200, 86400, 30600, None]


def test_sobol_fills_both_axes(spark):
    p = np.array([(r["u"], r["v"]) for r in files.sobol(spark, 64).collect()])
    for axis in (0, 1):
        assert sorted((p[:, axis] * 64).astype(int)) == list(range(64))
    cells = {(int(u * 8), int(v * 8)) for u, v in p}
    assert len(cells) == 64  # a net: one point in each of 8 x 8 cells


def test_grid_and_calendar(spark):
    assert files.grid(spark, a=[1, 2], b=["x", "y", "z"]).count() == 6
    assert files.calendar(spark, "2024-01-01", "2024-01-02", "6 hours").count() == 5


def test_sinks(spark, tmp_path):
    import pytest

    df = spark.createDataFrame([("a", 1.5), ("b", None)], "k string, v double")
    sinks.write_once(df, str(tmp_path / "t"))
    with pytest.raises(Exception, match="already exists|PATH_ALREADY_EXISTS"):
        sinks.write_once(df, str(tmp_path / "t"))
    assert sinks.markdown(df).first()["table"].split("\n")[2] == "| a | 1.5000 |"
    m = json.loads(sinks.manifest(files.files(spark, str(tmp_path / "t")).where(F.col("path").endswith(".parquet")), question="q1").first()["manifest"])
    assert m["question"] == "q1" and m["n_inputs"] == len(m["inputs"])
    n = sinks.write_counted(df, str(tmp_path / "u"))
    (tmp_path / "a.py").write_text("x = 1")
    (tmp_path / "b.py").write_text("y = 2")
    code = files.files(spark, str(tmp_path)).where(F.col("path").endswith(".py"))
    m = json.loads(sinks.manifest(files.files(spark, str(tmp_path / "u")), code, {"u": n}).first()["manifest"])
    each = sorted(f"{k}\0{hashlib.sha256(v).hexdigest()}" for k, v in (("a.py", b"x = 1"), ("b.py", b"y = 2")))
    assert n == 2 and m["rows"] == {"u": 2} and m["code_sha256"] == hashlib.sha256("\0".join(each).encode()).hexdigest() and m["spark"].startswith(spark.version)
