"""Loaders over small workbooks of each layout."""

import datetime as dt
import zipfile

import pytest

from tidewater.sources import loaders

NS = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'


def workbook(path, **sheets):
    """Sheets of rows of cells; text is kept in the cell, None leaves it out."""
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f"<workbook {NS}><sheets>" + "".join(f'<sheet name="{n}" sheetId="{i}"/>' for i, n in enumerate(sheets, 1)) + "</sheets></workbook>")
        for i, rows in enumerate(sheets.values(), 1):
            out = []
            for r, row in enumerate(rows, 1):
                cells = []
                for c, v in enumerate(row):
                    at = f"{chr(65 + c)}{r}"
                    if isinstance(v, str):
                        cells.append(f'<c r="{at}" t="inlineStr"><is><t>{v}</t></is></c>')
                    elif v is not None:
                        cells.append(f'<c r="{at}"><v>{v}</v></c>')
                out.append(f'<row r="{r}">{"".join(cells)}</row>')
            z.writestr(f"xl/worksheets/sheet{i}.xml", f"<worksheet {NS}><sheetData>{''.join(out)}</sheetData></worksheet>")
    return str(path)


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_history_is_the_first_sheet(spark, tmp_path):
    at = workbook(tmp_path / "h.xlsx", one=[["from", "to", "date", "n"], [" A ", "B", 44197, 5], ["A", "C", "2021-01-02", "x"], [None, "C", 44198, 1]], two=[["from"], ["Z", "Z", 44197, 9]])
    assert rows(loaders.history(spark, at)) == [("A", "B", dt.date(2021, 1, 1), 5.0)]


def test_titled_sheets(spark, tmp_path):
    at = workbook(tmp_path / "t.xlsx", a=[["x", "day", "z"], [1, "2020-01-01", 2]], b=[["x", "y"], [1, 2]], c=[[" z ", "x"], [5, 6], [None, 7]])
    got = rows(loaders.titled(spark, at, ["x", "z"]).select("sheet", "row", "x", "z"))
    assert got == [("a", 2, "1", "2"), ("c", 2, "6", "5"), ("c", 3, "7", None)]


def test_station_series(spark, tmp_path):
    sheet = [["y", "m", "d", "time", "level", "flow", "sediment"], [2016, 1, 31, "8:00", 42.1, 100, 0.5], [None, None, None, 0.5, 42.2, 110, None], [None, None, None, 0.5, 42.4, 130, None], [None, None, None, "24:00", "n/a", 90, 1], [None, 2, 1, "6:30", 40, 0, 1], [None, None, None, "7:00", 41, 80, None]]
    got = rows(loaders.station_series(spark, workbook(tmp_path / "s.xlsx", s1=sheet)))
    t = dt.datetime
    assert got == [
        ("s1", t(2016, 1, 31, 12), pytest.approx(42.3), 120.0, None), ("s1", t(2016, 1, 31, 8), 42.1, 100.0, 0.5), ("s1", t(2016, 2, 1, 0), None, 90.0, 1.0), ("s1", t(2016, 2, 1, 7), 41.0, 80.0, None),
    ]


def test_paired_profiles(spark, tmp_path):
    sheet = [["2016-06-08", None, "2016-10-20", None], ["x", "z", "x", "z"], [0, 43, 0, 42.5], [5, 41, 5, 40], [5, 42, None, None]]
    got = rows(loaders.paired_profiles(spark, workbook(tmp_path / "p.xlsx", s=sheet)))
    a, b = dt.date(2016, 6, 8), dt.date(2016, 10, 20)
    assert got == sorted([(a, 0.0, 43.0), (a, 5.0, 41.5), (b, 0.0, 42.5), (b, 5.0, 40.0)], key=repr)


def test_verticals(spark, tmp_path):
    sheet = [["date", "station", "start", "stage", "depth", "point", "v"], ["2016-06-08", "K1", 10, 43, 2.0, 0.4, 1.0], [None, None, None, None, 2.5, 1.6, 2.0], [None, None, 20, 43, 3.0, 0.6, 1.5]]
    got = rows(loaders.verticals(spark, workbook(tmp_path / "v.xlsx", s=sheet)))
    d = dt.date(2016, 6, 8)
    assert got == [(d, "K1", 10.0, 43.0, 2.5, 2, 1.5), (d, "K1", 20.0, 43.0, 3.0, 1, 1.5)]


def test_samples_and_their_artifacts(spark, tmp_path):
    at = workbook(tmp_path / "g.xlsx", artifacts=[["id", "kind", "w"], [1, "high", "no"], ["12", "low", "yes"]], samples=[["id", "a", "b"], ["01", 60, 35], ["12 part", 50, None], ["99", 90, 1]])
    got = rows(loaders.samples(spark, at, 2))
    assert got == [("01", "high", "no", "01", [60.0, 35.0], 95.0, True), ("12", "low", "yes", "12 part", [50.0, 0.0], 50.0, False), ("99", None, None, "99", [90.0, 1.0], 91.0, True)]


def test_centres_and_paths(spark, tmp_path):
    at = workbook(tmp_path / "c.xlsx", s=[["x", "y"], [1.5, -2], [3, 4]])
    assert rows(loaders.centres(spark, at)) == [(2, 1.5, -2.0), (3, 3.0, 4.0)]
    with pytest.raises(ValueError, match="coordinates"):
        loaders.centres(spark, workbook(tmp_path / "d.xlsx", s=[["x", "y"], [1.5, "?"]]))
    assert loaders.first_path(spark, [str(tmp_path / "no"), at]) == at
    with pytest.raises(FileNotFoundError, match="none"):
        loaders.first_path(spark, [str(tmp_path / "no")])
