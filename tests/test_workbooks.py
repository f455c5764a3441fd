"""Workbooks: what is written is read again, and one made by hand has what spreadsheets make of cells."""

import datetime as dt
import io
import zipfile
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tidemark.operators import markup
from tidemark.sources import workbooks

MAIN, OFFICE, PACKAGE = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships", "http://schemas.openxmlformats.org/package/2006/relationships"


def book(sheets, strings="", styles="", properties=""):
    """A workbook by hand; sheets maps names to rows of XML."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("_rels/.rels", f'<Relationships xmlns="{PACKAGE}"><Relationship Id="a" Type="{OFFICE}/officeDocument" Target="/XL/Book.xml"/></Relationships>')
        z.writestr("xl/book.xml", f'<workbook xmlns="{MAIN}" xmlns:r="{OFFICE}">{properties}<sheets>' + "".join(f'<sheet name="{n}" sheetId="{i}" r:id="s{i}"/>' for i, n in enumerate(sheets)) + "</sheets></workbook>")
        links = "".join(f'<Relationship Id="s{i}" Type="{OFFICE}/worksheet" Target="{"/xl/" if i % 2 else ""}sheets/{i}.xml"/>' for i in range(len(sheets)))
        z.writestr("xl/_rels/Book.xml.rels", f'<Relationships xmlns="{PACKAGE}">{links}<Relationship Id="t" Type="{OFFICE}/sharedStrings" Target="strings.xml"/><Relationship Id="y" Type="{OFFICE}/styles" Target="styles.xml"/></Relationships>')
        z.writestr("xl/strings.xml", f'<sst xmlns="{MAIN}">{strings}</sst>')
        z.writestr("xl/styles.xml", f'<styleSheet xmlns="{MAIN}">{styles}</styleSheet>')
        for i, rows in enumerate(sheets.values()):
            z.writestr(f"xl/sheets/{i}.xml", f'<worksheet xmlns="{MAIN}"><sheetData>{rows}</sheetData></worksheet>')
    return bytearray(out.getvalue())


STYLES = """<numFmts><numFmt numFmtId="170" formatCode="[Red]yyyy/mm/dd;@"/><numFmt numFmtId="171" formatCode="0.0&quot;days&quot;"/><numFmt numFmtId="172" formatCode="[h]:mm"/></numFmts>
  <cellStyleXfs><xf numFmtId="14"/></cellStyleXfs><cellXfs><xf/><xf numFmtId="14"/><xf numFmtId="170"/><xf numFmtId="171"/><xf numFmtId="172"/></cellXfs>"""
STRINGS = "<si><t>plain &amp; short</t></si><si><r><rPr/><t xml:space='preserve'>two </t></r><r><t>runs</t></r><rPh><t>phonetic</t></rPh></si><si/>"
ROWS = """<row r="2"><c r="B2" t="s"><v>0</v></c><c t="s"><v>1</v></c><c r="AB2"><v>1.5E3</v></c></row><row><c><v>7</v></c><c t="s"><v>2</v></c></row>
  <row r="9"><c r="A9" s="1"><v>60</v></c><c r="B9" s="2"><v>43831.75</v></c><c r="C9" s="3"><v>3</v></c><c r="D9" t="b"><v>1</v></c><c r="E9" t="e"><v>#N/A</v></c><c r="F9" t="str"><f>A1</f><v>formula</v></c><c r="G9" t="inlineStr"><is><t>in line</t></is></c><c r="H9"/><c r="I9" s="4"><v>0.5</v></c><c r="J9" s="1"><v>1</v></c></row>"""


def cells(df):
    return sorted((r.file, r.sheet, r.row, r.column, r.text, r.kind) for r in df.collect())


def test_cells_of_a_workbook_by_hand(spark):
    files = spark.createDataFrame([("x.xlsx", book({"one": ROWS, "two": "<row><c><v>2</v></c></row>"}, STRINGS, STYLES)), ("none", None)], "path string, content binary")
    got = cells(workbooks.sheet_cells(files, "one"))
    want = [(1, 1, "plain & short", "text"), (1, 2, "two runs", "text"), (1, 27, "1.5E3", "number"), (2, 0, "7", "number"), (2, 1, "", "text"), (8, 0, "1900-02-28", "date"), (8, 1, "2020-01-01 18:00:00", "date"), (8, 2, "3", "number"), (8, 3, "true", "boolean"), (8, 4, "#N/A", "error"), (8, 5, "formula", "text"), (8, 6, "in line", "text"), (8, 8, "1899-12-31 12:00:00", "date"), (8, 9, "1900-01-01", "date")]
    assert got == [("x.xlsx", "one", *w) for w in want]
    assert cells(workbooks.sheet_cells(files, 1)) == [("x.xlsx", "two", 0, 0, "2", "number")]
    assert len(cells(workbooks.sheet_cells(files))) == len(want) + 1


def test_days_from_1904(spark):
    files = spark.createDataFrame([("x", book({"a": '<row><c s="1"><v>0</v></c><c s="1"><v>366</v></c></row>'}, "", STYLES, '<workbookPr date1904="1"/>'))], "path string, content binary")
    assert [c[4] for c in cells(workbooks.sheet_cells(files))] == ["1904-01-01", "1905-01-01"]


@pytest.mark.parametrize("content, sheet, message", [(bytearray(b"no zip"), None, "bad.xlsx is no workbook"), (book({"a": ""}), "b", "has no sheet"), (book({"a": ""}), 4, "has no sheet"), (book({"a": "<row>"}), None, "is no workbook")])
def test_errors_name_the_file(spark, content, sheet, message):
    files = spark.createDataFrame([("bad.xlsx", content)], "path string, content binary")
    with pytest.raises(Exception, match=message):
        workbooks.sheet_cells(files, sheet).collect()


def test_what_is_written_is_read_again(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(workbooks, "BOOK_ROWS", 7)
    day = dt.date(1900, 1, 1)
    rows = [(i, f"näme <{i}> & \x01 x" if i % 3 else None, i / 3 if i % 4 else None, Decimal(i) / 4, day + dt.timedelta(days=i * 31), dt.datetime(2001, 2, 3, 4, 5, i), i % 2 == 0) for i in range(40)]
    df = spark.createDataFrame(rows, "i long, s string, x double, d decimal(10,2), day date, at timestamp_ntz, b boolean")
    books = workbooks.workbooks(df.coalesce(2), ["a title"])
    assert books.count() >= 6
    for r in books.collect():
        (tmp_path / r.path).write_bytes(r.content)
    (tmp_path / "other.txt").write_text("no workbook")
    files = workbooks.files_at(spark, f"file://{tmp_path}")
    got = workbooks.read_workbook(files, {"i": ("i", "long"), "s": ("s", "string"), "x": ("x", "double"), 3: ("d", "decimal(10,2)"), "day": ("day", "date"), 5: ("at", "timestamp_ntz"), "b": ("b", "boolean")}, skip=1)
    want = [(i, s and s.replace("\x01", ""), x, d, day, at, b) for i, s, x, d, day, at, b in rows]
    assert sorted(tuple(r)[2:] for r in got.collect()) == want
    places = workbooks.read_workbook(files, {0: ("i", "int"), 2: ("none", "int")}, header=False, skip=2).where("i > 2")
    assert {(r.i, r.none) for r in places.collect()} == {(i, None if x is None else int(x)) for i, _, x, *_ in rows if i > 2}


def test_labels_over_columns_work_for_sheets(spark):
    df = spark.createDataFrame([("4", "1,200"), ("5", "△7")], "Month string, Sales string")
    sheets = workbooks.sheet_cells(workbooks.workbooks(df.coalesce(1))).select("file", F.lit(0).alias("table"), "row", "column", "text", F.lit(False).alias("head"))
    got = markup.adapted(sheets, "file", {"month": "^Month", "sales": "Sales"}, heads=1).select("month", markup.figure("sales").alias("sales")).orderBy("month").collect()
    assert [tuple(r) for r in got] == [("4", 1200.0), ("5", -7.0)]


def test_formats_that_show_dates():
    assert all(map(workbooks.shows_date, ["yyyy-mm-dd", "m/d", "[h]:mm:ss", "[$-411]ge.m.d", 'd" of "mmm'])) and not any(map(workbooks.shows_date, ["General", "0.00", '#,##0"days"', "[Red]0", "0\\d", "@", "0_d"]))


def test_a_large_sheet_is_read_as_a_stream(spark):
    rows = "".join(f'<row r="{i}"><c r="A{i}"><v>{i}</v></c><c r="B{i}" t="inlineStr"><is><t>x</t></is></c></row>' for i in range(1, 60_001))
    files = spark.createDataFrame([("x", book({"a": rows}))], "path string, content binary")
    assert workbooks.sheet_cells(files).count() == 120_000
