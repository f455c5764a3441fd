"""Workbooks (Office Open XML) in and out, by the standard library in tasks: files come and go as rows of bytes, so Spark's own readers reach them wherever they lie."""

from __future__ import annotations

import datetime as dt
import decimal
import io
import math
import posixpath
import re
import zipfile
from collections.abc import Iterator, Mapping
from xml.etree import ElementTree
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

#: Fixed values of the format: numbers of built-in formats that show dates or times.
DATE_FORMATS = frozenset([*range(14, 23), *range(27, 37), *range(45, 48), *range(50, 59)])
#: Rows of a batch that leaves a task, and of a workbook that is written.
BATCH_ROWS, BOOK_ROWS = 5000, 50_000
_QUOTED = re.compile(r'"[^"]*"|\\.|_.|\[(?!h+\]|m+\]|s+\])[^\]]*\]', re.I)
#: What XML has no place for.
_FORBIDDEN = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f\ufffe\uffff]")


def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


def _texts(node: ElementTree.Element) -> str:
    """The text of a string item: all its runs, without phonetic ones."""
    out = []
    for child in node:
        if _local(child.tag) == "t":
            out.append(child.text or "")
        elif _local(child.tag) == "r":
            out += [t.text or "" for t in child if _local(t.tag) == "t"]
    return "".join(out)


def shows_date(code: str) -> bool:
    """Whether a number format is for dates or times: it has a letter for one outside of quotes, colours and conditions."""
    return bool(re.search(r"[ymdhs]", _QUOTED.sub("", code.split(";")[0]), re.I)) and "general" not in code.lower()


def moment(serial: float, since_1904: bool) -> str:
    """A serial day as an ISO date, or date and time. Day 60 of the system from 1900, which never was, is the last of February."""
    if since_1904:
        start = dt.datetime(1904, 1, 1)
    else:
        start = dt.datetime(1899, 12, 31) if serial < 60 else dt.datetime(1899, 12, 30)
    at = start + dt.timedelta(milliseconds=round(serial * 86_400_000))
    return at.date().isoformat() if at.time() == dt.time() else at.isoformat(sep=" ", timespec="milliseconds" if at.microsecond else "seconds")


class _Book:
    def __init__(self, content: bytes) -> None:
        self.zip = zipfile.ZipFile(io.BytesIO(content))
        self.names = {n.lower(): n for n in self.zip.namelist()}
        root = self._related("", "_rels/.rels")
        self.book = next((t for kind, t in root.values() if kind == "officeDocument"), "xl/workbook.xml")
        folder, name = posixpath.split(self.book)
        related = self._related(folder, f"{folder}/_rels/{name}.rels")
        part = lambda kind: next((t for k, t in related.values() if k == kind), None)
        self.sheets, self.since_1904 = [], False
        for node in self._xml(self.book).iter():
            if _local(node.tag) == "sheet":
                link = next((v for k, v in node.attrib.items() if _local(k) == "id" and "}" in k), None)
                if link in related and related[link][0] == "worksheet":
                    self.sheets.append((node.get("name"), related[link][1]))
            elif _local(node.tag) == "workbookPr":
                self.since_1904 = node.get("date1904") in ("1", "true")
        self.strings = [_texts(n) for n in self._xml(part("sharedStrings")) if _local(n.tag) == "si"] if part("sharedStrings") else []
        self.dates = self._date_styles(part("styles"))

    def _open(self, path: str):
        return self.zip.open(self.names[path.lower()])

    def _xml(self, path: str) -> ElementTree.Element:
        with self._open(path) as f:
            return ElementTree.parse(f).getroot()

    def _related(self, folder: str, path: str) -> dict[str, tuple[str, str]]:
        if path.lower() not in self.names:
            return {}
        where = lambda t: t.lstrip("/") if t.startswith("/") else posixpath.normpath(posixpath.join(folder, t))
        return {n.get("Id"): (n.get("Type", "").rpartition("/")[2], where(n.get("Target", ""))) for n in self._xml(path)}

    def _date_styles(self, path: str | None) -> set[int]:
        if not path:
            return set()
        root = self._xml(path)
        codes = {int(n.get("numFmtId")): n.get("formatCode", "") for n in root.iter() if _local(n.tag) == "numFmt"}
        cells = next((n for n in root if _local(n.tag) == "cellXfs"), [])
        number = [int(n.get("numFmtId", 0)) for n in cells]
        return {i for i, k in enumerate(number) if (shows_date(codes[k]) if k in codes else k in DATE_FORMATS)}

    def cells(self, path: str) -> Iterator[tuple[int, int, str, str]]:
        """row, column, text and kind of the cells that hold something, rows and columns from 0, read as a stream."""
        row, column = -1, -1
        with self._open(path) as f:
            walk = ElementTree.iterparse(f, events=("start", "end"))
            parent = None
            for event, node in walk:
                tag = _local(node.tag)
                if event == "start":
                    if tag == "sheetData":
                        parent = node
                    elif tag == "row":
                        row, column = int(node.get("r", row + 2)) - 1, -1
                    elif tag == "c":
                        column += 1
                        if place := re.match(r"([A-Za-z]+)(\d+)$", node.get("r", "")):
                            column = 0
                            for letter in place[1].upper():
                                column = 26 * column + ord(letter) - 64
                            column -= 1
                elif tag == "c":
                    if found := self._value(node):
                        yield row, column, *found
                elif tag == "row" and parent is not None:
                    parent.clear()  # what has been read is let go

    def _value(self, node: ElementTree.Element) -> tuple[str, str] | None:
        kind = node.get("t", "n")
        if kind == "inlineStr":
            inside = next((n for n in node if _local(n.tag) == "is"), None)
            return None if inside is None else (_texts(inside), "text")
        text = next((n.text for n in node if _local(n.tag) == "v"), None)
        if text is None:
            return None
        if kind == "s":
            return self.strings[int(text)], "text"
        if kind in ("str", "e", "d"):
            return text, {"str": "text", "e": "error", "d": "date"}[kind]
        if kind == "b":
            return ("true" if text.strip() in ("1", "true") else "false"), "boolean"
        if int(node.get("s", 0)) in self.dates:
            return moment(float(text), self.since_1904), "date"
        return text.strip(), "number"


def _book_cells(path: str, content: bytes, sheet: str | int | None) -> Iterator[tuple]:
    try:
        book = _Book(content)
        wanted = book.sheets if sheet is None else [s for i, s in enumerate(book.sheets) if sheet in (i, s[0])]
        for name, part in wanted:
            for cell in book.cells(part):
                yield path, name, *cell
    except (zipfile.BadZipFile, KeyError, ElementTree.ParseError) as cause:
        raise ValueError(f"{path} is no workbook") from cause
    if not wanted and sheet is not None:
        raise ValueError(f"{path} has no sheet {sheet!r}")


def sheet_cells(files: DataFrame, sheet: str | int | None = None) -> DataFrame:
    """file, sheet, row, column, text, kind (text, number, date, boolean, error) of all cells that hold something.

    ``files`` has path and content, as Spark's binaryFile has them. ``sheet`` is a name or a place from 0, or None for all. A formula's last
    value counts. Null contents have no cells; what isn't a workbook, or lacks the sheet, is an error that names the file.
    """
    schema = "file string, sheet string, row int, column int, text string, kind string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        types = (pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string())
        batch_of = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=[x.split()[0] for x in schema.split(", ")])
        for batch in batches:
            for path, content in zip(*batch.columns):
                if not content.is_valid:
                    continue
                for cell in _book_cells(path.as_py(), content.as_py(), sheet):
                    out.append(cell)
                    if len(out) >= BATCH_ROWS:
                        yield batch_of(out)
                        out = []
        if out:
            yield batch_of(out)

    return files.select(F.col("path").cast("string"), "content").mapInArrow(run, schema)


def read_workbook(files: DataFrame, columns: Mapping[str | int, tuple[str, str]], sheet: str | int = 0, header: bool = True, skip: int = 0) -> DataFrame:
    """file, row and the named columns of one sheet of each file, a row for each row with a cell in any of them.

    ``columns`` maps a place from 0, or a title in the header row, to (name, type); ``skip`` rows come before the header, or before the
    data if there is none. What isn't of the type is null. Of equal titles the first column counts.
    """
    cells = sheet_cells(files, sheet).where(F.col("row") >= skip)
    data = cells.where(F.col("row") >= skip + header)
    places = {k: v for k, v in columns.items() if isinstance(k, int)}
    titles = {k: v for k, v in columns.items() if isinstance(k, str)}
    pick = lambda have, name: F.max(F.when(have, F.col("text"))).alias(name)
    if titles:
        heads = cells.where(F.col("row") == skip).where(F.trim("text").isin(*titles)).groupBy("file", F.trim("text").alias("_title")).agg(F.min("column").alias("column"))
        data = data.join(heads, ["file", "column"], "left")
    else:
        data = data.withColumn("_title", F.lit(None).cast("string"))
    wanted = F.col("column").isin(*places) | F.col("_title").isNotNull()
    rows = data.where(wanted).groupBy("file", "row").agg(*(pick(F.col("column") == k, name) for k, (name, _) in places.items()), *(pick(F.col("_title") == k, name) for k, (name, _) in titles.items()))
    number = lambda c, kind: F.col(c).try_cast("double").cast("long").try_cast(kind) if kind in ("int", "long", "bigint") else F.col(c).try_cast(kind)
    return rows.select("file", "row", *(number(name, kind).alias(name) for name, kind in columns.values()))


def files_at(spark: SparkSession, path: str) -> DataFrame:
    """path and content of all workbooks under ``path``."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.xls[xm]").option("recursiveFileLookup", "true").load(path).select("path", "content")


def workbook(title: list[str], names: list[str], rows: list[tuple], sheet: str = "LIST") -> bytes:
    """A workbook with one sheet: a row for each of ``title``, the names, and the rows. Dates and booleans are shown as such; None and what isn't finite are left out."""
    strings: dict[str, int] = {}
    places = [_letters(i) for i in range(max(1, len(names)))]

    def cell(at: str, x) -> str:
        if x is None:
            return ""
        if isinstance(x, bool):
            return f'<c r="{at}" t="b"><v>{int(x)}</v></c>'
        if isinstance(x, dt.date):
            start = dt.datetime(1899, 12, 30, tzinfo=x.tzinfo) if isinstance(x, dt.datetime) else dt.date(1899, 12, 30)
            days = (x - start) / dt.timedelta(days=1)
            return f'<c r="{at}" s="1"><v>{days - (days < 61):.15g}</v></c>'
        if isinstance(x, (int, float, decimal.Decimal)):
            return f'<c r="{at}"><v>{x}</v></c>' if math.isfinite(x) else ""
        return f'<c r="{at}" t="s"><v>{strings.setdefault(_FORBIDDEN.sub("", str(x)), len(strings))}</v></c>'

    lines = [[t] for t in title] + [names] + rows
    body = "".join(f'<row r="{r}">{"".join(cell(f"{c}{r}", x) for c, x in zip(places, line))}</row>' for r, line in enumerate(lines, 1))
    main, rel, office = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/package/2006/relationships", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    link = lambda i, kind, target: f'<Relationship Id="rId{i}" Type="{office}/{kind}" Target="{target}"/>'
    kind = lambda part, what: f'<Override PartName="/xl/{part}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.{what}+xml"/>'
    parts = {
        "[Content_Types].xml": f'<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/>{kind("workbook", "sheet.main")}{kind("worksheets/sheet1", "worksheet")}{kind("sharedStrings", "sharedStrings")}{kind("styles", "styles")}</Types>',
        "_rels/.rels": f'<Relationships xmlns="{rel}">{link(1, "officeDocument", "xl/workbook.xml")}</Relationships>',
        "xl/workbook.xml": f'<workbook xmlns="{main}" xmlns:r="{office}"><sheets><sheet name="{escape(sheet)}" sheetId="1" r:id="rId1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": f'<Relationships xmlns="{rel}">{link(1, "worksheet", "worksheets/sheet1.xml")}{link(2, "sharedStrings", "sharedStrings.xml")}{link(3, "styles", "styles.xml")}</Relationships>',
        "xl/worksheets/sheet1.xml": f'<worksheet xmlns="{main}"><sheetData>{body}</sheetData></worksheet>',
        "xl/sharedStrings.xml": f'<sst xmlns="{main}">{"".join(f"""<si><t xml:space="preserve">{escape(s)}</t></si>""" for s in strings)}</sst>',
        "xl/styles.xml": f'<styleSheet xmlns="{main}"><fonts count="1"><font/></fonts><fills count="1"><fill/></fills><borders count="1"><border/></borders><cellStyleXfs count="1"><xf/></cellStyleXfs><cellXfs count="2"><xf numFmtId="0"/><xf numFmtId="14" applyNumberFormat="1"/></cellXfs></styleSheet>',
    }
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in parts.items():
            z.writestr(name, '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>' + text)
    return out.getvalue()


def _letters(i: int) -> str:
    out = ""
    while i >= 0:
        out = chr(65 + i % 26) + out
        i = i // 26 - 1
    return out


def workbooks(df: DataFrame, title: list[str] | None = None) -> DataFrame:
    """path and content: the rows of ``df`` as workbooks of BOOK_ROWS rows at most, a task's rows in their order."""
    names, lines = df.columns, list(title or [])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        held, number = [], 0
        row = lambda rows: pa.RecordBatch.from_pydict({"path": [f"book-{TaskContext.get().partitionId():05d}-{number:05d}.xlsx"], "content": [workbook(lines, names, rows)]})
        for batch in batches:
            held += [tuple(r.values()) for r in batch.to_pylist()]
            while len(held) >= BOOK_ROWS:
                yield row(held[:BOOK_ROWS])
                held, number = held[BOOK_ROWS:], number + 1
        if held:
            yield row(held)

    return df.mapInArrow(run, "path string, content binary")
