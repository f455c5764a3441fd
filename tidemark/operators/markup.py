"""Lists and tables of pages: tags with attributes and nesting are scanned, cells are placed on a grid, labels name columns."""

from __future__ import annotations

import html as references
import re
from collections.abc import Iterator, Sequence
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

_NAME, _SPACE, _ATTRIBUTE, _EQUALS, _VALUE = (re.compile(p) for p in (r"[a-zA-Z][^\s/>]*", r"[\s/]*", r"[^\s/>][^\s/>=]*", r"\s*=\s*", r"[^\s>]*"))
_PLAIN = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9]*)>")
#: Elements whose content is no markup.
_RAW = {name: re.compile(f"</{name}", re.I) for name in ("script", "style", "textarea", "title")}
#: Comments, and tags of well-formed and short attributes, which mean the same on any page. A tag never reads beyond the next "<".
_TAGS = re.compile(r"""(<!--[\s\S]*?-->|</?[a-zA-Z][a-zA-Z0-9]{0,50}+(?:\s{1,50}+[a-zA-Z-]{1,50}+(?:=(?:"[^"<]{0,300}+"|'[^'<]{0,300}+'|[^\s"'<>=]{1,300}+))?+){0,20}+\s{0,50}+>)""")
#: Elements that words on both sides don't run through.
_BREAKS = frozenset("address article aside blockquote br caption dd div dl dt fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav p pre section".split())
_ROLES = {"ul": "list", "ol": "list", "menu": "list", "li": "item", "table": "table", "tr": "row", "td": "cell", "th": "cell", "thead": "group", "tbody": "group", "tfoot": "group"} | dict.fromkeys(_BREAKS, "break")
_ARROW = {"int": pa.int32(), "string": pa.string(), "boolean": pa.bool_(), "array<string>": pa.list_(pa.string()), "array<array<string>>": pa.list_(pa.list_(pa.string()))}
#: Rows of a batch that leaves Python, or those of one page if it has more.
_BATCH = 5000
#: What HTML allows a cell to span.
MOST_COLUMNS, MOST_ROWS = 1000, 65534


def events(page: str) -> Iterator[tuple[str, str, dict[str, str]]]:
    """(kind, name or text, attributes) in order; kind is open, close or text. Time is in proportion to the page, however broken it is."""
    at, n, unclosed = 0, len(page), set()
    while at < n:
        start = page.find("<", at)
        if start != at:
            yield "text", page[at : start if start >= 0 else n], {}
            if start < 0:
                return
        if plain := _PLAIN.match(page, start):
            at, tag = plain.end(), plain[2].lower()
            yield ("close" if plain[1] else "open"), tag, {}
            if not plain[1] and tag in _RAW:
                end = _RAW[tag].search(page, at)
                at = end.start() if end else n
            continue
        if page.startswith("<!--", start):
            end = page.find("-->", start + 4)
            at = n if end < 0 else end + 3
            continue
        closing = page.startswith("</", start)
        name = _NAME.match(page, start + 1 + closing)
        if not name:
            end = page.find(">", start) if page[start + 1 : start + 2] in ("!", "?", "/") else start
            if end == start:
                yield "text", "<", {}
            at = n if end < 0 else end + 1
            continue
        at, attributes = name.end(), {}
        while True:
            at = _SPACE.match(page, at).end()
            if at >= n:
                return
            if page[at] == ">":
                at += 1
                break
            attribute = _ATTRIBUTE.match(page, at)
            at, value = attribute.end(), ""
            if equals := _EQUALS.match(page, at):
                at = equals.end()
                quote = page[at : at + 1]
                end = page.find(quote, at + 1) if quote and quote in "\"'" and quote not in unclosed else -1
                if end >= 0:
                    value, at = page[at + 1 : end], end + 1
                else:
                    if quote in ("'", '"'):
                        unclosed.add(quote)  # none follows anywhere, so none is looked for again
                    value = _VALUE.match(page, at)
                    at, value = value.end(), value[0]
            attributes.setdefault(attribute[0].lower(), references.unescape(value))
        tag = name[0].lower()
        yield ("close" if closing else "open"), tag, attributes
        if not closing and tag in _RAW:
            end = _RAW[tag].search(page, at)
            at = end.start() if end else n


def _step(tag: str, open_: bool, attributes: dict[str, str]) -> tuple[str, bool, bool, dict[str, str]] | None:
    role = _ROLES.get(tag)
    return role and (role, open_, tag == "th", attributes)


class _Raw(Exception):
    """Not all of a page is markup."""


@lru_cache(5000)
def _known(tag: str) -> tuple[str, bool, bool, dict[str, str]] | None:
    """The step of a tag of _TAGS: pages repeat few of them."""
    kind, name, attributes = next(events(tag))
    if kind == "open" and name in _RAW:
        raise _Raw
    return _step(name, kind == "open", attributes)


def _steps(page: str) -> list:
    """What boxes() takes of events(): text, or (role, whether it opens, whether it is th, attributes) of a tag, or None."""
    if ("<!--" not in page or page.rfind("<!--") <= page.rfind("-->") - 4):
        steps = _TAGS.split(page)
        if "<" not in "".join(steps[::2]):
            try:
                steps[1::2] = [_known(x) if x[1] != "!" else None for x in steps[1::2]]
                return steps
            except _Raw:
                pass
    return [x if kind == "text" else _step(x, kind == "open", attributes) for kind, x, attributes in events(page)]


class _Box:
    """A list or table that is being read: a list's rows have one cell each."""

    __slots__ = ("kind", "number", "parent", "depth", "id", "css", "rows", "cell", "row", "group")

    def __init__(self, kind: str, number: int, parent: int | None, depth: int, attributes: dict[str, str]) -> None:
        self.kind, self.number, self.parent, self.depth = kind, number, parent, depth
        self.id, self.css = attributes.get("id"), attributes.get("class")
        self.rows: list[tuple[int, list]] = []  # row group, cells
        self.cell: tuple[list[str], bool, int, int] | None = None  # texts, head, down, right
        self.row: list | None = None
        self.group = 0

    def begin_row(self) -> None:
        self.cell, self.row = None, []
        self.rows.append((self.group, self.row))

    def begin_cell(self, head: bool, attributes: dict[str, str]) -> None:
        if self.row is None:
            self.begin_row()
        down = right = 1
        if attributes:
            span = lambda name, most: min(most, int(x[:9])) if (x := attributes.get(name, "").strip()).isascii() and x.isdigit() else 1
            down, right = span("rowspan", MOST_ROWS) or MOST_ROWS, max(1, span("colspan", MOST_COLUMNS))
        self.cell = ([], head, down, right)
        self.row.append(self.cell)


def boxes(page: str) -> list[_Box]:
    """Lists and tables of a page in the order of their starts. Text belongs to the innermost item or cell around it."""
    found: list[_Box] = []
    stack: list[_Box] = []
    inside: dict[str, list[_Box]] = {"list": [], "table": []}
    numbers = {"list": 0, "table": 0}

    def push(kind: str, attributes: dict[str, str]) -> None:
        same = inside[kind]
        stack.append(_Box(kind, numbers[kind], same[-1].number if same else None, len(same), attributes))
        same.append(stack[-1])
        numbers[kind] += 1
        found.append(stack[-1])

    def pop() -> None:
        inside[stack.pop().kind].pop()

    def table() -> _Box | None:
        """The innermost table; what is open inside of it ends."""
        if not inside["table"]:
            return None
        while stack[-1].kind != "table":
            pop()
        return stack[-1]

    top = into = None
    for step in _steps(page):
        if step.__class__ is str:
            if step and into is not None:
                into.append(step)
            continue
        if step is None:
            continue
        role, opens, head, attributes = step
        if role == "cell" and top and top.kind == "table":  # what most tags are
            if opens:
                top.begin_cell(head, attributes)
                into = top.cell[0]
            else:
                top.cell = into = None
            continue
        if role in ("cell", "row", "group"):
            if box := table():
                box.cell = None
                if role == "cell":
                    if opens:
                        box.begin_cell(head, attributes)
                else:
                    box.row = None
                    if role == "group":
                        box.group += 1
                    elif opens:
                        box.begin_row()
        elif role == "break":
            if into is not None:
                into.append(" ")
            continue
        elif role == "table":
            if opens:
                push("table", attributes)
            elif table():
                pop()
        elif role == "list":
            if opens:
                push("list", attributes)
            elif top and top.kind == "list":
                pop()
        elif top and top.kind == "list":
            top.row = top.cell = None
            if opens:
                top.begin_cell(False, {})
        top = stack[-1] if stack else None
        into = top.cell[0] if top and top.cell else None
    return found


def _text(cell: tuple[list[str], bool, int, int]) -> str:
    text = cell[0][0] if len(cell[0]) == 1 else "".join(cell[0])
    return " ".join((references.unescape(text) if "&" in text else text).split())


def _places(box: _Box) -> Iterator[dict[int, tuple[int, str, bool, int]]]:
    """Each row's places by column: the row after the cell's last, text, head, and the cell's own row, which is -1 beyond its first column."""
    row: dict[int, tuple[int, str, bool, int]] = {}
    last = None
    for r, (group, cells) in enumerate(box.rows):
        row, last, column = {c: x for c, x in row.items() if x[0] > r} if group == last else {}, group, 0
        for cell in cells:
            while column in row:
                column += 1
            _, head, down, right = cell
            row[column] = (r + down, text := _text(cell), head, r)
            column += 1
            for _ in range(right - 1):
                if column in row:
                    break
                row[column] = (r + down, text, head, -1)
                column += 1
        yield row


def grid(box: _Box) -> Iterator[tuple[int, int, str, bool, bool]]:
    """(row, column, text, head, first) of a table: a cell stands at all places that it spans, in rows of its group that are there, and first at its own.

    Where two cells claim a place the earlier one has it.
    """
    for r, row in enumerate(_places(box)):
        for c in sorted(row):
            _, text, head, own = row[c]
            yield r, c, text, head, own == r


def _boxed(pages: DataFrame, key: str, html: str, kind: str, schema: str, rows) -> DataFrame:
    """key and ``schema``: ``rows`` of each list or table of each page, some thousands in a batch."""
    pages = pages.where(F.col(html).isNotNull()).select(key, html)
    kinds = [F.lit(None).cast(t).alias(n) for n, t in (x.split() for x in schema.split(", "))]
    whole = pages.select(key, *kinds).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.name for f in whole.fields]
        types = [_ARROW[f.dataType.simpleString()] for f in whole.fields[1:]]
        for batch in batches:
            keys, found = [], []
            for name, page in zip(batch.column(0), batch.column(1)):
                for b in boxes(page.as_py()):
                    if b.kind == kind:
                        found += rows(b)
                keys += [name.as_py()] * (len(found) - len(keys))
                if len(found) >= _BATCH:
                    yield pa.RecordBatch.from_arrays([pa.array(keys, batch.schema.field(0).type), *map(pa.array, zip(*found), types)], names=names)
                    keys, found = [], []
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(keys, batch.schema.field(0).type), *map(pa.array, zip(*found), types)], names=names)

    return pages.mapInArrow(run, whole)


def page_lists(pages: DataFrame, key: str, html: str) -> DataFrame:
    """key, list, parent, depth, element_id, element_class, item, text: the items of all lists of all pages, lists numbered by where they start.

    ``parent`` is the list around, null for outer ones. An item's text is its own, without that of lists and tables in it; white space is
    one space, character references are decoded. Items and lists may be left open. Null pages have none.
    """
    rows = lambda b: ((b.number, b.parent, b.depth, b.id, b.css, i, _text(cells[0])) for i, (_, cells) in enumerate(b.rows))
    return _boxed(pages, key, html, "list", "list int, parent int, depth int, element_id string, element_class string, item int, text string", rows)


def page_tables(pages: DataFrame, key: str, html: str) -> DataFrame:
    """key, table, parent, depth, element_id, element_class, row, column, text, head, first: the grids of all tables of all pages.

    A cell that spans rows or columns stands at each of its places, and is ``first`` at one. Spans end with the row group. Nested tables
    are tables of their own, as lists are in page_lists(), and add nothing to the text around them. ``head`` marks th.
    """
    rows = lambda b: ((b.number, b.parent, b.depth, b.id, b.css, *x) for x in grid(b))
    return _boxed(pages, key, html, "table", "table int, parent int, depth int, element_id string, element_class string, row int, column int, text string, head boolean, first boolean", rows)


def adapted(cells: DataFrame, key: str, columns: dict[str, str], heads: int | None = None) -> DataFrame:
    """key, table, row and a text column for each of ``columns``, which maps names to patterns of labels.

    A grid column's label is the texts above its data, from top to bottom without repeats, one space between; ``heads`` rows are
    labels, or else those before the first row with a cell that isn't one. A name is the leftmost column whose label has its
    pattern. Tables with none of the names give no rows; rows above the data are left out. A table's
    cells are shuffled once, and are together in one task.
    """
    one, down = Window.partitionBy(key, "table"), Window.partitionBy(key, "table", "column").orderBy("row").rowsBetween(Window.unboundedPreceding, 0)
    x = cells.withColumn("_begin", F.min(F.when(~F.col("head"), F.col("row"))).over(one) if heads is None else F.lit(heads))
    above = F.collect_list(F.when(F.col("row") < F.col("_begin"), F.col("text"))).over(down)
    x = x.withColumn("_label", F.array_join(F.array_distinct(above), " ")).where(F.col("row") >= F.col("_begin"))
    at = {name: F.min(F.when(F.col("_label").rlike(pattern), F.col("column"))).over(one) for name, pattern in columns.items()}
    x = x.withColumns({f"_at_{name}": c for name, c in at.items()})
    mine = {name: F.col("column") == F.col(f"_at_{name}") for name in columns}
    named = F.lit(False)
    for held in mine.values():
        named = named | F.coalesce(held, F.lit(False))
    return x.where(named).groupBy(key, "table", "row").agg(*(F.max(F.when(held, F.col("text"))).alias(name) for name, held in mine.items()))


def _labelled(box: _Box, heads: int | None) -> Iterator[tuple[int, int, list[str], list[list[str | None]]]]:
    """(number, first row of the data, labels, texts of each row of data) of a table with data, for the columns that have any."""
    rows = list(_places(box))
    begin = heads if heads is not None else next((r for r, row in enumerate(rows) if not all(x[2] for x in row.values())), len(rows))
    above, data = rows[:begin], rows[begin:]
    if columns := sorted(set().union(*data)):
        labels = [" ".join(dict.fromkeys([row[c][1] for row in above if c in row])) for c in columns] if above else [""] * len(columns)
        yield box.number, begin, labels, [[row[c][1] if c in row else None for c in columns] for row in data]


def adapted_tables(pages: DataFrame, key: str, html: str, columns: dict[str, str], heads: int | None = None) -> DataFrame:
    """adapted() of page_tables(), where each page is: a table leaves Python with its columns' labels, and nothing is shuffled.

    Pages of equal or null keys stay apart.
    """
    x = _boxed(pages, key, html, "table", "table int, _begin int, _labels array<string>, _texts array<array<string>>", lambda b: _labelled(b, heads))
    x = x.withColumns({f"_at_{name}": F.array_position(F.transform("_labels", lambda l: l.rlike(pattern)), F.lit(True)).cast("int") - 1 for name, pattern in columns.items()})
    x = x.where(F.greatest(F.lit(-1), *(F.col(f"_at_{name}") for name in columns)) >= 0)
    x = x.select(key, "table", "_begin", *(f"_at_{name}" for name in columns), F.posexplode("_texts").alias("_row", "_cells"))
    x = x.select(key, "table", (F.col("_begin") + F.col("_row")).alias("row"), *(F.get("_cells", F.col(f"_at_{name}")).alias(name) for name in columns))
    return x.where(F.coalesce(*columns, F.lit(None)).isNotNull())


def figure(text: str | Column) -> Column:
    """The number that a cell shows: full-width digits, separators and units after it don't matter; brackets and triangles are minus signs. Null if it is none."""
    x = F.translate(F.regexp_replace(text, r"[,，\s ]", ""), "０１２３４５６７８９．－＋（）％", "0123456789.-+()%")
    x = F.regexp_replace(F.regexp_replace(x, "^[△▲−–]", "-"), r"^\((.*)\)$", "-$1")
    return F.regexp_extract(x, r"^([+-]?(?:\d+\.?\d*|\.\d+))(?:[^\d.].*)?$", 1).try_cast("double")
