"""Lists and tables of pages against an own reading of well-formed ones, and by hand of odd ones."""

import random
import time
from html.parser import HTMLParser

import pytest
from pyspark.sql import functions as F

from tidemark.operators import markup


def lists(spark, *pages):
    df = spark.createDataFrame([(i, p, "x") for i, p in enumerate(pages)], "id int, html string, text string")
    return sorted((r.id, r.list, r.item, r.text, r.parent, r.depth) for r in markup.page_lists(df, "id", "html").collect())


def tables(spark, *pages):
    df = spark.createDataFrame([(i, p, "x") for i, p in enumerate(pages)], "id int, html string, text string")
    return markup.page_tables(df, "id", "html")


def texts(df, page=0):
    rows = {}
    for r in df.where(F.col("id") == page).collect():
        rows.setdefault(r.table, {})[r.row, r.column] = r.text
    return rows


def test_lists_with_attributes_nesting_and_missing_ends(spark):
    page = """<UL class="a > b" id='menu'><LI data-x='</li>'>One<li>Two <b>bold</b>&amp;<br/>more
      <ol><li>inner 1<li>inner <table><tr><td>cell</td></tr></table>2</ol> after</li></UL><ul><li></ul>
      <script>"<ul><li>no</li></ul>"</script><!-- <ul><li>no --><ol start=3><li>Ünï &#x41; <li>last"""
    got = lists(spark, page, None, "", "<li>alone</li></ul>", "< ul><li <b>")
    assert got == [(0, 0, 0, "One", None, 0), (0, 0, 1, "Two bold& more after", None, 0), (0, 1, 0, "inner 1", 0, 1), (0, 1, 1, "inner 2", 0, 1), (0, 2, 0, "", None, 0), (0, 3, 0, "Ünï A", None, 0), (0, 3, 1, "last", None, 0)]
    df = spark.createDataFrame([(1, page)], "id int, html string")
    assert {(r.list, r.element_id, r.element_class) for r in markup.page_lists(df, "id", "html").collect()} == {(0, "menu", "a > b"), (1, None, None), (2, None, None), (3, None, None)}


def test_spans(spark):
    page = """<table><thead><tr><th rowspan=2>A<th colspan=2>B</tr><tr><th>x<th rowspan=9>y</tr></thead>
      <tr><td rowspan="0">all<td>1<td>2<tr><td>3<td rowspan=2 colspan=2>wide<tr><td>4</table>"""
    got = texts(tables(spark, page))[0]
    assert got == {(0, 0): "A", (0, 1): "B", (0, 2): "B", (1, 0): "A", (1, 1): "x", (1, 2): "y", (2, 0): "all", (2, 1): "1", (2, 2): "2", (3, 0): "all", (3, 1): "3", (3, 2): "wide", (3, 3): "wide", (4, 0): "all", (4, 1): "4", (4, 2): "wide", (4, 3): "wide"}
    first = {(r.row, r.column) for r in tables(spark, page).where("first").collect()}
    assert first == {(0, 0), (0, 1), (1, 1), (1, 2), (2, 0), (2, 1), (2, 2), (3, 1), (3, 2), (4, 1)}


def test_nested_tables_and_broken_ones(spark):
    page = "<table><tr><td>out<table><tr><td>in<ul><li>item</ul>side</table>er<td>2</table> <td>none</td><table>x<td>no row<tr></table><table><caption>c</caption><tr><td>open"
    got = texts(tables(spark, page))
    assert got == {0: {(0, 0): "outer", (0, 1): "2"}, 1: {(0, 0): "inside"}, 2: {(0, 0): "no row"}, 3: {(0, 0): "open"}}
    rows = {r.table: (r.parent, r.depth) for r in tables(spark, page).collect()}
    assert rows == {0: (None, 0), 1: (0, 1), 2: (None, 0), 3: (None, 0)}
    assert tables(spark, None, "", "no table").count() == 0


class Plain(HTMLParser):
    def __init__(self):
        super().__init__()
        self.cells, self.row, self.text = [], -1, None

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        if tag == "tr":
            self.row += 1
        if tag in ("td", "th"):
            self.text = []
            self.cells.append((self.row, int(a.get("rowspan", 1)), int(a.get("colspan", 1)), self.text, tag == "th"))

    def handle_data(self, data):
        if self.text is not None:
            self.text.append(data)

    def handle_endtag(self, tag):
        if tag in ("td", "th"):
            self.text = None


def grid_plain(page):
    """Cells on a grid, place by place."""
    p = Plain()
    p.feed(page)
    taken = {}
    for row, down, right, text, head in p.cells:
        column = 0
        while (row, column) in taken:
            column += 1
        for k in range(right):
            if (row, column + k) in taken:
                break
            for r in range(row, min(row + down, p.row + 1)):
                taken.setdefault((r, column + k), (" ".join("".join(text).split()), head))
    return taken


def test_random_tables(spark):
    r = random.Random(8)
    pages = []
    for _ in range(60):
        rows = "".join("<tr>" + "".join(f"<{(t := r.choice(['td', 'th']))} class='c {r.randint(0, 9)}' rowspan={r.choice([1, 1, 1, 2, 3])} colspan=\"{r.choice([1, 1, 2, 3])}\">{r.randint(0, 999)} &lt;<i>{r.choice('äßz')}</i></{t}>" for _ in range(r.randint(0, 5))) + "</tr>" for _ in range(r.randint(1, 6)))
        pages.append(f"<div><table width=100%>{rows}</table></div>")
    got = {}
    for x in tables(spark, *pages).collect():
        got.setdefault(x.id, {})[x.row, x.column] = (x.text, x.head)
    assert got == {i: g for i, p in enumerate(pages) if (g := grid_plain(p))}


def test_columns_by_labels(spark):
    page = "<table><tr><th rowspan=2>Month<th colspan=2>Sales</tr><tr><th>all<th>old</tr><tr><th>4<td>1,200<td>△3.5%<tr><td>5<td>(7)<td>n/a</table><table><tr><td>Month<td>Old sales<tr><td>6<td>９．５</table><table><tr><td>x</table>"
    cells = tables(spark, page)
    got = [tuple(r) for r in markup.adapted(cells, "id", {"month": "Month", "old": "(?i)old", "all": "Sales all"}).orderBy("table", "row").collect()]
    assert got == [(0, 0, 2, "4", "△3.5%", "1,200"), (0, 0, 3, "5", "n/a", "(7)")]
    got = [tuple(r) for r in markup.adapted(cells, "id", {"month": "Month", "old": "(?i)old"}, heads=1).where("table = 1").collect()]
    assert got == [(0, 1, 1, "6", "９．５")]
    figures = {"△3.5%": -3.5, "1,200": 1200.0, "(7)": -7.0, "n/a": None, "９．５": 9.5, "": None, None: None, "-.5 m": -0.5, "1.2.3": None, "▲１，０００": -1000.0}
    df = spark.createDataFrame([(k,) for k in figures], "t string").select("t", markup.figure("t").alias("x"))
    assert {r.t: r.x for r in df.collect()} == figures


@pytest.mark.parametrize("page", ["<ul><li>" * 100_000, "<table><tr><td>" * 50_000, "<a b=\"" * 100_000, "<a b='" * 50_000 + '<c d="' * 50_000, "<!-- " * 100_000, "<" * 300_000, "<ul>" * 50_000 + "<td>" * 50_000, "<table><tr>" + "<td rowspan=65534>" * 300 + "<tr>" * 300, "</ul>" * 100_000, "<script>" * 50_000, "<table><ul><li>" * 30_000 + "</table>" * 30_000])
def test_hostile_pages_take_linear_time(page):
    began = time.time()
    found = markup.boxes(page)
    n = sum(len(list(markup.grid(b))) for b in found if b.kind == "table")
    assert time.time() - began < 5 and n < 1_000_000


@pytest.mark.parametrize("heads", [None, 0, 1, 2])
def test_tables_are_adapted_where_their_pages_are(spark, heads):
    """As adapted() of the cells has it, without a shuffle, on tables with spans, ragged rows and nesting."""
    r = random.Random(5)
    texts = ["A", "B", "A B", "", "7 &amp; 8", "x<br>y", "<table><tr><th>A<tr><td>1<td>2</table>", "<ul><li>B</ul>"]
    pages = ["<table></table>", "", None, "no", "<table><tr><th>A</table>", "<table><tr><tr><td>A"]
    for _ in range(80):
        rows = "".join("<tr>" + "".join(f"<{r.choice(['td', 'th', 'th'])}{r.choice(['', '', ' rowspan=2', ' colspan=2', ' rowspan=0'])}>{r.choice(texts)}" for _ in range(r.randint(0, 4))) for _ in range(r.randint(0, 5)))
        pages.append(f"<!-- <table> --><table>{rows}</table>{r.choice(['', '<', '<script><tr></script>'])}<table>{rows}")
    columns = {"a": "A", "b": "(?i)b$", "none": "^nothing", "bare": "^$"}
    df = spark.createDataFrame([(i, p) for i, p in enumerate(pages)], "id int, html string")
    got = markup.adapted_tables(df, "id", "html", columns, heads)
    want = markup.adapted(markup.page_tables(df, "id", "html"), "id", columns, heads)
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString() and got.dtypes == want.dtypes
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str) and want.count() > 50


def test_quick_pages_are_read_as_slow_ones(monkeypatch):
    """Pages of well-formed tags are split at once; the tags that are read one by one give the same lists and tables."""
    r = random.Random(6)
    bits = ["<table>", "</table>", "<TR>", "<td>", "</td>", "<td rowspan=2>", '<td colspan="3" >', "<th rowspan='2'>", "<td a=b/>", "<br/>", "<p>", "<ul>", "<li>", '<ol class="a > b">', "<b>", "x", "&lt;", " y ", "<!-- <td> -->", "<td rowspan=2 rowspan=3>", "<tbody>", '<td ROWSPAN="&#50;">', "<td a='\"' b=\"'\">", "<td a b c=1 >", "\n"]
    odd = ["<", '<td a="', "<!-- ", "<script>", "<td a=<b>", "</title>", "<td a=\"x<y\">", "<td a=b\"c>", "<!-->", "<textarea>", "<td class='" + "x" * 400 + "'>"]
    pages = ["".join(r.choice(odd if r.random() < 0.02 else bits) for _ in range(r.randint(1, 40))) for _ in range(3000)]
    read = lambda p: [(b.kind, b.number, b.parent, b.depth, b.id, b.css, [*markup.grid(b)]) for b in markup.boxes(p)]
    quick = [read(p) for p in pages]
    monkeypatch.setattr(markup, "_steps", lambda page: [x if kind == "text" else markup._step(x, kind == "open", a) for kind, x, a in markup.events(page)])
    assert quick == [read(p) for p in pages] and sum(map(len, quick)) > 3000
