"""Main text of pages written by hand, none of which the generator of training pages makes, and of broken and hostile ones."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import html

LINKS = "".join(f"<li><a href='/{k}'>{w}</a></li>" for k, w in enumerate(("Home", "World", "Science", "Sport", "Weather", "About us")))
PARAGRAPHS = [
    "The harbour was quiet when the first boats came back, and nobody on the quay had expected them before noon.",
    "Three of the crews had turned round in the night, after the wind had gone round to the north and the swell had grown.",
    "“We have seen worse,” said one of the skippers, “but not in June, and not with so little warning from the coast.”",
    "By the evening all but one of the boats had been accounted for, and the last one answered at a quarter past nine.",
]
TEXT = " ".join(PARAGRAPHS)
BODY = "".join(f"<p>{p}</p>" for p in PARAGRAPHS)
PAGES = {
    "plain": (f"<!DOCTYPE html><html><head><title>T</title></head><body><header><h2>Site</h2><nav><ul>{LINKS}</ul></nav></header><main><article><h1>Boats return</h1>{BODY}</article></main><footer><p>© 2024 The Site. All rights reserved.</p></footer></body></html>", "Boats return " + TEXT),
    "head left open": (f"<html><head><title>T</title><meta charset=utf-8><body><nav><ul>{LINKS}</ul></nav><article><h1>Boats return</h1>{BODY}</article><footer>© 2024</footer>", "Boats return " + TEXT),
    "no head, upper case": (f"<HTML><BODY><DIV CLASS=menu><UL>{LINKS}</UL></DIV><DIV CLASS=content><H1>Boats return</H1>{BODY}</DIV><DIV CLASS=footer>© 2024 The Site</DIV></BODY></HTML>", "Boats return " + TEXT),
    "scripts and styles inside": (f"<body><div id='main'><h1>Boats return</h1><script>if (a < b) document.write('<p>no</p>')</script>{BODY}<style>p {{ color: red }}</style></div><div class='sidebar'><h3>Most read</h3><ul>{LINKS}</ul></div></body>", "Boats return " + TEXT),
    "comments and form": (f"<body><article><h1>Boats return</h1>{BODY}</article><form class='newsletter'><label>Your address</label><input name=e><button>Subscribe now</button></form><section id='comments'><h3>2 comments</h3><div class='comment'><p>Glad they are all back.</p></div><div class='comment'><p>So am I, thanks for the report.</p></div></section></body>", "Boats return " + TEXT),
    "formula": (f"<body><nav><ul>{LINKS}</ul></nav><article><h1>Boats return</h1>{BODY}<p>Its speed was <math><mi>v</mi><mo>=</mo><mn>9</mn></math> knots &amp; more, as x &lt; y.</p></article></body>", "Boats return " + TEXT + " Its speed was v=9 knots & more, as x < y."),
}


@pytest.mark.parametrize("name", PAGES)
def test_hand_written_page(spark, name):
    page, want = PAGES[name]
    assert html.main_texts([page], html.train(spark)) == [want]


def test_very_long_page(spark):
    long = "".join(f"<p>{p} {k}</p>" for k in range(3000) for p in PARAGRAPHS)
    want = " ".join(f"{p} {k}" for k in range(3000) for p in PARAGRAPHS)
    assert html.main_texts([f"<body><nav><ul>{LINKS}</ul></nav><article>{long}</article></body>"], html.train(spark)) == [want]


def test_clashing_columns(spark):
    pages = spark.createDataFrame([(1, "u", PAGES["plain"][0])], "page_id long, url string, html string").withColumns({c: F.lit(7) for c in ("text", "n_chars", "margin")})
    row = html.extracted(pages, html.train(spark)).first()
    assert row.text == PAGES["plain"][1] and row.n_chars == len(row.text)


@pytest.mark.parametrize("piece", ["<div>", "<ul><li>", "<p a='", "<a ", "<a<", "<p title=\"<", "<svg>x", "<tr><td>x", "<!--", "<!x", "</", "&", "<p><button><div>", "<i class=ad>", "</x><div></span>"])
def test_hostile_pages_take_linear_time(piece):
    page = piece * (500_000 // len(piece))
    began = time.process_time()
    parsed = html.Page(page)
    x, parents, ends, _ = html.node_features([parsed])
    parsed.text(html.decode(np.ones(len(x)), parents, ends))
    assert time.process_time() - began < 4  # a second or less where nothing else runs


def test_broken_markup():
    def whole(source):
        page = html.Page(source)
        return page.text(np.ones(len(page.tags), bool))

    assert whole("<p title='<b>bold</b>'>a</p><p title=\"x > y\">b</p>") == "a b"
    assert whole("a < b and <p c='>d") == "a < b and d"
    assert whole("<svg>kept<p>more") == "kept more" and whole("<script>gone<p>more") == "" and whole("<!-- gone <p>more") == ""
