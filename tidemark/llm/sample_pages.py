"""Labelled pages for the extraction model: invented words in the layouts that web pages have. No page of a corpus is among them."""

from __future__ import annotations

import random

#: Marks a block of main text in a sample page; no feature sees it.
MARK = "data-k"

_MAIN = ["content", "main-content", "post", "entry-content", "article-body", "story", "post-body", "text", "page-content", "articleBody"]
#: Names of wrappers and main parts that hint at something else.
_MISLEADING = ["has-sidebar", "two column", "top-story", "post tag-news", "no-comments", "main-column", "single more", "content-side", "page-top", "with-ads", "article-header-less"]
_BOILER = {
    "nav": ["nav", "navbar", "main-menu", "navigation", "breadcrumb", "breadcrumbs", "site-menu", "pagination", "toc", "pager"],
    "head": ["header", "site-header", "masthead", "top-bar", "topbar", "page-header", "branding"],
    "foot": ["footer", "site-footer", "page-footer", "bottom", "copyright", "colophon", "legal"],
    "side": ["sidebar", "side", "widget", "right-column", "sidebar-left", "secondary", "rail"],
    "ad": ["ad", "ads", "advert", "advertisement", "banner-ad", "sponsored", "promo", "adsbox", "ad-slot", "banner", "sponsor"],
    "notice": ["cookie-notice", "cookie-banner", "consent", "notice", "alert", "popup", "modal", "gdpr", "cookies", "warning", "notification", "paywall"],
    "form": ["newsletter", "subscribe", "signup", "login", "search", "search-form", "contact-form", "subscription"],
    "comment": ["comments", "comment-list", "comment", "replies", "disqus", "discussion", "user-comments", "reader-comments", "responses"],
    "social": ["share", "social", "share-buttons", "sharing", "follow-us", "social-links"],
    "more": ["related", "related-posts", "recommended", "read-more", "more-stories", "also-like", "trending", "popular", "tags"],
}


class _Page:
    def __init__(self, seed: int):
        self.r = random.Random(seed)
        messy = self.r.random() < 0.6  # marks in links and headings, too
        letters = self.r.choice(["etaoinshrdlu", "eaiésrntloudèç", "enisrahtdulüäöß", "aeosrnidlctuñíó", "abcdefghijklmnopqrstuvwxyz"])
        self.vocabulary = ["".join(self.r.choices(letters, k=self.r.randint(1, 9))) + self.r.choice(["", "", "", "", "", ",", ".", "!"] if messy else [""])  for _ in range(120)]

    def words(self, lo: int, hi: int) -> str:
        return " ".join(self.r.choices(self.vocabulary, k=self.r.randint(lo, hi)))

    def sentence(self) -> str:
        x = self.words(1, 18).capitalize()
        if self.r.random() < 0.15:
            x = x.replace(" ", self.r.choice(["*** ", " &amp; ", "%%% ", ", ", " | ", "!! ", "$$$ "]))
        return x + self.r.choice([".", ".", ".", ".", "!", "?", ""])

    def sentences(self, lo: int, hi: int) -> str:
        return " ".join(self.sentence() for _ in range(self.r.randint(lo, hi)))

    def named(self, names: list[str], always: bool = False) -> str:
        if not always and self.r.random() < 0.15:
            return ""
        name = self.r.choice(names)
        return self.r.choice([f' class="{name}"', f' id="{name}"', f" class='{name} {self.r.choice('abc')}{self.r.randint(1, 9)}'", f' class="{name}" role="region"'])

    def links(self, lo: int, hi: int) -> str:
        link = lambda: f'<a href="/{self.r.randint(1, 999)}">{self.words(1, most)}</a>'
        n, most = self.r.randint(lo, hi), self.r.choice([1, 2, 4, 8])
        return self.r.choice([lambda: "<ul>" + "".join(f"<li>{link()}</li>" for _ in range(n)) + "</ul>", lambda: self.r.choice([" | ", " ", " &rsaquo; "]).join(link() for _ in range(n))])()

    def boiler(self, kind: str) -> str:
        r, names = self.r, _BOILER[kind]
        inner = {
            "nav": lambda: self.links(2, 12), "head": lambda: r.choice(["", f"<div class='logo'><a href='/'>{self.words(1, 3)}</a></div>"]) + r.choice([self.links(2, 6), f"<p>{self.words(2, 8)}</p>", f"<h1>{self.words(1, 4)}</h1>"]),
            "foot": lambda: r.choice(["&copy; ", "", "Copyright "]) + r.choice([self.sentences(1, 2), self.words(1, 5) + " &middot; " + self.sentence(), self.links(2, 6), f"<p>{self.sentence()}</p>"]),
            "side": lambda: f"<h3>{self.words(1, 3)}</h3>" + r.choice([self.links(3, 8), f"<p>{self.sentences(1, 3)}</p>", f"<div>{self.sentences(1, 2)}</div>"]),
            "ad": lambda: r.choice([self.sentences(1, 2), f"<p>{self.sentences(1, 3)}</p>", f'<a href="http://x.example/"><img src="a.png">{self.words(1, 6)}</a>', f"<span>{self.words(1, 5)}</span>"]),
            "notice": lambda: r.choice([f"<p>{self.sentences(1, 3)}</p>", self.sentences(1, 2)]) + r.choice(["", f"<button>{self.words(1, 2)}</button>"]),
            "form": lambda: f"<label>{self.words(1, 4)}</label><input type='text'>" + r.choice(["", f"<p>{self.sentence()}</p>", f"<select><option>{self.words(1, 2)}</option><option>{self.words(1, 2)}</option></select>", f"<textarea>{self.words(0, 4)}</textarea>"]) + f"<button>{self.words(1, 2)}</button>",
            "comment": lambda: f"<h{r.choice('23')}>{self.words(1, 3)}</h3>" + "".join(r.choice([f"<div{self.named(['comment', 'comment-body', 'reply'])}><p>{self.sentences(1, 5)}</p></div>", f"<li{self.named(['comment', 'comment-body'])}><b>{self.words(1, 2)}</b> {self.sentences(1, 4)}</li>", f"<article class='comment'><p>{self.sentences(1, 4)}</p></article>"]) for _ in range(r.randint(1, 5))),
            "social": lambda: self.links(2, 5), "more": lambda: r.choice(["", f"<h3>{self.words(1, 3)}</h3>"]) + r.choice([self.links(2, 6), f"<p>{self.links(1, 2)}</p>"]),
        }[kind]()
        tag = {"nav": ["nav", "nav", "div", "ul"], "head": ["header", "header", "div"], "foot": ["footer", "footer", "div"], "side": ["aside", "aside", "div"], "form": ["form", "form", "div"], "comment": ["section", "div", "ol", "div"], "ad": ["div", "div", "aside", "ins", "section"], "notice": ["div", "div", "section", "dialog"]}.get(kind, ["div", "section", "div"])
        tag = r.choice(tag)
        if tag != "ul" and r.random() < 0.15:
            inner = r.choice([self.words(1, 4), self.sentence(), f"<p>{self.sentence()}</p>"])
        plain = tag in ("nav", "header", "footer", "aside", "form") and r.random() < 0.55
        attr = "" if plain else self.named(names, always=tag not in ("nav", "header", "footer", "form", "ul"))
        if kind == "form" and tag == "div":
            inner = f"<form>{inner}</form>"
        return f"<{tag}{attr}>{inner}</{tag}>"

    def block(self) -> str:
        r, k = self.r, f' {MARK}="1"'
        x = r.random()
        if x < 0.68:
            text = self.sentences(1, r.choice([1, 3, 6, 12]))
            if r.random() < 0.2:
                text = f"<b>{text}" + r.choice(["</b>", "<br>", ""])
            if r.random() < 0.2:
                text += f' <a href="/{r.randint(1, 99)}">{self.words(1, 4)}</a> {self.sentence()}'
            return f"<p{k}>{text}" + r.choice(["</p>", "</p>", "</p>", ""])
        if x < 0.78:
            return f"<h{(n := r.randint(2, 4))}{k}>{self.words(1, 7)}</h{n}>"
        if x < 0.86:
            tag = r.choice(["ul", "ol"])
            return f"<{tag}{k}>" + "".join(f"<li{k}>{self.sentences(1, 2)}</li>" for _ in range(r.randint(2, 5))) + f"</{tag}>"
        if x < 0.9:
            return f"<blockquote{k}>{r.choice(['', '<p' + k + '>'])}{self.sentences(1, 3)}</blockquote>"
        if x < 0.93:
            return f"<table{k}>" + "".join(f"<tr{k}>" + "".join(f"<td{k}>{self.words(1, 3)}</td>" for _ in range(3)) + "</tr>" for _ in range(r.randint(2, 4))) + "</table>"
        if x < 0.96:
            return f"<div{k}>{self.sentences(1, 6)}</div>"
        return r.choice([f"<pre{k}>{self.words(3, 30)}</pre>", f"<figure{k}><img src='x.png'><figcaption{k}>{self.sentence()}</figcaption></figure>", f"<section{k}><h2{k}>{self.words(1, 4)}</h2><p{k}>{self.sentences(1, 5)}</p></section>"])

    def html(self) -> str:
        r = self.r
        blocks = [self.block() for _ in range(r.choice([1, 1, 2, 3, 5, 8, 14]))]
        if r.random() < 0.7:
            blocks.insert(0, f'<h1 {MARK}="1">{self.words(1, 12)}</h1>')
        if r.random() < 0.2:  # a few words alone, under a heading that repeats them
            text = r.choice([self.sentence(), self.words(1, 6).capitalize() + ".", self.words(1, 3).capitalize() + "."])
            blocks = [f'<h1 {MARK}="1">{text}</h1>', f'<p {MARK}="1">{r.choice(["", "<b>"])}{text}{r.choice(["", "<br>", "</p>"])}']
        for kind, p in (("ad", 0.25), ("form", 0.1), ("more", 0.15), ("social", 0.2), ("comment", 0.12), ("notice", 0.08), ("side", 0.06)):
            if r.random() < p:
                at = len(blocks) if kind in ("comment", "social", "more", "form") else r.randint(1, len(blocks))
                blocks.insert(at, self.boiler(kind))
        if r.random() < 0.04:
            return "".join(self.block() for _ in range(r.randint(1, 4)))  # a fragment without a layout
        inner = "".join(blocks)
        tag = r.choice(["article", "article", "main", "div", "div", "section", "td", ""])
        if tag:
            attr = f' class="{r.choice(_MISLEADING)}"' if r.random() < 0.08 else self.named(_MAIN) if tag in ("div", "section", "td") else r.choice(["", self.named(_MAIN)])
            inner = f"<{tag}{attr}>{inner}</{tag}>"
            if tag == "td":
                cells = [f"<td{self.named(_BOILER[k], always=True)}>{r.choice([self.links(1, 6), self.words(1, 5)])}</td>" for k in r.choices(["nav", "side", "ad"], k=r.randint(0, 2))]
                at = r.randint(0, len(cells))
                inner = f"<table><tr>{''.join(cells[:at])}{inner}{''.join(cells[at:])}</tr></table>"
        for _ in range(r.choice([0, 0, 1, 2])):
            names = _MISLEADING if r.random() < 0.12 else ["wrapper", "container", "page", "row", "col", "main", "inner"]
            inner = f"<div{self.named(names)}>{inner}</div>"
        before = [self.boiler(k) for k, p in (("head", 0.5), ("nav", 0.75), ("notice", 0.3), ("ad", 0.5), ("form", 0.15), ("side", 0.15), ("social", 0.1)) if r.random() < p]
        after = [self.boiler(k) for k, p in (("social", 0.15), ("comment", 0.3), ("more", 0.3), ("side", 0.3), ("ad", 0.2), ("form", 0.15), ("notice", 0.15), ("foot", 0.8)) if r.random() < p]
        if r.random() < 0.3:
            r.shuffle(before)
        return f"<!DOCTYPE html><html><head><title>{self.words(1, 8)}</title><style>p{{}}</style><script>var t='</p>';</script></head><body{self.named(_MISLEADING) if r.random() < 0.06 else ''}>{''.join(before)}{inner}{''.join(after)}" + r.choice(["</body></html>", "</body></html>", ""])


def sample_page(seed: int) -> str:
    return _Page(seed).html()
