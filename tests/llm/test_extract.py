from __future__ import annotations

import random
import time
from html.parser import HTMLParser

from quillon.llm import extract

SCHEMA = "page_id long, url string, html string"
PAGE = """<!DOCTYPE html><html><head><title>T &amp; t</title><style>p{}</style><script>var t="</p><article>no</article>";</script></head><body class="page-12">
<header><p>Site header</p></header><nav><ul><li><a href="/">Home</a></li></ul></nav><!-- <p>hidden</p> --><div class="cookie-notice">We use cookies</div>
<div class="ad-slot">Buy!</div><main><article class="post-%d"><h1>Head &eacute;&#33;</h1><p>First <b>bold</b>
 para.<p>Second<br>line <a href="x">link</a></p><aside>Side</aside><form><input value="q"><button>Go</button></form><ul><li>one<li>two</ul></article>
<div id="comments"><p>Reader comment that is very long indeed, longer than the article itself by far, so that it would win by length alone.</p></div></main>
<div class="sidebar"><p>Sidebar</p></div><footer>&copy; us</footer></body></html>"""
TEXT = "Head é! First bold para. Second line link one two"


def texts(spark, rows, extra=""):
    return {r.page_id: r for r in extract.main_texts(spark.createDataFrame(rows, SCHEMA + extra)).collect()}


def test_article_only(spark):
    found = texts(spark, [(i, f"https://user@Host.example:80/{i}", PAGE % i, "p", 2) for i in range(4)], ", path string, host int")
    assert all(r.text == TEXT and r.n_chars == len(TEXT) for r in found.values())


def test_hosts_agree_on_a_path(spark):
    body = "<html><body><div class='teasers'><p>%s</p></div><div class='story s%d'><p>%s</p></div></body></html>"
    rows = [(i, "http://h.example/x", body % ("t" * 30, i, "story " * 30)) for i in range(9)] + [(9, "http://h.example/y", body % ("long teaser " * 30, 9, "short story"))]
    assert texts(spark, rows)[9].text == "short story"
    assert texts(spark, rows[-1:])[9].text.startswith("long teaser")


def test_salted_join_gives_the_same(spark, monkeypatch):
    rows = [(i, f"http://h{i % 3}.example/x", PAGE % i) for i in range(30)]
    whole = texts(spark, rows)
    monkeypatch.setattr(extract, "MAX_BROADCAST", 0)
    assert texts(spark, rows) == whole


def test_odd_pages(spark):
    rows = [(1, None, None), (2, "u", ""), (3, "", "plain &lt;text&gt;"), (4, "http://x/", "<p>a<p>b <div>c</i>"), (5, "http://y/", "<nav>menu</nav>"), (6, "http://z/", "<div>" * 3000 + "deep" + "<script>x"), (4, "http://x/", "<p>a<p>b <div>c</i>")]
    assert {k: r.text for k, r in texts(spark, rows).items()} == {1: "", 2: "", 3: "plain <text>", 4: "a b c", 5: "", 6: "deep"}
    assert extract.main_texts(spark.createDataFrame(rows, SCHEMA)).count() == 7
    assert extract.main_texts(spark.createDataFrame([], SCHEMA)).count() == 0


def test_whole_article_around_the_winner(spark):
    content = "<html><body><article><h1>Head</h1><p>Lead.</p><div class='content'><p>%s</p></div></article><div class='teasers'><p>Other</p></div></body></html>" % ("body " * 60)
    sections = "<html><body><div class='post'><div class='intro'><p>%s</p></div><div class='body'><p>%s</p></div></div><div class='links'><a href='/'>All</a></div></body></html>" % ("intro " * 50, "body " * 400)
    found = texts(spark, [(1, "http://a.example/", content), (2, "http://b.example/", sections)])
    assert found[1].text == "Head Lead. " + ("body " * 60).strip()
    assert found[2].text == ("intro " * 50 + "body " * 400).strip()


def test_headings_with_slugs_stay(spark):
    page = "<html><body><article><h2 id='search-algorithms'>Search</h2><p>One.</p><h2 id='related-work'>Related</h2><p class='notice'>Two <span class='share'>three</span>.</p><div class='related'><p>Gone</p></div></article></body></html>"
    assert texts(spark, [(1, "http://c.example/", page)])[1].text == "Search One. Related Two three."


class Plain(HTMLParser):
    """Another reading of a page, by the standard library: text outside of what is skipped, by blocks."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.skipped, self.blocks, self.words = 0, [], []

    def handle_starttag(self, tag, attrs):
        if tag in extract.SKIP:
            self.skipped += 1
        if tag in extract.BLOCK:
            self.cut()

    def handle_endtag(self, tag):
        if tag in extract.BLOCK:
            self.cut()
        if tag in extract.SKIP:
            self.skipped = max(0, self.skipped - 1)

    def handle_data(self, data):
        if not self.skipped:
            self.words.append(data)

    def cut(self):
        text = " ".join("".join(self.words).split())
        self.blocks += [text] if text else []
        self.words = []


def test_blocks_against_another_parser():
    draw = random.Random(12)

    def inside(depth):
        out = []
        for _ in range(draw.randrange(1, 4)):
            kind = draw.choice(["text", "p", "div", "nav", "script", "b", "comment", "a", "li"] if depth < 4 else ["text"])
            if kind == "text":
                out.append(draw.choice(["one &amp; two ", "3 < 4 and 5 > 2 ", "caf&eacute; ", "x\n  y ", "&#33;&nbsp;end "]))
            elif kind == "script":
                out.append("<script type='a>b'>if (a < b) { '<p>no</p>' }</script>")
            elif kind == "comment":
                out.append("<!-- <p>no</p> > -->")
            else:
                quoted = draw.choice([' class="k1"', " data-x='a > b'", " title=plain", ' title="it\'s"', ""])
                out.append(f"<{kind}{quoted}>{inside(depth + 1)}</{kind}>")
        return "".join(out)

    for _ in range(300):
        html = f"<html><body><div>{inside(0)}</div></body></html>"
        other = Plain()
        other.feed(html)
        other.close()
        other.cut()
        assert [b.text for b in extract.Page(html).blocks] == other.blocks, html


def test_hostile_pages_take_time_in_proportion():
    def seconds(make, n):
        began = time.perf_counter()
        extract.Page(make(n)).text(None)
        return time.perf_counter() - began

    pages = [
        lambda n: '<a "' * n, lambda n: "<a '" * n + ">", lambda n: "<div>" * n + "x", lambda n: "<i>" + "<div>" * n + "</i>" * n, lambda n: "<svg>" * n + "<p>y",
        lambda n: "<script>" * n, lambda n: "<!--" * n, lambda n: "<" * n, lambda n: "<div class=c>t" * n, lambda n: "<p>a" * n, lambda n: "&" * n, lambda n: "<a x=\"'>" * n,
        lambda n: "<a " + "b" * 4 * n + ">", lambda n: "<p " + "= " * n + ">",
    ]
    for make in pages:
        assert seconds(make, 20_000) < 40 * max(seconds(make, 2000), 0.01), make(3)


def test_unclosed_elements_and_comments_by_readers(spark):
    page = "<html><body><div><p>One.</p><svg><path d='x'><p>Two.</p><iframe src=x><h2>Three</h2><select><option>a<p>Four.</div></body></html>"
    assert texts(spark, [(1, "http://d.example/", page)])[1].text == "One. Two. Three Four."
    blog = "<html><body><main><article><p>%s</p></article><article class='comment'><p>Mine!</p></article></main></body></html>" % ("text " * 50)
    assert texts(spark, [(1, "http://e.example/", blog)])[1].text == ("text " * 50).strip()


def test_articles_keep_formulas_drawings_and_slug_sections(spark):
    long = "Prose that goes on for a while, without any link in it, as articles do."
    junk = '<ul><li><a href="/x">Another story</a></li><li><a href="/y">One more</a></li></ul>'
    pages = [
        ("<article><p><math><mi>e</mi><annotation>tex</annotation></math> equals one</p></article>", "e equals one"),
        ("<article><p>before</p><svg><title>A chart</title><style>.a{}</style><text>of rain</text></svg><p>after</p></article>", "before A chart of rain after"),
        (f'<article><h1>T</h1><p>{long}</p><section id="related-work"><h2>R</h2><p>{long}</p></section><section class="search"><p>{long}</p></section></article>', f"T {long} R {long} {long}"),
        (f'<main><h1>T</h1><p>{long}</p><div id="search"><p>{long}</p></div><div class="related">{junk}</div><div class="share">Share this</div></main>', f"T {long} {long}"),
        (f'<article><p>{long}</p><section id="comments"><p>{long}</p></section><div class="related-comments"><p>{long}</p></div><div id="related">{junk}</div></article>', long),
        (f'<article><p>{long}</p><div class="related"><p>{long}</p><div class="related">{junk}</div>', f"{long} {long}"),
        (f'<html><title>not this</title><body><article><p>{long}</p><div class="notice"><p>{long}</p></div></article>', long),
    ]
    rows = [(i, f"http://h{i}/", html) for i, (html, _) in enumerate(pages)]
    found = {r.page_id: r.text for r in extract.main_texts(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert found == {i: text for i, (_, text) in enumerate(pages)}
