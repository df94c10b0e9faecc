"""Main text of pages: hand-made pages of several layouts, broken markup, awkward rows, and the tables' pages against SQL."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from check import canonical
from eventloom.llm import html_text as ht
from eventloom.llm.registry import registered

from ..conftest import DATA

ONE = "The committee met on Tuesday, heard three reports, and put off its decision until the end of the month."
TWO = "Members asked for figures, which the treasurer will bring, and for a plan of the building that shows all exits."
THREE = "A vote is expected in June, after the summer budget is known and the two vacant seats are filled."

MENU = '<nav><ul><li><a href="/">Home</a><li><a href="/news">News</a><li><a href="/about">About us, and more</a></ul></nav>'
HEAD = "<!doctype html><html><head><title>A title, with commas, many</title><style>p{content:'</p>'}</style><script>var x = '<p>no</p>';</script></head><body>"
COOKIES = f"<div class='cookie-notice'><p>We use cookies, as all do, and {ONE}</p><button>Accept</button></div>"
COMMENTS = f"<section id='comments'><div class='comment-body'><p>{TWO}</p></div><article class='comment'><p>{THREE * 5}</p></article></section>"
FOOT = f"<footer><p>{ONE}</p></footer></body></html>"

PAGES = {
    "article element": (f"{HEAD}{MENU}<article><h1>Vote</h1><p>{ONE}</p><p>{TWO}<p>{THREE}</article>{COMMENTS}{FOOT}", f"Vote {ONE} {TWO} {THREE}"),
    "divs only": (
        f"{HEAD}<div id='header'><p>{ONE}</p></div><div class='main-menu'><p>{TWO}</p></div><div id='wrap'><h2>Vote</h2>"
        f"<div class='entry-content'><p>{ONE}</p><p>Yes.</p><p>{TWO}</p></div><div class='sidebar'><p>{THREE * 9}</p></div></div>{FOOT}",
        f"Vote {ONE} Yes. {TWO}",
    ),
    "sections": (
        f"{HEAD}<main><section><h2>A</h2><p>{ONE * 3}</p></section><section><h2>B</h2><p>Short.</p></section><aside><p>{TWO}</p></aside></main>{COOKIES}{FOOT}",
        f"A {ONE * 3} B Short.",
    ),
    "siblings": (
        f"{HEAD}<div><div class='part'><p>{ONE}</p><p>{TWO}</p></div><div class='ad'><p>{THREE}</p></div><div class='part'><p>Brief.</p></div></div>{FOOT}",
        f"{ONE} {TWO} Brief.",
    ),
    "layout names": (f"{HEAD}<div class='layout-with-sidebar'><div class='has-ads post'><p>{ONE}</p><p>{TWO}</p></div></div>{FOOT}", f"{ONE} {TWO}"),
    "text in divs": (f"{HEAD}<div id='content'>{ONE}<br>{TWO}<div>{THREE}</div></div>{FOOT}", f"{ONE} {TWO} {THREE}"),
    "form": (f"{HEAD}<article><p>{ONE}</p><form><p>{TWO}</p><input><textarea>{THREE}</textarea></form><p>{TWO}</p></article>{FOOT}", f"{ONE} {TWO}"),
    "inline": (f"{HEAD}<article><p>The <b>committee</b> met<em>.</em> It<!-- not --> <a href='x'>left</a>.</p></article>", "The committee met. It left."),
    "references": (f"{HEAD}<article><p>a &amp;lt; b&nbsp;&#x41;&#66; &eacute; &amp &am &unknown;</p></article>", "a &lt; b AB é & &am &unknown;"),
    "left open": (f"{HEAD}<article><p><b>{ONE}<p>{TWO}<div>{THREE}", f"{ONE} {TWO} {THREE}"),
    "cut inside a tag": (f"{HEAD}<article><p>{ONE}</p><p class='x", ONE),
    "odd quotes": (f"{HEAD}<article><p title='it\"s >'>{ONE}</p><p x=\"y>{TWO}</p></article>", f"{ONE} {TWO}"),
    "less than": (f"{HEAD}<article><p>1 < 2 and 3 <4, {ONE}</p></article>", f"1 < 2 and 3 <4, {ONE}"),
    "hidden": (f"{HEAD}<article><p>{ONE}</p><p hidden>{TWO}</p><div style='display: none'>{TWO}</div><p aria-hidden=true>x</p></article>", ONE),
    "article header": (f"{HEAD}<header><p>{TWO}</p></header><article><header><h1>Vote</h1></header><p>{ONE}</p></article>", f"Vote {ONE}"),
    "link list": (f"{HEAD}<article><p>{ONE}</p><ul><li><a>one thing</a><li><a>two things</a><li><a>three</a></ul><ul><li>a<li>b</ul></article>", f"{ONE} a b"),
    "table cells": (f"{HEAD}<article><p>{ONE}</p><table><tr><td>1<td>2<tr><td>3</table></article>", f"{ONE} 1 2 3"),
    "plain text": (f"{ONE}\n\n{TWO}", f"{ONE} {TWO}"),
    "short paragraphs": (f"{HEAD}{MENU}<div class='ad'>Buy now.</div><article><h1>Be.</h1><p>Be.</p></article>{FOOT}", "Be. Be."),
    "menu only": (f"{HEAD}{MENU}{FOOT}", ""),
    "header only": ("<html><head><title>x</title></head></html>", ""),
}


@pytest.mark.parametrize("name", PAGES)
def test_main_text(name):
    page, want = PAGES[name]
    assert ht.main_text(page) == want


def test_html_text_matches_sql(spark, duck):
    query, sql = registered()["op13_html_text"]
    got, want = query(spark, DATA).toPandas(), duck.sql(sql).df()
    assert len(got) == 50 and canonical(got) == canonical(want)


def test_html_text_awkward_rows(spark, monkeypatch):
    page = PAGES["article element"][0]
    rows = [(1, "u", page), (1, "u", page), (2, None, None), (None, None, ""), (3, "u", " \n "), (4, "u", page.replace(THREE, THREE * 20_000))]
    df = spark.createDataFrame([(*r, "old", 9, b"x") for r in rows], "page_id long, url string, html string, text string, n_chars int, extra binary")
    got = {(r.page_id, r.url): (r.text, r.n_chars) for r in ht.extract_text(df).collect()}
    article = PAGES["article element"][1]
    assert got[1, "u"] == (article, len(article)) and got[2, None] == ("", 0) and got[None, None] == ("", 0) and got[3, "u"] == ("", 0)
    assert got[4, "u"][1] == len(article) + 19_999 * len(THREE)
    assert ht.extract_text(df).count() == 6 and set(ht.extract_text(df).columns) == set(df.columns)
    assert ht.extract_text(df.limit(0)).count() == 0
    monkeypatch.setattr(ht, "read", lambda *_: df)
    assert ht.op13_html_text(spark, DATA).columns == ["page_id", "url", "text", "n_chars"]


def test_deep_and_long_pages_take_linear_time():
    assert ht.main_text("<div>" * 50_000 + ONE) == ONE
    assert ht.main_text("<p x='" * 20_000 + ONE) in ("", ONE)
    assert ht.main_text("<script>" * 20_000) == ""
    assert ht.main_text("<a><b>" * 20_000 + ONE) == ONE
    assert ht.main_text("<!-- " * 20_000 + ONE) == ""


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["<p>", "</p>", "<b>", "</b>", "<div class=ad>", "</div>", "<td>", "<a href='", "'>", "text, ", "<!--", "-->", "<", "&am", "<li>", "</article>"])))
def test_any_markup_is_read(parts):
    text = ht.main_text("".join(parts))
    assert text == " ".join(text.split())
