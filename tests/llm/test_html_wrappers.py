"""Pages that wrap everything in a form, loose attributes, names inside an article, and markup that never closes."""

import time

import pytest

from rasterloom.llm import html_extract

PARA = "A sentence, with commas, that is long enough to be prose. " * 3
TEXT = PARA.strip()


@pytest.mark.parametrize("inner", ["<article><p>{p}</p><p>{p}</p></article>", "<div id='content'><p>{p}</p><p>{p}</p></div>"])
def test_a_form_around_the_page_is_a_wrapper(inner):
    page = f"<html><body><form id='aspnetForm' action='/'><div class='menu'><a href='/'>Home</a></div>{inner.format(p=PARA)}<input type=text><button>Go</button></form></body></html>"
    assert html_extract.extract(page) == f"{TEXT} {TEXT}"


def test_a_form_in_the_page_goes():
    page = f"<body><div><p>{PARA}</p><p>{PARA}</p></div><form><p>Tell us what you think of this page, so that we can make it better for everybody who reads it.</p><label>Name</label><input></form></body>"
    assert "Tell us" not in html_extract.extract(page)


@pytest.mark.parametrize("tag", ["<p title=Bob's>", "<p title=a\"b>", "<p data-x='a>b' title=\"it's > that\">", "<p title = 'x'>", "<p =>"])
def test_quotes_inside_loose_values(tag):
    assert html_extract.extract(f"<div>{tag}{PARA}</p><p>{PARA}</p></div>") == f"{TEXT} {TEXT}"


def test_prose_under_a_name_inside_an_article():
    other = "Another sentence, about searching in large libraries, that nobody would call a search form at all."
    for part in (f"<div class='search'><p>{other}</p></div>", f"<p id='reply'>{other}</p>"):
        assert other in html_extract.extract(f"<article><p>{PARA}</p>{part}<p>{PARA}</p></article>")
    for part in (f"<div class='comments'><p>{other}</p></div>", f"<div class='cookie-notice'><p>{other}</p></div>", "<div class='search'><a href='/'>All</a> <a href='/b'>More</a></div>"):
        got = html_extract.extract(f"<article><p>{PARA}</p>{part}<p>{PARA}</p></article>")
        assert got == f"{TEXT} {TEXT}"


@pytest.mark.parametrize("page", ["<b>" * 50_000 + "<p>x" * 50_000, "<b>" * 50_000 + "</i>" * 50_000, "<b>" * 30_000 + "<h1>x</h1>" * 30_000, "<div>" * 50_000 + "x", "<i>" * 30_000 + "<article>y" * 30_000, "<li><b>x" * 50_000])
def test_unclosed_tags_take_linear_time(page):
    began = time.time()
    html_extract.extract(page)
    assert time.time() - began < 10
