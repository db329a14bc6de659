"""Links in an article stay; menus without a name go."""

from rasterloom.llm import html_extract

PARA = "A sentence, with commas, that is long enough to be prose. " * 3


def test_links_of_the_article_stay():
    page = (f'<div id="content"><p>{PARA}</p><p><a href="/r">Read the full report</a></p><div><p><a href="/p">All of the tables</a></p></div>'
            '<ul><li><a href="/x">Linked point</a></li><li>A plain point of the list, in words of its own</li></ul>'
            '<ol><li><a href="/1">A. Author: On the reading of long pages by machines, 2011</a></li>'
            '<li><a href="/2">B. Author: A survey of the extraction of main texts, 2014</a></li>'
            '<li><a href="/3">C. Author: Lists of references and what they hold, 2019</a></li></ol>'
            '<ul><li><a href="/a">Home</a></li><li><a href="/b">News</a></li><li><a href="/c">Sport</a></li></ul>'
            f'<div><a href="/a">Home</a> | <a href="/b">News</a> | <a href="/c">Weather today</a></div><p>{PARA}</p></div>')
    got = html_extract.extract(page)
    for kept in ("Read the full report", "All of the tables", "Linked point", "A plain point", "A. Author", "B. Author", "C. Author"):
        assert kept in got, kept
    for gone in ("Home", "News", "Sport", "Weather"):
        assert gone not in got, gone
