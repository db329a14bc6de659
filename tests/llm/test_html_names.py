"""Names decide only what they prove; pages against what was put into them."""

import random

from rasterloom.llm import html_extract

PARA = "A sentence, with commas, that is long enough to be prose. " * 3


def test_prose_under_doubtful_names_stays():
    for name in ("notice-board", "related", "tags", "legal", "widget-text", "share"):
        page = f'<article><h1>Head</h1><p>{PARA}</p><div class="{name}"><p>{PARA} One.</p><p>{PARA} Two.</p></div><p>{PARA} Three.</p></article>'
        got = html_extract.extract(page)
        assert "One." in got and "Two." in got and "Three." in got, name
        linked = f'<article><p>{PARA}</p><div class="{name}"><a href="/a">One story</a> <a href="/b">Another</a></div><p>{PARA}</p></article>'
        assert "One story" not in html_extract.extract(linked) or name == "notice-board", name


def test_what_the_surroundings_are_called_goes():
    for name in ("cookie-notice", "notice", "site-header", "sidebar", "ad-slot", "comments", "page-footer", "main-menu", "newsletter-form", "alert"):
        page = f'<body><div id="content"><p>{PARA}</p><div class="{name}"><p>{PARA} Gone.</p></div><p>{PARA} Kept.</p></div></body>'
        got = html_extract.extract(page)
        assert "Gone." not in got and "Kept." in got, name


def test_short_paragraphs_and_linked_items_stay():
    page = f'<body><div><p>{PARA}</p><p>{PARA}</p></div><p>Short end.</p><nav><a href="/x">Menu</a></nav></body>'
    assert html_extract.extract(page).endswith("Short end.")
    page = f'<article><p>{PARA}</p><ul><li><a href="/1">First linked item</a></li><li><a href="/2">Second one</a></li></ul><p>{PARA}</p></article>'
    got = html_extract.extract(page)
    assert "First linked item" in got and "Second one" in got


def test_pages_put_together_from_parts():
    """Articles of known text in several layouts come back as they are."""
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9)))
    sentence = lambda: " ".join(word() for _ in range(rng.randint(6, 18))).capitalize() + rng.choice([".", "!", ", so."])
    for k in range(60):
        paras = [" ".join(sentence() for _ in range(rng.randint(1, 5))) for _ in range(rng.randint(2, 9))]
        body = "".join(f"<p>{p}</p>" if rng.random() < 0.8 else f"<blockquote>{p}</blockquote>" for p in paras)
        inner = rng.choice(["<article>{}</article>", "<main>{}</main>", '<div class="post-body">{}</div>', '<div id="content"><section>{}</section></div>', "<table><tr><td>{}</td></tr></table>"]).format(body)
        menu = "<ul>" + "".join(f'<li><a href="/{word()}">{word()}</a></li>' for _ in range(rng.randint(3, 12))) + "</ul>"
        page = (f"<html><head><title>{sentence()}</title><script>var x = '{sentence()}';</script></head><body><header>{sentence()}</header><nav>{menu}</nav>"
                f'<div class="cookie-banner">{sentence()}</div>{inner}<div class="sidebar"><p>{sentence()}</p>{menu}</div>'
                f'<section id="comments"><div class="comment"><p>{sentence()}</p></div></section><form><p>{sentence()}</p></form><footer>{sentence()}</footer></body></html>')
        assert html_extract.extract(page) == " ".join(paras), k


def test_columns_that_clash_and_repeated_rows(spark):
    rows = [("a", "u", f"<article><p>{PARA}</p></article>", "x", 5), ("a", "u", f"<article><p>{PARA}</p></article>", "x", 5), (None, None, None, None, None)]
    got = html_extract.extract_pages(spark.createDataFrame(rows, "page_id string, url string, html string, text string, n_chars int")).collect()
    assert [(r.page_id, r.text, r.n_chars) for r in sorted(got, key=repr)] == [("a", PARA.strip(), len(PARA.strip()))] * 2 + [(None, "", 0)]


def test_a_very_long_page():
    paras = [f"Paragraph number {k}, with a comma and an end." for k in range(40_000)]
    assert html_extract.extract("<article>" + "".join(f"<p>{p}</p>" for p in paras) + "</article>") == " ".join(paras)
