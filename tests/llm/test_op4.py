"""HTML extraction on small pages with known text."""

import duckdb
import pytest

from caminho.llm.op4_html import blocks, extract, main_text

LONG = "The man and the dog went to the house that was on the hill, and it was all they had for the day of the feast in the town with the old walls and the river that runs by it to the sea."

PAGES = [
    (None, ""),
    ("", ""),
    ("plain", ""),
    ("<p>", ""),
    ("<article><h1>Title</h1><p>One  &amp;\n two&nbsp;x</p><p>Th<b>re</b>e<br>four</article><footer>no</footer>", "Title\n\nOne & two x\n\nThree four"),
    ("<nav><ul><li><a href=/>a</a></ul></nav><article><p><b>Bold.<br><p>Next</p></article>", "Bold.\n\nNext"),
    ("<script>var t='</p>';<p>x</p></script><style>p{}</style><main><!-- <p>c</p> --><p class='lead'>Text &lt;b&gt;</p><div class='ad'>Buy</div><section id=comments><p>First!</p></section></main>", "Text <b>"),
    ("<body><article><header><p>by me</p><h1>Head</h1></header><p>Body</p><form><p>in</p></form><aside>x</aside><div class='cookie-notice'>ok</div></article>", "Head\n\nBody"),
    ("<article><p class=ad>spam<p>good<ul><li>one<li class='share'>two<li>three</ul></article>", "good\n\none\n\nthree"),
    (f"<div class=x><a href=/>Home</a> <a href=/>News</a></div><div><h2>Story</h2><p>{LONG}</p><p>Short.</p><p>{LONG}</p></div><div>Bye</div>", f"Story\n\n{LONG}\n\nShort.\n\n{LONG}"),
    ("<article><p>a &amp b &am; &#233; &bogus;</p></article", "a & b &am; é &bogus;"),
    ("<article><div hidden>x</div><p style='display: none'>y</p><p title='a > b'>z</p></article>", "z"),
    ("<article><span class='advert'>x<span>y</span></span><p>keep", "keep"),
]


@pytest.mark.parametrize("page,text", PAGES)
def test_known_pages(page, text):
    assert main_text(page) == text


def test_articles_of_the_given_pages():
    """The given pages mark their article; all of its text and nothing else is extracted."""
    rows = duckdb.sql("SELECT html FROM read_parquet('/root/testdata/sf0.001/pages.parquet')").fetchall()
    for (page,) in rows:
        inner = page[page.index("<article>") : page.index("</article>") + 10]
        assert main_text(page) == "\n\n".join(b.text for b in blocks(inner))


def test_table(spark):
    rows = [(i, "u", page, "mine") for i, (page, _) in enumerate(PAGES)] + [(None, None, PAGES[4][0], ""), (4, "u", PAGES[4][0], "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    found = extract(pages)
    assert found.columns == ["page_id", "url", "text", "n_chars"]
    rows_out = found.collect()
    assert len(rows_out) == len(rows)
    for r in rows_out:
        want = PAGES[4 if r.page_id is None else r.page_id][1]
        assert (r.text, r.n_chars) == (want, len(want))
    assert extract(pages.limit(0)).count() == 0


PROSE = "the cat and the dog of the house is in " * 8


def test_class_tokens_are_read_whole():
    for name in ("content no-sidebar", "site-content has-sidebar", "post comments-open"):
        assert main_text(f"<div class='{name}'><p>{PROSE}</p></div>") == PROSE.strip()
    for name in ("sidebar", "site-header", "comments-area", "ad-banner", "cookie-notice"):
        assert main_text(f"<p>{PROSE}</p><div class='{name}'><p>{PROSE}!</p></div>") == PROSE.strip()


def test_languages_without_known_stop_words():
    prose = "кошка собака дом улица город " * 12
    assert main_text(f"<body><div><a href=x>меню</a></div><p>{prose}</p><p>ночь</p></body>") == f"{prose.strip()}\n\nночь"


def test_passes_decide_within_the_article():
    links = "".join(f"<a href=x>link number {k}</a> " for k in range(6))
    page = f"<article><h1>Title</h1><p>{PROSE}</p><p>Short.</p><p>{links}</p><p>{PROSE}end</p></article>"
    assert main_text(page) == f"Title\n\n{PROSE.strip()}\n\nShort.\n\n{PROSE}end"


def test_pages_without_their_article_tags():
    """Most blocks of the given articles are found by the block rules alone, and hardly any other."""
    import re

    import duckdb

    pages = duckdb.sql("select html from '/root/testdata/sf0.01/pages.parquet' where html is not null").fetchall()
    wanted = found = both = 0
    for (page,) in pages:
        a, b = (set(x.split("\n\n")) for x in (main_text(page), main_text(re.sub(r"</?(article|main)\b[^>]*>", "", page))))
        wanted, found, both = wanted + len(a), found + len(b), both + len(a & b)
    assert both >= 0.9 * wanted and both >= 0.95 * found


def test_deep_nesting_is_linear():
    import time

    began = time.time()
    assert main_text("<div>" * 60_000 + PROSE) == PROSE.strip()
    assert time.time() - began < 10
