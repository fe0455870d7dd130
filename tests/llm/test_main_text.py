import random
import re
from html.parser import HTMLParser

import pytest

from strata.llm.main_text import blocks_of, compose, extract, fit, main_text, op3_main_text


class Article(HTMLParser):
    """What stands in the article element, by borders of paragraphs and headings."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.on, self.blocks = False, [""]

    def handle_starttag(self, tag, attrs):
        self.on |= tag == "article"
        if tag in ("p", "h1", "article"):
            self.blocks.append("")

    def handle_endtag(self, tag):
        if tag == "article":
            self.on = False
        if tag in ("p", "h1", "article"):
            self.blocks.append("")

    def handle_data(self, data):
        if self.on:
            self.blocks[-1] += data


def by_article(page):
    p = Article()
    p.feed(re.sub(r"<(script|style)>.*?</\1>|<footer.*", "", page, flags=re.S))
    p.close()
    return "\n".join(t for t in (" ".join(b.split()) for b in p.blocks) if t)


@pytest.fixture(scope="module")
def field(spark, tiny):
    return fit([r.html for r in spark.read.parquet(f"{tiny}/pages.parquet").collect()])


def test_every_page_of_the_tables(spark):
    at = "/root/testdata/sf0.1"
    pages = {r.page_id: r for r in spark.read.parquet(f"{at}/pages.parquet").collect()}
    got = op3_main_text(spark, at).collect()
    assert len(got) == len(pages)
    wrong = [r.page_id for r in got if r.text != by_article(pages[r.page_id].html) or r.n_chars != len(r.text) or r.url != pages[r.page_id].url]
    assert len(wrong) <= 0.002 * len(pages), (len(wrong), wrong[:5])


def test_other_layouts(field):
    rng = random.Random(99)
    paragraphs = ["A long sentence about rivers, mills and boats that stands here.", "Short one.", "The keeper of the bridge said nothing, as so often before that winter.", "Prices rose again by a little"]
    right = total = 0
    for _ in range(200):
        page, text = compose(rng, paragraphs)
        got = main_text(page, field).split("\n")
        right += len(set(got) & set(text))
        total += max(len(set(got)), len(set(text)))
    assert right >= 0.93 * total


def test_reading():
    page = "<p>a &amp; b&nbsp; c<br>d<p>e <b>f</b>g<script>if (a<b) x('</p>')</script> h <!-- no <p> --><ul><li>i<li>j &lt;k&#62;</ul><textarea>no</textarea>l"
    assert [b.text for b in blocks_of(page)] == ["a & b c d", "e fg", "h", "i", "j <k>", "l"]
    for odd in ("<", "<p", "a<b", "</p></div>x", "<a href='x>y</a>", "<!-- open", "<script>open", "&#xffffff; &bogus;", "<p " * 2000, "<div>" * 3000 + "x"):
        blocks_of(odd)


def test_edges(spark, field):
    rows = [(None, None, None), (1, "u", ""), (2, "u", "<p></p>"), (2, "u", "<p></p>"), (3, None, "<article><h1>T</h1><p>" + "One sentence, and another. " * 20_000 + "</p></article>")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, text int")
    got = sorted(((r.page_id or 0, r.n_chars) for r in extract(df, field).collect()))
    assert got == [(0, 0), (1, 0), (2, 0), (2, 0), (3, 540_000 + 1)]
    assert extract(df.limit(0)).collect() == []


def test_quotes_in_tags_hide_no_text():
    from strata.llm.main_text import blocks_of

    texts = lambda page: [b.text for b in blocks_of(page)]
    assert texts("<p data=it's>Hello don't</p><p>Second para isn't lost</p>") == ["Hello don't", "Second para isn't lost"]
    assert texts("<p title=\"a > b\" class = 'c>d'>One</p><p title=\"open>Two</p><p>Three</p>") == ["One", "Two", "Three"]
    assert texts("<p a\"b>One</p><p>\"Two\"</p>") == ["One", '"Two"']
