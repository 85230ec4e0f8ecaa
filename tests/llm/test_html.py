import re
import time
from html.parser import HTMLParser

import pandas as pd
import pytest

from cellwise.llm import html_extract, queries

PAGE = (
    '<!DOCTYPE html><html lang="en"><head><meta charset="utf-8"><title>T &amp; U</title><style>p{margin:0}</style><script>var t="</p>";track(0);</script></head><body>'
    '<nav><ul><li><a href="/The">The</a></li></ul></nav><!-- ad 0 <p>no</p> --><div class="ad">Buy this now.</div>'
    "<article><h1>T &amp; U</h1><p><b>One &lt;two&gt;<br><p>Short.</p><p>A  long\n paragraph of&nbsp;text with <a href=x>a link</a> in it.</p></article>"
    "<footer>&copy; x.example &middot; Impressum</footer>"
)
LONG = "Some words of the story, one after the other, and then a good many more of them. "


def test_the_article_of_a_page_that_marks_it():
    text = "T & U\nOne <two>\nShort.\nA long paragraph of text with a link in it."
    assert html_extract.main_text(PAGE) == text
    assert html_extract.main_text(PAGE + "</body></html>") == text
    assert html_extract.main_text(PAGE.replace("<article>", "<main>").replace("</article>", "</main>")) == text


def test_a_page_without_article_by_lengths():
    body = "".join(f"<p>{'Some words of the story, line %d. ' % i * 4}</p>" for i in range(6))
    page = (
        "<html><body class='has-sidebar'><div id=header><a href=/>Home</a> | <a href=/b>News</a></div><div><a href=/1>One</a></div><div><a href=/2>Two</a></div>"
        f"<div class='content'><h1>Title here</h1>{body}<p>End.</p></div><div><div><div><a href=/3>Next story</a></div></div></div>"
        "<div id='comments'><article class='comment'><p>First! What a long comment this is, a very long one, one that goes on and on and on.</p></article></div>"
        "<div class='cookie-notice'>We use cookies.</div><form><label>Mail</label><input></form><div class=footer>Imprint</div></body></html>"
    )
    wanted = "\n".join(["Title here", *[" ".join(("Some words of the story, line %d. " % i * 4).split()) for i in range(6)], "End."])
    assert html_extract.main_text(page) == wanted


ARTICLES = {
    "a table between long paragraphs": (f"<h1>T</h1><p>{LONG}</p><table><tbody><tr><td>a</td><td>1</td></tr><tr><td>b</td><td>2</td></tr></tbody></table><p>{LONG}</p>", f"T\n{LONG.strip()}\na 1\nb 2\n{LONG.strip()}"),
    "a short closing paragraph": (f"<h1>T</h1><p>{LONG}</p><blockquote><p>Quoted.</p></blockquote><p>End.</p>", f"T\n{LONG.strip()}\nQuoted.\nEnd."),
    "a list of links": (f"<h1>T</h1><p>{LONG}</p><ul><li><a href=1>One</a></li><li><a href=2>Two</a></li><li><a href=3>Three</a></li><li><a href=4>Four</a></li></ul><p>{LONG}</p>", f"T\n{LONG.strip()}\nOne\nTwo\nThree\nFour\n{LONG.strip()}"),
    "a caption": (f"<h1>T</h1><p>{LONG}</p><figure><img src=x><figcaption>A view.</figcaption></figure><p>{LONG}</p>", f"T\n{LONG.strip()}\nA view.\n{LONG.strip()}"),
    "names that only hold such words": (
        f"<h1>T</h1><p>{LONG}</p><h2 id='side-effects'>Side effects</h2><section id='social-history'><p>Smokes.</p></section><p class='notice-period'>A month.</p><p id='search-methods'>By hand.</p>"
        "<table class='navigation-data'><tr><td>North</td></tr></table><p>This <span class='ad'>sentence</span> is whole.</p>",
        f"T\n{LONG.strip()}\nSide effects\nSmokes.\nA month.\nBy hand.\nNorth\nThis sentence is whole.",
    ),
    "paragraphs that are boxes": (f"<h1>T</h1><div>{LONG}</div><div>Short.</div><div><div>Deep.</div></div><div>{LONG}</div>", f"T\n{LONG.strip()}\nShort.\nDeep.\n{LONG.strip()}"),
    "an advert and a notice inside": (f"<h1>T</h1><p>{LONG}</p><div class='ad-slot'>Buy.</div><p>Mid.</p><div class='notice'><p>We moved.</p><p>Really.</p></div><p>End.</p>", f"T\n{LONG.strip()}\nMid.\nEnd."),
}
AROUND = (
    "<body><div class='site-header'><a href=/>Home</a></div><ul class='menu'><li><a href=/1>One</a></li><li><a href=/2>Two</a></li></ul>{}"
    f"<div class='sidebar'><p>{LONG}</p><p>About us.</p></div><section id='comments'><h3>Replies</h3><p>{LONG}</p><p>I agree.</p></section><div id='cookieBanner'>Cookies!</div><footer>Imprint</footer></body>"
)


@pytest.mark.parametrize("box", ["article", "main", "div"])
@pytest.mark.parametrize("name", sorted(ARTICLES))
def test_planted_pages(name, box):
    article, text = ARTICLES[name]
    assert html_extract.main_text(AROUND.format(f"<{box}>{article}</{box}>")) == text


def test_surge_and_dive_decide():
    """Every line is a candidate, those of menus and comments too: without the distribution they would be in the text."""
    related = "<div><div><p><a href=1>Another story of some length</a></p><p><a href=2>And one more of these</a></p></div></div>"
    for box in ("article", "div"):
        html = AROUND.format(f"<{box}><h1>T</h1><p>{LONG}</p><p>{LONG}</p><div class='comments'><p>{LONG}</p><p>No.</p></div>{related}</{box}>")
        lines = [line.text for line in html_extract.to_lines(html)[1]]
        kept = html_extract.main_text(html).split("\n")
        assert kept == ["T", LONG.strip(), LONG.strip()]
        assert {"Home", "One", "No.", "I agree.", "Cookies!", "Imprint", "And one more of these"} <= set(lines) - set(kept)
    flat = "".join(f"<div><div><p>{t}</p><p>{t}</p></div></div>" for t in ("tiny", LONG, "small"))
    assert html_extract.main_text(flat) == f"{LONG.strip()}\n{LONG.strip()}"  # no name or hint at all
    assert html_extract.main_text(flat, surge=1) == "\n".join(t for t in ("tiny", LONG.strip(), "small") for _ in "12" if t == LONG.strip())
    assert html_extract.main_text(flat, window=9).count("\n") == 5  # a window too wide to dive


def test_the_surge_decides_without_names():
    """Boxes without a name or class: a short notice, the text, replies; only the surge keeps the notice from joining the text as one of its sections."""
    notice, text = "<div><p>We use cookies on this site.</p><p>Accept or read more.</p></div>", f"<div><h1>T</h1><p>{LONG}</p><p>{LONG}</p><p>End.</p></div>"
    wanted = f"T\n{LONG.strip()}\n{LONG.strip()}\nEnd."
    assert html_extract.main_text(notice + text) == wanted
    assert html_extract.main_text(notice + text, surge=1) != wanted
    replies = "<div><div><p>Jo</p><p>First! I say.</p></div><div><p>Al</p><p>What a long comment this is, one that goes on and on and on, and then some more of it.</p></div></div>"
    notice = f"<div><p>{'We use cookies and much else. ' * 8}</p><p>Accept</p></div>"
    text, wanted = text.replace("<p>End", f"<p>{LONG * 3}</p><p>End"), wanted.replace("End", f"{(LONG * 3).strip()}\nEnd")
    for page in (notice + text + replies, f"<div>{notice}{text}{replies}</div>", replies + text + notice):
        assert html_extract.main_text(page) == wanted
    sections = "".join(f"<div><h2>Part {i}</h2><p>{LONG}</p><p>{LONG}</p></div>" for i in range(3))
    assert html_extract.main_text(f"<div><div>{sections}</div>{replies}</div>").count("Part") == 3


def test_lists_of_links_and_sections_in_an_article_stay():
    refs = "<div><div><div><ul><li><a href=1>One</a></li><li><a href=2>Two</a></li></ul></div></div></div>"
    social = "<section id='social'><h2>Social life</h2><p>They live in groups.</p><p>Mostly.</p></section>"
    for end, text in ((refs, "One\nTwo"), (social, "Social life\nThey live in groups.\nMostly.")):
        assert html_extract.main_text(AROUND.format(f"<article><div><h1>T</h1><p>{LONG}</p></div>{end}</article>")) == f"T\n{LONG.strip()}\n{text}"


def test_given_pages_without_the_names_of_elements():
    """Element names replaced by div: line blocks find the article all the same, but for a few whose footer is the longer text."""
    pages = pd.read_parquet("/root/testdata/sf0.1/pages.parquet")["html"].fillna("")
    bare = [re.sub(r"(</?)(article|nav|footer|aside|header|form|main)\b", r"\1div", html) for html in pages]
    right = sum(html_extract.main_text(b) == Article(html).text() for b, html in zip(bare, pages))
    assert right >= 0.98 * len(pages)
    assert sum(html_extract.main_text(b, surge=1, window=60) == Article(html).text() for b, html in zip(bare[:200], pages)) < 20  # no dive, no text


def test_hints_never_count_alone():
    assert html_extract.main_text(f"<div class='content sidebar'><h1>T</h1><p>{LONG}</p></div>") == f"T\n{LONG.strip()}"
    assert html_extract.main_text(f"<form id=aspnet><div><h1>T</h1><p>{LONG}</p><p>End.</p></div></form>") == f"T\n{LONG.strip()}\nEnd."
    assert html_extract.main_text(f"<div class=notice><p>{LONG}</p><p>{LONG}</p></div><div>short</div>").startswith(LONG.strip())


def test_odd_pages():
    for html in (None, "", "<html></html>", "<p", "<!-- x", "<script>var a", "<div class='ad'>x", "<nav>a<p>b</nav>"):
        assert html_extract.main_text(html) == ""
    assert html_extract.main_text("just words & more &lt;") == "just words & more <"
    assert html_extract.main_text("<article><p>a</p><div class=ad>x</div><p>b</p><aside>s</aside><p>c</article><p>out</p>") == "a\nb\nc"
    assert html_extract.main_text("<nav>never closed<article><p>text</p></article>") == "text"
    assert html_extract.main_text("<article><p>x \U0001f600 y</p></article>") == "x \U0001f600 y"


def test_long_pages_take_linear_time():
    for piece in ("<p>word ", "<a href='", "<div class=ad>x", "<div>x</div><div>", "<", "&", 'x="', "<script>", "</div></p>"):
        took = time.time()
        html_extract.main_text("<article>" + piece * 100_000)
        assert time.time() - took < 20


def test_rows(spark):
    rows = [(1, "u", PAGE, "t", 5), (1, "u", PAGE, "t", 5), (None, None, None, None, None), (3, "v", "", "t", 1)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars int")
    found = html_extract.extract(pages)
    assert found.columns == ["page_id", "url", "text", "n_chars"]
    got = sorted(map(tuple, found.collect()), key=str)
    text = html_extract.main_text(PAGE)
    assert got == sorted([(1, "u", text, len(text))] * 2 + [(None, None, "", 0), (3, "v", "", 0)], key=str)
    assert html_extract.extract(pages.limit(0)).count() == 0


class Article(HTMLParser):
    """Brute force for the given pages, by another parser: the blocks of the article element."""

    def __init__(self, html):
        super().__init__(convert_charrefs=True)
        self.inside, self.blocks = False, [""]
        self.feed(html)
        self.close()

    def handle_starttag(self, tag, attrs):
        self.inside |= tag == "article"
        if tag in ("p", "h1", "h2", "h3", "li", "div", "tr", "article"):
            self.blocks.append("")
        elif tag == "br":
            self.blocks[-1] += " "

    def handle_endtag(self, tag):
        if tag == "article":
            self.inside = False
        if tag in ("p", "h1", "h2", "h3", "li", "div", "tr"):
            self.blocks.append("")

    def handle_data(self, data):
        if self.inside:
            self.blocks[-1] += data

    def text(self):
        return "\n".join(b for b in (" ".join(b.split()) for b in self.blocks) if b)


def test_the_query_on_every_given_page(spark):
    sf = "/root/testdata/sf0.01"
    found = {r.page_id: r for r in queries.QUERIES["op3_line_blocks"](spark, sf).collect()}
    pages = pd.read_parquet(f"{sf}/pages.parquet")
    assert len(found) == len(pages)
    for page in pages.itertuples():
        wanted = Article(page.html or "").text()
        row = found[page.page_id]
        assert (row.url, row.text, row.n_chars) == (page.url, wanted, len(wanted))
