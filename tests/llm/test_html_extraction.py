import html
from html.parser import HTMLParser

import pytest

from conftest import SMALL
from perilake.llm import html_extraction as hx

MEDIUM = "/root/testdata/sf0.01"
COLUMNS = "page_id long, url string, html string, text string, n_chars int"


class Article(HTMLParser):
    """Text of the article element of a page without anything else in it, by the standard library's parser."""

    def __init__(self):
        super().__init__()
        self.inside, self.blocks = 0, [""]

    def handle_starttag(self, tag, attrs):
        self.inside += tag == "article"
        if tag in ("p", "h1", "article"):
            self.blocks.append("")
        if tag == "br":
            self.blocks[-1] += " "

    def handle_endtag(self, tag):
        self.inside -= tag == "article"
        if tag in ("p", "h1", "article"):
            self.blocks.append("")

    def handle_data(self, data):
        if self.inside:
            self.blocks[-1] += data


def plain(page):
    if not page:
        return ""
    parser = Article()
    parser.feed(page)
    parser.close()
    return "\n\n".join(" ".join(b.split()) for b in parser.blocks if b.split())


@pytest.mark.parametrize("folder", [SMALL, MEDIUM])
def test_query_against_plain_articles(spark, folder):
    pages = {r.page_id: r for r in spark.read.parquet(f"{folder}/pages.parquet").collect()}
    got = hx.op11_html_extraction(spark, folder).collect()
    assert len(got) == len(pages)
    for r in got:
        assert r.url == pages[r.page_id].url and r.text == plain(pages[r.page_id].html) and r.n_chars == len(r.text)


@pytest.fixture(scope="module")
def weights(spark):
    return hx.Weights(hx.fitted(spark.read.parquet(f"{MEDIUM}/pages.parquet")))


ONE, TWO = "The first paragraph of a story has quite a few words in it.", "A second one follows it, and it has words as well."
NAV = '<nav><ul><li><a href="/a">Home</a></li><li><a href="/b">About us</a></li></ul></nav>'
PAGES = {
    "no article element": f"<body>{NAV}<div class='content'><p>{ONE}</p><p>{TWO}</p></div><footer>All rights reserved by us</footer></body>",
    "main": f"<body><header><h1>Site name</h1></header><main><p>{ONE}</p><p>{TWO}</p></main><aside><p>{ONE} {ONE}</p></aside></body>",
    "parts inside": f"<article><p>{ONE}</p><div class='ad-slot'>Buy this now, it is cheap and good and new.</div><aside>See also</aside><form>Your name <input></form><p>{TWO}</p></article>",
    "comments": f"<article><p>{ONE}</p><p>{TWO}</p><section id='comments'><article class='comment'><p>I do not agree with this at all, never.</p></article></section></article>",
    "comments after": f"<article><p>{ONE}</p><p>{TWO}</p></article><div class='comment-list'><p>I do not agree with this at all, never.</p></div>",
    "notice": f"<div role='dialog' class='cookieConsent'><p>We use cookies on this site, please agree to them all.</p><button>Yes</button></div><article><p>{ONE}</p><p>{TWO}</p></article>",
    "sidebar without names of its own": f"<div id=sideBar><p>Popular now: one two three four five</p></div><div><p>{ONE}</p><p>{TWO}</p></div>",
    "wrapper describes the page": f"<body class='has-sidebar no-ads'><div class='with-comments'><p>{ONE}</p><p>{TWO}</p></div></body>",
    "heading in a header of the article": f"<article><header class='entry-header'><p>{ONE}</p></header><p>{TWO}</p></article>",
    "scripts, styles, comments": f"<article><style>p{{}}</style><p>{ONE}<script>if (a < b) document.write('<p>no</p>')</script></p><!-- <p>not this</p> --><p>{TWO}</p><noscript>Turn it on</noscript></article>",
    "unclosed": f"<div class=ad>Buy it<p>Now</div><article><p><b>{ONE}<p>{TWO}",
    "upper case and attributes": f"<BODY><NAV>Home</NAV><ARTICLE data-x='a > b' title=\"it's\"><P CLASS=lead>{ONE}</P><P>{TWO}</P></ARTICLE></BODY>",
    "links and lists": f"<article><p>{ONE.replace('story', '<a href=/x>story</a>')}</p><ul><li>{TWO}</li></ul></article>",
    "inline tags and breaks": f"<article><p>{ONE.replace('graph', '<i>gra</i>ph').replace(' of ', '<br>of&nbsp;')}</p><p>{TWO.replace(' ', chr(10) + chr(9))}</p></article>",
    "end tags without start": f"</div></article><article></b></section><p>{ONE}</p></span><p>{TWO}</p></article>",
    "text in a container": f"{NAV}<div><div>{ONE}</div><div>{TWO}</div></div>",
}


@pytest.mark.parametrize("name", PAGES)
def test_kinds_of_pages(weights, name):
    for page in (PAGES[name], "<!DOCTYPE html><html><head><title>Not this title</title></head>" + PAGES[name] + "</html>"):
        assert hx.main_text(page, weights) == f"{ONE}\n\n{TWO}"
    assert hx.main_text(PAGES[name], hx.Weights({})) == f"{ONE}\n\n{TWO}"  # priors alone


def test_references_and_stray_signs(weights):
    page = "<article><p>a &lt;b&gt; &amp;amp; &copy; &#228;&#x4E00; &quot;q&quot; &nope; &am 1 < 2 &lt 3 &#0;</p></article>"
    assert hx.main_text(page, weights) == 'a <b> &amp; © ä一 "q" &nope; &am 1 < 2 < 3 �'
    assert hx.main_text(page, weights) == html.unescape("a &lt;b&gt; &amp;amp; © ä一 \"q\" &nope; &am 1 < 2 < 3 �")


@pytest.mark.parametrize("page", [None, "", " \n ", "<", "<!--", "<!-->", "<a", "<a href='", "<script>", "</", "<>", "</>", "<!", "<title>x", "<p>", "<nav>Home</nav>", "<article></article>", "\x00"])
def test_pages_without_text(weights, page):
    assert hx.main_text(page, weights) in ("", "<", "<>", "\x00", "</")


@pytest.mark.parametrize("page", ["<b>" * 20_000 + "x", "<div class=a>" * 20_000, "<a href='x" * 20_000, "<" * 200_000, "<p><b>w " * 20_000, "</i>" * 50_000, "<!-" * 50_000, "&" * 100_000])
def test_odd_long_pages(weights, page):
    hx.main_text(page, weights)


def test_scan_is_the_best_region(weights):
    """The region against all regions, by brute force over the same scores."""
    page = f"<div><p>one two</p>{'<ul><li><a>x</a></li></ul>' * 4}<p>{ONE}</p><ul><li><a>y</a></li></ul><p>{TWO}</p>{'<ul><li><a>z</a></li></ul>' * 4}<p>three</p></div>"
    found = list(hx.runs(page))
    scores = [(sum(map(weights.tag, tags)), weights.word(names, block) * len(text.split()) if block else 0) for tags, names, _, block, _, text in found]
    best = max(((sum(g + w for g, w in scores[i:j]) - scores[i][0], -(j - i), i, j) for i in range(len(found)) for j in range(i + 1, len(found) + 1)))
    want = " ".join(" ".join(r[5] for r in found[best[2] : best[3]]).split())
    assert hx.main_text(page, weights).split() == want.split() == [*ONE.split(), "y", *TWO.split()]


def test_odd_rows(spark):
    page = f"<article><p>{ONE}</p></article>"
    rows = [(1, "u", page, "t", 1), (1, "u", page, "t", 1), (None, None, page, None, None), (2, "u", None, "t", 1), (3, None, "", "t", 1), (4, "x", f"<article>{'<p>' + ONE * 2000 + '</p>'}</article>", "t", 0)]
    frame = spark.createDataFrame(rows, COLUMNS)
    got = [tuple(r) for r in hx.extract(frame, hx.fitted(frame)).collect()]
    want = [(i, u, plain(h), len(plain(h))) for i, u, h, _, _ in rows]
    assert sorted(got, key=str) == sorted(want, key=str)
    empty = spark.createDataFrame([], COLUMNS)
    assert hx.fitted(empty) == {} and hx.extract(empty, {}).collect() == []
    nothing = spark.createDataFrame([(1, "u", None, "t", 1)], COLUMNS)
    assert hx.extract(nothing, hx.fitted(nothing)).first().text == ""
