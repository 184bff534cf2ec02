"""Main text of web pages as the maximum-scoring subsequence of words and tags.

A page is read once into runs of text and the tags between them. Words score by where they stand
and tags score negative; the contiguous region with the largest sum, found by one linear scan, holds
the article. All words of a run stand in one place, so a run scores its words at once.

Weights come from labelled pages: pages that say themselves which element is their article
(``article`` or ``main``), where words inside are content and all others are not. They are log odds of
content against the rest, counted for the names of enclosing elements, the words of their ``class``, ``id``
and ``role``, and the innermost block; prior counts from the names HTML itself gives such parts stand in
for names the labelled pages never use. The weights are fitted on at most ``labelled_pages`` distinct
pages, those with the smallest hashes of their html; every page is then scored.

* A word in an element whose name or class word has log odds below ``VETO`` (navigation, adverts, comments, ...)
  is not text of the article. It scores 0 and is left out wherever it stands, also inside the region.
* A word outside the article a page declares scores ``-LIMIT``; one inside scores ``LIMIT``.
* Any other word scores the log odds of its innermost known name, else of its block (or link).
* A tag scores -0.1, and less the more it is seen outside content.

Text is what stays in the region: character references decoded, white space in a block one space,
blocks joined by a blank line in page order.

Defined results: missing or empty html, or a page without such words, gives an empty text. Tags that
are not closed end with their parents, an end tag without a start is ignored, a comment or script
without an end takes the rest of the page, and ``<`` before anything but a tag is text. Rows are not
joined or grouped, so repeated rows and missing ids or urls stay as they are. Of pages that repeat
their html, one is fitted. An empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import html as references
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from perilake.llm.common import column_values, query, table

LIMIT, VETO, TAG, PRIOR = 4.0, -2.0, 0.1, 200.0

# Element names of the HTML standard by their part in the text.
BLOCKS = frozenset((
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li listing main menu nav ol optgroup option p plaintext pre search section select "
    "summary table tbody td tfoot th thead title tr ul xmp"
).split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
NOTHING, PARAGRAPH, LISTS = frozenset(), frozenset(("p",)), frozenset("ul ol dl table select menu".split())
CLOSES_PARAGRAPH = BLOCKS - frozenset("body caption head html legend optgroup option tbody td tfoot th thead title tr".split())
RAW_END = {name: re.compile(f"</{name}", re.I | re.A) for name in RAW}
CLOSES_LIKE = {"li": {"li"}, "dd": {"dd", "dt"}, "dt": {"dd", "dt"}, "option": {"option"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
NEVER_TEXT = frozenset("script style noscript template head title iframe noembed noframes object canvas audio video svg math".split())
FORMS = frozenset("form button select textarea input fieldset dialog datalist".split())
AROUND = frozenset("nav aside footer header menu search".split())

# Words of class, id and role that name what surrounds an article.
AROUND_WORDS = frozenset((
    "ad ads adsbygoogle advert adverts advertisement advertising advertorial sponsor sponsored sponsors promo promos promoted promotion "
    "nav navbar navigation menu menubar menus breadcrumb breadcrumbs pagination pager toolbar topbar "
    "sidebar sidebars sidenav aside complementary widget widgets related recommended recommendations trending popular "
    "header masthead banner footer contentinfo copyright colophon "
    "cookie cookies consent gdpr notice notices alert alertdialog popup modal overlay newsletter subscribe subscription signup paywall "
    "comment comments commentlist disqus respond reply replies discussion share sharing social search login form"
).split())
COMMENT_WORDS = frozenset("comment comments commentlist disqus respond reply replies".split())
CONTENT_WORDS = frozenset("article post entry content story".split())  # "post-header" heads the text, not the page
SWITCHES = frozenset("has with without no is show hide js".split())  # "has-sidebar" describes the page, not the element

_OPEN = re.compile(r"<(?:(!--)|(/?)([a-zA-Z][^\s/>]*)|[!?/])")
_COMMENT_END = re.compile(r"--!?>")
_ATTRIBUTE = re.compile(r"""[\s/]*+(?:([^\s/>][^\s/>=]*+)(?:\s*+=\s*+(?:"([^"]*)"|'([^']*)'|([^\s>]*+)))?)""")
_WORD = re.compile(r"[a-z]+|[A-Z][a-z]*|[A-Z]+(?![a-z])")


class Element:
    """An open element: its name, the names around its text, the declared part and innermost block it is in."""

    __slots__ = ("name", "names", "declared", "block")

    def __init__(self, name: str, names: tuple[str, ...], declared: str, block: str):
        self.name, self.names, self.declared, self.block = name, names, declared, block


def name_words(value: str) -> set[str]:
    """Lower-cased words of a class, id or role value, without names that describe the whole page."""
    words: set[str] = set()
    for part in value.split():
        found = [w.lower() for w in _WORD.findall(part)]
        if found and found[0] not in SWITCHES:
            words.update(set(found) - {"header"} if CONTENT_WORDS & set(found) else {*found, "".join(found)})
    return words


def own_names(name: str, attributes: str) -> tuple[str, ...]:
    """Keys an element adds to the place of its text: its name if it says something, and its class words."""
    keys = [name] if name in NEVER_TEXT or name in FORMS or name in AROUND or name in ("article", "main") else []
    if attributes and name not in ("html", "body"):
        words: set[str] = set()
        for m in _ATTRIBUTE.finditer(attributes):
            if m[1] and m[1].lower() in ("class", "id", "role"):
                words |= name_words(references.unescape(m[2] or m[3] or m[4] or ""))
        if name in ("article", "main"):
            words &= COMMENT_WORDS
        keys += ["." + w for w in sorted(words)]
    return tuple(keys)


def attributes_end(page: str, at: int) -> int:
    """Place of the ``>`` that ends a tag whose attributes start at ``at``; the page's end if there is none."""
    while at < len(page):
        m = _ATTRIBUTE.match(page, at)
        if m is None or m.end() == at:
            close = page.find(">", at)
            return len(page) if close < 0 else close
        at = m.end()
        if at < len(page) and page[at] == ">":
            return at
    return len(page)


def runs(page: str) -> Iterator[tuple[list[str], tuple[str, ...], str, str, int, str]]:
    """Text runs in page order: (tags before, names around, declared part, innermost block, block number, text)."""
    stack, open_names = [Element("", (), "", "body")], Counter()
    tags: list[str] = []
    at, block = 0, 0

    def close(names: set[str] | frozenset[str], stop: frozenset[str]) -> None:
        """Close the nearest open element of these names and what is open in it; an element of ``stop`` is in the way."""
        if not any(open_names[n] for n in names):
            return
        for depth in range(len(stack) - 1, 0, -1):
            if stack[depth].name in names:
                for e in stack[depth:]:
                    open_names[e.name] -= 1
                del stack[depth:]
                return
            if stack[depth].name in stop:
                return

    while at < len(page):
        m = _OPEN.search(page, at)
        start = m.start() if m else len(page)
        if start > at:
            here, text = stack[-1], page[at:start]
            yield tags, here.names, here.declared, "" if text.isspace() else here.block, block, text
            tags = []
        if m is None:
            return
        if m[1]:
            if page.startswith((">", "->"), m.end()):
                at = page.index(">", m.end()) + 1
            else:
                end = _COMMENT_END.search(page, m.end())
                at = end.end() if end else len(page)
            continue
        if m[3] is None:
            end = page.find(">", m.end())
            at = len(page) if end < 0 else end + 1
            continue
        name = m[3].lower()
        end = m.end() if page.startswith(">", m.end()) else attributes_end(page, m.end())
        if end == len(page):
            return  # a tag that never ends is no text
        tags.append(name)
        at = end + 1
        if name in BLOCKS:
            block += 1
        if m[2]:
            close({name}, NOTHING if name in BLOCKS else BLOCKS)
            continue
        if name in CLOSES_PARAGRAPH:
            close(PARAGRAPH, BLOCKS - PARAGRAPH)
        if name in CLOSES_LIKE:
            close(CLOSES_LIKE[name], LISTS)
        if name == "br":
            yield tags, stack[-1].names, stack[-1].declared, "", block, "\n"
            tags = []
        if name in VOID:
            continue
        around = stack[-1]
        more = tuple(k for k in own_names(name, page[m.end() : end]) if k not in around.names)
        if around.declared:  # the heading of an article, not of the page
            more = tuple(k for k in more if k not in ("header", ".header"))
        declared = name if name in ("article", "main") and around.declared != "article" else around.declared
        element = Element(name, around.names + more if more else around.names, declared, name if name in BLOCKS or name == "a" else around.block)
        if name in RAW:
            ending = RAW_END[name].search(page, at)
            stop = ending.start() if ending else len(page)
            if stop > at and name not in NEVER_TEXT:
                yield tags, element.names, element.declared, name, block, page[at:stop]
                tags = []
            at = stop
        open_names[name] += 1
        stack.append(element)


def prior(key: str) -> tuple[float, float]:
    """Counts (content, rest) a name starts with."""
    if key in NEVER_TEXT or key in FORMS or key in AROUND or (key[:1] == "." and key[1:] in AROUND_WORDS):
        return 1.0, PRIOR
    if key in ("article", "main", "in p", "in h1", "in h2", "in h3", "in blockquote", "in pre", "in dd", "in td"):
        return PRIOR / 10, 1.0
    return {"in div": (20.0, 10.0), "in body": (15.0, 10.0), "in li": (12.0, 10.0), "in a": (5.0, 10.0)}.get(key, (1.0, 1.0))


def odds(content: float, rest: float, key: str) -> float:
    more, less = prior(key)
    return max(-LIMIT, min(LIMIT, math.log((content + more) / (rest + less))))


class Weights:
    """Scores of places and tags from counts of (content, rest) by key."""

    def __init__(self, counts: dict[str, tuple[float, float]]):
        self.counts, self.places, self.tags, self.known = counts, {}, {}, {}

    def of(self, key: str) -> float:
        if key not in self.known:
            self.known[key] = odds(*self.counts.get(key, (0.0, 0.0)), key)
        return self.known[key]

    def vetoed(self, names: tuple[str, ...]) -> bool:
        if names not in self.places:
            self.places[names] = any(self.of(k) < VETO for k in names)
        return self.places[names]

    def word(self, names: tuple[str, ...], block: str) -> float:
        for key in reversed(names):
            if key in self.counts:
                return self.of(key)
        return self.of("in " + block)

    def tag(self, name: str) -> float:
        if name not in self.tags:
            content, rest = self.counts.get(f"<{name}>", (0.0, 0.0))
            self.tags[name] = -TAG - max(0.0, min(1.0, -0.25 * math.log((content + 1.0) / (rest + 1.0))))
        return self.tags[name]


def declared_part(found: list, vetoed) -> str:
    """``article`` or ``main`` if the page declares one with words of its own, else nothing."""
    parts = {run[2] for run in found if run[2] and run[3] and not vetoed(run[1])}
    return "article" if "article" in parts else "main" if "main" in parts else ""


def counts_of(page: str, none: Weights) -> Counter:
    """(key, is content) -> words or tags, of a page that declares its article; empty for others. ``none`` knows priors only."""
    found, counts = list(runs(page)), Counter()
    part = declared_part(found, none.vetoed)
    if not part:
        return counts
    for tags, names, declared, block, _, text in found:
        vetoed = none.vetoed(names)
        inside = declared == part and not vetoed
        counts.update((f"<{t}>", inside) for t in tags)
        if words := len(text.split()) if block else 0:
            keys = set(names) if vetoed else {*names, "in " + block}  # a vetoed word says nothing about its block
            counts.update(dict.fromkeys(((k, inside) for k in keys), words))
    return counts


def main_text(page: str | None, weights: Weights) -> str:
    """Text of the best region of a page."""
    found = list(runs(page)) if page else []
    part = declared_part(found, weights.vetoed)
    best, total, start, region = 0.0, 0.0, 0, (0, 0)
    kept: list[bool] = []
    for i, (tags, names, declared, block, _, text) in enumerate(found):
        total += sum(map(weights.tag, tags))
        if total <= 0:
            total, start = 0.0, i
        kept.append(not weights.vetoed(names))
        if block and kept[-1]:
            one = (LIMIT if declared == part else -LIMIT) if part else weights.word(names, block)
            total += one * len(text.split())
            if total > best:
                best, region = total, (start, i + 1)
    blocks: dict[int, list[str]] = {}
    for keep, run in zip(kept[slice(*region)], found[slice(*region)], strict=True):
        if keep and (not part or run[2] == part):
            blocks.setdefault(run[4], []).append(run[5])
    joined = (" ".join(references.unescape("".join(b)).split()) for b in blocks.values())
    return "\n\n".join(b for b in joined if b)


def fitted(pages: DataFrame, html: str = "html", labelled_pages: int = 2000) -> dict[str, tuple[float, float]]:
    """Counts by key over the labelled pages of a bounded sample: the distinct pages with the smallest hashes."""
    given = pages.select(F.col(html).alias("html")).filter("html IS NOT NULL").withColumn("h", F.xxhash64("html"))
    least = given.groupBy("h").count().orderBy("h").limit(labelled_pages).agg(F.max("h").alias("h")).first().h
    if least is None:
        return {}
    sample = given.filter(F.col("h") <= least).groupBy("h").agg(F.min("html").alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, none = Counter(), Weights({})
        for batch in batches:
            for page in column_values(batch, "html"):
                total.update(counts_of(page, none))
        keys = sorted(total)
        yield pa.RecordBatch.from_arrays(
            [pa.array([k for k, _ in keys], pa.string()), pa.array([c for _, c in keys], pa.bool_()), pa.array([total[k] for k in keys], pa.int64())],
            names=["key", "content", "n"])

    counted = sample.select("html").mapInArrow(run, "key string, content boolean, n long").groupBy("key").agg(
        F.sum(F.when(F.col("content"), F.col("n")).otherwise(0)).alias("content"), F.sum(F.when(F.col("content"), 0).otherwise(F.col("n"))).alias("rest"))
    return {r.key: (float(r.content), float(r.rest)) for r in counted.collect()}  # names in labelled_pages pages at most


def extract(
    pages: DataFrame, counts: dict[str, tuple[float, float]], *, page_id: str = "page_id", url: str = "url", html: str = "html",
) -> DataFrame:
    """``page_id, url, text, n_chars`` of every page, with weights from :func:`fitted`."""
    given = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), F.col(html).alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = Weights(counts)
        for batch in batches:
            texts: list[str] = []
            first, size = 0, 0

            def part(stop: int) -> pa.RecordBatch:
                ids, urls = (batch.column(batch.schema.get_field_index(c)).slice(first, stop - first) for c in ("page_id", "url"))  # noqa: B023
                return pa.RecordBatch.from_arrays([ids, urls, pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["page_id", "url", "text", "n_chars"])  # noqa: B023

            column = batch.column(batch.schema.get_field_index("html"))
            for i in range(batch.num_rows):
                texts.append(main_text(column[i].as_py(), weights))
                size += len(texts[-1])
                if size > 1 << 22 or i == batch.num_rows - 1:
                    yield part(i + 1)
                    texts, first, size = [], i + 1, 0
            if len(weights.places) > 100_000:  # places are only remembered, never needed
                weights = Weights(counts)

    kinds = {f.name: f.dataType.simpleString() for f in given.schema}
    return given.mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")


@query("op11_html_extraction")
def op11_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return extract(pages, fitted(pages))
