"""Main text of web pages by line-block distribution.

The markup is stripped into lines: one for each block-level element's own text, in page order, with character references
decoded and white space folded. Each line has a length, less that of its links; lines in parts of the page that are not the article (menus,
headers, footers, sidebars, notices, adverts, forms, comments, by element or by the words of class, id and role) and
lines that are mostly links count zero. Such a mark is lifted where the marked element holds the story (`_blocked`). The
lengths are summed over sliding windows of ``WINDOW`` lines. A run lies between the points where the sums rise from zero and dive back
to it, so that up to ``WINDOW`` - 1 lines of zero length inside are bridged, and stays if the sums surge in it: to ``SURGE`` of the
typical sum of the page, which is the mean of the window sums weighted by themselves. Where article
or main elements hold half of a page's text or more, all runs inside are kept, so that short stories stay; elsewhere
runs without a surge are kept inside the container of the longest run only. Lines of length zero inside a kept run that only links made
zero are kept: prose may end in one.

Time and memory are linear in the page, whatever its markup: elements are nodes with a parent, and what depends on
ancestors or descendants is summed up over the nodes once.

Defined cases: null or empty html has an empty text; unclosed and misnested elements close with their parents; a tag that
the page ends in has no text; quotes in tags count until one is left open; raw text
of scripts and styles ends at its end tag only; repeated rows repeat; null ids and urls stay null; an empty table
gives an empty table; other columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from html import unescape
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

WINDOW, SURGE, LINKS = 3, 0.25, 0.6

_TAG = re.compile(r"/?[a-zA-Z][^\s/>]*+")
_REST = re.compile(r"(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>")
_NAMES = re.compile(r"(?:^|\s)(class|id|role|aria-hidden|hidden|style)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))|(?=\s|$))", re.I)
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_SPACE = re.compile(r"\s+")

RAW = {"script", "style", "noscript", "template", "iframe", "object", "svg", "math", "canvas", "textarea", "select", "audio", "video", "head", "title"}
VOID = {"br", "img", "hr", "meta", "link", "input", "source", "wbr", "area", "base", "col", "embed", "track", "param"}
BLOCK = {
    "address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "div", "dl", "dt", "fieldset", "figcaption",
    "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "p", "pre",
    "search", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul",
}
OUTSIDE = {"nav", "aside", "footer", "form", "menu", "dialog", "button", "label", "fieldset", "search"}
OUTSIDE_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "alertdialog", "menu", "menubar", "toolbar", "tablist", "status"}
OUTSIDE_WORDS = {
    "ad", "ads", "advert", "adverts", "advertisement", "advertising", "sponsor", "sponsored", "promo", "promotion", "banner", "nav", "navbar", "navigation",
    "menu", "breadcrumb", "breadcrumbs", "sidebar", "aside", "footer", "masthead", "comment", "comments", "reply", "replies", "respond", "disqus", "cookie",
    "cookies", "consent", "gdpr", "notice", "popup", "modal", "overlay", "newsletter", "subscribe", "subscription", "signup", "login", "share", "sharing",
    "social", "related", "recommended", "recommendations", "widget", "pagination", "pager", "toolbar", "copyright", "legal", "disclaimer", "skip", "tags",
    "form", "search", "outbrain", "taboola", "alert",
}
#: Marks that nothing lifts, that most of the page's text lifts as well as an article does, and words of headings and paragraphs that are their topic.
NEVER, FIRM, LOOSE = 2, 1, 0
NEVER_TAGS, NEVER_WORDS = {"nav", "footer", "menu", "dialog", "button", "label"}, {"comment", "comments", "reply", "replies", "respond", "disqus"}
LOOSE_WORDS = {"nav", "navbar", "navigation", "menu", "sidebar", "aside", "share", "sharing", "social", "related", "widget", "banner", "search", "form", "overlay", "toolbar", "tags", "notice", "legal", "alert"}
TOPICS, TOPIC_TAGS = {"legal", "notice", "related", "tags", "alert"}, {"p", "h1", "h2", "h3", "h4", "h5", "h6"}
#: A class such as has-sidebar or share-enabled tells of a page with such a part; it is not the part.
BEFORE, AFTER = {"has", "with", "no", "without", "is", "not"}, {"enabled", "disabled", "open", "opened", "closed", "collapsed", "expanded", "visible", "active", "on", "off"}
#: Elements that hold blocks of text, of which a story is made.
CONTAINERS = {"article", "body", "center", "div", "form", "fieldset", "html", "main", "section", "table", "tbody"}
#: A header belongs to the article when it is inside it and holds a heading; elsewhere it is the page's.
ARTICLE = {"article", "main"}
CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_ENDS_P = BLOCK - {"body", "html", "li", "dt", "dd", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "legend", "summary", "figcaption"}


def _outside(tag: str, attributes: str, in_article: bool) -> int | None:
    """The mark of an element that is not of the article: NEVER, FIRM or LOOSE."""
    marks = []
    if tag in OUTSIDE or (tag == "header" and not in_article):
        marks.append(NEVER if tag in NEVER_TAGS else LOOSE if tag in ("form", "fieldset") else FIRM)
    if not attributes or tag in ("html", "body", *ARTICLE):
        return max(marks, default=None)
    for m in _NAMES.finditer(attributes):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name == "hidden" or (name == "aria-hidden" and value.lower() == "true"):
            marks.append(NEVER)
        if name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            marks.append(NEVER)
        if name == "role" and value.lower() in OUTSIDE_ROLES:
            marks.append(LOOSE if value.lower() in ("form", "search") else FIRM)
        if name in ("class", "id"):
            for part in value.split():
                words = [w.lower() for w in _WORDS.findall(part)]
                if words and (words[0] in BEFORE or (len(words) > 1 and words[-1] in AFTER)):
                    continue
                found = OUTSIDE_WORDS.intersection(words) - (TOPICS if tag in TOPIC_TAGS else set())
                marks += [NEVER if w in NEVER_WORDS else LOOSE if w in LOOSE_WORDS else FIRM for w in found]
    return max(marks, default=None)


def _tokens(html: str) -> Iterator[tuple[str, str, str]]:
    """Texts ("", "", text), start tags ("<", name, attributes) and end tags ("/", name, ""), in page order."""
    at, n, last = 0, len(html), html.rfind(">")
    quotes = True
    raw_ends: dict[str, int] = {}
    while at < n:
        begin = html.find("<", at)
        if begin < 0:
            yield "", "", html[at:]
            return
        if begin > at:
            yield "", "", html[at:begin]
        if html.startswith("<!--", begin):
            end = html.find("-->", begin + 4)
            at = end + 3 if end >= 0 else n
            continue
        if html.startswith("<![CDATA[", begin) and (end := html.find("]]>", begin + 9)) >= 0:
            yield "", "", html[begin + 9 : end].replace("&", "&amp;")
            at = end + 3
            continue
        name = _TAG.match(html, begin + 1)
        if not name and html[begin + 1 : begin + 2] not in ("!", "?"):
            yield "", "", "<"
            at = begin + 1
            continue
        if begin > last:
            return
        if not name:
            at = html.find(">", begin) + 1
            continue
        rest = _REST.match(html, name.end()) if quotes else None
        if not rest:
            quotes = False
        at = rest.end() if rest else html.find(">", name.end()) + 1
        tag, attributes = name[0].lower(), html[name.end() : at - 1]
        if tag[0] == "/":
            yield "/", tag[1:], ""
            continue
        if tag in RAW:
            if not attributes.endswith("/"):
                if raw_ends.get(tag, 0) < at:
                    end = re.compile(rf"</{re.escape(tag)}\s*+>", re.I).search(html, at)
                    raw_ends[tag] = end.end() if end else n + 1
                if raw_ends[tag] <= n or tag not in ("head", "title"):
                    at = min(raw_ends[tag], n)
            continue
        yield "<", tag, attributes


class Page:
    """The lines of a page, and its elements as nodes 0 (the page), 1, ... in page order."""

    def __init__(self, html: str):
        self.parent, self.tag, self.mark, self.article = [0], [""], [None], [0]
        self.mains: set[int] = set()
        self.texts: list[str] = []
        self.nodes: list[int] = []  # of the lines
        self.links: list[int] = []  # characters of the lines that are links
        self._stack, self._blocks, self._open = [0], [0], Counter()
        self._line: list[tuple[str, int]] = []  # pieces of the line, with the lengths of their links
        # open marked inline elements: depth, and where their text starts; those before _fresh were split by a block
        self._inline: list[tuple[int, int]] = []
        self._fresh = 0
        self._read(html)

    def _put(self, parts: list[tuple[str, int]], depth: int) -> None:
        line = _SPACE.sub(" ", unescape("".join(raw for raw, _ in parts))).strip()
        if line:
            self.texts.append(line)
            self.nodes.append(self._stack[depth])
            self.links.append(sum(links for _, links in parts))

    def _flush(self) -> None:
        began = 0
        # a block within a marked inline element: what came before that element is the surrounding block's
        for depth, start in self._inline[self._fresh :]:
            self._put(self._line[began:start], depth - 1)
            began = start
        self._fresh = len(self._inline)
        self._put(self._line[began:], len(self._stack) - 1)
        self._line.clear()

    def _drop_inline(self, depth: int) -> None:
        """The text of unsplit marked inline elements from that depth on goes."""
        k = len(self._inline)
        while k > self._fresh and self._inline[k - 1][0] >= depth:
            k -= 1
        if k < len(self._inline):
            del self._line[self._inline[k][1] :]

    def _close(self, depth: int) -> None:
        """Closes the elements from that depth on; the text of marked inline elements goes."""
        k = len(self._inline)
        while k and self._inline[k - 1][0] >= depth:
            k -= 1
        if k < len(self._inline):
            if k < self._fresh:
                self._flush()
            else:
                self._drop_inline(depth)
            del self._inline[k:]
            self._fresh = min(self._fresh, k)
        for node in self._stack[depth:]:
            self._open[self.tag[node]] -= 1
        del self._stack[depth:]
        while self._blocks[-1] >= depth:
            self._blocks.pop()

    def _end(self, tag: str) -> None:
        if not self._open[tag]:
            if tag in BLOCK:
                self._flush()
            return
        depth = len(self._stack) - 1
        while self.tag[self._stack[depth]] != tag:
            depth -= 1
        if self._blocks[-1] >= depth:
            self._drop_inline(depth + 1)
            self._flush()
        self._close(depth)

    def _start(self, tag: str, attributes: str) -> None:
        if tag in BLOCK:
            self._flush()
            for closed in ({"p"} if tag in _ENDS_P else set(), CLOSES.get(tag, ())):
                if self.tag[self._stack[self._blocks[-1]]] in closed:
                    self._close(self._blocks[-1])
        if attributes.endswith("/"):
            return
        around = self._stack[-1]
        mark = _outside(tag, attributes, self.article[around] > 0)
        node, depth = len(self.parent), len(self._stack)
        if mark is not None and tag not in BLOCK:
            self._inline.append((depth, len(self._line)))
        main = tag == "main" or 'role="main"' in attributes
        if main:
            self.mains.add(node)
        self.parent.append(around)
        self.tag.append(tag)
        self.mark.append(mark)
        self.article.append(node if main or tag in ARTICLE else self.article[around])
        self._stack.append(node)
        self._open[tag] += 1
        if tag in BLOCK:
            self._blocks.append(depth)

    def _read(self, html: str) -> None:
        anchors = 0
        for kind, tag, value in _tokens(html):
            if not kind:
                self._line.append((value, len(value.strip()) if anchors else 0))
            elif kind == "/":
                if tag == "a":
                    anchors = max(anchors - 1, 0)
                self._end(tag)
            elif tag == "hr":
                self._flush()
            elif tag in VOID:
                if tag == "br":
                    self._line.append((" ", 0))
            else:
                anchors += tag == "a"
                self._start(tag, value)
        self._flush()

    def down(self, own: list[bool]) -> list[bool]:
        """For each node, whether it or a node around it is in ``own``."""
        out = own[:]
        for node in range(1, len(out)):
            out[node] = out[node] or out[self.parent[node]]
        return out

    def up(self, own: list, join: Callable) -> list:
        """For each node, its own value joined with those of all nodes inside it."""
        out = own[:]
        for node in range(len(out) - 1, 0, -1):
            out[self.parent[node]] = join(out[self.parent[node]], out[node])
        return out


def _blocked(page: Page) -> list[bool]:
    """For each node, whether it lies in a part that is not the article.

    The mark of a part is lifted if it holds the story all the same: a main element, an article longer than all unmarked text, or most of
    a page without articles.
    """
    size = len(page.parent)
    never, marked = page.down([m == NEVER for m in page.mark]), page.down([m is not None for m in page.mark])
    held, articles = [0] * size, [0] * size
    total = unmarked = free_articles = 0
    for text, node, linked in zip(page.texts, page.nodes, page.links):
        if never[node]:
            continue
        own = max(len(text) - linked, 0)
        total += own
        held[node] += own
        if page.article[node]:
            articles[page.article[node]] += own
        if not marked[node]:
            unmarked += own
            free_articles += own if page.article[node] else 0
    held = page.up(held, int.__add__)
    longest = page.up(articles, max)
    stories = page.up([node in page.mains and articles[node] > 0 for node in range(size)], bool.__or__)

    def lifted(node: int) -> bool:
        if page.mark[node] == NEVER:
            return False
        inside = longest[node] if page.article[node] != node else 0
        return stories[node] or inside > unmarked or (page.mark[node] == LOOSE and not free_articles and 2 * held[node] > total)

    return page.down([page.mark[node] is not None and not lifted(node) for node in range(size)])


def window_sums(lengths: list[int], window: int = WINDOW) -> list[int]:
    """Sum of the lengths of each line and the ones after it, ``window`` together."""
    through = [0, *accumulate(lengths)]
    n = len(lengths)
    return [through[min(k + window, n)] - through[k] for k in range(n)]


def runs(lengths: list[int], window: int = WINDOW) -> list[tuple[int, int, bool]]:
    """Between a rise and a dive of the window sums: half-open ranges without zero ends, and whether the sums surge inside."""
    sums = window_sums(lengths, window)
    surge = SURGE * sum(s * s for s in sums) / max(sum(sums), 1)
    found, k, n = [], 0, len(sums)
    while k < n:
        if not sums[k]:
            k += 1
            continue
        a = k
        while k < n and sums[k]:
            k += 1
        # the first window begins with lines of length zero, the last one ends the run
        while not lengths[a]:
            a += 1
        found.append((a, k, max(sums[a:k]) >= surge))
    return found


def main_text(html: str | None) -> str:
    page = Page(html or "")
    blocked = _blocked(page)
    texts, n = page.texts, len(page.texts)
    sized = [0 if blocked[node] else len(text) for text, node in zip(texts, page.nodes)]
    own = [max(size - links, 0) for size, links in zip(sized, page.links)]
    inside = sum(x for x, node in zip(own, page.nodes) if page.article[node])
    whole = inside > 0 and 2 * inside >= sum(own)
    if whole:
        sized = [size if page.article[node] else 0 for size, node in zip(sized, page.nodes)]
        found = runs(sized)
    else:
        # without an article element, lines of links don't make a surge
        dense = [0 if page.links[k] >= LINKS * len(texts[k]) else sized[k] for k in range(n)]
        found = runs(dense)
        if found:
            a, b, _ = max(found, key=lambda r: sum(dense[r[0] : r[1]]))
            story = [0] * len(page.parent)
            for k in range(a, b):
                story[page.nodes[k]] += dense[k] > 0
            held = page.up(story, int.__add__)
            # the innermost container of all lines of the longest run
            around = max((node for node, x in enumerate(held) if x == held[0] and page.tag[node] in CONTAINERS), default=0)
            within = page.down([node == around for node in range(len(held))])
            found = [r for r in found if r[2] or any(dense[k] and within[page.nodes[k]] for k in range(r[0], r[1]))]
    return "\n".join(texts[k] for a, b, _ in found for k in range(a, b) if sized[k])


def _extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [main_text(h.as_py()) for h in batch.column(2)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every row of ``pages`` (page_id, url, html). One scan, no shuffle."""
    return pages.select(F.col("page_id").cast("long"), "url", "html").mapInArrow(_extracted, "page_id long, url string, text string, n_chars long")


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))


#: The main text of pages that have one article element with paragraphs and a heading, for which plain string work suffices.
OP1_SQL = r"""
WITH a AS (
  SELECT page_id, url, regexp_extract(coalesce(html, ''), '<article[^>]*>(.*?)</article>', 1, 's') AS h FROM pages
), b AS (
  SELECT page_id, url, unnest(list_zip(parts, range(len(parts)))) AS p FROM (
    SELECT page_id, url, string_split_regex(regexp_replace(h, '<br ?/?>', ' ', 'g'), '</?(p|h[1-6]|li|ul|ol|div|section|blockquote|table|tr|td|th|pre)( [^>]*)?>') AS parts FROM a
  )
), c AS (
  SELECT page_id, url, p[2] AS k,
    trim(regexp_replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(regexp_replace(p[1], '</?[a-zA-Z][^>]*>', '', 'g'),
      '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#x27;', ''''), '&#39;', ''''), '&copy;', '©'), '&middot;', '·'), '&amp;', '&'), '&amp', '&'), '\s+', ' ', 'g')) AS line
  FROM b
), d AS (
  SELECT page_id, url, coalesce(string_agg(line, chr(10) ORDER BY k) FILTER (WHERE line <> ''), '') AS text FROM c GROUP BY page_id, url
)
SELECT page_id, url, text, CAST(length(text) AS BIGINT) AS n_chars FROM d
"""
