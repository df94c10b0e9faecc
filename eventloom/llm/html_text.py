"""Main text of web pages by tree scoring.

A page becomes a tree of elements. Every paragraph earns points for its length and its commas and passes them to its ancestors, the
parent most and each further one less; an ancestor's sum is discounted by the share of its text that lies in links. The best
container is kept with the siblings that look like parts of the same article, and the blocks in it are read in page order.
Menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles and comments are known by element, role or the names
in ``class`` and ``id``, give no points and are never read.

A page is one row and one pass over its tags; work and memory are linear in its length, whatever is nested or left open.
"""

from __future__ import annotations

import html
import re
from collections import defaultdict

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import map_columns, read

# Names of HTML elements and of parts of pages.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title noscript iframe xmp noembed noframes template".split())
BLOCK = set(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 "
    "h6 head header hgroup hr html li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split()
)
SKIP = set(
    "script style textarea title noscript iframe xmp noembed noframes template head nav aside footer form button select input "
    "option dialog menu search object applet audio video canvas svg math map".split()
)
SCOPE = set("td th table caption html body button".split())
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}
PART_ROLES = set("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar toolbar".split())
PART_NAMES = set(
    "ad ads advert adverts advertisement advertisements adsense sponsor sponsored sponsors promo promotion promoted outbrain taboola "
    "comment comments disqus respond replies reader-comments cookie cookies consent gdpr notice notices newsletter subscribe signup "
    "paywall popup modal overlay sidebar sidebars rail widget widgets share sharing social related recommended recommendations "
    "breadcrumb breadcrumbs pagination pager nav navbar navigation menu menus footer masthead toolbar login banner copyright disclaimer".split()
)
HEADER_NAMES = set("header topbar".split())
BODY_NAMES = set("article content main body post entry story text page wrapper container layout".split())
GOOD_NAMES = set("article body content entry main post story text".split())

NEXT = re.compile(r"<(?:!--|(?P<close>/?)(?P<name>[A-Za-z][^\s/>]*)|[!?]|/)")
REST = re.compile(r"(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>")
ATTRIBUTE = re.compile(r"(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
NAME = re.compile(r"[a-z]+|[0-9]+")
HUMP = re.compile(r"(?<=[a-z])(?=[A-Z])")

PARAGRAPHS = {"p", "pre", "td", "blockquote", "dd"}
CONTAINERS = {"article", "main"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
LONG, NAME_POINTS, SIBLING_SHARE, SIBLING_POINTS = 25, 25.0, 0.2, 10.0


def _attributes(text: str) -> dict[str, str]:
    found: dict[str, str] = {}
    for m in ATTRIBUTE.finditer(text):
        before = text[m.start() - 1 : m.start()]
        if before == "" or before in " \t\n\r\f\"'/":
            found.setdefault(m[1].lower(), html.unescape(m[2] or m[3] or m[4] or ""))
    return found


def _names(attributes: dict[str, str]) -> list[list[str]]:
    """Words of each class and of the id, without those that say what something has or lacks."""
    out = []
    for value in f"{attributes.get('class', '')} {attributes.get('id', '')}".split():
        words, skip = [], False
        for w in NAME.findall(HUMP.sub(" ", value).lower()):
            skip = skip or w in ("with", "has", "no", "without", "above", "below")
            if not skip:
                words.append(w)
        out.append(words)
    return out


def is_part(tag: str, attributes: dict[str, str], in_article: bool) -> bool:
    """Whether an element is a menu, header, advert or other part of the page that is not article, by what it says of itself."""
    if tag in SKIP:
        return True
    if not attributes:
        return tag == "header" and not in_article
    style = attributes.get("style", "").replace(" ", "").lower()
    if "hidden" in attributes or attributes.get("aria-hidden", "").lower() == "true" or "display:none" in style or "visibility:hidden" in style:
        return True
    if tag in ("html", "body", "main"):
        return False
    if attributes.get("role", "").lower() in PART_ROLES or tag == "header" and not in_article:
        return True
    for words in _names(attributes):
        if not words:
            continue
        hits = PART_NAMES.intersection(words)
        # the last word says what it is: "main-menu" is a menu, "sidebar-layout" a layout
        if hits and (words[-1] in PART_NAMES or not BODY_NAMES.intersection(words[-1:])):
            return True
        if hits & {"comment", "comments", "disqus"}:
            return True
        if HEADER_NAMES.intersection(words) and not in_article and not (BODY_NAMES - {"page", "main"}).intersection(words):
            return True
    return False


class Page:
    """The elements of a page, parents before children, and its blocks of text.

    Of each element: tag, parent, whether it is left out, characters of text and of linked text; of each block: the element it belongs
    to and its text with white space as single spaces.
    """

    def __init__(self, source: str):
        self.tags, self.parents, self.out, self.points = ["#page"], [-1], [False], [0.0]
        self.inside = [False]
        self.names: list[tuple] = [()]
        self.text, self.linked, self.links = [0], [0], [0]
        self.blocks: list[tuple[int, str]] = []
        self._stack, self._buffer, self._linked, self._owner = [0], [], 0, 0
        self._open: dict[str, int] = defaultdict(int)
        self._read(source)

    def _read(self, source: str) -> None:
        at, quoted, n = 0, True, len(source)
        while at < n:
            m = NEXT.search(source, at)
            if not m:
                self._say(source[at:])
                break
            if m.start() > at:
                self._say(source[at : m.start()])
            if m["name"] is None:
                if m[0] == "<!--":
                    end = source.find("-->", m.end() - 2 if source.startswith((">", "->"), m.end()) else m.end())
                    at = n if end < 0 else end + 3
                else:
                    end = source.find(">", m.end())
                    at = n if end < 0 else end + 1
                continue
            rest = REST.match(source, m.end()) if quoted else None
            if rest is None:  # a quote is left open: from here on, tags end at the next bracket
                quoted, end = False, source.find(">", m.end())
                if end < 0:
                    break
                at = end + 1
            else:
                at = rest.end()
            tag = m["name"].lower()
            if m["close"]:
                self._close(tag)
                continue
            inner = source[m.end() : at - 1]
            self._start(tag, _attributes(inner) if "=" in inner or "hidden" in inner.lower() else {})
            if tag in RAW:
                end = self._raw_end(source, tag, at)
                if end < 0:
                    break
                at = end
                self._close(tag)
            elif tag not in VOID and inner.endswith("/") and tag not in BLOCK:
                self._close(tag)
        self._flush()

    def _raw_end(self, source: str, tag: str, at: int) -> int:
        m = re.compile(rf"</{tag}(?=[\s/>])[^>]*>", re.I).search(source, at)
        return m.end() if m else -1

    def _say(self, text: str) -> None:
        here = self._stack[-1]
        if self.out[here]:
            return
        self._buffer.append(text)
        if self._open["a"]:
            self._linked += len("".join(text.split()))

    def _flush(self) -> None:
        if not self._buffer:
            return
        # references are decoded before white space is folded, so that encoded blanks count as blanks
        text = " ".join(html.unescape("".join(self._buffer)).split())
        if text:
            at, owner = self._owner, self._owner
            self.blocks.append((owner, text))
            linked = min(self._linked, len(text))
            self.text[at] += len(text)
            self.linked[at] += linked
        self._buffer, self._linked = [], 0

    def _start(self, tag: str, attributes: dict[str, str]) -> None:
        if tag == "br":
            self._say(" ")
            return
        if tag in VOID and tag != "hr":
            return
        block = tag in BLOCK
        if block:
            self._flush()
            if self._open["p"]:
                self._pop({"p"}, SCOPE)
            if tag in CLOSES:
                self._pop(*CLOSES[tag])
            if tag == "hr":
                return
        if tag == "a" and self._open["a"]:
            self._pop({"a"}, SCOPE | BLOCK)
        parent = self._stack[-1]
        inside = self.inside[parent] or tag in CONTAINERS
        self.tags.append(tag)
        self.parents.append(parent)
        self.out.append(self.out[parent] or is_part(tag, attributes, self.inside[parent]))
        self.inside.append(inside)
        self.names.append(tuple(sorted(attributes.get("class", "").split())) if attributes else ())
        good = bool(attributes) and any(GOOD_NAMES.intersection(words) for words in _names(attributes))
        self.points.append(NAME_POINTS * (tag in CONTAINERS) + NAME_POINTS * (good and block))
        self.text.append(0)
        self.linked.append(0)
        self.links.append(0)
        self._stack.append(len(self.tags) - 1)
        self._open[tag] += 1
        if tag == "a":
            self.links[self._block()] += 1
        if block:
            self._owner = len(self.tags) - 1

    def _block(self) -> int:
        return next(i for i in reversed(self._stack) if i == 0 or self.tags[i] in BLOCK)

    def _pop(self, wanted: set[str], barriers: set[str]) -> None:
        """Close the nearest open element of ``wanted`` and all in it, unless a barrier is nearer."""
        for depth in range(len(self._stack) - 1, 0, -1):
            tag = self.tags[self._stack[depth]]
            if tag in wanted:
                self._cut(depth)
                return
            if tag in barriers:
                return

    def _cut(self, depth: int) -> None:
        if any(self.tags[i] in BLOCK for i in self._stack[depth:]):
            self._flush()
        for i in self._stack[depth:]:
            self._open[self.tags[i]] -= 1
        del self._stack[depth:]
        self._owner = self._block()

    def _close(self, tag: str) -> None:
        if tag == "p":
            self._flush()
        if tag == "br":
            self._say(" ")
        if not self._open[tag]:
            return
        if tag in BLOCK:
            self._pop({tag}, (SCOPE - {tag}) if tag not in ("table", "body", "html") else {"html"} - {tag})
        else:
            self._pop({tag}, BLOCK | SCOPE)


def _score(page: Page) -> tuple[list[float], list[int], list[int]]:
    """Of each element: points discounted by link density, characters of text and links in and below it."""
    tags, parents = page.tags, page.parents
    points = list(page.points)
    earned = [False] * len(tags)
    for at, text in page.blocks:
        # text right inside a container is a paragraph without a tag of its own
        if tags[at] in HEADINGS or tags[at] in ("li", "dt", "figcaption", "caption", "th", "summary"):
            continue
        own = min(len(text) / 100, 3.0) + text.count(",") + text.count("，") + (len(text) >= LONG)
        own *= 1 - page.linked[at] / max(page.text[at], 1)
        node, level = (parents[at], 0) if tags[at] in PARAGRAPHS else (at, 0)
        while node > 0 and level < 8:
            points[node] += own / (1 if level == 0 else 2 if level == 1 else 3 * level)
            earned[node] = True
            node, level = parents[node], level + 1
    text, linked, links = list(page.text), list(page.linked), list(page.links)
    for i in range(len(tags) - 1, 0, -1):
        text[parents[i]] += text[i]
        linked[parents[i]] += linked[i]
        links[parents[i]] += links[i]
    density = [k / max(t, 1) for k, t in zip(linked, text)]
    scores = [p * (1 - d) if e and not o else 0.0 for p, d, e, o in zip(points, density, earned, page.out)]
    return scores, text, [n if d >= 0.5 else 0 for n, d in zip(links, density)]


def main_text(source: str | None) -> str:
    """The article's blocks in page order, joined by one space; empty for null, blank and textless pages.

    Without a paragraph anywhere, all text that is no other part of the page is the article.
    """
    if not source or source.isspace():
        return ""
    page = Page(source)
    scores, text, links = _score(page)
    tags, parents = page.tags, page.parents
    best = max(range(len(tags)), key=lambda i: (scores[i], -i))
    if scores[best] <= 0:
        kept = {0}
    else:
        # an article element holds what belongs to it; a section of it may score higher
        node = best
        while node > 0:
            if tags[node] in CONTAINERS and not page.out[node]:
                best = node
                if tags[node] == "article":
                    break
            node = parents[node]
        kept = {best}
        bar = max(SIBLING_POINTS, SIBLING_SHARE * scores[best])
        semantic = tags[best] in CONTAINERS
        for i in range(1, len(tags)):
            if parents[i] != parents[best] or i == best or page.out[i] or tags[best] in ("body", "html"):
                continue
            alike = tags[i] == tags[best] and page.names[i] == page.names[best]
            if semantic:
                keep = scores[i] >= bar and tags[i] == tags[best]
            elif tags[i] in PARAGRAPHS:
                keep = page.text[i] > 0 and not links[i]
            else:
                keep = scores[i] >= bar or alike and text[i] > 0 and not links[i] or tags[i] in HEADINGS and i < best
            if keep:
                kept.add(i)
    # an element is read when it is kept or lies in one, unless it is mostly a list of links
    shown = [False] * len(tags)
    shown[0] = 0 in kept
    for i in range(1, len(tags)):
        crowded = tags[i] in ("ul", "ol", "dl", "div", "section", "table") and links[i] >= 3 and i not in kept
        shown[i] = (i in kept or shown[parents[i]]) and not page.out[i] and not crowded
    return " ".join(t for at, t in page.blocks if shown[at])


def extract_text(pages: DataFrame, *, source: str = "html") -> DataFrame:
    """``pages`` with ``text``, the main text of ``source``, and ``n_chars``, its code points; columns of these names are replaced.

    White space is what Unicode calls so, no-break spaces included. A null, empty or blank page has an empty text. Every row is judged
    by itself: repeated rows give repeated results, and an empty table gives none.
    """
    rest = [f for f in pages.schema if f.name not in ("text", "n_chars")]
    schema = T.StructType([*rest, T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def run(rows):
        texts = [main_text(s) for s in rows[source]]
        return {"text": texts, "n_chars": [len(t) for t in texts]}

    return map_columns(pages.select([f.name for f in rest]), run, schema)


def op13_html_text(spark, sf_dir):
    pages = extract_text(read(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return pages.select("page_id", "url", "text", "n_chars")


# The pages of the tables mark their article; SQL can cut it out and strip it
_SQL = r"""
WITH cut AS (SELECT page_id, url, regexp_extract(html, '<article>(.*)</article>', 1, 's') AS inner_html FROM pages),
bare AS (SELECT page_id, url, regexp_replace(regexp_replace(inner_html, '</?b>', '', 'g'), '<[^>]*>', ' ', 'g') AS t FROM cut),
decoded AS (
    SELECT page_id, url, regexp_replace(replace(replace(replace(t, '&quot;', '"'), '&lt;', '<'), '&gt;', '>'), '&amp;?', '&', 'g') AS t FROM bare
), folded AS (SELECT page_id, url, trim(regexp_replace(t, '\s+', ' ', 'g')) AS text FROM decoded)
SELECT page_id, url, coalesce(text, '') AS text, length(coalesce(text, ''))::BIGINT AS n_chars FROM folded
"""

QUERIES = {"op13_html_text": (op13_html_text, _SQL)}
