"""Main text of web pages by composite text density.

A page becomes a tree; nodes that by tag, role or class are menus, headers, footers, sidebars, notices, adverts, forms,
scripts or comments of readers are cut off, unless they hold the main part, the only articles or, where only a class, an id
or a form says so, most of the text.  Formulas stay.  Every other node gets its link-adjusted characters per tag; each node sums
its children's densities, and the node of the largest sum is the content.  The smallest density on its way up to the body
is the threshold that other parts must reach to count as content; a declared article or main part around the content
is taken whole.

Defined results: null or empty pages, and pages without text, give the empty text; tags left open, unknown or closed twice
are repaired in the usual way; pages of any length are read whole in time linear in their length.
"""

from __future__ import annotations

import math
import re
from html import unescape

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_texts

# fixed values: how HTML elements behave
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes template svg".split())
INLINE = frozenset(("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark nobr q rp rt ruby s samp small span "
                    "strike strong sub sup time tt u var wbr math").split())
FORMULA = frozenset(("semantics mrow mi mn mo ms mtext mspace mfrac msqrt mroot mstyle merror mpadded mphantom menclose msub msup msubsup munder mover "
                     "munderover mmultiscripts mprescripts none mtable mtr mtd maction annotation annotation-xml").split())
CLOSES_P = frozenset(("address article aside blockquote body center details dialog dir div dl dd dt fieldset figcaption figure footer form "
                      "h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre section table tbody td tfoot th thead tr ul").split())
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
            "option": {"option"}, "tbody": {"tr", "td", "th", "tbody", "thead"}}
SCOPES = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select"},
          "tbody": {"table"}}

# which parts of a page are not its article
CUT_TAGS = frozenset("head nav footer aside form button select menu dialog object embed audio video canvas annotation annotation-xml".split()) | RAW
CUT_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form".split())
CUT_NAMES = frozenset(("ad ads advert adverts advertisement sponsor sponsored promo promotion banner cookie cookies consent notice alert popup modal "
                       "newsletter subscribe sidebar side widget nav navbar navigation menu breadcrumb breadcrumbs footer masthead comment comments replies "
                       "disqus share sharing social related recommended pagination pager toolbar login signup").split())
READERS = frozenset("comment comments replies disqus".split())
BOXES = frozenset("area bar block box buttons container form holder inner items links list outer panel section slot unit widget wrap wrapper".split())
STATES = frozenset("has no not non with without is in on off show hide open close closed after before".split())
HOLDERS = frozenset(("article", "main"))

TAG = re.compile(r"<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>")
LOOSE_TAG = re.compile(r"<(/?)([A-Za-z][^\s/>]*)([^>]*)>")
ATTRIBUTE = re.compile(r"""(?:^|[\s"'])(class|id|role|hidden|aria-hidden)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
SPACE = re.compile(r"\s+")


def cut_name(value: str) -> str | None:
    """The name by which a class or id, one of its words as a whole, marks a part that is no article: "site-footer" and "ad-slot" do, but
    not "has-sidebar" or "share-page"."""
    for word in value.lower().split():
        parts = [p for p in re.split(r"[_-]+", word) if p and not p.isdigit()]
        while len(parts) > 1 and parts[-1] in BOXES:
            parts.pop()
        if parts and parts[-1] in CUT_NAMES and not STATES.intersection(parts):
            return parts[-1]
    return None


def is_cut(tag: str, attributes: str, in_holder: bool) -> int:
    """Whether an element is no part of an article: 0, or 1, or 2 if only a guess by name says so."""
    if tag in CUT_TAGS or tag == "header" and not in_holder:
        return 2 if tag == "form" else 1
    if not attributes or tag in ("html", "body"):
        return 0
    named = 0
    for name, *values in ATTRIBUTE.findall(attributes):
        value, name = "".join(values), name.lower()
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true":
            return 1
        if name == "role" and value.lower() in CUT_ROLES:
            return 1
        if name in ("class", "id") and tag not in HOLDERS and (found := cut_name(value)):
            named = 1 if found in READERS else named or 2
    return named


class Page:
    """The tree of one page, in lists by node; node 0 is the root."""

    def __init__(self, html: str):
        self.parent, self.tag = [-1], ["html"]
        self.pieces: list[tuple[int, str]] = []  # node and text, in page order; "" ends a block
        self.open, self.count = [0], {}
        self.own = [0]
        self.parse(html)
        self.settle()

    def settle(self) -> None:
        """Cuts parts off, but none that holds the main part, the only articles or, if just guessed by name, most of the text."""
        n = len(self.tag)
        if not any(self.own):
            self.cut = [False] * n
            return
        size, main, article, within = [0] * n, [False] * n, [False] * n, [False] * n
        for node, text in self.pieces:
            size[node] += len("".join(text.split()))
        for i in range(1, n):
            within[i] = within[self.parent[i]] or self.own[i] > 0
        outside = any(t in HOLDERS and not w for t, w in zip(self.tag, within, strict=True))
        for i in range(n - 1, 0, -1):
            up = self.parent[i]
            size[up] += size[i]
            main[up] |= main[i] or self.tag[i] == "main"
            article[up] |= article[i] or self.tag[i] == "article"
        body = next((i for i in range(n) if self.tag[i] == "body"), 0)
        self.cut = [False] * n
        for i in range(1, n):
            holds = main[i] or article[i] and not outside or self.own[i] == 2 and 2 * size[i] > size[body]
            self.cut[i] = self.cut[self.parent[i]] or self.own[i] > 0 and not holds

    def push(self, tag: str, cut: int) -> None:
        self.parent.append(self.open[-1])
        self.own.append(cut)
        self.tag.append(tag)
        self.open.append(len(self.tag) - 1)
        self.count[tag] = self.count.get(tag, 0) + 1
        if tag not in INLINE and tag not in FORMULA:
            self.pieces.append((self.open[-1], ""))

    def pop(self) -> str:
        node = self.open.pop()
        tag = self.tag[node]
        self.count[tag] -= 1
        if tag not in INLINE and tag not in FORMULA:
            self.pieces.append((node, ""))
        return tag

    def close(self, tags, until=()) -> None:
        """Closes the innermost open element of ``tags`` unless one of ``until`` stands within."""
        if not any(self.count.get(t) for t in tags):
            return
        for node in reversed(self.open[1:]):
            if self.tag[node] in tags:
                while self.open[-1] != node:
                    self.pop()
                self.pop()
                return
            if self.tag[node] in until:
                return

    def text(self, raw: str) -> None:
        if raw:
            self.pieces.append((self.open[-1], unescape(raw) if "&" in raw else raw))

    def parse(self, html: str) -> None:
        at, size, last = 0, len(html), html.rfind(">")
        while at < size:
            lt = html.find("<", at)
            if lt < 0 or lt > last:
                break
            if html.startswith("<!--", lt):
                self.text(html[at:lt])
                end = html.find("-->", lt + 4)
                at = size if end < 0 else end + 3
                continue
            if html[lt + 1 : lt + 2] in ("!", "?"):
                self.text(html[at:lt])
                at = html.find(">", lt) + 1
                continue
            m = TAG.match(html, lt) or LOOSE_TAG.match(html, lt)
            if m is None:
                self.text(html[at : lt + 1])
                at = lt + 1
                continue
            self.text(html[at:lt])
            at = m.end()
            tag = m[2].lower()
            if m[1]:
                if tag == "p" and not self.count.get("p"):
                    continue
                if tag not in ("html", "body"):
                    self.close((tag,), ("td", "th", "table", "article", "main") if tag in INLINE else ())
                continue
            if tag == "html" or tag == "body" and self.count.get("body"):
                continue
            if tag in CLOSES_P:
                self.close(("p",), ("table", "button"))
                if tag in ("body", "article", "main"):
                    self.close(("head",))
            if tag in SIBLINGS:
                self.close(SIBLINGS[tag], SCOPES[tag])
            if tag in VOID:
                self.pieces.append((self.open[-1], " " if tag in INLINE else ""))
                continue
            if tag in RAW:
                if tag == "svg" and m[3].endswith("/"):
                    continue
                end = re.compile(f"</{re.escape(tag)}(?=[\\s/>])", re.I | re.A).search(html, at)
                stop = html.find(">", end.start()) if end else -1
                at = stop + 1 if stop >= 0 else at if tag == "svg" else size
                continue
            self.push(tag, is_cut(tag, m[3], bool(self.count.get("article") or self.count.get("main"))))
            if m[3].endswith("/") and (tag == "math" or tag not in INLINE and tag not in CLOSES_P):
                self.pop()
        self.text(html[at:])


def densities(page: Page) -> tuple[list[float], list[float]]:
    """Composite text density of every node, and the sum of its children's."""
    n = len(page.tag)
    chars, tags, link_chars, link_tags = [0] * n, [0] * n, [0] * n, [0] * n
    linked = [False] * n
    for i in range(1, n):
        linked[i] = page.tag[i] == "a" or linked[page.parent[i]]
    for node, text in page.pieces:
        if text and not page.cut[node]:
            size = len("".join(text.split()))
            chars[node] += size
            if linked[node]:
                link_chars[node] += size
    for i in range(n - 1, 0, -1):
        if not page.cut[i]:
            up = page.parent[i]
            chars[up] += chars[i]
            link_chars[up] += link_chars[i]
            tags[up] += tags[i] + 1
            link_tags[up] += link_tags[i] + (page.tag[i] == "a")
    body = next((i for i in range(n) if page.tag[i] == "body"), 0)
    base = link_chars[body] / max(chars[body], 1)
    density, total = [0.0] * n, [0.0] * n
    for i in range(n):
        c = chars[i]
        if c and not page.cut[i]:
            t, lc, lt = max(tags[i], 1), max(link_chars[i], 1), max(link_tags[i], 1)
            scale = math.log(c / max(c - link_chars[i], 1) * link_chars[i] + base * c + math.e)
            value = c / lc * t / lt
            density[i] = c / t * (math.log(value) / math.log(scale) if value > 1 and scale > 1 + 1e-9 else value if value < 1 else math.log(max(value, 1.0) + 1))
    for i in range(1, n):
        total[page.parent[i]] += density[i]
    return density, total


def main_text(html: str) -> str:
    """The article of a page, blocks joined by empty lines."""
    page = Page(html)
    n = len(page.tag)
    density, total = densities(page)
    best = max(range(n), key=lambda i: (total[i], -i))
    if total[best] <= 0:
        best = max(range(n), key=lambda i: (density[i], -i))
    path, node = [], best
    while node >= 0:
        path.append(node)
        node = page.parent[node]
    body = next((k for k, i in enumerate(path) if page.tag[i] == "body"), len(path) - 1)
    threshold = min((density[i] for i in path[: body + 1] if density[i] > 0), default=0.0)
    holder = next((i for i in reversed(path) if page.tag[i] == "article"), None) or next((i for i in reversed(path) if page.tag[i] == "main"), None)
    taken = [False] * n
    for i in range(1, n):
        if page.cut[i]:
            continue
        if holder is not None:
            taken[i] = i == holder or taken[page.parent[i]]
        else:  # headings and lists below the parts that reach the threshold come with them
            taken[i] = i == best or taken[page.parent[i]] or page.tag[i] != "body" and total[i] > 0 and density[i] >= threshold and i not in path
    if holder is None:
        taken[best] = not page.cut[best]
        for i in range(1, n):
            taken[i] |= not page.cut[i] and (taken[page.parent[i]] or page.tag[i][0] == "h" and page.tag[i][1:].isdigit() and page.parent[i] in path)
    blocks, held = [], []
    for node, text in [*page.pieces, (0, "")]:
        if text:
            if taken[node]:
                held.append(text)
        elif held:
            block = SPACE.sub(" ", "".join(held)).strip()
            if block:
                blocks.append(block)
            held = []
    return "\n\n".join(blocks)


def extract_text(pages: DataFrame, col: str = "html") -> DataFrame:
    """Adds ``text`` and ``n_chars`` to every row."""

    def per_text():
        return lambda htmls: {"text": [main_text(h) for h in htmls]}

    return map_texts(pages, per_text, "text string", col).withColumn("n_chars", F.length("text").cast("long"))
