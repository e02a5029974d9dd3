"""Main text of web pages by composite text density.

A page is parsed into a tree.  For each node the characters a tag, damped by the
share of characters and tags that belong to links, give its density; a node's
score is the sum of its children's densities.  The best-scoring node marks the
article.  The least density on its path to the body is the threshold that the
other children of its ancestors must reach to be counted as part of it.  Elements that
cannot be article text (menus, forms, scripts, adverts, comments ...) are cut
before counting.

Null and empty pages have no text.  Rows are independent: repeated rows give
repeated results, and an empty table an empty one.  A long page is parsed whole, in
time linear in its length; elements nested beyond ``MAX_DEPTH`` are read as part of
the element around them, but what is to be cut is cut there too.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridmill.llm.workers import tidy

#: Element names by their role in HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript".split())
CUT = frozenset(
    "script style textarea title xmp iframe noembed noframes noscript head template svg math object canvas audio video nav footer aside form button select option "
    "label fieldset dialog menu input".split()
)
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html "
    "legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption".split()
)
CLOSES_P = BLOCK - frozenset("td th tr tbody thead tfoot html body caption legend summary".split())
CONTAINER = frozenset("article main section div td body html".split())
SAME_KIND = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"}, "option": {"select"}}

#: Words of class, id and role that name page furniture.
FURNITURE = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion nav navbar navigation menu menubar breadcrumb breadcrumbs sidebar "
    "sidenav rail footer masthead topbar toolbar cookie cookies consent gdpr notice alert popup modal overlay newsletter subscribe subscription signup login comment comments "
    "commentlist disqus discussion reply replies respond share sharing social related recommended recommendations pagination pager search widget skip hidden contentinfo "
    "complementary tracking popular trending copyright legal".split()
)
_ABOUT = frozenset("no with without has".split())
_HEADER = frozenset("header pageheader siteheader".split())

# Possessive throughout: a tag that does not close is given up at once.
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)"
    r"|<(?P<close>/?)(?P<name>[a-zA-Z][^\s/>]*+)(?:(?P<attrs>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|(?P<attrs2>[^>]*+)>)",
    re.S,
)
#: Elements nested deeper than this are not opened (as in browsers); their text counts for the element around them.
#: Those that are cut are opened to twice the depth, where all around them is cut.
MAX_DEPTH = 400
_BROKEN = re.compile(r"<[!/?a-zA-Z]")
_ATTR = re.compile(r"""([a-zA-Z-]+)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)|(?<=\s)(hidden)(?=[\s/]|$)""")
_WORDS = re.compile(r"[a-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


def _is_furniture(attrs: str, in_article: bool) -> bool:
    if not attrs:
        return False
    for key, value, bare in _ATTR.findall(attrs):
        if bare:
            return True
        key, value = key.lower(), value.strip("\"'")
        if key in ("class", "id", "role"):
            found = _WORDS.findall(_CAMEL.sub(" ", value).lower())
            # "no-sidebar", "with-comments" and the like describe what is around.
            words = {w for before, w in zip(["", *found], found, strict=False) if before not in _ABOUT}
            if words & FURNITURE or (not in_article and words & _HEADER):
                return True
        elif key == "aria-hidden" and value.lower() == "true" or key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return True
    return False


class Page:
    """A parsed page: parallel lists over nodes, and the texts and block edges in page order."""

    def __init__(self, source: str) -> None:
        self.tag, self.parent, self.cut, self.in_article = ["#root"], [-1], [False], [False]
        self.parts: list[tuple[int, str | None]] = []  # (node, text); None: an edge between blocks
        stack = [0]
        at, end = 0, len(source)
        last = source.rfind(">")
        while at < end:
            m = _TOKEN.search(source, at) if at <= last else None
            if m is None:  # what is left has no whole tag; a tag or comment that the page breaks off is not text
                self._text(stack[-1], _BROKEN.split(source[at:], maxsplit=1)[0])
                break
            if m.start() > at:
                self._text(stack[-1], source[at : m.start()])
            at = m.end()
            name = (m["name"] or "").lower()
            if not name:
                continue
            if m["close"]:
                self._close(stack, name)
                continue
            attrs = m["attrs"] or m["attrs2"] or ""
            node = self._open(stack, name, attrs)
            if name in RAW:
                close = re.compile(rf"</{name}(?=[\s/>])[^>]*>", re.I).search(source, at)
                at = close.end() if close else end
            elif name not in VOID and not attrs.endswith("/") and (len(stack) < MAX_DEPTH or (self.cut[node] and len(stack) < 2 * MAX_DEPTH)):
                stack.append(node)

    def _text(self, node: int, text: str) -> None:
        if not self.cut[node]:
            self.parts.append((node, html.unescape(text) if "&" in text else text))

    def _open(self, stack: list[int], name: str, attrs: str) -> int:
        if name in CLOSES_P:
            self._close_within(stack, {"p"}, {"table", "button", "td", "th", "li", "div", "article", "section", "blockquote"})
        if name in SAME_KIND:
            self._close_within(stack, SAME_KIND[name], SCOPE[name])
        up = stack[-1]
        if name in BLOCK:
            self.parts.append((up, None))
        elif name == "br":
            self.parts.append((up, " "))
        in_article = self.in_article[up]
        gone = self.cut[up] or name in CUT or (name == "header" and not in_article) or (name not in ("html", "body", "article", "main") and _is_furniture(attrs, in_article))
        self.tag.append(name)
        self.parent.append(up)
        self.cut.append(gone)
        self.in_article.append(in_article or name in ("article", "main"))
        return len(self.tag) - 1

    def _close_within(self, stack: list[int], names: set[str], until: set[str]) -> None:
        """Close the innermost open element of ``names`` unless one of ``until`` stands above it."""
        for k in range(len(stack) - 1, 0, -1):
            tag = self.tag[stack[k]]
            if tag in names:
                self._pop(stack, k)
                return
            if tag in until:
                return

    def _close(self, stack: list[int], name: str) -> None:
        for k in range(len(stack) - 1, 0, -1):
            if self.tag[stack[k]] == name:
                self._pop(stack, k)
                return
            if name not in BLOCK and self.tag[stack[k]] in BLOCK:
                return  # an inline end tag does not close blocks
        if name == "p":
            self.parts.append((stack[-1], None))

    def _pop(self, stack: list[int], k: int) -> None:
        for i in stack[k:]:
            if self.tag[i] in BLOCK:
                self.parts.append((self.parent[i], None))
        del stack[k:]

    def densities(self) -> tuple[list[int], list[int], list[float]]:
        """(characters, link characters, density) of every node."""
        n = len(self.tag)
        chars, tags, link_chars, link_tags = [0] * n, [0] * n, [0] * n, [0] * n
        in_link = [False] * n
        for i in range(1, n):
            in_link[i] = in_link[self.parent[i]] or self.tag[i] == "a"
        for node, text in self.parts:
            if text:
                size = len("".join(text.split()))
                chars[node] += size
                if in_link[node]:
                    link_chars[node] += size
        for i in range(n - 1, 0, -1):
            if self.cut[i]:
                continue
            up = self.parent[i]
            chars[up] += chars[i]
            link_chars[up] += link_chars[i]
            tags[up] += tags[i] + 1
            link_tags[up] += link_tags[i] + (self.tag[i] in ("a", "button", "select"))
        whole = link_chars[0] / max(1, chars[0])
        density = [0.0] * n
        for i in range(n):
            c, t, lc, lt = chars[i], max(1, tags[i]), link_chars[i], link_tags[i]
            if c and not self.cut[i]:
                base = math.log(c * lc / max(1, c - lc) + whole * c + math.e)
                ratio = (c / max(1, lc)) * (t / max(1, lt))
                density[i] = c / t * max(0.0, math.log(ratio) / math.log(base) if base > 1.000001 else math.log(ratio)) if ratio > 1 else 0.0
        return chars, link_chars, density

    def article(self) -> tuple[int, set[int]]:
        """(root of the main text, nodes within it that are link lists or too sparse)."""
        chars, link_chars, density = self.densities()
        n = len(self.tag)
        score, has_children = [0.0] * n, [False] * n
        for i in range(1, n):
            if not self.cut[i]:
                score[self.parent[i]] += density[i]
                has_children[self.parent[i]] = True
        for i in range(n):
            if not has_children[i]:
                score[i] = density[i]
        body = next((i for i in range(n) if self.tag[i] == "body"), 0)
        inside = [False] * n
        for i in range(n):
            inside[i] = i == body or (i > 0 and inside[self.parent[i]])
        best = max((i for i in range(n) if inside[i] and not self.cut[i]), key=lambda i: (score[i], -i))
        path = [best]
        while path[-1] not in (body, 0):
            path.append(self.parent[path[-1]])
        threshold = min(density[i] for i in path)
        # The outermost article on the path, else the nearest container and, up to main or the body, what else its ancestors hold that is as dense.
        root = next((i for i in reversed(path) if self.tag[i] == "article"), None)
        sparse: set[int] = set()
        if root is None:
            root = next((i for i in path if self.tag[i] in CONTAINER), body)
            inner, top = root, next((i for i in reversed(path) if self.tag[i] == "main"), body)
            above = set(path[path.index(inner) + 1 : path.index(top) + 1]) if top in path and path.index(top) > path.index(inner) else set()
            on_path = set(path)
            for i in range(1, n):
                if self.parent[i] in above and i not in on_path and density[i] < threshold:
                    # Inline elements belong to the text around them, unless they are links.
                    if self.tag[i] in BLOCK or link_chars[i] >= 0.8 * chars[i]:
                        sparse.add(i)
            root = top if above else inner
        lists = {i for i in range(n) if self.tag[i] in ("ul", "ol", "div", "p", "section", "table") and chars[i] and link_chars[i] >= 0.8 * chars[i] and density[i] < threshold}
        return root, lists | sparse

    def text(self) -> str:
        if not any(t and not t.isspace() for _, t in self.parts):
            return ""
        root, lists = self.article()
        n = len(self.tag)
        keep = [False] * n
        for i in range(n):
            keep[i] = not self.cut[i] and (i == root or (i > 0 and keep[self.parent[i]] and i not in lists))
        blocks: list[str] = []
        run: list[str] = []
        for node, text in [*self.parts, (0, None)]:
            if text is None:
                if run:
                    if block := " ".join("".join(run).split()):
                        blocks.append(block)
                    run = []
            elif keep[node]:
                run.append(text)
        return "\n\n".join(blocks)


def main_text(source: str | None) -> str:
    return Page(source).text() if source else ""


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) of every row; no shuffle."""
    arrow = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 500):
                part = batch.slice(a, 500)
                texts = [main_text(x.as_py()) for x in part.column(2)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], schema=arrow)

    return pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html")).mapInArrow(tidy(run), "page_id long, url string, text string, n_chars long")
