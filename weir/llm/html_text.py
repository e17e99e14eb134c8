"""Main text of web pages by composite text density.

Each DOM node gets its characters per tag, adjusted for links; a node's children's densities are summed, and the subtree
with the largest sum is the main text. Parts beside it count too if they are at least as dense as the least dense node
on the path from it to the body; outside an article only parts with articles count, which may have as much text per tag
instead. Blocks that are mostly links are no text wherever they stand. Menus, notices and the like, which say by tag, or
by a whole name of their role or class, what they are, are taken out before densities are computed, but for nodes marked
by role or class that hold the bulk of the page's own text.

A page is read once, whatever is broken in it: work grows in proportion with its length.
"""

from __future__ import annotations

import html
import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Names of HTML elements, by what they do.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp noscript template iframe".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img".split())
DROPPED = frozenset("nav footer aside form button select fieldset dialog menu head svg math canvas audio video object noscript template iframe script style textarea title".split())
ENDS_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
ENDS_SAME = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
# Words in a class, id or role that mark what is not the article.
MARKS = frozenset("ad ads advert adverts advertisement advertising adsense banner breadcrumb breadcrumbs comment comments consent contentinfo cookie cookies disqus footer feedback gdpr masthead menu modal nav navbar navigation navigationmenu newsletter notice overlay pager pagination popup promo promoted promotion recommend reactions recommended related remarks reply replies respond responses search share sharing sidebar signup social sponsor sponsored subscribe subscription toolbar widget widgets".split())
# Of these, names of what readers write: a class that is just one of them is never the article, however long.
READERS = frozenset("comment comments disqus feedback reactions remarks reply replies respond responses".split())
# Words that may stand beside them in a name that still says just that.
BESIDE = frozenset("area article bar block blog bottom box container cookie form group header holder inner item left list main outer page panel post posts reader readers right section site social story theme thread top user users wrap wrapper".split())
WHOLE = frozenset("html body main article p h1 h2 h3 h4 h5 h6 b i em strong span a li td".split())

_NAME = re.compile(r"[a-zA-Z][a-zA-Z0-9:-]*")
_STOP = re.compile(r"[>\"']")
_NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
#: Links that a block needs to count as a list of links, and the share of its characters in them.
LINKS, LINKED = 3, 2 / 3


def _tokens(source: str, onward: list[int]):
    """(text before, kind, tag, attributes, end): kind is "open", "close" or "" (comments, declarations). A quote that is
    never closed is none, and from there on tags end at the next ">". The next token is looked for from onward[0] on."""
    at = start = 0
    strict, n = True, len(source)
    while (lt := source.find("<", at)) >= 0:
        kind = tag = attributes = ""
        if source.startswith("<!--", lt):
            end = source.find("-->", lt + 4)
            end = end + 3 if end >= 0 else n
        elif source[lt + 1 : lt + 2] in ("!", "?"):
            end = source.find(">", lt) + 1
        else:
            close = source.startswith("/", lt + 1)
            m = _NAME.match(source, lt + 1 + close)
            if not m:
                at = lt + 1
                continue
            end = at = m.end()
            while strict and (stop := _STOP.search(source, at)):
                if stop[0] == ">":
                    end = stop.end()
                    break
                at = source.find(stop[0], stop.end()) + 1
                if not at:
                    strict = False
            else:
                strict, end = False, source.find(">", end) + 1
            kind, tag, attributes = "close" if close else "open", m[0].lower(), source[m.end() : end - 1]
        if not end:  # nothing ends any more
            break
        yield source[start:lt], kind, tag, attributes, end
        at = start = max(end, onward[0])
    yield source[start:], "", "", "", n


class _Page:
    """Nodes of a page in document order, and its text runs as (node, block, text)."""

    def __init__(self, source: str):
        self.tag, self.parent, self.gone, self.marked, self.runs = ["#root"], [-1], [False], [""], []
        self.stack: list[int] = [0]
        self.open: dict[str, list[int]] = {}  # places in the stack by tag
        block, n, endless = 0, len(source), set()
        onward = [0]
        for text, kind, tag, attributes, at in _tokens(source, onward):
            top = self.stack[-1]
            if text and not self.gone[top]:
                self.runs.append((top, block, text))
            if kind == "close":
                if self.open.get(tag):
                    self._close(self.open[tag][-1])
                block += tag not in INLINE
            elif kind == "open":
                if tag == "br":
                    self.runs.append((top, block, " "))
                block += tag not in INLINE and tag != "br"
                if tag in ENDS_P:
                    self._end(("p",), ("article", "section", "div", "body", "td", "li"))
                if tag in ENDS_SAME:
                    self._end(ENDS_SAME[tag], ("ul", "ol", "dl", "table", "select"))
                top = self.stack[-1]
                self.tag.append(tag)
                self.parent.append(top)
                self.gone.append(self.gone[top] or self._boilerplate(tag))
                self.marked.append(self._mark(tag, attributes))
                if tag in RAW:
                    end = None if tag in endless else re.compile(rf"</{tag}\b[^>]*>", re.I).search(source, at)
                    if end or tag != "noscript":
                        onward[0] = end.end() if end else n
                    else:
                        endless.add(tag)
                elif tag not in VOID and not attributes.endswith("/"):
                    self.open.setdefault(tag, []).append(len(self.stack))
                    self.stack.append(len(self.tag) - 1)

    def _close(self, place: int) -> None:
        """Everything from this place in the stack on is closed."""
        for node in self.stack[place:]:
            self.open[self.tag[node]].pop()
        del self.stack[place:]

    def _end(self, tags: tuple[str, ...], within: tuple[str, ...]) -> None:
        bound = max((self.open[t][-1] for t in within if self.open.get(t)), default=0)
        inside = [self.open[t][-1] for t in tags if self.open.get(t) and self.open[t][-1] > bound]
        if inside:
            self._close(min(inside))

    def _boilerplate(self, tag: str) -> bool:
        return tag in DROPPED or tag == "header" and not any(self.open.get(t) for t in ("article", "main"))

    def _mark(self, tag: str, attributes: str) -> str:
        """The name in class, id or role that says, as a whole, that the node is of MARKS, if any."""
        if tag not in WHOLE and attributes:
            for m in _NAMES.finditer(attributes):
                for name in (m[1] or m[2] or m[3] or "").split():
                    words = [w.lower() for w in _WORDS.findall(name)]
                    if any(w in MARKS for w in words) and all(w in MARKS or w in BESIDE for w in words):
                        return " ".join(words)
        return ""

    def drop_marked(self) -> None:
        """Marked nodes go, with what is in them, unless they hold over half of the page's text outside links."""
        if not any(self.marked):
            return
        n = len(self.tag)
        linked, plain, articles = [False] * n, [0] * n, [0] * n
        for x in range(1, n):
            linked[x] = linked[self.parent[x]] or self.tag[x] == "a"
        for node, _, text in self.runs:
            plain[node] += 0 if linked[node] else len(" ".join(text.split()))
        for x in range(n - 1, 0, -1):
            articles[x] += not self.gone[x] and plain[x] > 0 and self.tag[x] in ("article", "main")
            plain[self.parent[x]] += plain[x]
            articles[self.parent[x]] += articles[x]
        around = [0] * n  # articles that the node stands in
        for x in range(1, n):
            up = self.parent[x]
            around[x] = around[up] + (self.tag[x] in ("article", "main") and not self.gone[x] and plain[x] > 0)
            if self.gone[up]:
                self.gone[x] = True
            elif self.marked[x]:
                bulk = 2 * plain[x] > plain[0] and articles[x] + around[up] == articles[0]
                self.gone[x] = self.gone[x] or not bulk or any(w in READERS for w in self.marked[x].split())
        self.runs = [r for r in self.runs if not self.gone[r[0]]]


def densities(page: _Page):
    """(chars, tags, link_chars, link_tags, body, density, sums, own) of each node: its density is the logarithm-adjusted
    characters per tag of its subtree, sums add up its children's densities, own counts text that is no block's."""
    n = len(page.tag)
    chars, tags, link_chars, link_tags = [0] * n, [0] * n, [0] * n, [0] * n
    in_link = [False] * n
    for x in range(1, n):
        in_link[x] = in_link[page.parent[x]] or page.tag[x] == "a"
        link_tags[x] = int(page.tag[x] == "a")
    for node, _, text in page.runs:
        size = len(" ".join(text.split()))
        chars[node] += size
        link_chars[node] += size * in_link[node]
    for x in range(n - 1, 0, -1):
        up = page.parent[x]
        if not page.gone[x]:
            chars[up] += chars[x]
            tags[up] += tags[x] + 1
            link_chars[up] += link_chars[x]
            link_tags[up] += link_tags[x]
    body = next((x for x in range(n) if page.tag[x] == "body"), 0)
    if not chars[body]:
        body = 0
    ratio = link_chars[body] / max(1, chars[body])
    density = [0.0] * n
    for x in range(n):
        if chars[x] and not page.gone[x]:
            c, lc, t, lt = chars[x], link_chars[x] or 1, tags[x] or 1, link_tags[x] or 1
            plain = max(1, c - link_chars[x])
            base = math.log(c / plain * link_chars[x] + ratio * c + math.e)
            density[x] = c / t * math.log(max(c * t / (lc * lt), 1.0000001)) / math.log(max(base, 1.0000001)) if base > 1 else c / t * math.log(max(c * t / (lc * lt), 1.0000001))
    sums = [0.0] * n
    for x in range(n - 1, 0, -1):
        if not page.gone[x]:  # inline tags are part of their block, which bold print doesn't split
            sums[page.parent[x]] += sums[x] if page.tag[x] in INLINE else density[x]
    # a node's own text, inline tags included, counts like a child of it
    own = [0] * n
    for node, _, text in page.runs:
        own[node] += len(" ".join(text.split()))
    for x in range(n - 1, 0, -1):
        own[page.parent[x]] += own[x] if page.tag[x] in INLINE else 0
    return chars, tags, link_chars, link_tags, body, density, sums, own


def main_text(source: str | None) -> str:
    """The article's blocks, white space in a block made one blank, joined by two \\n; empty for null and empty pages."""
    if not source:
        return ""
    page = _Page(source)
    page.drop_marked()
    n = len(page.tag)
    chars, tags, link_chars, link_tags, body, density, sums, own = densities(page)
    if not chars[body]:
        return ""
    best = max((x for x in range(n) if not page.gone[x] and chars[x] and page.tag[x] not in INLINE), key=lambda x: (sums[x] + density[x] * own[x] / chars[x], -x))
    path = [best]
    while path[-1] not in (body, 0):
        path.append(page.parent[path[-1]])
    threshold = min(density[x] for x in path)
    article = next((x for x in reversed(path) if page.tag[x] == "article"), None)
    holds = [page.tag[x] == "article" and not page.gone[x] for x in range(n)]
    for x in range(n - 1, 0, -1):
        holds[page.parent[x]] = holds[page.parent[x]] or holds[x]
    on_path = set(path)
    at = {x: k for k, x in enumerate(path)}
    outside = at[article] if article is not None else len(path)
    # composite densities grow with a part's size: an article beside the path is held to its text per tag, too
    rate = [(chars[x] - link_chars[x]) / (tags[x] or 1) for x in range(n)]
    least_rate = min(rate[x] for x in path)
    chosen = {best}
    for y in range(1, n):
        k = at.get(page.parent[y], 0)
        if k and y not in on_path and not page.gone[y]:
            if density[y] >= threshold and k <= outside or holds[y] and (density[y] >= threshold or rate[y] >= least_rate):
                chosen.add(y)
    listed = [link_tags[x] >= LINKS and link_chars[x] >= LINKED * chars[x] and page.tag[x] not in INLINE for x in range(n)]
    inside = [False] * n
    for x in range(n):
        up = inside[page.parent[x]] and (not listed[x] or listed[best]) if x else False
        inside[x] = (x in chosen or up) and not page.gone[x]
    blocks: dict[int, list[str]] = {}
    for node, block, text in page.runs:
        if inside[node]:
            blocks.setdefault(block, []).append(text)
    out = (" ".join(html.unescape("".join(b)).split()) for b in blocks.values())
    return "\n\n".join(x for x in out if x)


def extract_text(pages: DataFrame, html_col: str = "html", id_cols: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """The id columns, text and n_chars of every row of pages: null and empty pages have an empty text, repeated rows a
    row each, and a page's whole source counts."""
    own = pages.select(*id_cols, F.col(html_col).cast("string").alias("_html"))
    keep = own.drop("_html").schema
    names = [*keep.names, "text", "n_chars"]

    def f(batches):
        for b in batches:
            texts = [main_text(x) for x in b.column(b.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names)

    return own.mapInArrow(f, keep.add("text", "string").add("n_chars", "long"))
