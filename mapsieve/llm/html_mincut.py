"""Main-text extraction by minimum-cut labelling of a page's blocks.

A page is cut into blocks: runs of text between block-level tags, outside scripts, styles and the
like.  A logistic classifier over textual features, with the marks of its elements, gives each block a
log-odds of being content; it becomes the block's capacity to the source or to the sink.  Neighbouring blocks
are joined by smoothness edges, stronger where they share their container, and a block is joined
to the previous block of its container across what stands between (DOM proximity).  Maximum flow
separates content from boilerplate.  Blocks whose capacity exceeds all their edges are settled
beforehand; they act on the rest as terminals, which leaves the minimum cut as it is.

The classifier is trained here, on SAMPLE_PAGES pages at most, from what the text of a block looks
like: its length, words, sentence end, links, its element, its neighbours and its place in the page.
The labels come from elsewhere, the marks of the pages: blocks within article or main are content,
those within navigation, footers, asides, forms and elements named for such use are not, and others
give no label.  No mark is a feature, so the weights hold on pages without marks too.  Where a
sample lacks one of the labels, PRIOR holds.  A block's own marks add their odds (MARK_ODDS, a
parameter) to what its text says.

Pages are scanned in linear time, whatever is left unclosed.

Defined results: a null or empty html gives an empty text; br is white space; unclosed tags end
with their container; a < without a later > is text; numeric references that name no character
become U+FFFD; pages are judged one by one, whole, however long, so repeated rows get equal answers;
page_id and url are returned as they are; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import deque
from html import unescape

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SAMPLE_PAGES = 1000
ADJACENT, SAME_PARENT, PROXIMITY = 0.5, 0.7, 0.6
MOST_ODDS = 6.0

#: Elements by their part in a page.
_RAW = frozenset({"script", "style", "noscript", "template", "iframe", "object", "svg", "math", "head", "textarea", "select", "canvas", "audio", "video", "title", "button"})
_BLOCK = frozenset({"p", "div", "h1", "h2", "h3", "h4", "h5", "h6", "li", "ul", "ol", "dl", "dt", "dd", "table", "thead", "tbody", "tfoot", "tr", "td", "th", "caption", "article", "section", "main", "header", "footer", "nav", "aside", "form", "fieldset", "blockquote", "pre", "figure", "figcaption", "address", "details", "summary", "dialog", "hr", "body", "html", "hgroup", "menu", "center", "legend", "option"})
_HOLDS = _BLOCK - {"p", "h1", "h2", "h3", "h4", "h5", "h6", "hr", "option", "html", "body"}
_APART = frozenset({"nav", "footer", "aside", "form", "menu", "dialog", "fieldset"})
_NAMED = re.compile(r"side-?bar|advert(?!ent)|cookie|newsletter|breadcrumb|sponsor|popup|footer|(?:^|[^a-z])(?:(?:user|reader)?comment(?:s|er|ers|list|form|box|area|thread|section|count|text|body)?|ads?|promo\w*|banner|consent|gdpr|notice\w*|alert|modal|overlay|subscri\w*|signup|repl(?:y|ies)|disqus|shar(?:e|ing)|social\w*|related|recommend\w*|widget\w*|menu\w*|nav|navbar|navigation|pagination|pager|masthead|toolbar|login|search\w*|copyright|legal|disclaimer)(?:$|[^a-z])")
_HEADER = re.compile(r"(?:^|[^a-z])(?:site-?|page-?|top-?)?header(?:$|[^a-z])")
_GOOD = re.compile(r"(?:^|[^a-z])(?:article\w*|main\w*|content\w*|post\w*|entry\w*|story\w*|body\w*)(?:$|[^a-z])")
_OPEN = re.compile(r"<(?:!--|!\[CDATA\[|[!?]|/?([a-zA-Z][^\s/>]*))")
_REST = re.compile(r"""(?:"[^"]*"|'[^']*'|[^>"'])*+>""")
_MARKS_OF_TAGS = re.compile("[\"'>]")
_CAMEL = re.compile(r"([a-z])([A-Z])")
_ZEROS, _HUGE = re.compile(r"&#([xX]?)0+(?=[0-9a-fA-F])"), re.compile(r"&#(?:[0-9]{8,}|[xX][0-9a-fA-F]{7,});?")
_ATTR = re.compile(r"""\b(class|id|role|style|hidden|aria-hidden)\b(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""", re.IGNORECASE)

FEATURES = ("link_share", "long", "sentence", "heading", "item", "words", "near_links", "near_long", "edge", "one")
PRIOR = np.array([-4.0, 1.2, 1.5, 0.2, -0.8, 0.8, -0.5, 0.3, -0.3, -1.0])
MARKS = ("content_root", "apart", "named_apart", "named_content")
MARK_ODDS = np.array([4.5, -6.5, -6.5, 1.5])


class Scanner:
    """The tags of a page in order.  The work is linear in the page, whatever is left open in it."""

    def __init__(self, html: str):
        self.html, self.at, self.last = html, 0, html.rfind(">")
        self.unclosed: set[str] = set()
        self.ends: tuple[list[int], list[int]] | None = None

    def next(self):
        """(text before, name, closing, attributes) of the next tag, name None for comments and the like; None with the rest as text at the end."""
        html, begin = self.html, self.at
        m = _OPEN.search(html, begin, self.last + 1)
        if m is None:
            self.at = len(html)
            return html[begin:], None, False, None
        text, name, end = html[begin : m.start()], m[1], m.end()
        if name is not None:
            self.at = self._end(end)
            return text, name.lower(), html[m.start() + 1] == "/", html[end : self.at]
        shut = "-->" if m[0] == "<!--" else "]]>" if m[0] == "<![CDATA[" else ">"
        found = html.find(shut, end)
        self.at = found + len(shut) if found >= 0 else len(html)
        return text, None, False, ""

    def _end(self, at: int) -> int:
        """Where a tag ends: after the first > outside quotes, or the first > of all where quotes stay open (one stands before the page's last >)."""
        if self.ends is None:
            m = _REST.match(self.html, at)
            if m:
                return m.end()
            self._index()
        places, ends = self.ends
        found = ends[bisect_left(places, at)]
        return found if found >= 0 else self.html.find(">", at) + 1

    def _index(self) -> None:
        """For every quote mark and >: the end of a tag whose next such mark it is (-1: none)."""
        places = [m.start() for m in _MARKS_OF_TAGS.finditer(self.html)]
        ends, later = [-1] * (len(places) + 1), {}
        for i in range(len(places) - 1, -1, -1):
            mark = self.html[places[i]]
            if mark == ">":
                ends[i] = places[i] + 1
            else:
                ends[i] = ends[later[mark] + 1] if mark in later else -1
                later[mark] = i
        self.ends = places, ends

    def skip(self, name: str, to_end: bool) -> None:
        """Go behind the closing tag of a raw element; without one stay, or go to the page's end."""
        end = None
        if name not in self.unclosed:
            end = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*>", re.IGNORECASE).search(self.html, self.at, self.last + 1)
            if end is None:
                self.unclosed.add(name)
        if end is not None:
            self.at = end.end()
        elif to_end:
            self.at = len(self.html)


def decoded(text: str) -> str:
    """Character references decoded, white space turned into one space each, trimmed."""
    if "&#" in text:
        text = _HUGE.sub("\ufffd", _ZEROS.sub(r"&#\1", text))
    return " ".join(unescape(text).split())


class Block:
    __slots__ = ("text", "root", "apart", "named", "good", "links", "tag", "parent")

    def __init__(self, text, root, apart, named, good, links, tag, parent):
        self.text, self.root, self.apart, self.named, self.good, self.links, self.tag, self.parent = text, root, apart, named, good, links, tag, parent


def blocks(html: str) -> list[Block]:
    """The blocks of a page in page order."""
    out: list[Block] = []
    held: list[str] = []
    # (tag, content root, apart, named apart, named content, number): what holds within the element
    stack = [("", False, False, False, False, 0)]
    number, links, in_link, tag = 0, 0, 0, ""
    open_names: dict[str, int] = {}
    own = (False, False)  # of the open paragraph or heading: named apart, named content

    def flush():
        nonlocal links
        if held:
            text = decoded("".join(held))
            held.clear()
            if text:
                _, root, apart, named, good, parent = stack[-1]
                out.append(Block(text, root, apart, named or own[0], good or own[1], min(1.0, links / len(text)), tag, parent))
        links = 0

    scanner = Scanner(html)
    while True:
        text, name, closing, attributes = scanner.next()
        if text:
            held.append(text)
            if in_link:
                links += len(text.strip())
        if attributes is None:
            break
        if name is None:
            continue
        if name in _RAW:
            if not closing and not attributes.endswith("/>"):
                scanner.skip(name, name in ("script", "style"))
            held.append(" ")
        elif name == "a":
            in_link = 0 if closing else 1
        elif name == "br":
            held.append(" ")
        elif name in _BLOCK:
            flush()
            tag, own = "" if closing else name, (False, False)
            words = "" if closing or len(attributes) < 2 else _names(attributes)
            if name not in _HOLDS:
                if words and name not in ("html", "body"):
                    own = (bool(_NAMED.search(words)), bool(_GOOD.search(words)))
            elif closing:
                if open_names.get(name):
                    while True:
                        shut = stack.pop()[0]
                        open_names[shut] -= 1
                        if shut == name:
                            break
                in_link = 0
            else:
                number += 1
                open_names[name] = open_names.get(name, 0) + 1
                _, root, apart, named, good, _ = stack[-1]
                if words and name not in ("article", "main"):
                    named = named or bool(_NAMED.search(words)) or (not root and bool(_HEADER.search(words)))
                good = good or bool(words and _GOOD.search(words))
                stack.append((name, root or name in ("article", "main") or " role=main" in words, apart or name in _APART or (name == "header" and not root), named, good, number))
    flush()
    return out


def _names(attributes: str) -> str:
    """Class, id and role of a tag, lower-cased; popup stands for what is hidden."""
    words = ""
    for key, value in _ATTR.findall(attributes):
        key, value = key.lower(), _CAMEL.sub(r"\1-\2", value.strip("\"'")).lower()
        if key in ("class", "id"):
            words += " " + value
        elif key == "role":
            words += f" role={value} {value}"
        elif key == "style":
            words += " popup" if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value) else ""
        elif key == "hidden" or value == "true":
            words += " popup"
    return words


def features(page: list[Block]) -> np.ndarray:
    """What the text of each block looks like, beside its neighbours; no marks."""
    rows = np.zeros((len(page), len(FEATURES)))
    for i, b in enumerate(page):
        n = len(b.text)
        rows[i, :6] = (b.links, min(n, 400) / 200, b.text[-1] in ".!?…:;\"”»" and n > 20, b.tag[:1] == "h" and b.tag[1:].isdigit(), b.tag in ("li", "td", "th", "dt", "option"), min(b.text.count(" "), 20) / 10)
    for column, own in ((6, 0), (7, 1)):
        rows[1:, column] += rows[:-1, own] / 2
        rows[:-1, column] += rows[1:, own] / 2
    rows[:, 8] = np.maximum(0, 1 - 5 * np.minimum(np.arange(len(page)), np.arange(len(page))[::-1]) / max(1, len(page)))
    rows[:, 9] = 1.0
    return rows


def marks(page: list[Block]) -> np.ndarray:
    """The marks of each block's elements."""
    return np.array([(b.root and not b.apart and not b.named, b.apart, b.named, b.good) for b in page], dtype=float).reshape(-1, len(MARKS))


def own_label(b: Block) -> int:
    """1 content, 0 boilerplate, -1 unknown, by the marks of the page itself."""
    return 0 if b.apart or b.named else 1 if b.root else -1


def train(rows: np.ndarray, labels: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Weights of a ridge logistic regression about PRIOR, by Newton steps."""
    if not (labels == 0).any() or not (labels == 1).any():
        return PRIOR.copy()
    share = np.where(labels == 1, 0.5 / (labels == 1).mean(), 0.5 / (labels == 0).mean())
    share *= min(len(labels), 2000) / len(labels)
    w = PRIOR.copy()
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(rows @ w, -30, 30)))
        grad = rows.T @ (share * (p - labels)) + ridge * (w - PRIOR)
        step = np.linalg.solve((rows * (share * p * (1 - p))[:, None]).T @ rows + ridge * np.eye(len(w)), grad)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def edges(page: list[Block]) -> list[tuple[int, int, float]]:
    out, last = [], {}
    for i, b in enumerate(page):
        if i:
            out.append((i - 1, i, SAME_PARENT if page[i - 1].parent == b.parent else ADJACENT))
        before = last.get(b.parent)
        if before is not None and before != i - 1:
            out.append((before, i, PROXIMITY))
        last[b.parent] = i
    return out


def min_cut(odds: list[float], links: list[tuple[int, int, float]]) -> list[bool]:
    """Source side of the minimum cut of: source -> i with odds, i -> sink with -odds, and links both ways."""
    n = len(odds)
    near: list[list[tuple[int, float]]] = [[] for _ in range(n)]
    for a, b, w in links:
        near[a].append((b, w))
        near[b].append((a, w))
    side: list[bool | None] = [None] * n
    odds = list(odds)
    # a node whose terminal outweighs its edges is on that terminal's side in every minimum cut
    weak = [sum(w for _, w in e) for e in near]
    todo = deque(i for i in range(n) if abs(odds[i]) > weak[i])
    while todo:
        i = todo.popleft()
        if side[i] is not None:
            continue
        side[i] = odds[i] > 0
        for j, w in near[i]:
            if side[j] is None:
                odds[j] += w if side[i] else -w
                weak[j] -= w
                if abs(odds[j]) > weak[j]:
                    todo.append(j)
    left = [i for i in range(n) if side[i] is None]
    if left:
        index = {v: k for k, v in enumerate(left)}
        for v, on in zip(left, max_flow([odds[v] for v in left], [(index[a], index[b], w) for a, b, w in links if side[a] is None and side[b] is None]), strict=True):
            side[v] = on
    return [bool(x) for x in side]


def max_flow(odds: list[float], links: list[tuple[int, int, float]]) -> list[bool]:
    """Nodes that the source reaches after Dinic's maximum flow."""
    n = len(odds)
    s, t = n, n + 1
    graph: list[list[int]] = [[] for _ in range(n + 2)]
    to, room = [], []

    def add(a, b, there, back):
        graph[a].append(len(to))
        to.append(b)
        room.append(there)
        graph[b].append(len(to))
        to.append(a)
        room.append(back)

    for i, x in enumerate(odds):
        if x > 0:
            add(s, i, x, 0.0)
        elif x < 0:
            add(i, t, -x, 0.0)
    for a, b, w in links:
        add(a, b, w, w)
    tiny = 1e-9
    while True:
        level = [-1] * (n + 2)
        level[s] = 0
        queue = deque([s])
        while queue:
            v = queue.popleft()
            for e in graph[v]:
                if room[e] > tiny and level[to[e]] < 0:
                    level[to[e]] = level[v] + 1
                    queue.append(to[e])
        if level[t] < 0:
            return [level[i] >= 0 for i in range(n)]
        turn = [0] * (n + 2)
        path: list[int] = []
        v = s
        while True:
            if v == t:
                push = min(room[e] for e in path)
                for e in path:
                    room[e] -= push
                    room[e ^ 1] += push
                path, v = [], s
                continue
            while turn[v] < len(graph[v]):
                e = graph[v][turn[v]]
                if room[e] > tiny and level[to[e]] == level[v] + 1:
                    break
                turn[v] += 1
            else:
                if v == s:
                    break
                e = path.pop()
                v = to[e ^ 1]
                turn[v] += 1
                continue
            path.append(e)
            v = to[e]


def main_text(html: str | None, weights: np.ndarray) -> str:
    page = blocks(html or "")
    if not page:
        return ""
    odds = np.clip(features(page) @ weights + marks(page) @ MARK_ODDS, -MOST_ODDS, MOST_ODDS)
    keep = min_cut(odds.tolist(), edges(page))
    return "\n\n".join(b.text for b, k in zip(page, keep, strict=True) if k)


def fitted(pages: DataFrame) -> np.ndarray:
    """Classifier weights from at most SAMPLE_PAGES pages, the first by the hash of their id; of pages with one id the least html counts."""
    ids = [r.page_id for r in pages.filter(F.col("page_id").isNotNull()).select("page_id").distinct().orderBy(F.xxhash64("page_id"), "page_id").limit(SAMPLE_PAGES).collect()]

    def run(batches):
        for batch in batches:
            for html in batch["html"]:
                page = blocks(html or "")
                labels = [own_label(b) for b in page]
                rows = [(*x, float(y)) for x, y in zip(features(page).tolist(), labels, strict=True) if y >= 0]
                yield pd.DataFrame({"x": [x for r in rows for x in r]})

    sample = pages.filter(F.col("page_id").isin(ids)).groupBy("page_id").agg(F.min(F.col("html").cast("string")).alias("html")).select("html") if ids else None
    got = sample.mapInPandas(run, "x double").toPandas()["x"].to_numpy() if ids else np.zeros(0)
    got = got.reshape(-1, len(FEATURES) + 1)
    # collected rows come in any order; sums of floating-point numbers must not depend on it
    got = got[np.lexsort(got.T)]
    return train(got[:, :-1], got[:, -1])


def extract(pages: DataFrame, weights: np.ndarray | None = None) -> DataFrame:
    """(page_id, url, text, n_chars) of every row of (page_id, url, html)."""
    w = fitted(pages) if weights is None else weights

    def run(batches):
        for batch in batches:
            text = [main_text(html, w) for html in batch["html"]]
            yield pd.DataFrame({"page_id": batch["page_id"], "url": batch["url"], "text": text, "n_chars": [len(x) for x in text]})

    kinds = dict(pages.dtypes)
    return pages.select("page_id", "url", F.col("html").cast("string").alias("html")).mapInPandas(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")
