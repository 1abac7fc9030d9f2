"""Main text of HTML pages by minimum-cut labelling.

A tolerant scanner turns a page into blocks of text with their open elements. A log-linear classifier gives each block the cost
of being content and of being boilerplate; these are the capacities from the source and to the sink. Neighbouring blocks, and
blocks near each other in the tree, are joined by smoothness edges. A maximum flow separates content from boilerplate at the
least total cost. Blocks whose own costs outweigh all their edges are settled beforehand, which changes no minimum cut. What
open elements tell is summed as they open, so that the time grows with the page's length and not with its depth.

Words of class and id count by element and by place: those of html, body and main say nothing against what is in them, nor do
those of an article that names itself content too (a comment may be an article); words after has-, no-, with- or without- say
nothing at all, and weak words (legal, tags and the like) tell boilerplate only outside an article. A name tells what it ends
in, words of layout aside (sidebar-left, cookie-banner): a word that only describes another (share-price, promotion-review) is a
hint, which an article's text outweighs. A header of something (news-header) belongs to it. The more of a page's text stands in
article or main elements, the more a block outside them needs to be content; where there are none, plain text is content.

Defined cases: a null or empty page, or one without content, gives an empty text; broken, unclosed or cut-off markup is read as
far as it goes; texts of any length are read whole; a null page_id or url passes through; repeated rows give equal rows; an
empty table gives an empty result; only page_id, url and html are read, so other columns cannot clash.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections import deque

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import read_table

#: Element names.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
OPAQUE = frozenset("script style title textarea noscript template iframe object svg math canvas audio video select datalist head".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br".split())
CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPES = frozenset("article section div main body ul ol dl table blockquote aside nav header footer form td th".split())

#: Log odds of content for elements, roles and words of class and id.
ELEMENT = {"article": 3.0, "main": 2.5, "p": 0.8, "blockquote": 0.4, "pre": 0.5, "h1": 0.8, "h2": 0.5, "h3": 0.4, "nav": -7.0, "header": -3.5, "footer": -6.0, "aside": -6.0, "form": -6.0, "button": -6.0, "menu": -6.0, "dialog": -6.0, "fieldset": -4.0, "label": -2.0, "address": -2.0}
ROLE = {"main": 2.5, "article": 3.0, "navigation": -7.0, "banner": -5.0, "contentinfo": -6.0, "complementary": -6.0, "search": -6.0, "dialog": -6.0, "alert": -5.0, "alertdialog": -6.0, "menu": -6.0, "menubar": -6.0, "form": -6.0}
BAD_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert nav navbar navigation menu menus breadcrumb breadcrumbs sidebar aside widget widgets footer bottombar header masthead topbar comment comments commentlist reply replies respond disqus share sharing social related recommended recommendations subscribe subscription newsletter signup login popup modal overlay pagination pager search form toolbar skip hidden".split()
)
WEAK_WORDS = frozenset("side rail foot discussion tags copyright legal disclaimer".split())
MODIFIERS = frozenset("has no with without not".split())
TAIL_WORDS = frozenset(  # words of layout, after which a name still means the word before
    "left right top bottom upper lower inner outer wrapper wrap container box area block section column col row list item items bar link links button buttons icon icons logo main primary secondary site global page panel body content text title heading label slot unit zone space group module region holder results result articles stories posts news media count thread policy overlay this inline mobile desktop fixed sticky small large".split()
)
SITE_WORDS = frozenset("site page main top global web app".split())  # whose header is the site's
PLAIN = frozenset("html body main".split())  # elements whose own words count for nothing bad
GOOD_WORDS = frozenset("article content main post entry story body text maincontent articlebody".split())
BAD, WEAK, HINT, GOOD = -7.0, -2.5, -1.0, 1.0
BIAS, OUTSIDE = -0.2, -3.0  # of any block; of one outside article and main, times their share of the page's text
OWN_HEADER = -0.5
ADJACENT, SIBLING = 0.6, 0.8  # smoothness of neighbours in page order, and of blocks in one parent
DECAY, FAR = 3.0, 64  # tree steps over which it falls, and beyond which it is nothing

TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)", re.S)
ATTR = re.compile(r"([^\s/>=]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?")  # all of them, so that no value is read as a name
SPLIT = re.compile(r"[^a-z0-9]+")
CAMEL = re.compile(r"(?<=[a-z0-9])(?=[A-Z])")


def _token(words: list[str]) -> float:
    """What a name of class or id, split into words, says against what it stands for."""
    cost = WEAK if WEAK_WORDS.intersection(words) else 0.0
    for i, w in enumerate(words):
        if w in BAD_WORDS:
            ends = all(x in TAIL_WORDS or x in BAD_WORDS or x[0].isdigit() for x in words[i + 1 :])
            own_header = w == "header" and i and words[0] not in SITE_WORDS and words[0] not in BAD_WORDS
            cost = min(cost, OWN_HEADER if own_header else BAD if ends else HINT)
    return cost


def _names(value: str) -> tuple[float, bool, bool]:
    """The worst that a class or id says, whether by a name of one word, and whether it names content."""
    cost, alone, good = 0.0, False, False
    for token in value.split():
        own = [w for w in SPLIT.split(CAMEL.sub(" ", token).lower()) if w]
        if own and own[0] not in MODIFIERS:
            c = _token(own)
            cost, alone, good = min(cost, c), alone or (c == BAD and len(own) == 1), good or not GOOD_WORDS.isdisjoint(own)
    return cost, alone, good


class Element:
    """An open element. against and for_ are the sums of what it and all around it say; of equal tags only the innermost speaks for."""

    __slots__ = ("tag", "parent", "depth", "odds", "hidden", "holder", "in_article", "in_main", "against", "for_")

    def __init__(self, tag: str, attrs: str, parent: Element | None, same: Element | None):
        """same: the innermost open element with this tag."""
        self.tag, self.parent = tag, parent
        self.depth = parent.depth + 1 if parent else 0
        self.hidden = bool(parent and parent.hidden)
        self.in_article = tag == "article" or bool(parent and parent.in_article)
        self.in_main = tag in ("article", "main") or bool(parent and parent.in_main)
        self.holder = parent.holder if parent and tag in INLINE else self
        own = ELEMENT.get(tag, 0.0)
        if tag == "header" and self.in_article:
            own = -0.5
        worst = 0.0
        for name, value in ATTR.findall(attrs) if attrs else ():
            name, value = name.lower(), value.strip("\"'")
            if name in ("class", "id"):
                if tag in ("html", "body"):  # of the whole page, so they tell no block from another
                    continue
                bad, alone, good = _names(value)
                if tag == "article" and bad == BAD and not alone:
                    bad = HINT
                if tag not in PLAIN and not (tag == "article" and good):
                    worst = min(worst, bad)
                    own -= max(0.0, ELEMENT.get(tag, 0.0)) if bad == BAD else 0.0
                own += GOOD if good and not bad else 0.0
            elif name == "role":
                own += ROLE.get(value.lower(), 0.0)
            elif name == "style":
                self.hidden |= bool(re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I))
            elif name in ("hidden", "aria-hidden"):
                self.hidden |= value.lower() != "false"
        self.odds = own + worst
        self.against = (parent.against if parent else 0.0) + min(0.0, self.odds)
        self.for_ = (parent.for_ if parent else 0.0) + max(0.0, self.odds) - (max(0.0, same.odds) if same else 0.0)


class Block:
    __slots__ = ("text", "parent", "links", "odds")

    def __init__(self, text: str, parent: Element, links: int):
        self.text, self.parent, self.links = text, parent, links
        self.odds = classify(self)


def classify(b: Block) -> float:
    """Log odds that a block is content."""
    if b.parent.hidden:
        return -12.0
    x = BIAS + b.parent.against + b.parent.for_
    n = len(b.text)
    x += min(1.5, math.log1p(n) / 4) - 3.0 * min(1.0, b.links / max(1, n))
    x += 0.4 if b.text[-1:] in ".!?…\"”»" else 0.0
    x -= 4.0 if b.text[:1] == "©" else 0.0
    return x


class _Open:
    """The open elements of a page: a stack, with the open elements of each tag and of SCOPES at hand."""

    def __init__(self):
        self.stack: list[Element] = []
        self.by_tag: dict[str, list[Element]] = {}
        self.scopes: list[Element] = []
        self.push("#root", "")

    def innermost(self, tag: str) -> Element | None:
        own = self.by_tag.get(tag)
        return own[-1] if own else None

    def push(self, tag: str, attrs: str) -> None:
        e = Element(tag, attrs, self.stack[-1] if self.stack else None, self.innermost(tag))
        self.stack.append(e)
        self.by_tag.setdefault(tag, []).append(e)
        if tag in SCOPES:
            self.scopes.append(e)

    def close(self, e: Element) -> None:
        """e and all within it."""
        while len(self.stack) > e.depth:
            x = self.stack.pop()
            self.by_tag[x.tag].pop()
            if x.tag in SCOPES:
                self.scopes.pop()

    def end(self, tag: str) -> None:
        e = self.innermost(tag)
        if e and (tag not in INLINE or not self.scopes or e.depth > self.scopes[-1].depth):
            self.close(e)

    def make_way(self, tags) -> None:
        """Closes the innermost of the elements that tags name, unless a scope is open within it."""
        found = [e for e in map(self.innermost, tags) if e]
        if found:
            e = max(found, key=lambda x: x.depth)
            if not self.scopes or e.depth >= self.scopes[-1].depth:
                self.close(e)


def blocks(page: str) -> list[Block]:
    open_ = _Open()
    out, piece, linked = [], [], 0
    at, n = 0, len(page)
    endless: set[str] = set()  # tags of which no end follows

    def flush() -> None:
        nonlocal piece, linked
        text = " ".join("".join(piece).split())
        if text:
            out.append(Block(text, open_.stack[-1].holder, linked))
        piece, linked = [], 0

    def add(raw: str) -> None:
        nonlocal linked
        if raw:
            text = entities.unescape(raw) if "&" in raw else raw
            piece.append(text)
            if open_.by_tag.get("a"):
                linked += len(text)

    while at < n:
        m = TAG.search(page, at)
        if not m:
            add(page[at:])
            break
        add(page[at : m.start()])
        at = m.end()
        if m.group(2) is None:
            continue
        tag, closing = m.group(2).lower(), bool(m.group(1))
        if tag in OPAQUE and not closing:
            if tag not in INLINE:
                flush()
            if tag == "head":  # what is in it is opaque by itself; a page may never close it
                continue
            raw = tag in ("script", "style", "title", "textarea")
            if raw or not m.group(3).rstrip().endswith("/"):
                end = None if tag in endless else re.compile(rf"</{re.escape(tag)}\b[^>]*(?:>|\Z)", re.I).search(page, at)
                endless |= set() if end else {tag}
                at = end.end() if end else n if raw else at
            continue
        if tag in VOID:
            piece.append(" ") if tag == "br" or tag in INLINE else flush()
            continue
        if tag not in INLINE:
            flush()
        if closing:
            open_.end(tag)
            continue
        if tag in CLOSES or tag not in INLINE:
            open_.make_way(CLOSES.get(tag, {"p"}))
        open_.push(tag, m.group(3))
    flush()
    return out


def _distance(a: Element, b: Element) -> int:
    """Steps between two elements of the tree, at most FAR."""
    steps = 0
    while a is not b and steps < FAR:
        if a.depth >= b.depth:
            a, steps = a.parent, steps + 1
        else:
            b, steps = b.parent, steps + 1
    return steps


def edges(found: list[Block]) -> dict[tuple[int, int], float]:
    out: dict[tuple[int, int], float] = {}
    last: dict[int, int] = {}
    for i, b in enumerate(found):
        if i:
            out[i - 1, i] = ADJACENT * math.exp(-_distance(found[i - 1].parent, b.parent) / DECAY)
        up = b.parent.parent or b.parent
        j = last.get(id(up))
        if j is not None:
            out[j, i] = out.get((j, i), 0.0) + SIBLING
        last[id(up)] = i
    return out


def min_cut(gain: list[float], near: dict[tuple[int, int], float]) -> list[bool]:
    """Labels that minimise the costs: gain[i] is what True saves over False, and a pair with two labels costs its edge."""
    n = len(gain)
    around: list[dict[int, float]] = [{} for _ in range(n)]
    for (a, b), w in near.items():
        around[a][b] = around[a].get(b, 0.0) + w
        around[b][a] = around[b].get(a, 0.0) + w
    label: list[bool | None] = [None] * n
    gain = list(gain)
    todo = deque(range(n))
    while todo:  # a block whose own gain outweighs its edges is settled; for the others its edges become gains
        i = todo.popleft()
        if label[i] is None and abs(gain[i]) > sum(around[i].values()):
            label[i] = gain[i] > 0
            for j, w in around[i].items():
                gain[j] += w if label[i] else -w
                del around[j][i]
                if label[j] is None:
                    todo.append(j)
            around[i] = {}
    left = [i for i in range(n) if label[i] is None]
    if left:
        for i, x in zip(left, _max_flow(left, gain, around)):
            label[i] = x
    return [bool(x) for x in label]


def _max_flow(left: list[int], gain: list[float], around: list[dict[int, float]]) -> list[bool]:
    """Dinic's algorithm; True is the source's side."""
    at = {v: i for i, v in enumerate(left)}
    s, t = len(left), len(left) + 1
    to: list[int] = []
    cap: list[float] = []
    adj: list[list[int]] = [[] for _ in range(t + 1)]

    def arc(a: int, b: int, there: float, back: float) -> None:
        for x, y, c in ((a, b, there), (b, a, back)):
            adj[x].append(len(to))
            to.append(y)
            cap.append(c)

    for v in left:
        if gain[v] > 0:
            arc(s, at[v], gain[v], 0.0)
        elif gain[v] < 0:
            arc(at[v], t, -gain[v], 0.0)
        for u, w in around[v].items():
            if u > v:
                arc(at[v], at[u], w, w)
    tiny = 1e-9
    while True:
        level = [-1] * (t + 1)
        level[s] = 0
        queue = deque([s])
        while queue:
            x = queue.popleft()
            for e in adj[x]:
                if cap[e] > tiny and level[to[e]] < 0:
                    level[to[e]] = level[x] + 1
                    queue.append(to[e])
        if level[t] < 0:
            return [level[i] >= 0 for i in range(len(left))]
        nxt = [0] * (t + 1)
        path: list[int] = []
        x = s
        while True:
            if x == t:
                flow = min(cap[e] for e in path)
                for k, e in enumerate(path):
                    cap[e] -= flow
                    cap[e ^ 1] += flow
                cut = next(k for k, e in enumerate(path) if cap[e] <= tiny)
                x = to[path[cut] ^ 1]
                del path[cut:]
                continue
            while nxt[x] < len(adj[x]):
                e = adj[x][nxt[x]]
                if cap[e] > tiny and level[to[e]] == level[x] + 1:
                    break
                nxt[x] += 1
            else:
                if x == s:
                    break
                e = path.pop()
                x = to[e ^ 1]
                nxt[x] += 1
                continue
            path.append(e)
            x = to[e]


def main_text(page: str | None) -> str:
    found = blocks(page or "")
    if not found:
        return ""
    outside = OUTSIDE * sum(len(b.text) for b in found if b.parent.in_main) / sum(len(b.text) for b in found)
    keep = min_cut([b.odds + (0.0 if b.parent.in_main else outside) for b in found], edges(found))
    return "\n\n".join(b.text for b, k in zip(found, keep) if k)


def _run(batches):
    for batch in batches:
        for at in range(0, batch.num_rows, 64):
            part = batch.slice(at, 64)
            texts = [main_text(x) for x in part.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars (code points) of each row of pages; no shuffle."""
    pages = pages.select("page_id", "url", "html")
    kind = dict(pages.dtypes)
    return pages.mapInArrow(_run, f"page_id {kind['page_id']}, url {kind['url']}, text string, n_chars bigint")


def op4_extract_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(read_table(spark, sf_dir, "pages"))
