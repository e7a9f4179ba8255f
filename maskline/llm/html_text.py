"""HTML extraction by minimum cut.

A page becomes text blocks. A classifier's costs for calling a block content or boilerplate, by its text and tag alone, are its
capacities to the two terminals; its weights are fitted to pages whose elements tell what is what. Elements whose name, role, class
or id speaks for or against them are nodes too, with costs of their own. Smoothness edges tie blocks that follow each other, blocks
under the same parent, and blocks to the nearest such element around them. The minimum cut (maximum flow) labels all blocks of a
page at once, so that blocks may overrule a mark, and a mark its blocks; the content side, in page order, is the main text.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maskline.plans.session import ship

TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]+|=\s*(?:\"[^\"]*\"|'[^']*')|=)*)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
#: Elements whose content is raw text that is never shown.
RAW = {"script", "style", "noscript", "template", "iframe", "svg", "annotation", "annotation-xml", "object", "head", "canvas", "title"}
RAW_END = {x: re.compile(rf"</{x}\s*>", re.I) for x in RAW}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
#: Elements that stay inside a block; all others begin and end one.
INLINE = set("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rb rp rt ruby s samp small span strike strong sub sup time tt u var wbr math semantics mrow mi mn mo ms mtext mspace mfrac msqrt mroot mstyle msub msup msubsup munder mover munderover mmultiscripts mpadded mphantom menclose".split())
#: Elements that a start tag of the same kind closes.
CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: An open paragraph ends where one of these starts.
ENDS_P = set("address article aside blockquote center details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
#: Elements and roles that mark boilerplate for certain, whatever the text; words of class and id that speak for it.
BAD_ELEMENTS = {"nav", "footer", "aside", "button", "select", "textarea", "menu", "dialog", "input", "label", "fieldset"}
BAD_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert", "alertdialog", "menu", "menubar", "form", "note"}
BAD_WORDS = set("ad ads advert advertisement adverts advertising adsense banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies copyright disqus footer gdpr login masthead menu menus modal nav navbar navigation newsletter notice notices notification overlay pager pagination popup promo promoted related reply respond share sharing sidebar signup skip social sponsor sponsored subscribe subscription tags toolbar topbar widget widgets discussion feedback responses legal disclaimer".split())
#: What follows one of these in a class or id says what an element has or lacks, not what it is.
ABOUT = {"has", "with", "without", "no", "not", "is"}
GOOD_ELEMENTS = {"article", "main"}
GOOD_WORDS = set("article body content entry main post story text".split())
WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
#: Elements that say nothing by themselves.
PLAIN = {"p", "b", "i", "em", "strong", "span", "ul", "ol", "li", "div", "table", "tr", "td", "th"}
#: The classifier's weights before fitting (log odds), by feature: one, length (powers of ten), share of links, punctuation, heading,
#: paragraph, copyright sign.
WEIGHTS = np.array([-1.2, 1.1, -4.0, 0.8, 1.0, 0.8, -3.0])
#: How firmly they hold: the fitted ones are those of greatest posterior, with this precision, and each side counting as so many blocks.
PRECISION, FIT_BLOCKS = 4.0, 100.0
#: Pages (about) and blocks of a page and side that the weights are fitted to.
FIT_PAGES, FIT_SIDE = 400, 32
#: What ties a block to a marked element, and the element, for each of its blocks, to its side. All are finite.
IN_ARTICLE, GOOD, BAD_WORD, BAD_ELEMENT = 8.0, 2.0, 5.0, 8.0
#: An element that is called good by a name of its own, and bad by a part of another, ties by this much, and its side costs it BAD_WORD in all.
DOUBTFUL = 2.0
#: A form around so many blocks of so many characters, or around one in an element with a good name, wraps the page's text.
PROSE_BLOCKS, PROSE_CHARS = 3, 80
#: Articles of these alone are answers to the main text.
ANSWERS = {"comment", "comments", "commentlist", "reply", "respond", "responses", "discussion", "feedback"}
#: Smoothness: between neighbours in the page, less the farther apart in the tree; between a parent's blocks in a row.
NEAR, SIBLING = 0.6, 0.8


@dataclass
class Node:
    name: str
    parent: Node | None
    depth: int
    bad: bool = False
    good: bool = False
    link: bool = False
    heading: bool = False
    #: By its own words of class and id; by those of inline elements around it; around an article or main.
    suspect: bool = False
    aside: bool = False
    holds: bool = False
    #: Good and bad names together.
    doubtful: bool = False
    #: What makes it bad for certain, the article or main, the form and the element that isn't inline around it (or itself).
    bad_at: Node | None = None
    article: Node | None = None
    form: Node | None = None
    home: Node | None = None
    #: The nearest element whose words speak against it, once known.
    against: Node | None = None
    settled: bool = False
    chars: int = 0
    prose: int = 0
    prose_chars: int = 0
    good_prose: int = 0

    def __post_init__(self) -> None:
        up = self.parent
        self.home = self if up is None or self.name not in INLINE else up.home
        if up is not None:
            self.bad_at, self.article, self.form = up.bad_at, up.article, up.form


@dataclass
class Block:
    parent: Node
    parts: list[str] = field(default_factory=list)
    asides: set[int] = field(default_factory=set)
    linked: int = 0
    aside_linked: int = 0
    bad: bool = False
    against: Node | None = None
    good: bool = False
    heading: bool = False
    text: str = ""


def hidden(attributes: dict[str, str]) -> bool:
    style = attributes.get("style", "").replace(" ", "").lower()
    return "hidden" in attributes or attributes.get("aria-hidden", "").lower() == "true" or "display:none" in style or "visibility:hidden" in style


def node(name: str, attributes: dict[str, str], parent: Node) -> Node:
    if not attributes and name in PLAIN:
        return Node(name, parent, parent.depth + 1, parent.bad, parent.good, parent.link, parent.heading, aside=parent.aside and name in INLINE)
    words = own_words(attributes)
    good = parent.good or name in GOOD_ELEMENTS or attributes.get("role", "").lower() == "main"
    body = name in ("html", "body", "main", "article")
    head = name == "header" and not parent.good  # an article's own header holds its title
    bad = parent.bad or (not body and (name in BAD_ELEMENTS or head)) or attributes.get("role", "").lower() in BAD_ROLES or hidden(attributes)
    suspect = not body and (bool(words & BAD_WORDS) or "header" in words and not (parent.good or words & GOOD_WORDS)) or answers(name, words)
    out = Node(name, parent, parent.depth + 1, bad, good or bool(words & GOOD_WORDS), parent.link or name == "a", parent.heading or bool(re.fullmatch("h[1-6]", name)))
    out.suspect, out.aside, out.doubtful = suspect, name in INLINE and (suspect or parent.aside), suspect and torn(attributes)
    if bad and not parent.bad:
        out.bad_at = out
    if name in GOOD_ELEMENTS:
        out.article = out
    if name == "form":
        out.form = out
    return out


def names_of(attributes: dict[str, str]) -> Iterator[list[str]]:
    """The words of each name in class and id, up to one that says what the element has or lacks."""
    for name in " ".join(attributes.get(k, "") for k in ("class", "id")).split():
        words = [w.lower() for w in WORDS.findall(name)]
        yield words[: next((i for i, w in enumerate(words) if w in ABOUT), len(words))]


def torn(attributes: dict[str, str]) -> bool:
    """Whether one name is good throughout, and bad words stand only in names with words that say neither."""
    names = [x for x in names_of(attributes) if x]
    return any(set(x) <= GOOD_WORDS for x in names) and not any(set(x) & BAD_WORDS and set(x) <= BAD_WORDS | GOOD_WORDS for x in names)


def own_words(attributes: dict[str, str]) -> set[str]:
    """The words of class and id, less those that say what the element has or lacks."""
    return {w for name in names_of(attributes) for w in name}


def answers(name: str, words: set[str]) -> bool:
    return name == "article" and bool(words & ANSWERS) and not words & GOOD_WORDS


def worded(b: Block) -> None:
    """Gives a block its text. Inline elements with bad words lose theirs if the block has as much besides; else they speak against it."""
    rest = b.parts
    if b.asides:
        rest = [x for i, x in enumerate(b.parts) if i not in b.asides]
        if 2 * len("".join(rest).strip()) < len("".join(b.parts).strip()):
            b.against, rest = b.parent, b.parts
        else:
            b.linked -= b.aside_linked
    b.text = " ".join("".join(rest).split())
    form = b.parent.form
    if form is not None and not b.bad:
        form.chars += len(b.text)
        if len(b.text) >= PROSE_CHARS and 2 * b.linked < len(b.text):
            form.prose, form.prose_chars = form.prose + 1, form.prose_chars + len(b.text)
            form.good_prose += b.good and not form.good


def speaks(n: Node) -> bool:
    """Whether an element's words, or its being a form, speak against it. One around an article or main isn't judged by its words,
    and a form without such words isn't one if it wraps the page's text."""
    if n.holds:
        return False
    wraps = 2 * n.prose_chars > n.chars and (n.prose >= PROSE_BLOCKS or n.good_prose > 0)
    return n.suspect or (n.name == "form" and not wraps)


def judged(b: Block) -> None:
    """Finds the nearest element that speaks against a block; good marks count only where none stands nearer to the text."""
    path, n = [], b.parent
    while n is not None and not n.settled:
        path.append(n)
        n = n.parent
    for x in reversed(path):
        x.against, x.settled = x if speaks(x) else x.parent and x.parent.against, True
    against = b.parent.against
    if against is not None:
        b.against = b.against or against
        b.good = b.good and not (against.parent.good if not against.doubtful else False)


def blocks_of(page: str) -> list[Block]:
    """The text blocks of a page, in order. Tolerates open and misplaced tags, as browsers do."""
    root = Node("", None, 0)
    stack, out, block, at, opened = [root], [], None, 0, Counter()

    def close(i: int) -> None:
        opened.subtract(n.name for n in stack[i:])
        del stack[i:]

    def add(raw: str) -> None:
        nonlocal block
        if not raw:
            return
        top = stack[-1]
        if block is None:
            if raw.isspace():
                return
            block = Block(top.home)
            out.append(block)
        if top.bad and not block.parent.bad:
            return  # an inline element that is boilerplate for certain
        text = html.unescape(raw)
        if top.aside:
            block.asides.add(len(block.parts))
        block.parts.append(text)
        block.bad |= top.bad and not text.isspace()
        block.good |= top.good
        block.heading |= top.heading
        if top.link:
            block.linked += len(text)
            block.aside_linked += len(text) if top.aside else 0

    while at < len(page):
        m = TAG.search(page, at)
        if m is None:
            add(page[at:])
            break
        add(page[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        name, closing = m[2].lower(), bool(m[1])
        if not closing and name in RAW:
            end = RAW_END[name].search(page, at)
            if end is None and name not in ("script", "style"):
                continue  # never closed: what it holds is judged on its own
            at = end.end() if end else len(page)
            continue
        if name == "br":
            add(" ")
            continue
        if name not in INLINE:
            block = None
        if closing:
            if opened[name]:
                while (gone := stack.pop()).name != name:
                    opened[gone.name] -= 1
                opened[name] -= 1
            continue
        if name in VOID:
            continue
        if name in ENDS_P and opened["p"]:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].name == "p":
                    close(i)
                    break
                if stack[i].name not in INLINE:
                    break
        if name in CLOSES and any(opened[x] for x in CLOSES[name]):
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].name in CLOSES[name]:
                    close(i)
                    break
                if stack[i].name not in INLINE and stack[i].name not in ("td", "th"):
                    break
        attributes = {k.lower(): html.unescape(a or b or c or "") for k, a, b, c in ATTRIBUTE.findall(m[3])} if m[3].strip(" /\n\t") else {}
        stack.append(node(name, attributes, stack[-1]))
        opened[name] += 1
        if name in GOOD_ELEMENTS and not stack[-1].suspect:
            for n in reversed(stack[:-1] if not stack[-2].holds else []):
                if n.holds:
                    break
                n.holds = True
    for b in out:
        worded(b)
    for b in out:
        judged(b)
    return [b for b in out if b.text]


def features(b: Block) -> list[float]:
    """What the classifier sees of a block: its text and tag, no marks."""
    n = len(b.text)
    stops = min(3, len(re.findall(r"[.!?,;:…]", b.text))) / 3
    return [1.0, math.log10(max(n, 1)), min(1.0, b.linked / max(1, n)), stops, float(b.heading), float(b.parent.name in ("p", "blockquote", "pre")), float("©" in b.text)]


def content_odds(b: Block, weights: np.ndarray = WEIGHTS) -> float:
    """The classifier: log odds that a block is content."""
    return float(weights @ features(b))


def mark(b: Block) -> tuple[Node, float] | None:
    """The marked element that a block is tied to, and how much for (positive) or against content."""
    if b.bad:
        return b.parent.bad_at or b.parent, -BAD_ELEMENT
    if b.against is not None:
        return b.against, -(DOUBTFUL if b.against.doubtful else BAD_WORD - GOOD * b.good)
    if b.good and b.parent.good and b.parent.article is not None:
        return b.parent.article, IN_ARTICLE
    return (b.parent, GOOD) if b.good else None


def distance(a: Node, b: Node) -> int:
    """Edges between two nodes of the tree."""
    d = 0
    while a is not b:
        if a.depth >= b.depth:
            a = a.parent
        else:
            b = b.parent
        d += 1
    return d


def cut(odds: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """For each node, whether a minimum cut leaves it on the source's (content's) side. Ties: content only if odds say so.

    Shortest augmenting paths by levels (Dinic); a node's terminal arcs are netted, so one of them is left.
    """
    n = len(odds)
    source, sink = n, n + 1
    to, capacity, arcs = [], [], [[] for _ in range(n + 2)]

    def arc(a: int, b: int, forth: float, back: float) -> None:
        arcs[a].append(len(to))
        arcs[b].append(len(to) + 1)
        to.extend((b, a))
        capacity.extend((forth, back))

    for i, x in enumerate(odds):
        if x > 0:
            arc(source, i, x, 0.0)
        elif x < 0:
            arc(i, sink, -x, 0.0)
    for a, b, w in edges:
        arc(a, b, w, w)
    while True:
        level = [-1] * (n + 2)
        level[source], queue = 0, [source]
        for a in queue:
            for e in arcs[a]:
                if capacity[e] > 1e-9 and level[to[e]] < 0:
                    level[to[e]] = level[a] + 1
                    queue.append(to[e])
        if level[sink] < 0:
            return [level[i] >= 0 for i in range(n)]
        at, path, here = [0] * (n + 2), [], source
        while True:
            if here == sink:
                flow = min(capacity[e] for e in path)
                for e in path:
                    capacity[e] -= flow
                    capacity[e ^ 1] += flow
                k = next(i for i, e in enumerate(path) if capacity[e] <= 1e-9)
                here = to[path[k] ^ 1]
                del path[k:]
                continue
            while at[here] < len(arcs[here]):
                e = arcs[here][at[here]]
                if capacity[e] > 1e-9 and level[to[e]] == level[here] + 1:
                    path.append(e)
                    here = to[e]
                    break
                at[here] += 1
            else:
                if here == source:
                    break
                level[here] = -2
                e = path.pop()
                here = to[e ^ 1]
                at[here] += 1


def smoothness(found: list[Block]) -> list[tuple[int, int, float]]:
    """Edges between blocks that follow each other, weaker the farther apart in the tree, and between a parent's blocks in a row."""
    edges, last = [], {}
    for i, b in enumerate(found):
        if i:
            edges.append((i - 1, i, NEAR / (1 + distance(found[i - 1].parent, b.parent))))
        above = b.parent.parent or b.parent
        if id(above) in last:
            edges.append((last[id(above)], i, SIBLING))
        last[id(above)] = i
    return edges


def labelled(found: list[Block], odds: list[float]) -> list[bool]:
    """Which blocks the minimum cut of a page leaves on the content side."""
    odds, edges, place = list(odds), smoothness(found), {}
    for i, b in enumerate(found):
        if tie := mark(b):
            element, by = tie
            if (key := (id(element), by > 0)) not in place:
                place[key] = len(odds)
                odds.append(-BAD_WORD if element.doubtful and by < 0 else 0.0)
            at = place[key]
            odds[at] += 0.0 if element.doubtful and by < 0 else by
            edges.append((at, i, abs(by)))
    return cut(odds, edges)[: len(found)]


def main_text(page: str | None, weights: np.ndarray = WEIGHTS) -> str:
    """The main text of a page: '' if there is none."""
    found = blocks_of(page or "")
    labels = labelled(found, [content_odds(b, weights) for b in found])
    return "\n\n".join(b.text for b, yes in zip(found, labels) if yes)


def lessons(page: str) -> list[tuple[list[float], bool]]:
    """Features and side of blocks whose elements settle it: in an article or main without a mark against them, or in a nav, footer
    or the like, or under words against them outside of any article. At most FIT_SIDE of each, evenly taken."""
    sides = ([], [])
    for b in blocks_of(page):
        if b.bad or b.against is not None or b.parent.article is not None:
            sides[not (b.bad or b.against is not None)].append(b)
    return [(features(b), bool(side)) for side in (0, 1) for b in sides[side][:: max(1, -(-len(sides[side]) // FIT_SIDE))]]


def fitted(rows: list[tuple[list[float], bool]]) -> np.ndarray:
    """Weights of greatest posterior (Newton's method), both sides counting alike; without one of the sides: WEIGHTS."""
    x, y = np.array([r[0] for r in rows]).reshape(-1, len(WEIGHTS)), np.array([r[1] for r in rows], float)
    if not 0 < y.sum() < len(y):
        return WEIGHTS
    count = np.where(y > 0, FIT_BLOCKS / y.sum(), FIT_BLOCKS / (len(y) - y.sum()))
    w = WEIGHTS.copy()
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (count * p * (1 - p))[:, None]).T @ x + PRECISION * np.eye(len(w)), x.T @ (count * (p - y)) + PRECISION * (w - WEIGHTS))
        w = w - step
        if np.abs(step).max() < 1e-9:
            break
    return w


def fit(pages: DataFrame) -> np.ndarray:
    """The classifier's weights for a table: of about FIT_PAGES pages, told by a hash of their id and address, the lessons."""
    n = pages.count()

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [r for page in b["html"].to_pylist() for r in lessons(page or "")]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.list_(pa.float64())), pa.array([r[1] for r in rows], pa.bool_())], ["x", "y"])

    chosen = pages.filter(F.expr(f"pmod(xxhash64(page_id, url), {max(1, n // FIT_PAGES)}) = 0"))
    rows = chosen.mapInArrow(each, "x array<double>, y boolean").limit(4 * FIT_PAGES * FIT_SIDE).collect()
    return fitted(sorted((r["x"], r["y"]) for r in rows))


def extract(pages: DataFrame) -> DataFrame:
    """pages (page_id, url, html) -> page_id, url, text, n_chars. Null or empty html, or none of content: text ''.

    Rows are taken one by one, so repeated rows and page_ids each give a row; other columns are left aside. An empty table, or one
    without pages whose elements tell, keeps the weights that stand here."""
    ship(pages.sparkSession)
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    weights = fit(pages)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(x, weights) for x in b["html"].to_pylist()]
            yield pa.RecordBatch.from_arrays([b["page_id"], b["url"], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.mapInArrow(each, "page_id long, url string, text string, n_chars long")


def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
