"""Main text of web pages by a minimum cut.

A page becomes its blocks of text in order. A logistic classifier over a block's own text (length, links, heading, rights sign)
gives it a cost of being boilerplate and one of being content: capacities to the two terminals. Its weights are learned from a
bounded sample of pages that mark their article; neither the element nor any class name is an input of it. Elements that
hold blocks (sections) are nodes as well, whose labels the cut finds. Their capacities, in proportion to their blocks, come from the name
of the element or of its class, else from a classifier of sections (blocks, length, links) learned from the same sample. What surrounds a block comes in by edges alone: from each
block to its section, from sections to those around them, and between blocks next to each other or under one parent. The
minimum cut of this graph is the labelling of least total cost; the content side, in page order, is the text. A short
paragraph looks like boilerplate by itself and is content by what is around it.
"""

from __future__ import annotations

import html
import math
import re
from collections import defaultdict, deque
from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# A tag that meets another "<" before its end is text: every sign is looked at a bounded number of times.
TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^<>]*+>|<(/?)([a-zA-Z][^\s/<>]*+)((?:[^<>"']++|"[^"]*+"|'[^']*+'|["'])*+)>""", re.S)
ATTRIBUTE = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""")

# Element names of HTML.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "img", "wbr"}
RAW = {"script", "style", "textarea", "title"}
#: Controls that HTML lets hold phrases only: a block element behind an unclosed one is outside.
CONTROLS = {"button", "select", "option", "label"}
CLOSES_P = {"address", "article", "aside", "blockquote", "details", "div", "dl", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "main", "menu", "nav", "ol", "p", "pre", "section", "table", "ul"}
SELF_CLOSING = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPE = {"ul", "ol", "dl", "table", "td", "th", "div", "section", "article", "body", "html", "nav", "aside", "form", "main", "header", "footer", "blockquote"}
# Sections that are boilerplate by their element, role, or the words of their class and id.
BOILER_TAGS = {"nav", "footer", "aside", "form", "menu", "dialog", "fieldset", "address", "button", "select", "noscript", "template", "iframe", "svg", "object", "noembed", "noframes"}
BOILER_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alertdialog", "alert", "menu", "menubar", "toolbar"}
BOILER_WORDS = {"ad", "ads", "adbox", "adslot", "banner", "promo", "promoted", "widget", "widgets", "consent", "gdpr", "notice", "notices", "alert", "popup", "modal", "overlay", "signup", "reply", "replies", "disqus", "respond", "nav", "menu", "menus", "masthead", "topbar", "toolbar", "share", "sharing", "social", "related", "recommended", "login", "search", "searchbox", "copyright", "legal", "disclaimer", "pagination", "pager", "header", "sidebar", "skip", "dropdown"}
BOILER_STEMS = ("advert", "sponsor", "sidebar", "cookie", "newsletter", "subscri", "comment", "navbar", "navigation", "breadcrumb", "footer", "discuss")
CONTENT_WORDS = {"article", "content", "post", "entry", "story", "main", "body", "text"}

# The log-odds that a block is content, by its own text, are a sum over these: one, share of characters in links, log of
# the length, heading, a rights sign in a short text. Those of a section without a name: one, logs of its blocks and its
# length, share of characters in links. These weights stand where no page of the sample marks an article, and few pages move
# them little.
DEFAULT_COSTS = ((-1.0, -4.0, 0.8, 0.8, -3.0), (-0.3, 0.3, 0.6, -4.0))
Costs = tuple[Sequence[float], Sequence[float]]
#: No text, and no section a block, says more than this for itself.
SURE = 4.0
# Capacities of sections to their terminal, a block: boilerplate by element or name (for each of both), an article,
# content by name, and the page around an article.
IN_BOILER, IN_ARTICLE, NAMED, BESIDE = 9.0, 6.0, 1.0, 4.0
# Edges: a block and its section; a section and the one around it, a block: where that is told by a name, else at all; blocks
# in a row, more if they share a section; blocks in a row under one parent.
WITHIN, INHERIT, LOOSE, NEXT, SECTION, PARENT = 6.0, 12.0, 0.3, 0.3, 0.5, 0.8
#: Pages that the costs are learned from at most, and bytes of their html together.
SAMPLE_PAGES, SAMPLE_BYTES = 400, 16 << 20
RIDGE = 3.0


class Section:
    """An element that holds blocks: its own capacity a block, whether it or one around it is named (as boilerplate)."""

    __slots__ = ("above", "boiler", "odds", "told")

    def __init__(self, above: int, odds: float, told: bool, boiler: bool):
        self.above, self.odds, self.told, self.boiler = above, odds, told, boiler


class Block:
    __slots__ = ("heading", "linked", "parent", "pieces", "section", "size", "zone")

    def __init__(self, zone: tuple[int, int, int], parent: int, section: int, heading: bool):
        self.zone, self.parent, self.section, self.heading = zone, parent, section, heading
        self.pieces: list[str] = []
        self.size = self.linked = 0


def _zone(tag: str, attributes: str, above: tuple[int, int, int]) -> tuple[int, int, int]:
    """(inside an article, boilerplate sections around, named as content) of an element under one with these."""
    article, boiler, named = above
    if tag in ("article", "main"):
        article = 1
    elif tag in BOILER_TAGS or (tag == "header" and not article):
        boiler += 1
    if attributes and tag not in ("html", "body"):
        bad = False
        for name, value in ATTRIBUTE.findall(attributes):
            name = name.lower()
            if name in ("class", "id"):
                words = re.findall(r"[a-z0-9]+", re.sub(r"(?<=[a-z])(?=[A-Z])", " ", html.unescape(value)).lower())
                if tag not in ("article", "main"):
                    bad = bad or any(w in BOILER_WORDS or w.startswith(BOILER_STEMS) for w in words)
                named = named or int(any(w in CONTENT_WORDS for w in words))
            elif name == "role":
                role = value.strip("\"'").lower()
                bad = bad or role in BOILER_ROLES
                article = article or int(role in ("main", "article"))
            elif name == "hidden" or (name == "aria-hidden" and "true" in value.lower()) or (name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value.lower())):
                bad = True
        boiler += bad
    return article, boiler, named


def _section(sections: list[Section], above: int, zone: tuple[int, int, int], around: tuple[int, int, int]) -> int:
    """The number of a new section of this zone."""
    if zone[1] > around[1]:
        odds = -IN_BOILER * (zone[1] - around[1])
    elif zone[0] > around[0]:
        odds = IN_ARTICLE
    else:
        odds = NAMED if zone[2] > around[2] else 0.0
    sections.append(Section(above, odds, sections[above].told or odds != 0, zone[1] > 0))
    return len(sections) - 1


def blocks(page: str) -> tuple[list[tuple[Block, str]], list[Section]]:
    """The page's blocks that hold text, with that text: references decoded, white space one space, trimmed; and its sections,
    the page first, each after the one around it."""
    sections = [Section(-1, 0.0, False, False)]
    stack: list[tuple[str, tuple[int, int, int], int, int]] = [("", (0, 0, 0), 0, 0)]  # tag, zone, number, section
    found: list[tuple[Block, str]] = []
    now: Block | None = None
    links = number = at = 0
    open_: dict[str, int] = defaultdict(int)
    length = len(page)

    def say(text: str) -> None:
        nonlocal now
        if not text:
            return
        if now is None:
            own = next(x for x in reversed(stack) if x[0] not in INLINE)
            now = Block(own[1], own[2], own[3], own[0] in ("h1", "h2", "h3", "h4", "h5", "h6"))
            if stack[-1][1][1] > own[1][1] and not text.isspace():
                now.zone, now.section = stack[-1][1], stack[-1][3]
        now.pieces.append(text)
        n = len(text)
        now.size += n
        if links:
            now.linked += n

    def flush() -> None:
        nonlocal now
        if now is not None:
            text = " ".join(html.unescape("".join(now.pieces)).split())
            if text:
                found.append((now, text))
            now = None

    def drop(k: int) -> None:
        """Close the elements from place k of the stack on."""
        nonlocal links
        for x in stack[k:]:
            open_[x[0]] -= 1
        links = open_["a"]
        del stack[k:]

    while at < length:
        m = TOKEN.search(page, at)
        if m is None:
            say(page[at:])
            break
        if m.start() > at:
            say(page[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            if not open_[tag]:
                if tag == "br":
                    say(" ")
                elif tag == "p":
                    flush()
                continue
            k = len(stack) - 1
            while stack[k][0] != tag:
                if tag in INLINE and stack[k][0] not in INLINE:
                    k = 0
                    break  # an inline end tag does not close the blocks inside
                k -= 1
            if not k:
                continue
            if any(x[0] not in INLINE for x in stack[k:]):
                flush()
            drop(k)
            continue
        if tag == "br":
            say(" ")
            continue
        if tag in RAW:
            if tag != "title" or not open_["svg"]:
                end = RAW_END[tag].search(page, at) or (UNCLOSED_CODE if tag in ("script", "style") else UNCLOSED).search(page, at)
                at = length if end is None else end.end() if end[0].startswith("</") else end.start()
            continue
        if tag in VOID:
            if tag not in INLINE:
                flush()
            continue
        if tag not in INLINE:
            if tag not in CONTROLS:
                for k in range(1, len(stack)) if any(open_[x] for x in CONTROLS) else ():
                    if stack[k][0] in CONTROLS:
                        flush()
                        drop(k)
                        break
            flush()
            for tags in ({"p"} if tag in CLOSES_P else None, SELF_CLOSING.get(tag)):
                k = _nearest(stack, tags) if tags and any(open_[x] for x in tags) else 0
                if k:
                    drop(k)
        elif tag == "a":
            links += 1
        if m[3].endswith("/") and tag in ("svg", "math"):
            continue
        number += 1
        zone = _zone(tag, m[3], stack[-1][1])
        section = stack[-1][3]
        if zone != stack[-1][1] or tag in SCOPE:
            section = _section(sections, section, zone, stack[-1][1])
        open_[tag] += 1
        stack.append((tag, zone, number, section))
    flush()
    return found, sections


RAW_END = {tag: re.compile(rf"</{tag}(?=[\s/>])[^>]*>", re.I) for tag in RAW}
#: Where a textarea or title ends that is never closed: at the next block element or end tag of one. In a script or style only
#: where white space or another tag is before it: others are parts of its own strings.
UNCLOSED = re.compile(rf"<(?:/?(?:head|body|html|{'|'.join(sorted(CLOSES_P))})(?=[\s/>]))", re.I)
UNCLOSED_CODE = re.compile(rf"(?<=[\s>]){UNCLOSED.pattern}", re.I)


def _nearest(stack: list, tags: set[str]) -> int:
    """The place of the nearest of these elements, 0 if there is none or a section lies between."""
    for i in range(len(stack) - 1, 0, -1):
        if stack[i][0] in tags:
            return i
        if stack[i][0] in SCOPE:
            return 0
    return 0


def features(block: Block, text: str) -> tuple[float, ...]:
    """What the block's own text shows."""
    return 1.0, block.linked / max(1, block.size), math.log1p(len(text) / 40), float(block.heading), float(len(text) < 300 and "\u00a9" in text)


def section_features(blocks_: int, size: int, linked: int) -> tuple[float, ...]:
    return 1.0, math.log1p(blocks_), math.log1p(size / 40), linked / max(1, size)


def _odds(costs: Sequence[float], shown: Sequence[float]) -> float:
    return max(-SURE, min(SURE, sum(w * x for w, x in zip(costs, shown, strict=True))))


def _sums(found: list[tuple[Block, str]], sections: list[Section]) -> list[list[int]]:
    """(blocks, characters, characters in links, blocks of the article) in each section and those inside it."""
    sums = [[0, 0, 0, 0] for _ in sections]
    for b, _ in found:
        for i, x in enumerate((1, b.size, b.linked, b.zone[0] and not b.zone[1])):
            sums[b.section][i] += x
    for k in range(len(sections) - 1, 0, -1):
        for i, x in enumerate(sums[k]):
            sums[sections[k].above][i] += x
    return sums


def _logistic(rows: list[tuple[float, ...]], labels: list[bool], prior: Sequence[float]) -> tuple[float, ...]:
    """Weights of a logistic regression, held near the prior ones as long as rows are few: ridge RIDGE, at most
    twenty Newton steps, none of which may raise the loss."""
    x, y = np.array(rows), np.array(labels, float)
    start = np.array(prior)

    def loss(w: np.ndarray) -> float:
        return float(np.logaddexp(0, np.where(y > 0, -1, 1) * (x @ w)).sum() + RIDGE / 2 * ((w - start) ** 2).sum())

    w, now = start, loss(start)
    for _ in range(20):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x.T * (p * (1 - p))) @ x + RIDGE * np.eye(len(w)), x.T @ (y - p) - RIDGE * (w - start))
        # A whole step may overshoot where classes are nearly separable: it is halved until it helps.
        size = next((h for h in 0.5 ** np.arange(20) if loss(w + h * step) < now), 0.0)
        if not size:
            break
        w = w + size * step
        now = loss(w)
    return tuple(float(v) for v in w)


def learned_costs(pages: Iterable[str]) -> Costs:
    """Weights learned from the pages with an article: of a block, whether it is of the article and not of boilerplate in it;
    of a section, whether most of its blocks are. DEFAULT_COSTS if there are no blocks of both kinds."""
    rows: list[tuple[float, ...]] = []
    labels: list[bool] = []
    parts: list[tuple[float, ...]] = []
    mostly: list[bool] = []
    for page in pages:
        found, sections = blocks(page)
        own = [b.zone[0] == 1 and not b.zone[1] for b, _ in found]
        if any(own):
            rows += [features(b, t) for b, t in found]
            labels += own
            for n, size, linked, good in _sums(found, sections)[1:]:
                if n:
                    parts.append(section_features(n, size, linked))
                    mostly.append(2 * good > n)
    if not any(labels) or all(labels):
        return DEFAULT_COSTS
    return _logistic(rows, labels, DEFAULT_COSTS[0]), _logistic(parts, mostly, DEFAULT_COSTS[1])


def minimum_cut(odds: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Which nodes are on the source side of a minimum cut: odds above 0 are capacity from the source, below 0 to the
    sink, edges hold both ways. Nodes whose odds outweigh all their edges are settled first (no cut of least cost
    labels them otherwise) and give their edges to their neighbours' odds; augmenting paths do the rest."""
    n = len(odds)
    odds = list(odds)
    near: list[dict[int, float]] = [{} for _ in range(n)]
    for a, b, w in edges:
        near[a][b] = near[a].get(b, 0.0) + w
        near[b][a] = near[b].get(a, 0.0) + w
    label: list[bool | None] = [None] * n
    held = [sum(x.values()) for x in near]
    queue = deque(range(n))
    while queue:
        i = queue.popleft()
        if label[i] is None and abs(odds[i]) >= held[i] - 1e-9:
            label[i] = odds[i] > 0
            for j, w in near[i].items():
                del near[j][i]
                held[j] -= w
                odds[j] += w if label[i] else -w
                queue.append(j)
            near[i] = {}
    rest = [i for i in range(n) if label[i] is None]
    if not rest:
        return [bool(x) for x in label]
    # Residual capacities among the rest; source n, sink n + 1.
    cap: dict[int, dict[int, float]] = {i: dict(near[i]) for i in rest}
    cap[n], cap[n + 1] = {}, {}
    for i in rest:
        if odds[i] > 0:
            cap[n][i] = odds[i]
            cap[i][n] = 0.0
        elif odds[i] < 0:
            cap[i][n + 1] = -odds[i]
            cap[n + 1][i] = 0.0
    while True:
        # One breadth-first search gives levels; all paths along them are filled before the next.
        level = {n: 0}
        queue = deque([n])
        while queue and n + 1 not in level:
            i = queue.popleft()
            for j, c in cap[i].items():
                if c > 1e-12 and j not in level:
                    level[j] = level[i] + 1
                    queue.append(j)
        if n + 1 not in level:
            for i in rest:
                label[i] = i in level
            return [bool(x) for x in label]
        arcs = {i: list(cap[i]) for i in level}
        at = dict.fromkeys(level, 0)
        path = [n]
        while path:
            i = path[-1]
            if i == n + 1:
                flow = min(cap[a][b] for a, b in zip(path, path[1:]))
                first_full = len(path) - 2
                for k in range(len(path) - 2, -1, -1):
                    a, b = path[k], path[k + 1]
                    cap[a][b] -= flow
                    cap[b][a] = cap[b].get(a, 0.0) + flow
                    if cap[a][b] <= 1e-12:
                        first_full = k
                del path[first_full + 1 :]
                continue
            while at[i] < len(arcs[i]):
                j = arcs[i][at[i]]
                if level.get(j) == level[i] + 1 and cap[i][j] > 1e-12:
                    path.append(j)
                    break
                at[i] += 1
            else:
                path.pop()
                if path:
                    at[path[-1]] += 1


def graph(page: str, costs: Costs = DEFAULT_COSTS) -> tuple[list[str], list[float], list[tuple[int, int, float]]]:
    """(texts of the blocks, capacities of the blocks and then of the sections that hold some, edges)."""
    found, sections = blocks(page)
    sums = _sums(found, sections)
    beside = sum(not b.zone[0] and not b.zone[1] for b, _ in found) if any(b.zone[0] and not b.zone[1] for b, _ in found) else 0
    odds = [_odds(costs[0], features(b, t)) for b, t in found]
    node: dict[int, int] = {}
    edges = []
    under = [False] * len(sections)  # around an article, and not in a section with a name
    for k, x in enumerate(sections):
        n, size, linked, _ = sums[k]
        if not n:
            continue
        node[k] = len(odds)
        odds.append(n * (x.odds or _odds(costs[1], section_features(n, size, linked))) if k else -BESIDE * beside)
        under[k] = beside > 0 and not x.told
        if k:
            up = sections[x.above]
            if x.odds == 0:
                tied = up.told or under[x.above]
                under[k] = under[x.above] and tied
            else:
                tied = x.odds > 0 and up.boiler
            edges.append((node[x.above], node[k], INHERIT * n if tied else LOOSE))
    last: dict[int, int] = {}
    for i, (b, _) in enumerate(found):
        edges.append((i, node[b.section], WITHIN))
        if i:
            edges.append((i - 1, i, NEXT + SECTION * (found[i - 1][0].section == b.section)))
        if b.parent in last:
            edges.append((last[b.parent], i, PARENT))  # near in the tree, though others may lie between
        last[b.parent] = i
    return [t for _, t in found], odds, edges


def labelled(page: str, costs: Costs = DEFAULT_COSTS) -> list[tuple[str, bool, float]]:
    """(text, whether it is content, the log-odds of its own text) of every block."""
    texts, odds, edges = graph(page, costs)
    return list(zip(texts, minimum_cut(odds, edges), odds, strict=False))


def main_text(page: str | None, costs: Costs = DEFAULT_COSTS) -> str:
    return "\n".join(t for t, use, _ in labelled(page or "", costs) if use)


def _extractor(costs: Costs) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x.as_py(), costs) for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(np.array([len(t) for t in texts], np.int64))], ["page_id", "url", "text", "n_chars"])

    return run


def sample_of_pages(pages: DataFrame, most_pages: int = SAMPLE_PAGES, most_bytes: int = SAMPLE_BYTES) -> list[str]:
    """The html of at most most_pages rows of (page_id, html_), first by md5 of the id; a page that would take them beyond most_bytes is
    passed over. Ids and lengths come to the driver first, then the chosen pages, each whole."""
    sized = pages.where("page_id is not null and html_ is not null").groupBy("page_id").agg(F.sum(F.octet_length("html_").cast("long")).alias("size_"))
    chosen, room = [], most_bytes
    for r in sized.orderBy(F.md5(F.col("page_id").cast("string")), "page_id").limit(most_pages).collect():
        if r["size_"] <= room:
            room -= r["size_"]
            chosen.append((r["page_id"],))
    if not chosen:
        return []
    picked = pages.sparkSession.createDataFrame(chosen, "page_id long")
    got = pages.join(F.broadcast(picked), "page_id").select("page_id", "html_").where("html_ is not null").collect()
    return [r["html_"] for r in sorted(got, key=lambda r: (r["page_id"], r["html_"]))]


def extract_main_text(pages: DataFrame, id_column: str = "page_id", url_column: str = "url", html_column: str = "html", costs: Costs | None = None) -> DataFrame:
    """One row per row of pages: page_id, url, text, n_chars.

    costs: weights of the classifiers; None learns them from at most SAMPLE_PAGES pages (whole, SAMPLE_BYTES together) of these.
    Null or empty html, and pages without content, give an empty text. Null ids and urls stay null. Repeated rows are
    extracted alike, pages of any length whole. Where labellings cost the same, which one is taken depends on the
    page and the costs alone. An empty table gives no rows. Other columns are not read.
    """
    own = pages.select(F.col(id_column).cast("long").alias("page_id"), F.col(url_column).cast("string").alias("url"), F.col(html_column).cast("string").alias("html_"))
    weights = learned_costs(sample_of_pages(own)) if costs is None else costs
    return own.mapInArrow(_extractor(weights), "page_id long, url string, text string, n_chars long")
