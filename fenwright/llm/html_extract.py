"""Main text of web pages by a minimum cut between content and boilerplate.

A page becomes a row of blocks: runs of text between block-level tags. A logistic classifier gives
each block costs for the labels content and boilerplate from its text, links, tag, place and the
text around it; no name of an element or class is among its features, but for the kind of text block.
The costs become the block's capacities to the two terminals, MOST at most. What the elements around a block state (`article` or
`main` against `nav`, `footer`, `aside`, `form` and telling class names) is a bounded prior added to them: STRONG for
elements and names that say nothing else, WEAK for names that also say something else. So a classifier that is sure overrules a weak
name alone, and a strong one together with the edges. Names that state how a page is set (`has-sidebar`, `no-comments`) say nothing of
their element; `html` and `body` have no role; nor has a form, or an element of a weak name, with more than half of the page's own text.
Neighbouring blocks, and blocks of one parent, are joined
by edges that cost the more to cut the fewer steps of the element tree lie between them. A maximum
flow then cuts the page at least cost, and the content side, in page order, is the text.

The classifier is trained on blocks with roles, labelled by those and weighed by their strength, of at most TRAIN_PAGES
pages, those with the smallest ids, and on PROTOTYPES, so that it is defined for any table.

Cases: null or empty html, or no content, gives an empty text. Unclosed elements end with their
parent, or where HTML ends them (`p`, `li`). Quotes inside an unquoted attribute mean nothing; a quote that is
never closed ends at the next `>`. After the last `>` all is text. What follows an unclosed comment, script or style is no text.
Repeated rows are treated alike. An empty table gives an empty result. Extra columns are
ignored, whatever their names. Long pages are taken whole; the flow works on their block graph.
"""

from __future__ import annotations

import html
import re
from collections import Counter, deque
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fenwright.llm import _text

TRAIN_PAGES = 200

#: Elements of HTML by behaviour.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
HIDDEN = frozenset("script style noscript template head title iframe object svg canvas select option button textarea".split())
RAW = ("script", "style", "noscript", "template", "iframe", "svg", "textarea", "title")
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
CLOSES = {"p": BLOCK, "li": frozenset({"li"}), "dt": frozenset({"dt", "dd"}), "dd": frozenset({"dt", "dd"}), "tr": frozenset({"tr"}), "td": frozenset({"td", "th", "tr"}), "th": frozenset({"td", "th", "tr"})}
#: Roles by element, and by words of class, id and role; words of which a name is built that say nothing of the role; words of names that are about the page.
GOOD_TAGS, BAD_TAGS = frozenset({"article", "main"}), frozenset({"nav", "header", "footer", "aside", "form", "menu", "dialog"})
GOOD_WORDS = frozenset("article content main post story entry body text".split())
BAD_WORDS = frozenset("ad ads advert advertisement banner sponsor sponsored promo nav navigation navbar menu breadcrumb breadcrumbs header footer sidebar aside widget related share social comment comments reply replies respond disqus cookie cookies consent notice notices alert popup modal newsletter subscribe login search form copyright legal pagination".split())
BUILT = frozenset("list area section wrapper wrap container box block left right top bottom inner outer item items row col group bar panel site page global primary secondary links link area holder main body content".split())
STATE = frozenset("has no with without is not open closed enabled disabled single hide show".split())
STRONG, WEAK = 5.0, 2.5
#: Share of an edge's weight between blocks under different roles and of different elements.
UNLIKE = 0.4

#: Comments, declarations and tags; no part of an attribute is looked at twice.
ATTRIBUTE = r"""[^\s/>][^\s/>=]*+(?:\s*+=\s*+(?:"[^"]*+"|'[^']*+'|["'][^>]*+|[^\s>"'][^\s>]*+)?+)?+"""
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)|</?([a-zA-Z][^\s/>]*+)((?:[\s/]++|" + ATTRIBUTE + r")*+)(?:>|\Z)", re.S)
NAMES = re.compile(r"(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
SPLIT = re.compile(r"[^a-z]+")
SPACE = re.compile(r"\s+")


@dataclass
class Block:
    text: str
    linked: int  # characters inside links
    parent: int  # number of the block-level element around the block's own
    depth: int  # block-level elements around the text
    shared: int  # how many of them are around the block before, too
    tag: str
    node: int  # number of the nearest element with a role of its own
    role: float = 0.0  # prior by the elements around: above 0 content, below boilerplate


def _named(name: str) -> float:
    """What one name of class, id or role says."""
    parts = [w for w in SPLIT.split(name.lower()) if w]
    if STATE.intersection(parts):
        return 0.0
    telling = [w for w in parts if w not in BUILT] or parts
    bad = [w in BAD_WORDS for w in telling]
    if any(bad):
        return -STRONG if all(bad) else -WEAK
    return WEAK if any(w in GOOD_WORDS for w in telling) else 0.0


def _role(tag: str, attributes: str) -> float:
    """The role that an element states of itself."""
    if tag in ("html", "body"):
        return 0.0
    said = [_named(name) for m in NAMES.finditer(attributes) for name in "".join(filter(None, m.groups())).split()] if attributes and "=" in attributes else []
    if tag in BAD_TAGS:
        said.append(-STRONG)
    if tag in GOOD_TAGS:
        said.append(STRONG)
    low, high = min(said, default=0.0), max(said, default=0.0)
    return low if -low >= high else high


def _put_roles(blocks: list[Block], nodes: list[tuple[int, str, float]]) -> None:
    """The role in force at each block. nodes: elements with roles: the node around, tag, own role; an outer one comes first."""
    own_text = [0] * len(nodes)
    for b in blocks:
        own_text[b.node] += len(b.text) - b.linked
    total = sum(own_text)
    for i in range(len(nodes) - 1, 0, -1):
        own_text[nodes[i][0]] += own_text[i]
    role = [0.0] * len(nodes)
    for i, (around, tag, own) in enumerate(nodes):
        outer = role[around]
        frame = own < 0 and (tag == "form" or own > -STRONG) and 2 * own_text[i] > total
        if frame or tag == "header" and outer > 0 or outer < 0 < own <= -outer or outer < own < 0:
            own = 0.0
        role[i] = max(own, outer) if own > 0 else own or outer
    for b in blocks:
        b.role = role[b.node]


def blocks_of(page: str) -> list[Block]:
    """Text blocks of a page in order; white space is single and references are decoded."""
    out: list[Block] = []
    stack: list[tuple[str, int, int]] = []  # tag, number, node
    nodes: list[tuple[int, str, float]] = [(0, "", 0.0)]
    around: list[tuple[str, int]] = []  # those of the stack that are block-level
    pieces: list[str] = []
    open_tags: Counter[str] = Counter()
    number = linked = hidden = links = at = low = 0  # low: fewest block-level elements since the last block
    last = page.rfind(">")

    def flush() -> None:
        nonlocal linked, low
        if pieces:
            text = SPACE.sub(" ", html.unescape("".join(pieces))).strip()
            if text:
                parent = around[-2][1] if len(around) > 1 else 0
                out.append(Block(text, min(linked, len(text)), parent, len(around), min(low, len(around)), around[-1][0] if around else "", stack[-1][2] if stack else 0))
                low = len(around)
            pieces.clear()
        linked = 0

    def close(upto: int) -> None:
        nonlocal hidden, links, low
        while len(stack) > upto:
            tag = stack.pop()[0]
            open_tags[tag] -= 1
            hidden -= tag in HIDDEN
            links -= tag == "a"
            if tag in BLOCK:
                around.pop()
                low = min(low, len(around))

    def take(text: str) -> None:
        nonlocal linked
        if text and not hidden:
            pieces.append(text)
            if links:
                linked += len(text.strip())

    lower = None
    while True:
        m = TOKEN.search(page, at) if at <= last else None
        take(page[at : m.start() if m else len(page)])
        if not m:
            break
        at = m.end()
        if not m[1]:
            continue
        tag, closing = m[1].lower(), page[m.start() + 1] == "/"
        if tag in BLOCK:
            flush()
        elif tag == "br":
            take(" ")
        if closing:
            if not open_tags[tag]:
                continue
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == tag:
                    close(i)
                    break
                if tag not in BLOCK and stack[i][0] in BLOCK:  # an inline end tag does not reach out of its block
                    break
            continue
        if tag in RAW and not m[2].endswith("/"):
            lower = page.lower() if lower is None else lower
            end = lower.find(f"</{tag}", at)
            after = page.find(">", end) + 1 if end >= 0 else 0
            at = after or len(page)
            continue
        while stack and tag in CLOSES.get(stack[-1][0], ()) or (tag in BLOCK and stack and stack[-1][0] not in BLOCK and any(tag in CLOSES.get(t, ()) for t, _, _ in stack[-4:])):
            close(len(stack) - 1)
        if tag in VOID or m[2].endswith("/"):
            continue
        node = stack[-1][2] if stack else 0
        own = _role(tag, m[2])
        if own:
            nodes.append((node, tag, own))
            node = len(nodes) - 1
        number += 1
        stack.append((tag, number, node))
        open_tags[tag] += 1
        if tag in BLOCK:
            around.append((tag, number))
        hidden += tag in HIDDEN
        links += tag == "a"
    flush()
    _put_roles(out, nodes)
    return out


def features(blocks: list[Block]) -> np.ndarray:
    """Of each block: what its text, links and tag are like, where it stands, and how much of the page's text its siblings hold."""
    n = len(blocks)
    size = np.array([len(b.text) for b in blocks], float)
    words = np.array([b.text.count(" ") + 1 for b in blocks], float)
    linked = np.array([b.linked for b in blocks], float)
    marks = np.array([sum(map(b.text.count, ".,;:!?")) for b in blocks], float)
    group = np.unique([b.parent for b in blocks], return_inverse=True)[1] if n else np.zeros(0, np.int64)
    siblings, their_links = np.bincount(group, size), np.bincount(group, linked)
    long = np.concatenate([[0.0], np.log1p(size) / 5, [0.0]])
    place = (np.cumsum(size) - size / 2) / max(size.sum(), 1.0)
    is_tag = lambda *tags: np.array([b.tag in tags for b in blocks], float)
    return np.stack(
        [
            np.ones(n), linked / np.maximum(size, 1), long[1:-1], np.minimum(1.0, marks / words), is_tag("p"), is_tag("li", "td"), is_tag("h1", "h2", "h3", "h4", "h5", "h6"), np.array(["\u00a9" in b.text for b in blocks], float),
            siblings[group] / max(size.sum(), 1.0), their_links[group] / np.maximum(siblings[group], 1), place < 0.02, place > 0.98, long[:-2], long[2:],
        ],
        1,
    ).astype(float)


#: Blocks with known labels: (html, content?).
PROTOTYPES = (
    ("<article><h1>A title of some words</h1><p>A paragraph of plain prose, long enough to be read.</p><p>Short.</p><ul><li>an item</li></ul></article>", 1),
    ("<main><p>Another paragraph, with a <a href=x>link</a> in it, and more words after.</p></main>", 1),
    ("<nav><ul><li><a href=x>Home</a></li><li><a href=y>About us</a></li></ul></nav><footer>(c) Someone, all rights reserved.</footer>", 0),
    ("<aside><p>Read also what others have read.</p></aside><div class=ad>Buy this now.</div><div class=comments><p>I do not agree, said a reader.</p></div>", 0),
    ("<p>Prose outside of any frame, with several clauses, that goes on for a while and ends here.</p>", 1),
    ("<p>" + "a page of one paragraph without marks " * 40 + "</p>", 1),
    ("Plain text, and nothing else.", 1),
    ("<div>A text in one element of no name, of some sentences. It is all there is on the page.</div>", 1),
    ("<div><a href=x>More</a></div><div><a href=y>Next page</a></div>", 0),
)


def train(pages: list[str | None], steps: int = 300, penalty: float = 1e-3) -> np.ndarray:
    """Weights of a logistic classifier of blocks, by Newton steps on a ridge-penalised likelihood."""
    x, y, w = [], [], []
    for page in pages:
        known = [b for b in blocks_of(page or "") if b.role]
        if known:
            x.append(features(known))
            y += [b.role > 0 for b in known]
            w += [abs(b.role) / STRONG for b in known]
    for page, label in PROTOTYPES:
        own = blocks_of(page)
        x.append(features(own))
        y += [label] * len(own)
        w += [20.0] * len(own)
    x, y, w = np.concatenate(x), np.array(y, float), np.array(w)
    beta = np.zeros(x.shape[1])
    for _ in range(min(steps, 30)):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        gradient = x.T @ (w * (y - p)) - penalty * len(y) * beta
        curvature = (x * (w * p * (1 - p))[:, None]).T @ x + penalty * len(y) * np.eye(len(beta))
        step = np.linalg.solve(curvature, gradient)
        beta += step
        if np.abs(step).max() < 1e-8:
            break
    return beta


def _edges(blocks: list[Block], smooth: float) -> list[tuple[int, int, float]]:
    """Neighbours, and the next block of the same parent, weighted by the steps between them in the element tree.

    Blocks under different roles and of different elements, such as a paragraph and an advert beside it, are less alike."""
    out: dict[tuple[int, int], float] = {}
    last: dict[int, int] = {}
    for i, b in enumerate(blocks):
        alike = lambda o: smooth * (UNLIKE if o.node != b.node and o.tag != b.tag else 1.0)  # noqa: E731, B023
        if i:
            steps = blocks[i - 1].depth + b.depth - 2 * b.shared
            out[i - 1, i] = alike(blocks[i - 1]) * 4.0 ** -max(0, steps - 2)
        j = last.get(b.parent, -1)
        if j >= 0:
            out[j, i] = alike(blocks[j])
        last[b.parent] = i
    return [(i, j, w) for (i, j), w in out.items()]


#: Capacities are whole numbers of this part of a log-odds unit, so no path of the flow is longer than edges can feed.
UNIT = 1 / 256


def content_side(supply: np.ndarray, edges: list[tuple[int, int, float]]) -> np.ndarray:
    """Labels of a minimum cut: supply > 0 is a node's net capacity from the content terminal, < 0 to the other.

    Each node with supply left sends it along shortest paths of the residual graph to nodes with demand left.
    What a node reaches without finding demand can never reach any again: it is settled as content, and later
    searches stop there. At the end the content side is what supply still reaches.
    """
    n = len(supply)
    left = np.rint(np.asarray(supply, float) / UNIT).astype(np.int64).tolist()
    links: list[list[int]] = [[] for _ in range(n)]
    to, room = [], []
    for i, j, w in edges:
        w = round(w / UNIT)
        links[i].append(len(to))
        links[j].append(len(to) + 1)
        to += [j, i]
        room += [w, w]
    settled = [False] * n
    for source in range(n):
        while left[source] > 0 and not settled[source]:
            came, queue, end = {source: -1}, deque([source]), -1
            while queue and end < 0:
                i = queue.popleft()
                for e in links[i]:
                    j = to[e]
                    if room[e] and j not in came and not settled[j]:
                        came[j] = e
                        if left[j] < 0:
                            end = j
                            break
                        queue.append(j)
            if end < 0:
                for i in came:
                    settled[i] = True
                break
            path, at = [], end
            while came[at] >= 0:
                path.append(came[at])
                at = to[came[at] ^ 1]
            flow = min(left[source], -left[end], *(room[e] for e in path))
            left[source] -= flow
            left[end] += flow
            for e in path:
                room[e] -= flow
                room[e ^ 1] += flow
    return np.array(settled, bool)


#: Most that the classifier says of a block.
MOST = 4.0


def labels(blocks: list[Block], weights: np.ndarray, smooth: float = 1.0) -> np.ndarray:
    """Which blocks are content. The classifier's log-odds and the role are the difference of the two labels' costs."""
    supply = np.clip(features(blocks) @ weights, -MOST, MOST) + np.array([b.role for b in blocks], float)
    return content_side(supply, _edges(blocks, smooth)) if len(blocks) and supply.min() < 0 < supply.max() else supply > 0


def main_blocks(page: str, weights: np.ndarray, smooth: float = 1.0) -> list[str]:
    blocks = blocks_of(page)
    return [b.text for b, keep in zip(blocks, labels(blocks, weights, smooth)) if keep] if blocks else []


def judge(pages: DataFrame, train_pages: int = TRAIN_PAGES, smooth: float = 1.0) -> DataFrame:
    """One row per page: page_id, url, text, n_chars."""
    spark = pages.sparkSession
    # The least ids are found among ids alone; then only their pages, one of each id, come to the driver.
    chosen = pages.select("page_id").where("page_id is not null").distinct().orderBy("page_id").limit(train_pages)
    sample = pages.join(F.broadcast(chosen), "page_id").groupBy("page_id").agg(F.max("html").alias("html"))
    weights = train([r["html"] for r in sample.orderBy("page_id").collect()])
    _text.bounded_batches(spark)
    kind = pages.schema["page_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = ["\n".join(main_blocks(h.as_py() or "", weights, smooth)) for h in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", F.col("html")).mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long")
