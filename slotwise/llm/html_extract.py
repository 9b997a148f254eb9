"""HTML extraction: minimum-cut labelling of text blocks.

A page is cut into text blocks at block-level tags.  A classifier of fixed
log-odds scores each block (ancestors, class names, links, sentences).  The
scores become terminal capacities of a graph (source: content, sink:
boilerplate); blocks next to each other in the page and blocks with the same
DOM parent are joined by smoothness edges, weaker the further apart they are
in the DOM.  The minimum cut labels all blocks at once.

Pages are independent, so the Spark side is a narrow map; a page needs memory
in proportion to its own size only.

Defined cases: a null or blank page and a page without content give an empty
text; unclosed, misnested and truncated markup is read as far as it goes: a
control that is never closed hides nothing, a "<" that opens no tag is text.
Reading takes time in proportion to the page, however deep it is nested.
"""

from __future__ import annotations

import html
import re
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from slotwise.llm.common import column, read_table

# fixed values: element classes of the HTML standard
BLOCK_TAGS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody tfoot thead tr ul caption".split()
)
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SILENT_TAGS = frozenset("head script style noscript template svg math iframe object canvas audio video textarea select button title".split())
RAW_TAGS = frozenset("script style noscript template svg math iframe textarea title".split())
#: Start tags that can stand in a head; any other, and text, ends an open head as its end tag may be left out.
HEAD_TAGS = frozenset("base basefont bgsound link meta noframes noscript script style template title".split())
#: Tags inside which an item or paragraph of the surrounding element stays open.
SCOPE_TAGS = frozenset("ul ol dl table div section article aside main nav body".split())
ITEM_TAGS = ("li", "dt", "dd", "tr", "option")
#: Controls and embedded objects: silent only if the page closes them.
CLOSED_TAGS = SILENT_TAGS - RAW_TAGS - {"head"}
SPACING_TAGS = frozenset("br td th img hr".split())
# fixed values: tags and class words that tell boilerplate or content
BAD_TAGS = frozenset("nav footer aside form header menu dialog fieldset search".split())
GOOD_TAGS = frozenset("article main".split())
BAD_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies "
    "copyright disqus dialog footer gdpr header login masthead menu modal nav navbar navigation newsletter notice notices notification "
    "overlay pager pagination paywall popup promo promoted promotion recommended related replies respond share sharing sidebar signup "
    "skip social sponsor sponsored subscribe tags toolbar topbar widget widgets alert hidden".split()
)
GOOD_WORDS = frozenset("article articlebody content entry main post story text body".split())

_TAG = re.compile(
    r"<!--(?:-?>|.*?(?:--!?>|\Z))"
    r"|<(?!(?:svg|math)\b(?:[^>\"']++|\"[^\"<]*+\"|'[^'<]*+'|[\"'])*+(?<=/)>)"  # self-closed svg and math hold nothing
    r"(?P<raw>script|style|noscript|template|svg|math|iframe|textarea|title)\b[^>]*+>.*?(?:</(?P=raw)\s*+>|\Z)"
    r"|<(?P<end>/?)(?P<name>[a-zA-Z][a-zA-Z0-9:-]*+)(?P<attrs>(?>[^>\"']++|\"[^\"<]*+\"|'[^'<]*+'|[\"'])*+)(?:>|\Z)"
    r"|<[!?][^>]*+(?:>|\Z)"
    r"|</(?:>|[^a-zA-Z>][^>]*+(?:>|\Z))",
    re.S | re.I,
)
_CLOSERS = re.compile("</(" + "|".join(sorted(CLOSED_TAGS)) + r")\b", re.I)
_ATTR = re.compile(r"([a-zA-Z_:@-]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")
_WORDS = re.compile(r"[a-z]+")
_SENTENCE = re.compile(r"[.!?:;,…。！？]")


class _Node:
    """An element: tag, parent, depth, nearest block and scope (itself included), and signals."""

    __slots__ = ("tag", "parent", "depth", "block", "scope", "bad", "good", "chars", "heading", "hidden", "signal")

    def __init__(self, tag: str, parent: _Node | None, attrs: str = ""):
        self.tag, self.parent, self.depth = tag, parent, 0 if parent is None else parent.depth + 1
        self.block = self if parent is None or tag in BLOCK_TAGS else parent.block
        self.scope = self if parent is None or tag in SCOPE_TAGS else parent.scope
        self.chars, self.heading, self.hidden = 0, False, False
        self.signal = (False, False, False)
        self.bad, self.good = tag in BAD_TAGS, tag in GOOD_TAGS
        if attrs and ("=" in attrs or "hidden" in attrs):
            for key, value in _ATTR.findall(attrs):
                key = key.lower()
                if key in ("class", "id", "role", "itemprop"):
                    words = set(_WORDS.findall(re.sub(r"([a-z])([A-Z])", r"\1 \2", value).lower()))
                    self.bad = self.bad or bool(words & BAD_WORDS) or "complementary" in words or "contentinfo" in words
                    self.good = self.good or bool(words & GOOD_WORDS)
                elif key == "hidden" or (key == "aria-hidden" and "true" in value.lower()):
                    self.hidden = True
                elif key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value.lower()):
                    self.hidden = True


class Block:
    """One run of text between block-level tags."""

    __slots__ = ("text", "node", "linked")

    def __init__(self, text: str, node: _Node, linked: int):
        self.text, self.node, self.linked = text, node, linked


def blocks_of(page: str) -> list[Block]:
    """The text blocks of a page in page order."""
    root = _Node("#root", None)
    nodes, node, owner, links, silent = [root], root, root, 0, 0
    opened: dict[str, list[_Node]] = {}
    closed_at = _last_ends(page)
    parts: list[str] = []
    linked = 0
    out: list[Block] = []

    def flush() -> None:
        nonlocal parts, linked
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                out.append(Block(text, owner, linked))
                owner.chars += len(text)
        parts, linked = [], 0

    def innermost(name: str) -> _Node:
        found = opened.get(name)
        return found[-1] if found else root

    def close(target: _Node) -> None:
        nonlocal node, silent, links
        while target is not root:
            top, node = node, node.parent
            opened[top.tag].pop()
            silent -= top.tag in SILENT_TAGS
            links -= top.tag == "a"
            if top is target:
                return

    def said(text: str) -> None:
        nonlocal linked, owner
        if node.tag == "head" and text.strip():
            close(node)
        if silent:
            return
        if not parts:
            if not text.strip():
                return
            owner = node.block
        parts.append(text)
        if links:
            linked += len(text)

    at = 0
    for m in _TAG.finditer(page):
        if m.start() > at:
            said(page[at : m.start()])
        at = m.end()
        name = m.group("name")
        if name is None:
            continue
        name = name.lower()
        if name in SPACING_TAGS and parts:
            said(" ")
        if m.group("end"):
            target = innermost(name)
            if name in BLOCK_TAGS:
                flush()
                close(target)
            elif target.depth > node.block.depth:  # an inline end tag does not close blocks
                close(target)
            continue
        if silent and name not in HEAD_TAGS:
            close(innermost("head"))
        if name == "button":
            close(innermost("button"))
        if name in BLOCK_TAGS:
            flush()
            # a new block ends an open paragraph; an item ends the item before it
            ends = ("p", *ITEM_TAGS) if name in ITEM_TAGS else ("p",)
            target = max((innermost(t) for t in ends), key=lambda x: x.depth)
            if target.depth > node.scope.depth:
                close(target)
            if name == "h1":
                node.heading = True
        if name in VOID_TAGS or m.group("attrs").rstrip().endswith("/") or (name in CLOSED_TAGS and closed_at[name] < at):
            continue
        node = _Node(name, node, m.group("attrs"))
        nodes.append(node)
        opened.setdefault(name, []).append(node)
        silent += name in SILENT_TAGS
        links += name == "a"
    said(page[at:])
    flush()
    _set_signals(nodes)
    return out


def _last_ends(page: str) -> dict[str, int]:
    """Position of the last end tag of each control or embedded object, -1 without one."""
    found = dict.fromkeys(CLOSED_TAGS, -1)
    for m in _CLOSERS.finditer(page):
        found[m.group(1).lower()] = m.start()
    return found


def _set_signals(nodes: list[_Node]) -> None:
    """(boilerplate container, content container, hidden) of every element, ancestors included.

    Characters and headings are summed up the tree, signals handed down; parents stand
    before their children.  A boilerplate name on a container of the page's heading or of
    most of its text names the layout, not the text, and does not count.
    """
    for x in reversed(nodes[1:]):
        x.parent.chars += x.chars
        x.parent.heading = x.parent.heading or x.heading
    total = nodes[0].chars
    for x in nodes[1:]:
        bad, good, hidden = x.parent.signal
        if x.bad:
            fixed = x.tag in ("nav", "footer", "aside")
            most = x.chars > 0.6 * total
            own_heading = x.heading and (x.tag == "header" or x.chars > 0.3 * total)
            bad = bad or fixed or not (most or own_heading)
        x.signal = (bad, good or (x.good and x.tag != "body"), hidden or x.hidden)


def scores_of(blocks: list[Block]) -> list[float]:
    """Log-odds that a block is content (fixed weights)."""
    marked = any(b.node.signal[1] for b in blocks)
    out = []
    for b in blocks:
        bad, good, hidden = b.node.signal
        n = len(b.text)
        score = -0.6 + min(n, 200) / 100 + 0.3 * min(len(_SENTENCE.findall(b.text)), 4) - 4.0 * min(1.0, b.linked / n)
        if b.node.tag in ("h1", "h2", "h3", "h4", "h5", "h6", "p", "blockquote", "pre"):
            score += 0.8
        if good:
            score += 5.0
        elif marked:
            score -= 5.0
        if bad:
            score -= 14.0
        if hidden:
            score -= 30.0
        out.append(score)
    return out


def edges_of(blocks: list[Block]) -> list[tuple[int, int, float]]:
    """Smoothness edges: neighbours in the page, and neighbours under one DOM parent."""
    edges, last = [], {}
    for i, b in enumerate(blocks):
        if i:
            a, c, steps = blocks[i - 1].node, b.node, 0
            while a is not c and a is not None and c is not None:
                if a.depth >= c.depth:
                    a = a.parent
                else:
                    c = c.parent
                steps += 1
            edges.append((i - 1, i, 1.5 / (1 + steps)))
        parent = id(b.node.parent)
        if parent in last and last[parent] != i - 1:
            edges.append((last[parent], i, 0.5))
        last[parent] = i
    return edges


def min_cut(scores: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """True for nodes on the source (content) side of the minimum cut.

    Capacities: score > 0 from the source, score < 0 to the sink, edge weights
    both ways.  A node whose terminal capacity is not below the sum of its edges
    takes its own side in a minimum cut; such nodes are settled first and their
    edges move to the neighbours' terminals.  The rest is solved by augmenting
    along shortest paths (Dinic's phases).
    """
    n = len(scores)
    score, side = list(scores), [None] * n
    near: list[dict[int, float]] = [{} for _ in range(n)]
    for a, b, w in edges:
        near[a][b] = near[a].get(b, 0.0) + w
        near[b][a] = near[b].get(a, 0.0) + w
    todo = deque(range(n))
    while todo:
        i = todo.popleft()
        if side[i] is None and abs(score[i]) >= sum(near[i].values()):
            side[i] = score[i] > 0
            for j, w in near[i].items():
                del near[j][i]
                score[j] += w if side[i] else -w
                todo.append(j)
            near[i] = {}
    open_nodes = [i for i in range(n) if side[i] is None]
    if open_nodes:
        for i, content in zip(open_nodes, _max_flow(open_nodes, score, near)):
            side[i] = content
    return [bool(x) for x in side]


def _max_flow(nodes: list[int], score: list[float], near: list[dict[int, float]]) -> list[bool]:
    at = {i: k for k, i in enumerate(nodes)}
    source, sink = len(nodes), len(nodes) + 1
    to, cap, out = [], [], [[] for _ in range(len(nodes) + 2)]

    def link(a: int, b: int, w: float, back: float) -> None:
        out[a].append(len(to))
        to.append(b)
        cap.append(w)
        out[b].append(len(to))
        to.append(a)
        cap.append(back)

    for i in nodes:
        if score[i] > 0:
            link(source, at[i], score[i], 0.0)
        elif score[i] < 0:
            link(at[i], sink, -score[i], 0.0)
        for j, w in near[i].items():
            if i < j:
                link(at[i], at[j], w, w)
    eps = 1e-12
    while True:
        level = [-1] * len(out)
        level[source], queue = 0, deque([source])
        while queue:
            u = queue.popleft()
            for e in out[u]:
                if cap[e] > eps and level[to[e]] < 0:
                    level[to[e]] = level[u] + 1
                    queue.append(to[e])
        if level[sink] < 0:
            return [level[k] >= 0 for k in range(len(nodes))]
        step, path, u = [0] * len(out), [], source
        while True:
            if u == sink:
                push = min(cap[e] for e in path)
                for e in path:
                    cap[e] -= push
                    cap[e ^ 1] += push
                path, u = [], source
                continue
            while step[u] < len(out[u]):
                e = out[u][step[u]]
                if cap[e] > eps and level[to[e]] == level[u] + 1:
                    break
                step[u] += 1
            if step[u] < len(out[u]):
                path.append(out[u][step[u]])
                u = to[path[-1]]
            elif path:
                e = path.pop()
                u = to[e ^ 1]
                step[u] += 1
            else:
                break


def main_text(page: str | None) -> str:
    """Main text of one page: content blocks joined by a blank line."""
    if not page:
        return ""
    blocks = blocks_of(page)
    if not blocks:
        return ""
    keep = min_cut(scores_of(blocks), edges_of(blocks))
    return "\n\n".join(b.text for b, k in zip(blocks, keep) if k)


def extract(pages: DataFrame) -> DataFrame:
    """``pages`` without html, with ``text`` (a column of that name is replaced)."""
    rest = [c for c in pages.columns if c not in ("html", "text")]
    fields = [pages.schema[c] for c in rest]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x) for x in column(batch, "html").to_pylist()]
            yield pa.RecordBatch.from_arrays([*[column(batch, c) for c in rest], pa.array(texts, pa.string())], [*rest, "text"])

    source = pages.select(*[F.col(f"`{c}`") for c in rest], F.col("html").cast("string").alias("html"))
    return source.mapInArrow(run, T.StructType([*fields, T.StructField("text", T.StringType())]))


def op10_html_extract(spark, sf_dir: str) -> DataFrame:
    """Contract query: page_id, url, text, n_chars of every page."""
    pages = read_table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return extract(pages).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
