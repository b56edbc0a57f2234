"""Main text of web pages by minimum-cut labelling of text blocks.

A page is cut into blocks of text at block-level tags. A fixed linear
classifier on a block's own text and its ancestors gives the log-odds, a few
nats, that it is content; they are capacities from the two terminals. Blocks
that follow each other, and blocks in the same container, are joined by
smoothness edges of like size that weaken with their distance in the document
tree. The minimum cut, found by max-flow, is the cheapest labelling. A page
that keeps nothing so, one of a few words say, is cut again with the odds of
all blocks raised until its likeliest block is content, if that takes at most
``RAISE`` nats.

Null and empty pages, and pages of nothing but boilerplate, give an empty
text. Nesting may be of any depth. Markup may be broken: unclosed, unopened or cut-off tags are borne; only
an unclosed comment or raw-text element (script, style, ...) takes the rest.
Repeated rows give repeated results; an empty table gives an empty result.
Input columns that clash with an output give way to it.
"""

from __future__ import annotations

import html
import re
from collections import Counter, deque

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cladelake.llm import shared

OUTPUTS = [T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType()), T.StructField("n_blocks", T.IntegerType()), T.StructField("n_kept", T.IntegerType())]

#: Comments, raw-text elements, tags (quoted values may hold >), tags cut off by the end.
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style)\b(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)|<[!?][^>]*(?:>|\Z)",
    re.S | re.I,
)
#: Other elements whose inside is no text; without a close tag only their open tag is skipped. Those of ``ALONE`` hold none of their kind.
ALONE = {t: re.compile(rf"<(?:(/){t}\s*>|{t}(?=[\s/>]))", re.I) for t in "title iframe noscript textarea button select canvas audio video".split()}
CLOSED = ALONE | {t: re.compile(rf"<(/){t}\s*>", re.I) for t in "svg math object template".split()}
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
SPACED = frozenset("br img td th input".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
LEAF = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd blockquote pre tr td th figcaption caption summary".split())
#: What closes itself when one of its kind opens.
CLOSES = {"li": ("li", ("ul", "ol", "menu")), "dt": ("dt dd", ("dl",)), "dd": ("dt dd", ("dl",)), "tr": ("tr td th", ("table",)), "td": ("td th", ("tr", "table")), "th": ("td th", ("tr", "table")), "option": ("option", ("select",))}
NAMED = re.compile(r"(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
PLAIN = re.compile(r"[a-z0-9]+")
#: Words in class, id and role that speak of boilerplate, or may do so, and of content.
BOILER_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising adbox adslot banner sponsor sponsored sponsors promo promoted nav navbar navigation menu submenu breadcrumb breadcrumbs footer foot copyright masthead topbar toolbar sidebar aside rail widget widgets "
    "cookie cookies consent gdpr notice notices popup modal overlay subscribe subscription newsletter signup login signin searchbox sharing pagination pager comment comments commentlist disqus reply replies respond complementary contentinfo".split()
)
MAYBE_WORDS = frozenset("promotion legal header side alert register form search share social follow related recommended recommendations more discussion feedback skip tags".split())
CONTENT_WORDS = frozenset("article post entry story content main maincontent body text prose blog".split())
#: Nats that an ancestor takes or gives.
BOILER_TAGS = {"nav": 3.0, "footer": 3.0, "aside": 3.0, "menu": 2.0, "dialog": 2.0, "header": 1.5, "form": 1.0, "fieldset": 1.0}
WORD_SAYS, MAYBE_SAYS, HIDDEN_SAYS, ARTICLE_SAYS, CONTENT_SAYS = 3.0, 1.0, 3.0, 0.8, 0.5
ENDS = re.compile(r"[.!?…。！？:;][\"'”’)\]]*$")
RIGHTS = re.compile(r"©|\(c\)\s*\d{4}|all rights reserved|cookie|privacy policy|terms of (?:use|service)", re.I)
#: Weights of edges between neighbours and within a container.
NEAR, SAME, SPAN = 1.0, 0.8, 4.0
RAISE = 2.5


class Box:
    """A block-level element: its parent, depth, and what it and those around it say of their inside."""

    __slots__ = ("parent", "depth", "tag", "boiler", "content")

    def __init__(self, parent: Box | None, tag: str, boiler: float, content: float) -> None:
        self.parent, self.tag, self.boiler, self.content = parent, tag, boiler, content
        self.depth = parent.depth + 1 if parent else 0


class Block:
    __slots__ = ("text", "linked", "box")

    def __init__(self, text: str, linked: int, box: Box) -> None:
        self.text, self.linked, self.box = text, linked, box


def _opinion(tag: str, attrs: str, in_article: bool) -> tuple[float, float]:
    """Nats that an element takes from its inside as boilerplate, and gives it as content."""
    boiler = BOILER_TAGS.get(tag, 0.0)
    head = tag == "header" and in_article
    if head:
        boiler = 0.3
    content = ARTICLE_SAYS if tag in ("article", "main") else 0.0
    if attrs and tag not in ("body", "html"):
        for m in NAMED.finditer(attrs):
            names = PLAIN.findall((m[1] or m[2] or m[3] or "").lower())
            if not head and any(n in BOILER_WORDS for n in names):
                boiler = max(boiler, WORD_SAYS)
            elif not head and any(n in MAYBE_WORDS for n in names):
                boiler = max(boiler, MAYBE_SAYS)
            elif any(n in CONTENT_WORDS for n in names):
                content = max(content, CONTENT_SAYS)
        if "hidden" in attrs and re.search(r"\bhidden\b|display\s*:\s*none", attrs):
            boiler = max(boiler, HIDDEN_SAYS)
    return boiler, content


def blocks_of(page: str) -> list[Block]:
    """Blocks of text in page order."""
    root = Box(None, "", 0.0, 0.0)
    # open elements: tag, innermost block-level element, links around; and how many of each tag are open
    stack: list[tuple[str, Box, int]] = [("", root, 0)]
    open_tags: Counter[str] = Counter()
    out: list[Block] = []
    parts: list[str] = []
    linked, at = 0, 0

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                out.append(Block(text, linked, stack[-1][1]))
            parts.clear()
        linked = 0

    def add(raw: str) -> None:
        nonlocal linked
        if "&" in raw:
            raw = html.unescape(raw)
        parts.append(raw)
        if stack[-1][2]:
            linked += len(raw.strip())

    def close_from(k: int) -> None:
        for tag, _, _ in stack[k:]:
            open_tags[tag] -= 1
        del stack[k:]

    unclosed = set()
    while m := TOKEN.search(page, at):
        if m.start() > at:
            add(page[at : m.start()])
        at = m.end()
        close, tag, attrs = (m[2], m[3], m[4]) if m[3] is not None else (m[5], m[6], m[7])
        if tag is None:
            continue  # a comment, a declaration or an element without text
        tag = tag.lower()
        if tag in CLOSED and not close:
            if not attrs.endswith("/") and tag not in unclosed:
                end = CLOSED[tag].search(page, at)
                if end is None:
                    unclosed.add(tag)
                elif end[1]:
                    at = end.end()
            continue
        inline = tag in INLINE
        if tag in SPACED:
            parts.append(" ")
        elif not inline:
            flush()
        if close:
            for k in range(len(stack) - 1, 0, -1) if open_tags[tag] > 0 else ():
                if stack[k][0] == tag:
                    close_from(k)
                    break
                if inline and stack[k][0] not in INLINE:
                    break
            continue
        if tag in VOID:
            continue
        if not inline:
            ends, bounds = CLOSES.get(tag, ("", ()))
            for k in range(len(stack) - 1, 0, -1):
                name = stack[k][0]
                if name == "p" and tag not in ("td", "th") or name in ends.split():
                    close_from(k)
                    break
                if name in bounds or name not in INLINE and name != "p" and not ends:
                    break
        _, box, links = stack[-1]
        if not inline:
            boiler, content = _opinion(tag, attrs, box.content >= ARTICLE_SAYS)
            box = Box(box, tag, max(box.boiler, boiler), max(box.content, content))
        stack.append((tag, box, links + (tag == "a")))
        open_tags[tag] += 1
    if at < len(page):
        add(page[at:])
    flush()
    return out


def evidence(b: Block) -> float:
    """Log-odds that a block is content, from the block and what is around it."""
    n = len(b.text)
    z = -1.5 + b.box.content - b.box.boiler + 0.8 * min(n / 100, 3.0) - 3.0 * min(1.0, b.linked / n)
    if b.box.tag in ("p", "blockquote", "pre"):
        z += 0.5
    elif b.box.tag in ("h1", "h2", "h3", "h4"):
        z += 0.3
    if ENDS.search(b.text[-8:]):
        z += 0.5
    if n < 200 and RIGHTS.search(b.text):
        z -= 0.8
    return z


def tree_distance(a: Box, b: Box) -> int:
    """Steps from one element to the other by way of the element around both."""
    steps = 0
    while a is not b:
        if a.depth >= b.depth:
            a = a.parent
        else:
            b = b.parent
        steps += 1
    return steps


def edges_of(blocks: list[Block]) -> list[tuple[int, int, float]]:
    """Smoothness between neighbours, and between blocks that share a container."""
    out, last = [], {}
    for i, b in enumerate(blocks):
        box = b.box.parent if b.box.tag in LEAF and b.box.parent else b.box
        if i:
            out.append((i - 1, i, NEAR / (1 + max(0, tree_distance(blocks[i - 1].box, b.box) - 2))))
        if (j := last.get(box, i - 1)) < i - 1:
            out.append((j, i, SAME / (1 + (i - j) / SPAN)))
        last[box] = i
    return out


def min_cut(gain: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """The labelling with the greatest total gain of true nodes less weights of cut edges.

    ``gain[i]`` is what node i costs as false less what it costs as true.
    Nodes whose gain outweighs all their open edges are settled first, which
    never loses the optimum; max-flow (Dinic) settles the rest.
    """
    n = len(gain)
    gain = list(gain)
    near: list[list[tuple[int, float]]] = [[] for _ in range(n)]
    for a, b, w in edges:
        near[a].append((b, w))
        near[b].append((a, w))
    open_ = [sum(w for _, w in x) for x in near]
    label: list[bool | None] = [None] * n
    queue = deque(range(n))
    while queue:
        i = queue.popleft()
        if label[i] is not None or abs(gain[i]) < open_[i]:
            continue
        label[i] = gain[i] > 0
        for j, w in near[i]:
            if label[j] is None:
                gain[j] += w if label[i] else -w
                open_[j] -= w
                queue.append(j)
    rest = [i for i in range(n) if label[i] is None]
    if rest:
        for i, side in zip(rest, _max_flow(rest, gain, near), strict=True):
            label[i] = side
    return [bool(x) for x in label]


def _max_flow(nodes: list[int], gain: list[float], near: list[list[tuple[int, float]]]) -> list[bool]:
    """Which nodes stay with the source after a maximum flow."""
    index = {i: k for k, i in enumerate(nodes)}
    s, t = len(nodes), len(nodes) + 1
    to: list[int] = []
    cap: list[float] = []
    out: list[list[int]] = [[] for _ in range(t + 1)]

    def arc(a: int, b: int, there: float, back: float) -> None:
        out[a].append(len(to))
        to.append(b)
        cap.append(there)
        out[b].append(len(to))
        to.append(a)
        cap.append(back)

    for i in nodes:
        k = index[i]
        arc(s, k, max(gain[i], 0.0), 0.0)
        arc(k, t, max(-gain[i], 0.0), 0.0)
        for j, w in near[i]:
            if j in index and i < j:
                arc(k, index[j], w, w)
    tiny = 1e-9
    while True:
        level = [-1] * (t + 1)
        level[s] = 0
        queue = deque([s])
        while queue:
            a = queue.popleft()
            for e in out[a]:
                if cap[e] > tiny and level[to[e]] < 0:
                    level[to[e]] = level[a] + 1
                    queue.append(to[e])
        if level[t] < 0:
            return [level[k] >= 0 for k in range(len(nodes))]
        turn = [0] * (t + 1)
        path: list[int] = []
        a = s
        while True:
            if a == t:
                flow = min(cap[e] for e in path)
                for e in path:
                    cap[e] -= flow
                    cap[e ^ 1] += flow
                cut = next(k for k, e in enumerate(path) if cap[e] <= tiny)
                a = to[path[cut] ^ 1]
                del path[cut:]
                continue
            while turn[a] < len(out[a]):
                e = out[a][turn[a]]
                if cap[e] > tiny and level[to[e]] == level[a] + 1:
                    break
                turn[a] += 1
            if turn[a] < len(out[a]):
                path.append(e)
                a = to[e]
            elif a == s:
                break
            else:
                level[a] = -1
                a = to[path.pop() ^ 1]


def main_text(page: str | None) -> tuple[str, int, int]:
    """The page's main text, and how many blocks it has and keeps."""
    blocks = blocks_of(page) if page else []
    if not blocks:
        return "", 0, 0
    gain, edges = [evidence(b) for b in blocks], edges_of(blocks)
    label = min_cut(gain, edges)
    if not any(label) and max(gain) >= -RAISE:
        # the likeliest block must outweigh all that joins it to others
        more = 1e-6 - max(gain) + sum(w for a, b, w in edges if gain.index(max(gain)) in (a, b))
        label = min_cut([g + more if g >= -RAISE else g for g in gain], edges)
    kept = [b.text for b, yes in zip(blocks, label, strict=True) if yes]
    return "\n".join(kept), len(blocks), len(kept)


def extract(pages: DataFrame, html_col: str = "html", keep: list[str] | None = None) -> DataFrame:
    """Adds ``text``, ``n_chars`` (code points), ``n_blocks`` and ``n_kept``."""

    def make():
        def step(raw: pa.Array) -> list:
            found = [main_text(p) for p in raw.to_pylist()]
            return [pa.array([f[0] for f in found], pa.string()), np.array([len(f[0]) for f in found], np.int64), np.array([f[1] for f in found], np.int32), np.array([f[2] for f in found], np.int32)]

        return step

    return shared.map_texts(pages, html_col, keep if keep is not None else pages.columns, OUTPUTS, make)


def op1_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"), keep=["page_id", "url"]).select("page_id", "url", F.coalesce("text", F.lit("")).alias("text"), "n_chars", "n_blocks", "n_kept")
