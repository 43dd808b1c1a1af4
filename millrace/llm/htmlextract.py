"""Main text of HTML pages by tag-path ratios.

Every text block of a page has a root-to-leaf tag path: its block elements, with the first class name of
generic ones, and a last step `a` where most of the block is link text; formatting elements are no steps.  For every path
the text length and the punctuation of its blocks are summed and divided by their number.  Both ratios are
laid out in page order, smoothed, and fused with the path's own ratio; a path scores the mean of its blocks.

Paths that score at least a threshold, which follows the page's text, are content.  The content box is the deepest element that
holds nearly all content, widened until it holds all blocks on its content's paths, and to its article or main element where there is one.  In it a block is
returned if its path reaches LENIENT of the threshold, or if it is a paragraph, heading, list item, cell, quote
or the like and not mostly link text; so a short paragraph of an article stays, and a row of share links goes.

Roles of elements are an input beside the ratios: scripts, forms, menus, footers and their like never count; elements
that only a class or id marks as boilerplate go, unless they hold an article, a main element, the page's h1, or three quarters of
the text in three paragraphs or more; where article or main elements hold a tenth of the text, or a main
heading, only their blocks are scored.  Inside an article's own header only headings are kept.

Defined cases: null or empty html gives an empty text; a page without content text gives an empty text;
unclosed, misnested and unknown tags, comments without end and bare `<` are read as browsers read them, as
far as text goes; a line break element counts as white space; pages of any length or depth are read whole, in
memory and time that follow their length; repeated rows give repeated rows; null page_id or url are kept;
extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import spread

# Elements by role in a page, and words of class, id and role that mark boilerplate.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe noembed noframes xmp".split())
DROPPED = frozenset("script style noscript template head title iframe object svg canvas select option button textarea form nav footer aside dialog menu search datalist noembed noframes".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead title tr ul".split()
)
CLOSES_P = BLOCKS - frozenset("body caption head html legend li dd dt option optgroup td th tr tbody thead tfoot title".split()) | {"li", "dd", "dt"}
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
MARKS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense adsbygoogle sponsor sponsored sponsors promo promos promotion banner banners nav navbar navigation menu menus breadcrumb breadcrumbs "
    "sidebar sidebars aside footer footers masthead notice notices cookie cookies consent gdpr alert popup modal newsletter subscribe paywall comment comments commentlist disqus replies reply reviews "
    "share sharing social related recommended recommendations widget widgets toolbar pagination pager skip login signup search".split()
)
READERS = frozenset("comment comments commentlist replies reply".split())
WIDE = frozenset(["article", "main"])
LEAF_BLOCKS = HEADINGS | frozenset("p li dd dt td th tr tbody thead tfoot table ul ol dl blockquote pre figcaption figure caption summary details address hgroup center".split())

TAG = re.compile(r"<(?:!--|!|\?|/?[A-Za-z])")
NAME = re.compile(r"</?([A-Za-z][^\s/>]*)")
ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
PARTS = re.compile(r"[a-z]+|[A-Z]+(?![a-z])|[A-Z][a-z]+|\d+")
PUNCTUATION = re.compile(r"[.,;:!?…。，！？]")
GENERIC = frozenset("div section ul ol table".split())
#: Blocks that are content by their element wherever they stand in the content box, unless they are mostly link text.
COMPANIONS = HEADINGS | WIDE | frozenset("p li dd dt td th pre blockquote caption figcaption summary address".split())

#: Least share of the content, text by score, in the box; share of the text-weighted mean score that content paths reach, and the score that is enough.
BOX, SHARE, ENOUGH = 0.85, 0.6, math.log1p(100) * (1 + math.log1p(2))
#: Share of the threshold that a path inside the box must reach.
LENIENT = 0.7


@dataclass
class Tree:
    """Elements in page order as columns; parents come before their children."""

    tag: list[str] = field(default_factory=lambda: ["#"])
    parent: list[int] = field(default_factory=lambda: [0])
    path: list[int] = field(default_factory=lambda: [0])  # number of the tag path, formatting elements left out
    block: list[int] = field(default_factory=lambda: [0])  # nearest block element, itself included
    out: list[bool] = field(default_factory=lambda: [False])  # boilerplate by element or role, or inside such
    marked: list[int] = field(default_factory=lambda: [0])  # 1: class or id marks boilerplate, 2: reader comments
    inside: list[bool] = field(default_factory=lambda: [False])  # in an article or main element
    head: list[int] = field(default_factory=lambda: [0])  # 1: in an article's header, 2: in a heading there
    link: list[bool] = field(default_factory=lambda: [False])
    steps: dict[tuple[int, str], int] = field(default_factory=dict)

    def step(self, path: int, name: str) -> int:
        """The number of a path one step longer: paths are pairs of a shorter path and a step, never whole texts."""
        return self.steps.setdefault((path, name), len(self.steps) + 1)

    def add(self, tag: str, name: str, parent: int, out: bool, marked: int) -> int:
        at = len(self.tag)
        self.tag.append(tag)
        self.parent.append(parent)
        is_block = tag in BLOCKS
        self.path.append(self.step(self.path[parent], name) if is_block or tag == "a" else self.path[parent])
        self.block.append(at if is_block else self.block[parent])
        self.out.append(out)
        self.marked.append(marked)
        self.inside.append(self.inside[parent] or tag in WIDE)
        before = self.head[parent]
        self.head.append(0 if tag in WIDE else 1 if tag == "header" else 2 if before == 1 and tag in HEADINGS else before)
        self.link.append(self.link[parent] or tag == "a")
        return at


@dataclass
class Block:
    node: int
    path: int
    text: str
    linked: bool


def _tag_end(page: str, at: int) -> int:
    """Place after the `>` that ends a tag; quoted values may hold `>`."""
    end = page.find(">", at)
    if end < 0:
        return len(page)
    if '"' not in page[at:end] and "'" not in page[at:end]:
        return end + 1
    quote, i, n = "", at, len(page)
    before = ""
    while i < n:
        c = page[i]
        if quote:
            if c == quote:
                quote = ""
        elif c in "\"'" and before == "=":
            quote = c
        elif c == ">":
            return i + 1
        if not c.isspace():
            before = c
        i += 1
    return end + 1  # a quote without end: take the first bracket


def _role(tag: str, attributes: str, inside: bool) -> tuple[bool, int, str]:
    """Whether element and role make it boilerplate, what its class and id mark it as, and its step in a path."""
    if tag in DROPPED:
        return True, 0, tag
    if tag == "header" and not inside:
        return True, 0, tag
    if not attributes or attributes.isspace():
        return False, 0, tag
    values: dict[str, str] = {}
    for name, a, b, c in ATTRIBUTE.findall(attributes):
        values.setdefault(name.lower(), a or b or c)
    classes = html.unescape(values.get("class", "")).split()
    name = f"{tag}.{classes[0]}" if classes and tag in GENERIC else tag
    if tag in ("html", "body", "main"):
        return False, 0, name
    names = [*classes, *html.unescape(values.get("id", "")).split()]
    words = {p.lower() for w in names for p in PARTS.findall(w)} | {"".join(c for c in w.lower() if c.isalpha()) for w in names}
    comments = 2 if words & READERS else 0
    if tag == "article":
        return False, comments, name
    if values.get("role", "").lower() in ROLES:
        return True, 0, name
    if tag in ("div", "section") and not inside and "header" in words:
        return False, 1, name
    return False, comments or int(bool(words & MARKS)), name


def parsed(page: str) -> tuple[Tree, list[Block]]:
    """The elements of a page, and its text blocks outside boilerplate known by element or role."""
    tree = Tree()
    stack = [0]
    open_ = Counter({"#": 1})
    found: list[Block] = []
    pieces: list[str] = []
    first, linked, total = -1, 0, 0
    at, n = 0, len(page)

    def flush() -> None:
        nonlocal first, linked, total
        if pieces:
            text = " ".join(html.unescape("".join(pieces)).split())
            if text and first >= 0:
                link = 2 * linked > total
                path = tree.path[tree.block[first]]
                found.append(Block(first, tree.step(path, "a") if link else path, text, link))
            pieces.clear()
        first, linked, total = -1, 0, 0

    def text(data: str) -> None:
        nonlocal first, linked, total
        top = stack[-1]
        if tree.out[top] or not data:
            return
        pieces.append(data)
        if not data.isspace():
            first = top if first < 0 else first
            total += len(data)
            linked += len(data) * tree.link[top]

    def cut(place: int) -> None:
        for node in stack[place:]:
            open_[tree.tag[node]] -= 1
        del stack[place:]

    def close_to(tag: str, stop: frozenset[str]) -> bool:
        if not open_[tag]:
            return False
        for i in range(len(stack) - 1, 0, -1):
            here = tree.tag[stack[i]]
            if here == tag:
                cut(i)
                return True
            if here in stop:
                return False
        return False

    while at < n:
        m = TAG.search(page, at)
        if not m:
            text(page[at:])
            break
        if m.start() > at:
            text(page[at : m.start()])
        start = m.start()
        kind = m.group()
        if kind == "<!--":
            end = page.find("-->", start + 4)
            if page.startswith(">", start + 4):
                end = start + 2
            at = n if end < 0 else end + 3
            continue
        if kind in ("<!", "<?"):
            closing = "]]>" if page.startswith("<![CDATA[", start) else ">"
            end = page.find(closing, start)
            at = n if end < 0 else end + len(closing)
            continue
        name = NAME.match(page, start)
        tag = name.group(1).lower()
        at = _tag_end(page, name.end())
        if kind[1] == "/":
            if tag in BLOCKS:
                flush()
            if tag == "br":
                text(" ")
            elif tag not in ("html", "body"):
                close_to(tag, frozenset() if tag in TABLED or tag in WIDE else CELLS)
            continue
        if tag == "br":
            text(" ")
            continue
        if tag in BLOCKS:
            flush()
            if tag in CLOSES_P:
                close_to("p", frozenset(["button", "table", "td", "th", "div", "article", "section", "li", "blockquote", "body"]))
            if tag == "li":
                close_to("li", frozenset(["ul", "ol", "menu", "body"]))
            elif tag in ("dd", "dt"):
                if not close_to("dd", frozenset(["dl", "dt", "body"])):
                    close_to("dt", frozenset(["dl", "dd", "body"]))
            elif tag in ("td", "th"):
                if not close_to("td", frozenset(["tr", "th", "table", "body"])):
                    close_to("th", frozenset(["tr", "td", "table", "body"]))
            elif tag == "tr":
                close_to("tr", frozenset(["table", "body"]))
            elif tag in HEADINGS and tree.tag[stack[-1]] in HEADINGS:
                cut(len(stack) - 1)
        if tag == "option":
            close_to("option", frozenset(["select", "datalist", "body"]))
        if tag in ("html", "body") and open_[tag]:
            continue
        if tag == "body":
            cut(1 + (len(stack) > 1 and tree.tag[stack[1]] == "html"))
        elif tag in BLOCKS and tag not in ("head", "title", "html") and tree.tag[stack[-1]] == "head":
            cut(len(stack) - 1)
        if tag in VOID:
            continue
        parent = stack[-1]
        out, marked, step = _role(tag, page[name.end() : at].rstrip("/>"), tree.inside[parent])
        out |= tree.out[parent] or tree.tag[parent] == "header" and tree.inside[parent] and tag not in HEADINGS and tag not in ("hgroup", "div")
        node = tree.add(tag, step, parent, out, marked)
        if tag in RAW:
            end = _raw_end(tag).search(page, at)
            stop = end.start() if end else n
            if not out and tag not in DROPPED:
                stack.append(node)
                text(page[at:stop])
                stack.pop()
            at = _tag_end(page, stop) if end else n
            continue
        stack.append(node)
        open_[tag] += 1
    flush()
    return tree, [b for b in found if tree.head[b.node] != 1]


CELLS = frozenset("td th table html body".split())
TABLED = frozenset("table tr tbody thead tfoot td th body html".split())


def _raw_end(tag: str) -> re.Pattern:
    return re.compile(rf"</{tag}(?=[\s/>])", re.I)


def _sums(tree: Tree, weights: dict[int, float]) -> list[float]:
    """For each element the sum of the weights at and below it."""
    held: list[float] = [0] * len(tree.tag)
    for node, weight in weights.items():
        held[node] += weight
    for node in range(len(held) - 1, 0, -1):
        held[tree.parent[node]] += held[node]
    return held


def _unmarked(tree: Tree, found: list[Block]) -> list[Block]:
    """Leaves out the blocks of elements that class or id mark, but for marks on an element that holds the page's content."""
    if not any(tree.marked):
        return found
    size: Counter[int] = Counter()
    paragraphs: Counter[int] = Counter()
    kernel: Counter[int] = Counter()
    for b in found:
        size[b.node] += len(b.text)
        paragraphs[b.node] += tree.tag[tree.block[b.node]] == "p"
    for node, tag in enumerate(tree.tag):
        if (tag in WIDE or tag == "h1") and not tree.marked[node]:
            kernel[node] += 1
    sizes, paras, kernels = _sums(tree, size), _sums(tree, paragraphs), _sums(tree, kernel)
    gone = [False] * len(tree.tag)
    for node in range(1, len(gone)):
        mark = tree.marked[node]
        whole = bool(kernels[node]) and tree.tag[node] != "article" or mark == 1 and 4 * sizes[node] >= 3 * sizes[0] and paras[node] >= 3
        gone[node] = gone[tree.parent[node]] or bool(mark) and not whole
    return [b for b in found if not gone[b.node]]


def path_ratios(found: list[Block]) -> tuple[list[float], list[float]]:
    """For each block, its path's text length and its path's punctuation over the number of the path's blocks, as logarithms."""
    length: Counter[int] = Counter()
    marks: Counter[int] = Counter()
    number: Counter[int] = Counter()
    for b in found:
        length[b.path] += len(b.text)
        marks[b.path] += len(PUNCTUATION.findall(b.text))
        number[b.path] += 1
    return [math.log1p(length[b.path] / number[b.path]) for b in found], [math.log1p(marks[b.path] / number[b.path]) for b in found]


def smoothed(series: list[float]) -> list[float]:
    """A Gaussian window of one neighbour on either side."""
    side = math.exp(-0.5)
    padded = [series[0], *series, series[-1]]
    return [(side * padded[i] + padded[i + 1] + side * padded[i + 2]) / (1 + 2 * side) for i in range(len(series))]


def path_scores(found: list[Block]) -> dict[int, float]:
    """The fused ratio of each path: the mean over its blocks of own and smoothed ratios, both of length and punctuation."""
    lengths, marks = path_ratios(found)
    sums: dict[int, float] = {}
    number = Counter(b.path for b in found)
    for b, own, near, dots, dots_near in zip(found, lengths, smoothed(lengths), marks, smoothed(marks), strict=True):
        sums[b.path] = sums.get(b.path, 0.0) + math.sqrt(own * near) * (1 + math.sqrt(dots * dots_near))
    return {path: total / number[path] for path, total in sums.items()}


def main_text(page: str | None) -> str:
    tree, found = parsed(page or "")
    found = _unmarked(tree, found)
    if not found:
        return ""
    own = [b for b in found if tree.inside[b.node]]
    if any(tree.tag[tree.block[b.node]] == "h1" for b in own) or 10 * sum(len(b.text) for b in own) >= sum(len(b.text) for b in found):
        found = own
    scores = path_scores(found)
    total = sum(len(b.text) for b in found)
    threshold = min(SHARE * sum(scores[b.path] * len(b.text) for b in found) / total, ENOUGH)
    within = _below(tree, _box(tree, [b for b in found if scores[b.path] >= threshold], scores))
    return "\n".join(b.text for b in found if within[b.node] and (scores[b.path] >= LENIENT * threshold or _companion(tree, b)))


def _companion(tree: Tree, b: Block) -> bool:
    tag = tree.tag[tree.block[b.node]]
    return tag in HEADINGS or tag in COMPANIONS and not b.linked


def _below(tree: Tree, box: int) -> list[bool]:
    within = [False] * len(tree.tag)
    for node in range(len(within)):
        within[node] = node == box or node > 0 and within[tree.parent[node]]
    return within


def _box(tree: Tree, content: list[Block], scores: dict[int, float]) -> int:
    """The deepest element with at least BOX of the content, widened to blocks on its paths, and to its article, main or section of blocks."""
    size: dict[int, float] = {}
    for b in content:
        size[b.node] = size.get(b.node, 0) + scores[b.path] * len(b.text)
    held = _sums(tree, size)
    box = 0
    for node in range(1, len(held)):  # the elements that hold so much of the text lie on one line of descent
        if tree.parent[node] == box and held[node] >= BOX * held[0]:
            box = node
    within = _below(tree, box)
    paths = {b.path for b in content if within[b.node]}
    number = Counter(b.node for b in content if b.path in paths)
    same = _sums(tree, number)
    while same[box] < same[0]:
        box = tree.parent[box]
    at = box
    while at:
        if tree.tag[at] in WIDE:
            return at
        at = tree.parent[at]
    while box and (tree.tag[box] in LEAF_BLOCKS or tree.tag[box] not in BLOCKS):
        box = tree.parent[box]
    return box


def extracted(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(p) for p in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return spread(pages.select(F.col("page_id").cast("long"), "url", "html")).mapInArrow(run, "page_id long, url string, text string, n_chars long")
