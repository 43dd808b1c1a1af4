"""A small HTML tree for row functions: tolerant of unclosed and misnested tags, with a CSS subset.

Children of a node are strings and nodes in document order; a comment is a node without a tag.  Documents
always have html, head and body.  Parsing never raises.
"""

from __future__ import annotations

import functools
import html
import re
from collections.abc import Iterator

# Element groups of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW_TEXT = frozenset(["script", "style"])
ESCAPABLE = frozenset(["title", "textarea"])
HEAD_ONLY = frozenset("title meta link base script style template noscript".split())
HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")
ENDS_PARAGRAPH = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section summary table ul li dd dt".split()
)
#: Opening tag: the open elements it closes, and the elements behind which they are not looked for.
IMPLIED_ENDS: dict[str, tuple[frozenset[str], frozenset[str]]] = {
    "li": (frozenset(["li"]), frozenset(["ul", "ol", "menu"])),
    "dt": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "dd": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "tr": (frozenset(["tr", "td", "th"]), frozenset(["table", "tbody", "thead", "tfoot"])),
    "td": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "th": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "tbody": (frozenset(["tbody", "thead", "tfoot"]), frozenset(["table"])),
    "thead": (frozenset(["tbody", "thead", "tfoot"]), frozenset(["table"])),
    "tfoot": (frozenset(["tbody", "thead", "tfoot"]), frozenset(["table"])),
    "option": (frozenset(["option"]), frozenset(["select", "datalist"])),
    "optgroup": (frozenset(["option", "optgroup"]), frozenset(["select"])),
}
#: Paragraphs are not looked for beyond these.
PARAGRAPH_SCOPE = frozenset("table td th caption button object html body".split())

_MARKUP = re.compile(r"<(?:(!--)|(!|\?)|(/?)([A-Za-z][^\s/>]*))")
_ATTRIBUTE = re.compile(r"""\s*/?\s*([^\s"'<>/=][^\s/>=]*)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]*))?""")


class Node:
    """An element, or a comment where tag is None."""

    __slots__ = ("tag", "attrs", "children", "parent")

    def __init__(self, tag: str | None, attrs: dict[str, str] | None = None, parent: Node | None = None):
        self.tag = tag
        self.attrs = attrs or {}
        self.children: list[Node | str] = []
        self.parent = parent

    def get(self, name: str, default: str | None = None) -> str | None:
        return self.attrs.get(name, default)

    def elements(self) -> Iterator[Node]:
        """Child elements."""
        return (c for c in self.children if isinstance(c, Node) and c.tag is not None)

    def descendants(self) -> Iterator[Node]:
        """Elements below this one in document order."""
        waiting = [self.elements()]
        while waiting:
            node = next(waiting[-1], None)
            if node is None:
                waiting.pop()
                continue
            yield node
            waiting.append(node.elements())

    def ancestors(self) -> Iterator[Node]:
        node = self.parent
        while node is not None:
            yield node
            node = node.parent

    def text(self) -> str:
        """All text below, comments left out."""
        parts: list[str] = []
        waiting: list[Iterator[Node | str]] = [iter(self.children)]
        while waiting:
            child = next(waiting[-1], None)
            if child is None:
                waiting.pop()
            elif isinstance(child, str):
                parts.append(child)
            elif child.tag is not None:
                waiting.append(iter(child.children))
        return "".join(parts)


class _Builder:
    def __init__(self) -> None:
        self.root = Node("html")
        self.head = Node("head", parent=self.root)
        self.body = Node("body", parent=self.root)
        self.root.children = [self.head, self.body]
        self.open: list[Node] = [self.root, self.head]

    @property
    def top(self) -> Node:
        return self.open[-1]

    def in_head(self) -> bool:
        return len(self.open) == 2 and self.top is self.head

    def enter_body(self) -> None:
        self.open = [self.root, self.body]

    def add_text(self, text: str) -> None:
        if not text:
            return
        if self.in_head():
            if text.isspace():
                return
            self.enter_body()
        children = self.top.children
        if children and isinstance(children[-1], str):
            children[-1] += text
        else:
            children.append(text)

    def pop_to(self, tags: frozenset[str], stop: frozenset[str]) -> bool:
        """Closes the innermost open element of these tags, unless one of `stop` is met first."""
        for i in range(len(self.open) - 1, 1, -1):
            if self.open[i].tag in tags:
                del self.open[i:]
                return True
            if self.open[i].tag in stop:
                return False
        return False

    def start(self, tag: str, attrs: dict[str, str], closed: bool) -> Node | None:
        if tag in ("html", "head", "body"):
            target = {"html": self.root, "head": self.head, "body": self.body}[tag]
            for k, v in attrs.items():
                target.attrs.setdefault(k, v)
            if tag == "body" and self.in_head():
                self.enter_body()
            return None
        if self.in_head() and tag not in HEAD_ONLY:
            self.enter_body()
        if tag in ENDS_PARAGRAPH:
            self.pop_to(frozenset(["p"]), PARAGRAPH_SCOPE)
        if tag in IMPLIED_ENDS:
            closes, stop = IMPLIED_ENDS[tag]
            while self.pop_to(closes, stop):
                pass
        node = Node(tag, attrs, self.top)
        self.top.children.append(node)
        if tag not in VOID:
            self.open.append(node)
        return node

    def end(self, tag: str) -> None:
        if tag == "head":
            if self.in_head():
                self.enter_body()
        elif tag == "p":
            if not self.pop_to(frozenset(["p"]), PARAGRAPH_SCOPE):
                self.start("p", {}, False)
                self.open.pop()
        elif tag == "br":
            self.start("br", {}, False)
        elif tag not in ("html", "body"):
            self.pop_to(frozenset([tag]), frozenset())


def _attributes(page: str, at: int) -> tuple[dict[str, str], int]:
    """Attributes of a tag from the place after its name, and the place after its `>`; the first of a name stands."""
    found: dict[str, str] = {}
    n = len(page)
    while at < n:
        if page[at] == ">":
            return found, at + 1
        m = _ATTRIBUTE.match(page, at)
        if m and m.end() > at:
            value = m.group(2) or ""
            if value[:1] in ('"', "'") and value[-1:] == value[:1] and len(value) > 1:
                value = value[1:-1]
            found.setdefault(m.group(1).lower(), html.unescape(value))
            at = m.end()
        else:
            at += 1
    return found, n


def parse(page: str) -> Node:
    """The html element of a page."""
    builder = _Builder()
    at, n = 0, len(page)
    while at < n:
        m = _MARKUP.search(page, at)
        if not m:
            builder.add_text(html.unescape(page[at:]))
            break
        if m.start() > at:
            builder.add_text(html.unescape(page[at : m.start()]))
        if m.group(1):
            end = page.find("-->", m.end())
            stop = n if end < 0 else end
            comment = Node(None, parent=builder.top)
            comment.children.append(page[m.end() : stop])
            builder.top.children.append(comment)
            at = n if end < 0 else end + 3
        elif m.group(2):
            end = page.find(">", m.end())
            at = n if end < 0 else end + 1
        else:
            tag = m.group(4).lower()
            attrs, at = _attributes(page, m.end())
            if m.group(3):
                builder.end(tag)
                continue
            node = builder.start(tag, attrs, False)
            if node is not None and (tag in RAW_TEXT or tag in ESCAPABLE):
                close = _closing(tag).search(page, at)
                stop = close.start() if close else n
                text = page[at:stop]
                if text:
                    node.children.append(text if tag in RAW_TEXT else html.unescape(text))
                builder.open.pop()
                at = n if close is None else _attributes(page, close.end())[1]
    return builder.root


@functools.lru_cache(16)
def _closing(tag: str) -> re.Pattern[str]:
    return re.compile(rf"</{tag}(?=[\s/>])", re.IGNORECASE)


def fragment_root(page: str) -> Node:
    """The element that stands for a page or fragment: html for a document, else the only element, else the body as a div or span."""
    root = parse(page)
    if re.match(r"\s*<(?:html|!doctype)", page, re.IGNORECASE):
        return root
    body = root.children[1]
    inner = list(body.elements())
    loose = any(isinstance(c, str) and c.strip() for c in body.children)
    if len(inner) == 1 and not loose:
        return inner[0]
    body.tag = "div" if any(d.tag in ENDS_PARAGRAPH for d in body.descendants()) else "span"
    return body


# --- selectors -------------------------------------------------------------------------------------------

_PART = re.compile(r"""\s*(>)?\s*((?:[A-Za-z][\w-]*|\*)?)((?:\#[\w-]+|\.[\w-]+|\[\s*[\w:-]+\s*(?:\^?=\s*(?:"[^"]*"|'[^']*'|[^\]\s]+)\s*)?\])*)""")
_TEST = re.compile(r"""\#([\w-]+)|\.([\w-]+)|\[\s*([\w:-]+)\s*(?:(\^?=)\s*("[^"]*"|'[^']*'|[^\]\s]+)\s*)?\]""")

Compound = tuple[bool, str, tuple[tuple[str, str, str], ...]]


@functools.lru_cache(512)
def compiled(selector: str) -> tuple[tuple[Compound, ...], ...]:
    """A selector list: tag, #id, .class, [a], [a=v], [a^=v], descendant and child combinators, commas."""
    groups = []
    for part in selector.split(","):
        rest, compounds = part.strip(), []
        at = 0
        while at < len(rest):
            m = _PART.match(rest, at)
            if not m or not (m.group(2) or m.group(3)):
                raise ValueError(f"unsupported selector: {selector!r}")
            tests = []
            for i, c, a, op, v in _TEST.findall(m.group(3)):
                value = v[1:-1] if v[:1] in ("'", '"') else v
                tests.append(("=", "id", i) if i else (".", "class", c) if c else (op or "has", a.lower(), value))
            compounds.append((bool(m.group(1)), "" if m.group(2) == "*" else m.group(2).lower(), tuple(tests)))
            at = m.end()
        if not compounds:
            raise ValueError(f"empty selector in {selector!r}")
        groups.append(tuple(compounds))
    return tuple(groups)


def _fits(node: Node, compound: Compound) -> bool:
    _, tag, tests = compound
    if node.tag is None or tag and node.tag != tag:
        return False
    for kind, name, wanted in tests:
        value = node.attrs.get(name)
        if value is None:
            return False
        if kind == "=" and value != wanted or kind == "^=" and not (wanted and value.startswith(wanted)) or kind == "." and wanted not in value.split():
            return False
    return True


def _matches(node: Node, compounds: tuple[Compound, ...]) -> bool:
    if not _fits(node, compounds[-1]):
        return False
    if len(compounds) == 1:
        return True
    if compounds[-1][0]:
        return node.parent is not None and _matches(node.parent, compounds[:-1])
    return any(_matches(a, compounds[:-1]) for a in node.ancestors())


def select(node: Node, selector: str) -> Iterator[Node]:
    """Elements below a node that a selector matches, in document order."""
    groups = compiled(selector)
    return (d for d in node.descendants() if any(_matches(d, g) for g in groups))


def first(node: Node, selector: str) -> Node | None:
    return next(select(node, selector), None)
