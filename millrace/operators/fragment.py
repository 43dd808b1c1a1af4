"""HTML fragments as plain text and as markdown."""

from __future__ import annotations

import html
import re
from urllib.parse import urljoin

from millrace.functions.dom import HEADINGS, Node, parse

# Elements that stand apart, and markers of emphasis.
APART = frozenset("p div section article header footer aside blockquote pre".split()) | frozenset(HEADINGS)
MARKERS = {"em": "*", "i": "*", "strong": "**", "b": "**"}

_NARROW = re.compile("[\xa0 ]")
_SPACES = re.compile(r"[ \t]+")
_LINE_ENDS = re.compile(r"[ \t]+\n")
_GAPS = re.compile(r"\n{3,}")


def _root(fragment: str) -> Node:
    """Everything of a fragment under one div."""
    page = parse(fragment)
    root = Node("div")
    head, body = page.children
    root.children = [*head.children, *body.children]
    for c in root.children:
        if isinstance(c, Node):
            c.parent = root
    return root


def to_text(fragment: str | None) -> str:
    """Text without tags; entities are decoded, once more after the parser, and runs of spaces and tabs become one space."""
    if not fragment or not fragment.strip():
        return ""
    return _SPACES.sub(" ", _NARROW.sub(" ", html.unescape(_root(fragment).text()))).strip()


def to_markdown(fragment: str | None, base_url: str | None = None) -> str:
    """Paragraphs, line breaks, list items, emphasis and links as markdown; other tags go, comments keep their text."""
    if not fragment or not fragment.strip():
        return ""
    out: list[str] = []
    _element(_root(fragment), out, base_url)
    text = _NARROW.sub(" ", html.unescape("".join(out)))
    return _GAPS.sub("\n\n", _LINE_ENDS.sub("\n", text)).strip()


def _element(root: Node, out: list[str], base_url: str | None) -> None:
    """Writes an element; open elements wait on a list with what ends them, links with the place their text begins."""
    waiting: list[str | Node | tuple[str, int]] = [root]
    while waiting:
        node = waiting.pop()
        if isinstance(node, str):
            out.append(node)
        elif isinstance(node, tuple):
            href, start = node
            text = "".join(out[start:]).strip()
            out[start:] = [f"[{text}]({urljoin(base_url, href) if base_url else href})" if href else text]
        elif node.tag == "br":
            out.append("\n")
        else:
            mark = MARKERS.get(node.tag, "")
            out.append("\n- " if node.tag == "li" else mark)
            waiting.append((node.get("href") or "", len(out)) if node.tag == "a" else "\n" if node.tag == "li" else mark or "\n\n" * (node.tag in APART))
            waiting += node.children[::-1]
