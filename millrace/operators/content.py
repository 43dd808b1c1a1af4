"""Headings, role-classified links, metadata and main content of a page."""

from __future__ import annotations

import json
from dataclasses import dataclass
from datetime import date, datetime
from typing import Any

from millrace.functions.dom import HEADINGS, Node, parse, select
from millrace.operators.fragment import to_markdown

# Roles of links by the nearest ancestor's tag or role attribute, and labelled schemes.
ROLE_OF_TAG = {"nav": "nav", "footer": "footer", "header": "meta", "aside": "meta", "article": "primary", "main": "primary"}
ROLE_OF_ROLE = {"navigation": "nav", "contentinfo": "footer", "banner": "meta", "main": "primary", "article": "primary"}
CONTACT_SCHEMES = ("mailto:", "tel:")
CHROME = frozenset("nav footer header aside script style noscript template form iframe".split())
COMMENTS = frozenset("comment comments disqus replies discussion".split())


@dataclass(frozen=True)
class Link:
    anchor: str
    href: str
    role: str


def headings(root: Node) -> list[tuple[int, str]]:
    """Level and text of each heading that has text."""
    found = ((int(h.tag[1]), h.text().strip()) for h in select(root, ",".join(HEADINGS)))
    return [(level, text) for level, text in found if text]


def role(node: Node) -> str:
    for a in node.ancestors():
        found = ROLE_OF_TAG.get(a.tag or "") or ROLE_OF_ROLE.get((a.get("role") or "").lower())
        if found:
            return found
    return "primary"


def links(root: Node) -> list[Link]:
    """Links with a label; mail and telephone links lend theirs from the address."""
    out = []
    for a in select(root, "a[href]"):
        href, anchor = a.attrs["href"], a.text().strip()
        if not anchor:
            scheme = next((s for s in CONTACT_SCHEMES if href.lower().startswith(s)), None)
            anchor = href[len(scheme) :].split("?", 1)[0].strip() if scheme else ""
        if href and anchor:
            out.append(Link(anchor, href, role(a)))
    return out


def _flat(value: Any) -> dict[str, str]:
    if not isinstance(value, dict):
        return {}
    return {f"jsonld[0].{k}": str(v) for k, v in value.items() if isinstance(v, str | int | float)}


def metadata(root: Node) -> dict[str, str]:
    """og: and twitter: meta fields and the scalars of the first JSON-LD block under dotted keys; the last of a name stands."""
    out: dict[str, str] = {}
    for selector, name in (("meta[property^='og:']", "property"), ("meta[name^='twitter:']", "name")):
        for m in select(root, selector):
            if m.get("content"):
                out[m.attrs[name].replace(":", ".", 1)] = m.attrs["content"]
    block = next(select(root, "script[type='application/ld+json']"), None)
    if block is not None:
        try:
            value = json.loads(block.text().strip() or "null")
        except (ValueError, RecursionError):
            value = None
        out |= _flat(value[0] if isinstance(value, list) and value else value)
    return out


#: Where a page states its date, the surest first: selector and attribute.
DATED = (("meta[property='article:published_time']", "content"), ("meta[itemprop='datePublished']", "content"), ("meta[name='date']", "content"), ("time[datetime]", "datetime"))


def _day(value: str | None) -> date | None:
    try:
        return datetime.strptime((value or "")[:10], "%Y-%m-%d").date()  # noqa: DTZ007
    except ValueError:
        return None


def published(root: Node) -> date | None:
    """The day of publication: of the JSON-LD block, else of the first mark that holds a valid date; null without one."""
    stated = [metadata(root).get("jsonld[0].datePublished"), *(m.get(attribute) for selector, attribute in DATED for m in select(root, selector))]
    return next((day for day in map(_day, stated) if day), None)


@dataclass(frozen=True)
class Options:
    """What the main content keeps."""

    include_links: bool = False
    include_comments: bool = False
    include_tables: bool = True
    dropped: frozenset[str] = CHROME


#: Everything that is text: for markup that is clean already.
CLEAN = Options(True, True, True, frozenset({"script", "style", "noscript", "template"}))


def _skipped(node: Node, o: Options) -> bool:
    if node.tag is None or node.tag in o.dropped or node.tag == "table" and not o.include_tables:
        return True
    words = set(f"{node.get('class') or ''} {node.get('id') or ''}".lower().replace("-", " ").replace("_", " ").split())
    return bool(words & COMMENTS) and not o.include_comments


def _pruned(node: Node, o: Options) -> str:
    """Markup of a subtree without page chrome; links, tables and comment sections as the options say."""
    out: list[str] = []
    waiting: list[Node | str | int] = node.children[::-1]  # a number ends a heading whose text began there; other endings are markup
    ends: list[str] = []
    while waiting:
        child = waiting.pop()
        if isinstance(child, int):
            if child < 0:
                out.append(ends.pop())
            else:
                out[child:] = ["".join(out[child:]).strip(), "</p>"]
        elif isinstance(child, str):
            out.append(child.replace("&", "&amp;").replace("<", "&lt;"))
        elif _skipped(child, o):
            continue
        elif child.tag == "br":
            out.append("<br>")
        elif child.tag == "table":
            out.append(f"<p>{_table(child, o)}</p>")
        elif child.tag in HEADINGS:
            out.append(f"<p>{'#' * int(child.tag[1])} ")
            waiting += [len(out), *child.children[::-1]]
        else:
            linked = child.tag == "a" and o.include_links and child.get("href")
            if linked:
                out.append(f'<a href="{child.attrs["href"].replace("&", "&amp;").replace(chr(34), "&quot;")}">')
            elif child.tag != "a":
                out.append(f"<{child.tag}>")
            ends.append(f"</{child.tag}>" if linked or child.tag != "a" else "")
            waiting += [-1, *child.children[::-1]]
    return "".join(out)


def _table(node: Node, o: Options) -> str:
    rows = [[" ".join(to_markdown(_pruned(c, o)).split()) for c in r.elements() if c.tag in ("td", "th")] for r in select(node, "tr")]
    rows = [r for r in rows if r]
    if not rows:
        return ""
    lines = ["| " + " | ".join(c.replace("|", "\\|") for c in r) + " |" for r in rows]
    lines.insert(1, "| " + " | ".join("---" for _ in rows[0]) + " |")
    return "<br>".join(line.replace("&", "&amp;").replace("<", "&lt;") for line in lines)


def main_content(root: Node, options: Options = Options()) -> str:  # noqa: B008
    """Markdown of the main content: the first article or main element, else the block with most text, else the body.

    This rule is our own; page chrome is left out.
    """
    body = root.children[1]
    chosen = next(select(body, "article, main"), None)
    if chosen is None:
        blocks = [(sum(len(c) for c in e.children if isinstance(c, str)) + sum(len(p.text()) for p in e.elements() if p.tag == "p"), e) for e in body.descendants() if e.tag in ("div", "section", "td") and not any(a.tag in CHROME for a in [e, *e.ancestors()])]
        chosen = max(blocks, key=lambda b: b[0])[1] if blocks and max(b[0] for b in blocks) > 0 else body
    return to_markdown(_pruned(chosen, options))


def converted(root: Node, clean: bool = False, options: Options = Options()) -> tuple[str, str]:  # noqa: B008
    """Markdown and the way it was made: `main` content of a web page, or all of the body, `clean`, where asked or where there is none."""
    markdown = "" if clean else main_content(root, options)
    return (markdown, "main") if markdown.strip() else (to_markdown(_pruned(root.children[1], CLEAN)), "clean")


def parsed(page: str | None) -> Node:
    return parse(page or "")
