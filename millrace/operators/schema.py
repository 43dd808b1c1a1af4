"""Rows of a page by a declared schema: one container, rows in it, fields in each row."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from millrace.functions.dom import Node, first, parse, select

# The verdicts.
OK, EMPTY, ROT = "ok", "empty", "rot"


@dataclass(frozen=True)
class Field:
    """Where a value is: a selector ("." is the row itself), an attribute or the text, a prefix to cut."""

    css: str
    attr: str | None = None
    strip_prefix: str | None = None
    required: bool = False


@dataclass(frozen=True)
class Schema:
    container: str
    row: str
    fields: Mapping[str, Field]
    pair_with: str | None = None


@dataclass(frozen=True)
class Extraction:
    """ok: rows were found; empty: the container holds no row; rot: no container, or rows without any field."""

    verdict: str
    rows: tuple[dict[str, str], ...] = ()
    missing: dict[str, int] = field(default_factory=dict)


def value(row: Node, f: Field) -> str | None:
    node = row if f.css == "." else first(row, f.css)
    raw = None if node is None else node.get(f.attr) if f.attr else node.text()
    if raw is None:
        return None
    if f.strip_prefix:
        cut = raw.lstrip()
        raw = cut.removeprefix(f.strip_prefix) if cut.startswith(f.strip_prefix) else raw
    return " ".join(raw.split()) or None


def extract(root: Node | str, schema: Schema) -> Extraction:
    holder = first(parse(root) if isinstance(root, str) else root, schema.container)
    if holder is None:
        return Extraction(ROT)
    rows = list(select(holder, schema.row))
    if not rows:
        return Extraction(EMPTY)
    partners = list(select(holder, schema.pair_with)) if schema.pair_with else []
    out, missing = [], {}
    for i, row in enumerate(rows):
        halves = [row, *partners[i : i + 1]]
        found = {}
        for name, f in schema.fields.items():
            values = [v for h in halves if (v := value(h, f)) is not None]
            if values:
                found[name] = values[0]
            elif f.required:
                missing[name] = missing.get(name, 0) + 1
        if found:
            out.append(found)
    return Extraction(OK if out else ROT, tuple(out), missing)
