"""Tolerant parsing of model output: JSON objects and lists under per-field policies."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field
from typing import Any

from millrace.operators.payloads import balanced

# Tolerances and the length of kept excerpts.
STRICT, DERIVE, DEFAULT, OPTIONAL, SKIP = "strict", "derive", "default", "optional", "skip"
EXCERPT = 200
ENVELOPE = "_envelope"

_FENCED = re.compile(r"```[a-zA-Z0-9_-]*[ \t]*\n(.*?)\n[ \t]*```", re.DOTALL)


@dataclass(frozen=True)
class Policy:
    tolerance: str
    default: Any = None
    derive: Callable[[dict[str, Any]], Any] | None = None


@dataclass(frozen=True)
class Event:
    """One repair: where, which field, by which tolerance, from which model and text."""

    boundary: str
    field: str
    tolerance: str
    model: str
    raw: str


@dataclass
class Outcome:
    """A value or an error or the field that made the caller skip, with repaired fields and events."""

    value: Any = None
    recovered: list[str] = field(default_factory=list)
    error: str | None = None
    skipped: str | None = None
    events: list[Event] = field(default_factory=list)


def unfenced(text: str) -> str:
    """The body of a fence that a text begins with, else the text, stripped."""
    text = text.strip()
    if text.startswith("```"):
        text = text[3:].removeprefix("json").partition("```")[0].strip()
    return text


def without_fenced_blocks(text: str, json_only: bool = True) -> str:
    """Prose without its fenced blocks; by default only blocks that open like JSON go."""
    keep = lambda m: m.group(0) if json_only and m.group(1).strip()[:1] not in ("[", "{") else ""
    return _FENCED.sub(keep, text).strip()


def first_object(text: str) -> str | None:
    """The first balanced {...} of a text."""
    at = text.find("{")
    return balanced(text, at, quotes='"') if at >= 0 else None


def parse_object(raw: str | None, policies: Mapping[str, Policy], boundary: str, model: str, into: Callable[[dict[str, Any]], Any] | None = None) -> Outcome:
    """A JSON object from model output, each field under its policy, other fields after them."""
    out = Outcome()
    raw = raw or ""

    def event(name: str, tolerance: str) -> None:
        out.events.append(Event(boundary, name, tolerance, model, raw[:EXCERPT]))

    text = unfenced(raw)
    try:
        parsed = json.loads(text)
    except (ValueError, RecursionError):
        candidate = first_object(text)
        try:
            parsed = json.loads(candidate or "")
        except (ValueError, RecursionError):
            out.error = f"{boundary}: invalid JSON"
            return out
        event(ENVELOPE, DERIVE)
    if not isinstance(parsed, dict):
        out.error = f"{boundary}: expected JSON object, got {type(parsed).__name__}"
        return out
    resolved: dict[str, Any] = {}
    for name, policy in policies.items():
        given = parsed.get(name)
        if given is None:
            if policy.tolerance == STRICT or policy.tolerance == DERIVE and policy.derive is None:
                out.error = f"{boundary}: missing required field: {name!r}"
                return out
            if policy.tolerance == DERIVE:
                given = policy.derive(parsed)
            elif policy.tolerance != SKIP:
                given = policy.default
            if policy.tolerance != OPTIONAL:
                event(name, policy.tolerance)
            if policy.tolerance == SKIP:
                out.skipped = name
                return out
            if policy.tolerance != OPTIONAL:
                out.recovered.append(name)
        resolved[name] = given
    resolved |= {k: v for k, v in parsed.items() if k not in resolved}
    out.value = into(resolved) if into else resolved
    return out


def parse_list(raw: str | None, item: Callable[[dict[str, Any]], Any], boundary: str, model: str, strip_fences: bool = True) -> Outcome:
    """A JSON array from model output; entries that are no objects, or that `item` gives None for, are dropped and named."""
    out = Outcome()
    raw = raw or ""
    try:
        parsed = json.loads(unfenced(raw) if strip_fences else raw.strip())
    except (ValueError, RecursionError):
        out.error = f"{boundary}: invalid JSON"
        return out
    if not isinstance(parsed, list):
        out.error = f"{boundary}: expected JSON array, got {type(parsed).__name__}"
        return out
    results = [item(entry) if isinstance(entry, dict) else None for entry in parsed]
    out.value = [r for r in results if r is not None]
    out.recovered = [str(i) for i, r in enumerate(results) if r is None]
    if out.recovered:
        out.events.append(Event(boundary, f"items[{','.join(out.recovered)}]", DEFAULT, model, raw[:EXCERPT]))
    return out
