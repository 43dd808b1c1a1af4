"""Normalised rows and envelopes from outside tools: cookies, version control listings, errors, feedback, prompts, routing."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.functions.native import stripped

# Core error kinds with status, exit code (none for a bug) and whether a retry helps.
ERROR_KINDS: dict[str, tuple[int | None, int | None, bool]] = {
    "input": (400, 2, False),
    "auth": (401, 77, False),
    "policy": (403, 77, False),
    "infra": (503, 75, True),
    "bug": (None, None, False),
}
ENVELOPE_VERSION = "1"


def cookie_row(host: Column, name: Column, value: Column, path: Column, expires: Column, secure: Column, http_only: Column, same_site: Column) -> Column:
    """A cookie as the normal row: empty path is /, flags are 0 or 1, expiry 0 is none, same-site lax, strict, none or null."""
    site = F.lower(same_site)
    blank = lambda c: F.coalesce(c, F.lit(""))
    return F.struct(
        blank(host).alias("host_key"),
        blank(name).alias("name"),
        blank(value).alias("value"),
        F.when(blank(path) == "", "/").otherwise(path).alias("path"),
        F.when(expires != 0, expires.cast("long")).alias("expires_utc"),
        F.coalesce(secure, F.lit(False)).cast("int").alias("is_secure"),
        F.coalesce(http_only, F.lit(False)).cast("int").alias("is_httponly"),
        F.when(site.isin("lax", "strict", "none"), site).alias("samesite"),
    )


def _lines(text: Column) -> Column:
    return F.filter(F.split(text, r"\r\n|\n|\r"), lambda x: stripped(x) != "")


def changed_paths(porcelain: Column) -> Column:
    """Paths of a status listing: what follows the two marks and a space of each line."""
    return F.transform(_lines(porcelain), lambda x: stripped(F.substr(x, F.lit(4))))


def sync_state(branch: Column, porcelain: Column, counts: Column, merging: Column) -> Column:
    """Branch, cleanliness and distance from upstream; counts is "behind ahead" or blank."""
    changed = F.size(_lines(porcelain))
    pair = F.filter(F.split(stripped(F.coalesce(counts, F.lit(""))), r"\s+"), lambda x: x != "")
    number = lambda i: F.when(F.size(pair) == 2, F.element_at(pair, i).cast("long")).otherwise(F.lit(0).cast("long"))
    name = stripped(F.coalesce(branch, F.lit("")))
    return F.struct(
        F.when(name == "", "HEAD").otherwise(name).alias("branch"),
        (changed == 0).alias("clean"),
        changed.cast("long").alias("changed_files"),
        number(2).alias("ahead"),
        number(1).alias("behind"),
        merging.alias("conflict_paused"),
    )


def error_envelope(kind: Column, type_name: Column, hint: Column, extensions: Mapping[str, tuple[str, bool]] | None = None) -> Column:
    """An error as a struct; a registered kind (name -> base, retryable) resolves to its core kind, an unknown one is a null envelope."""
    base = F.when(kind.isin(*ERROR_KINDS), kind)
    for name, (core, _) in (extensions or {}).items():
        base = base.when(kind == name, core)
    of = lambda i: F.element_at(F.create_map(*[F.lit(x) for k, v in ERROR_KINDS.items() for x in (k, v[i])]), base)
    retry = F.when(F.lit(False), F.lit(False))
    for name, (_, again) in (extensions or {}).items():
        retry = retry.when(kind == name, F.lit(again))
    envelope = F.struct(
        type_name.alias("type"), kind.alias("kind"), base.alias("base_kind"), retry.otherwise(of(2)).alias("retryable"), hint.alias("hint"),
        of(0).alias("http_status"), of(1).alias("cli_exit_code"), F.lit(ENVELOPE_VERSION).alias("envelope_version"),
    )
    return F.when(base.isNotNull(), envelope)


def feedback_payload(service: str, scope: str, fields: Mapping[str, Column]) -> Column:
    """One log payload as JSON text; fields that are null stay out, empty ones stay."""
    attribute = lambda k, v: F.struct(F.lit(k).alias("key"), F.struct(v.alias("stringValue")).alias("value"))
    given = F.filter(F.array(*[F.when(v.isNotNull(), attribute(k, v)) for k, v in fields.items()]), lambda a: a.isNotNull())
    record = F.array(F.struct(given.alias("attributes")))
    scoped = F.array(F.struct(F.struct(F.lit(scope).alias("name")).alias("scope"), record.alias("logRecords")))
    resource = F.struct(F.array(attribute("service.name", F.lit(service))).alias("attributes"))
    return F.to_json(F.struct(F.array(F.struct(resource.alias("resource"), scoped.alias("scopeLogs"))).alias("resourceLogs")))


def flat_prompt(system: Column, user: Column, cached_system: Column, prefix: Column, tail: Column) -> Column:
    """System and user text: with a cached prefix its own system and prefix plus tail, else system parts by blank lines and the user text."""
    cached = F.coalesce(prefix, F.lit("")) != ""
    return F.struct(F.when(cached, cached_system).otherwise(F.array_join(system, "\n\n")).alias("system"), F.when(cached, F.concat(prefix, tail)).otherwise(user).alias("user"))


def routed(content: Column, structured: Column, compressed: Column, marker: Column, is_error: Column, consumer: Column, mode: Column) -> Column:
    """Both channels of a result: untouched for errors and other consumers; compact drops the structured one; strict puts a marker for the text; else the compressed text where there is one."""
    untouched = is_error | (consumer != "llm")
    strict = (mode == "strict") & structured.isNotNull()
    text = F.when(untouched, content).when(mode == "compact", F.coalesce(compressed, content)).when(strict, marker).otherwise(F.coalesce(compressed, content))
    return F.struct(text.alias("content"), F.when(untouched | (mode != "compact"), structured).alias("structured"))
