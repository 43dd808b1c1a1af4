"""Scalar operators as Column expressions, all inside Catalyst."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns and thresholds of the conversion grade.
GARBAGE = r"[�\x00-\x08\x0b\x0c\x0e-\x1f]"
CID_TOKEN = r"\(cid:\d+\)"
NUMERIC_RUN = r"[\d,.\-()%$¥€]{1,20}"
TABLE_LINE = r"(?Udm)^\s*\|.*\|\s*$"
HEADING_LINE = r"(?Udm)^#{1,6}\s"
LINE_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]"
_BREAKS = r"\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029"
_BLANK, _REST = rf"[\s&&[^{_BREAKS}]]*+", rf"[^{_BREAKS}]*+"
#: Matches over a whole text, one for each line that is not blank, that holds a glyph token, that is numbers alone.
GRADED_LINES = {
    "n": rf"(?U)[^\s\x1c-\x1f]{_REST}",
    "cid": rf"(?U){CID_TOKEN}{_REST}",
    "numeric": rf"(?U)(?<![^{_BREAKS}]){_BLANK}{NUMERIC_RUN}+{_BLANK}(?![^{_BREAKS}])",
}
SPACE = r"(?U)[\s\x1c-\x1f]"
#: The characters of SPACE.
WHITE = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
MOST_GARBAGE, MOST_CID, MOST_NUMERIC, LEAST_YIELD = 0.02, 0.03, 0.35, 0.02
SHATTER_LINES, YIELD_SIZE, STRUCTURE_SIZE = 20, 4096, 32768


def squeezed(text: Column) -> Column:
    """Runs of white space as one space, ends trimmed."""
    return F.trim(F.regexp_replace(text, SPACE + "+", " "))


def stripped(text: Column) -> Column:
    """Without white space at either end."""
    return F.btrim(text, F.lit(WHITE))


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with the value computed once a row, however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def duration(ms: Column) -> Column:
    """Milliseconds as 999ms, 1.5s, 59s or 1m05s."""
    seconds = F.floor(ms / 1000)
    return (
        F.when(ms < 1000, F.concat(ms.cast("string"), F.lit("ms")))
        .when(ms < 7000, F.concat(F.format_number(ms / F.lit(1000.0), 1), F.lit("s")))
        .when(ms < 60000, F.concat(seconds.cast("string"), F.lit("s")))
        .otherwise(F.concat(F.floor(seconds / 60).cast("string"), F.lit("m"), F.lpad((seconds % 60).cast("string"), 2, "0"), F.lit("s")))
    )


def region_replaced(body: Column, content: Column, start: str, end: str, escape: Callable[[Column], Column] | None = None) -> Column:
    """Writes content, escaped first where asked, between two markers of a text, or after its end where there is no pair yet."""
    trimmed = F.regexp_replace(escape(content) if escape else content, r"\n+\z", "")
    block = F.concat(F.lit(start + "\n"), trimmed, F.lit("\n" + end))
    s, e = F.instr(body, start), F.instr(body, end)
    inside = F.concat(F.substr(body, F.lit(1), s - 1), block, F.substr(body, e + F.lit(len(end))))
    return (
        F.when((s > 0) & (e > s), inside)
        .when(body == "", F.concat(block, F.lit("\n")))
        .otherwise(F.concat(F.regexp_replace(body, r"\n+\z", ""), F.lit("\n\n"), block, F.lit("\n")))
    )


def escaped_cell(text: Column) -> Column:
    """A text as one cell of a line: backslash, tab, line feed and carriage return escaped."""
    for raw, safe in (("\\", "\\\\"), ("\t", "\\t"), ("\n", "\\n"), ("\r", "\\r")):
        text = F.replace(text, F.lit(raw), F.lit(safe))
    return text


def text_key(*parts: Column) -> Column:
    """SHA-256 of each part, joined by colons."""
    return F.concat_ws(":", *[F.sha2(p.cast("binary"), 256) for p in parts])


def is_json_type(content_type: Column) -> Column:
    """application/json, text/json or application/*+json, parameters aside."""
    kind = F.lower(stripped(F.split_part(content_type, F.lit(";"), F.lit(1))))
    known = kind.isin("application/json", "text/json") | (kind.startswith("application/") & kind.endswith("+json"))
    return F.coalesce(known, F.lit(False))


def fetch_verdict(status: Column) -> Column:
    return F.when(status == 404, "not_found").when(status == 429, "rate_limited").when(status >= 400, "connection_error").otherwise("ok")


# Verdicts that count against a host; an answer such as 404 or 429 does not.
TRIPPING = ("timeout", "connection_error", "dns_error", "proxy_unavailable")


def trips_breaker(verdict: Column) -> Column:
    return F.coalesce(verdict.isin(*TRIPPING), F.lit(False))


def is_challenge(status: Column, resource: Column) -> Column:
    """A status that asks for proof, on a script's request."""
    return status.isin(401, 403, 429) & resource.isin("xhr", "fetch")


def conditional_headers(etag: Column, last_modified: Column) -> Column:
    """If-None-Match and If-Modified-Since where the stored values are not blank."""
    both = F.create_map(F.lit("If-None-Match"), etag, F.lit("If-Modified-Since"), last_modified)
    return F.map_filter(both, lambda _, v: v.isNotNull() & (v != ""))


def env_resolved(text: Column, values: Mapping[str, str]) -> Column:
    """${NAME} by given values; unknown names stay. One pass, so values are not expanded again."""
    parts = F.regexp_extract_all(text, F.lit(r"(?s)(\$\{[A-Za-z_][A-Za-z0-9_]*\}|.)"), F.lit(1))
    if not values:
        return text
    known = F.create_map(*[F.lit(x) for k, v in values.items() for x in ("${" + k + "}", v)])
    return F.array_join(F.transform(parts, lambda p: F.coalesce(F.element_at(known, p), p)), "")


def unfenced(text: Column) -> Column:
    """The body of a code fence that a text begins with, else the text, stripped."""
    t = stripped(text)
    rest = F.substr(t, F.lit(4))
    rest = F.when(rest.startswith("json"), F.substr(rest, F.lit(5))).otherwise(rest)
    return F.when(t.startswith("```"), stripped(F.split_part(rest, F.lit("```"), F.lit(1)))).otherwise(t)


def has_conflict_markers(text: Column) -> Column:
    return text.contains("<<<<<<<") & text.contains(">>>>>>>")


def dependency_name(spec: Column) -> Column:
    """What stands before the first version mark, bracket or space of a requirement."""
    return stripped(F.regexp_extract(spec, r"(?s)^([^\[<>=!~; (]*)", 1))


def has_upper_bound(spec: Column) -> Column:
    return spec.contains("<") | spec.contains("~=") | spec.contains("==")


def unit_vector(v: Column) -> Column:
    """A vector divided by its length; the zero vector stays."""
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    return once(norm, lambda n: F.transform(v, lambda x: F.when(n == 0, x.cast("double")).otherwise(x.cast("double") / n)))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def text_lines(text: Column) -> Column:
    """Lines that are not blank."""
    return F.filter(F.split(text, LINE_BREAK), lambda x: stripped(x) != "")


def grade(markdown: Column, source_size: Column, check_yield: bool = True) -> Column:
    """fidelity, lost and warnings of a conversion: the first defect found, else high."""
    counts = lambda md: F.struct(md.alias("md"), *[F.regexp_count(md, F.lit(pattern)).alias(name) for name, pattern in GRADED_LINES.items()])
    return once(markdown, lambda md: once(counts(md), lambda m: _graded(m["md"], source_size, check_yield, m)))


def _graded(markdown: Column, source_size: Column, check_yield: bool, m: Column) -> Column:
    n = F.greatest(m["n"], F.lit(1))
    garbage = F.regexp_count(markdown, F.lit(GARBAGE)) / F.greatest(F.length(markdown), F.lit(1))
    cid, numeric = m["cid"] / n, m["numeric"] / n

    def verdict(fidelity: str, lost: Sequence[str], warning: Column | None) -> Column:
        texts = F.array(warning) if warning is not None else F.array().cast("array<string>")
        return F.struct(F.lit(fidelity).alias("fidelity"), F.array(*map(F.lit, lost)).cast("array<string>").alias("lost"), texts.alias("warnings"))

    three = lambda name, value: F.concat(F.lit(name + "="), F.format_number(value, 3))
    result = F.when(m["n"] == 0, verdict("failed", ["all"], F.lit("empty_output")))
    result = result.when(garbage > MOST_GARBAGE, verdict("partial", ["encoding"], three("encoding_garbage_density", garbage)))
    result = result.when(cid > MOST_CID, verdict("partial", ["encoding"], three("cid_glyph_leak_line_fraction", cid)))
    result = result.when((m["n"] >= SHATTER_LINES) & (numeric > MOST_NUMERIC), verdict("partial", ["table_structure"], three("shattered_table_numeric_line_fraction", numeric)))
    if check_yield:
        low = F.concat(F.lit("low_yield="), F.length(markdown).cast("string"), F.lit("/"), source_size.cast("string"))
        result = result.when((source_size > YIELD_SIZE) & (F.length(markdown) < source_size * LEAST_YIELD), verdict("partial", ["content"], low))
    plain = ~markdown.rlike(TABLE_LINE) & ~markdown.rlike(HEADING_LINE)
    result = result.when((source_size > STRUCTURE_SIZE) & plain, verdict("partial", ["structure"], F.lit("no_tables_or_headings_in_large_doc")))
    return result.otherwise(verdict("high", [], None))


def pruned(fields: Column) -> Column:
    """A string map without null and empty values."""
    return F.map_filter(fields, lambda _, v: v.isNotNull() & (v != ""))


def token_cost(fresh: Column, written: Column, read: Column, output: Column, input_price: Column, output_price: Column) -> Column:
    """Price of a call per million tokens: cache writes cost 125 %, cache reads 10 % of input; 0 without a price."""
    million = 1_000_000
    cost = fresh / million * input_price + written / million * input_price * 1.25 + read / million * input_price * 0.10 + output / million * output_price
    return F.coalesce(cost, F.lit(0.0))
