"""DataFrame forms of the page operators.

`parsed_pages` parses every page once and emits only the asked parts; everything after is native Spark.
Select and filter before calling: Python operators stop column pruning and pushed filters.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from millrace.functions.dom import parse
from millrace.functions.native import grade
from millrace.operators import content, fragment, payloads, records, schema, wobble

_S, _L = T.StringType(), T.LongType()


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


LINK = _struct(anchor=_S, href=_S)
RECORD = _struct(text=_S, links=T.ArrayType(LINK), heading_text=_S, heading_link=LINK, depth=_L, markdown=_S)
RECORDS = _struct(records=T.ArrayType(RECORD), container=_S, child_signature=_S, max_depth=_L, markdown=_S)
PAYLOAD = _struct(source=_S, data=_S, script_id=_S, byte_size=_L, answers=T.BooleanType(), bucket=_L)
EXTRACTION = _struct(verdict=_S, rows=T.ArrayType(T.MapType(_S, _S)), missing=T.MapType(_S, _L))
OUTCOME = _struct(value=_S, recovered=T.ArrayType(_S), error=_S, skipped=_S, events=T.ArrayType(_struct(boundary=_S, field=_S, tolerance=_S, model=_S, raw=_S)))

#: What can be read off one parsed page.
PARTS: dict[str, tuple[T.DataType, Callable[[Any], Any]]] = {
    "links": (T.ArrayType(_struct(anchor=_S, href=_S, role=_S)), lambda root: [vars(x) for x in content.links(root)]),
    "headings": (T.ArrayType(_struct(level=_L, text=_S)), lambda root: [{"level": a, "text": b} for a, b in content.headings(root)]),
    "metadata": (T.MapType(_S, _S), lambda root: list(content.metadata(root).items())),
    "payloads": (T.ArrayType(PAYLOAD), lambda root: [_payload(p) for p in payloads.payloads(root)]),
    "main_content": (_S, content.main_content),
    "published": (T.DateType(), content.published),
}
#: The parts of a page as a document.
DOCUMENT = ["main_content", "published", "metadata", "headings", "links"]


def _payload(p: payloads.Payload) -> dict[str, Any]:
    return {"source": p.source, "data": json.dumps(p.data, ensure_ascii=False), "script_id": p.script_id, "byte_size": p.byte_size, "answers": payloads.answers(p.source, p.data), "bucket": payloads.bucket(p)}


def with_row_functions(df: DataFrame, functions: dict[str, tuple[str, T.DataType, Callable[[Any], Any]]]) -> DataFrame:
    """Adds columns by Python functions of one column each: name -> (input column, type, function); one Python pass for all."""
    added = T.StructType([T.StructField(name, kind) for name, (_, kind, _) in functions.items()])
    arrow = {name: to_arrow_type(kind) for name, (_, kind, _) in functions.items()}

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            inputs = {c: batch.column(c).to_pylist() for c in {c for c, _, _ in functions.values()}}
            made = [pa.array([f(v) for v in inputs[c]], arrow[name]) for name, (c, _, f) in functions.items()]
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], names=[*batch.schema.names, *functions])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, *added.fields]))


def parsed_pages(pages: DataFrame, parts: list[str], html: str = "html") -> DataFrame:
    """The other columns and the asked parts of each page; every page is parsed once."""
    kinds = [(p, *PARTS[p]) for p in parts]
    rest = [f for f in pages.schema.fields if f.name != html]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [to_arrow_type(kind) for _, kind, _ in kinds]
        for batch in batches:
            roots = [parse(p or "") for p in batch.column(html).to_pylist()]
            made = [pa.array([f(r) for r in roots], t) for (_, _, f), t in zip(kinds, types, strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in rest), *made], names=[*(f.name for f in rest), *parts])

    return spread(pages).mapInArrow(run, T.StructType([*rest, *(T.StructField(p, kind) for p, kind, _ in kinds)]))


def spread(df: DataFrame) -> DataFrame:
    """Deals a scan that came in fewer splits than there are cores out to all of them; anything above an exchange is dealt already."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    execution = df._jdf.queryExecution()
    if execution.executedPlan().toString().startswith("AdaptiveSparkPlan"):
        return df
    return df.repartition(cores) if execution.toRdd().getNumPartitions() < cores else df


def converted_pages(pages: DataFrame, clean: bool = False, options: content.Options = content.Options(), html: str = "html") -> DataFrame:  # noqa: B008
    """Adds markdown, engine, fidelity, lost and warnings; a null or empty page, or one without text, is a failed conversion."""

    def run(page: str | None) -> dict[str, str]:
        return dict(zip(("markdown", "engine"), content.converted(parse(page or ""), clean, options), strict=True))

    sized = pages.withColumn("_size", F.coalesce(F.octet_length(html), F.lit(0)))
    made = with_row_functions(sized, {"_made": (html, _struct(markdown=_S, engine=_S), run)})
    rest = [c for c in pages.columns if c != html]
    graded = made.select(*rest, "_made.markdown", "_made.engine", grade(F.col("_made.markdown"), F.col("_size")).alias("_grade"))
    blank = F.trim("markdown") == ""
    warnings = F.when(blank, F.array(F.lit("conversion_failed"))).otherwise(F.col("_grade.warnings"))
    return graded.select(*rest, "markdown", "engine", "_grade.fidelity", "_grade.lost", warnings.alias("warnings"))


def _record_set(found: records.RecordSet | None) -> dict[str, Any] | None:
    if found is None:
        return None
    pair = lambda link: None if link is None else {"anchor": link[0], "href": link[1]}
    rows = [vars(r) | {"links": [pair(x) for x in r.links], "heading_link": pair(r.heading_link)} for r in found.records]
    return {"records": rows, "container": found.container, "child_signature": found.child_signature, "max_depth": found.max_depth, "markdown": found.markdown()}


def with_records(pages: DataFrame, html: str = "html", base_url: str = "") -> DataFrame:
    """Adds the struct `found` (null where a page holds no records)."""
    return with_row_functions(pages, {"found": (html, RECORDS, lambda p: _record_set(records.records(p, base_url)))}).drop(html)


def with_extraction(pages: DataFrame, declared: schema.Schema, html: str = "html") -> DataFrame:
    """Adds the struct `extraction`: verdict, rows, missing."""

    def run(page: str | None) -> dict[str, Any]:
        e = schema.extract(page or "", declared)
        return {"verdict": e.verdict, "rows": [list(r.items()) for r in e.rows], "missing": list(e.missing.items())}

    return with_row_functions(pages, {"extraction": (html, EXTRACTION, run)}).drop(html)


def with_text(fragments: DataFrame, html: str = "html", base_url: str | None = None) -> DataFrame:
    """Adds `text` and `markdown` of HTML fragments."""
    return with_row_functions(fragments, {"text": (html, _S, fragment.to_text), "markdown": (html, _S, lambda f: fragment.to_markdown(f, base_url))}).drop(html)


def _outcome(o: wobble.Outcome) -> dict[str, Any]:
    value = None if o.value is None else json.dumps(o.value, ensure_ascii=False)
    return {"value": value, "recovered": o.recovered, "error": o.error, "skipped": o.skipped, "events": [vars(e) for e in o.events]}


def with_object(rows: DataFrame, raw: str, policies: dict[str, wobble.Policy], boundary: str, model: str) -> DataFrame:
    """Adds the struct `outcome` of tolerant object parsing; `value` is JSON text."""
    return with_row_functions(rows, {"outcome": (raw, OUTCOME, lambda v: _outcome(wobble.parse_object(v, policies, boundary, model)))})


def with_list(rows: DataFrame, raw: str, item: Callable[[dict[str, Any]], Any], boundary: str, model: str) -> DataFrame:
    """Adds the struct `outcome` of tolerant list parsing."""
    return with_row_functions(rows, {"outcome": (raw, OUTCOME, lambda v: _outcome(wobble.parse_list(v, item, boundary, model)))})


def exploded(df: DataFrame, array: str, out: str) -> DataFrame:
    """One row for each member of an array column, with its place `pos`."""
    others = [c for c in df.columns if c != array]
    return df.select(*others, F.posexplode(array).alias("pos", out))
