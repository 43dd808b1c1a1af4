"""Queries of text operators: grading, formatting, keys, regions, tolerant parsing, fences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions import native as N
from millrace.operators import pages as P
from millrace.operators.wobble import DEFAULT, DERIVE, OPTIONAL, SKIP, STRICT, Policy, without_fenced_blocks
from millrace.plans.registry import query, table
from millrace.plans.synth import cat

#: Stated grades of texts with each kind of injected defect, by doc_id % 8.
DEFECTS = "['failed', 'partial', 'partial', 'partial', 'partial', 'partial', 'high', 'high']"
LOSSES = "['all', 'encoding', 'encoding', 'table_structure', 'content', 'structure', '', '']"


@query(
    f"""SELECT doc_id, ({DEFECTS})[doc_id % 8 + 1] AS fidelity, ({LOSSES})[doc_id % 8 + 1] AS lost,
    CASE doc_id % 8 WHEN 0 THEN 'empty_output' WHEN 4 THEN 'low_yield=16/10000' WHEN 5 THEN 'no_tables_or_headings_in_large_doc' WHEN 3 THEN 'shattered_table_numeric_line_fraction=0.667' WHEN 2 THEN 'cid_glyph_leak_line_fraction=0.500' WHEN 1 THEN 'encoding_garbage_density=0.048' ELSE '' END AS warning
    FROM documents"""
)
def conversion_grade(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("doc_id") % 8
    lines = cat("A heading line\n", F.expr("repeat('1,234.50\\n', 14)"), F.expr("repeat('plain words\\n', 6)"))
    body = (
        F.when(k == 0, " \n\t ")
        .when(k == 1, cat("plain words of it", "� ", "go"))
        .when(k == 2, "one (cid:12) line\ntwo lines\n\nthree (cid:7)\nfour\n")
        .when(k == 3, lines)
        .when(k == 4, "sixteen letters.")
        .when(k == 5, F.expr("repeat('a long flat line of words\\n', 1500)"))
        .when(k == 6, cat(F.expr("repeat('a long flat line of words\\n', 1500)"), "# Title\n"))
        .otherwise(F.expr("repeat('| 1 | 2 |\\n', 40)"))
    )
    size = F.when(k == 4, 10000).when(k.isin(5, 6), 40000).otherwise(100)
    # Texts are made after ids are dealt: one split of ids stands for texts many times its size.
    rows = P.spread(table(spark, sf_dir, "documents").select("doc_id")).select("doc_id", body.alias("md"), size.alias("size"))
    graded = rows.select("doc_id", N.grade(F.col("md"), F.col("size")).alias("g"))
    return graded.select("doc_id", "g.fidelity", F.array_join("g.lost", ",").alias("lost"), F.array_join("g.warnings", ",").alias("warning"))


@query("SELECT doc_id, length(text) AS n, len(list_filter(regexp_split_to_array(text, '\\n'), lambda x: trim(x) <> ''))::BIGINT AS n_lines FROM documents WHERE text IS NOT NULL")
def line_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", F.length("text").cast("long").alias("n"), F.size(N.text_lines(F.col("text"))).cast("long").alias("n_lines"))


@query(
    """WITH m AS (SELECT event_id, (event_id * 37) % 130000 - 5 AS ms FROM events) SELECT event_id, CASE WHEN ms < 1000 THEN ms || 'ms' WHEN ms < 7000 THEN printf('%.1f', ms / 1000.0) || 's' WHEN ms < 60000 THEN (ms // 1000) || 's'
    ELSE (ms // 60000) || 'm' || lpad((ms // 1000 % 60)::VARCHAR, 2, '0') || 's' END AS duration FROM m"""
)
def fmt_dur(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", N.duration((F.col("event_id") * 37) % 130000 - 5).alias("duration"))


@query("SELECT doc_id, sha256(text) || ':' || sha256(lang) AS key FROM documents WHERE text IS NOT NULL AND lang IS NOT NULL")
def cache_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").where("text IS NOT NULL AND lang IS NOT NULL").select("doc_id", N.text_key(F.col("text"), F.col("lang")).alias("key"))


_TYPES = ["application/json", "text/json", " Application/LD+JSON ; charset=utf-8", "application/vnd.api+json", "text/html", "application/jsonx", "", "image/svg+json"]


@query("SELECT p_partkey, p_partkey % 8 < 4 AS is_json FROM part")
def content_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.element_at(F.array(*map(F.lit, _TYPES)), (F.col("p_partkey") % 8 + 1).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", N.is_json_type(kind).alias("is_json"))


@query("SELECT event_id, event_id % 5 IN (0, 1) AS is_json FROM events")
def sniff_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    from millrace.operators.payloads import sniffed

    k = F.col("event_id") % 5
    body = F.when(k == 0, F.col("props")).when(k == 1, cat(" \n[", F.col("props"), ",1]")).when(k == 2, cat("<html>", F.col("props"))).when(k == 3, F.substring("props", 1, 4)).otherwise("42")
    rows = table(spark, sf_dir, "events").select("event_id", body.cast("binary").alias("body"))
    # The cheap test comes before Python, which is given nothing where it fails.
    opens = F.substring(F.regexp_replace(F.substring(F.col("body").cast("string"), 1, 64), r"^\s+", ""), 1, 1).isin("{", "[")
    asked = rows.withColumn("body", F.when(opens, F.col("body")))
    return P.with_row_functions(asked, {"is_json": ("body", T.BooleanType(), lambda b: b is not None and sniffed(b))}).select("event_id", "is_json")


@query(
    """SELECT s_suppkey, CASE s_suppkey % 4 WHEN 0 THEN 'before <s>' || chr(10) || s_name || chr(10) || '<e> after <s>x<e>' WHEN 1 THEN '<s>' || chr(10) || s_name || chr(10) || '<e>' || chr(10)
    WHEN 2 THEN 'prose' || chr(10) || chr(10) || '<s>' || chr(10) || s_name || chr(10) || '<e>' || chr(10) ELSE '<e> reversed <s>' || chr(10) || chr(10) || '<s>' || chr(10) || s_name || chr(10) || '<e>' || chr(10) END AS body FROM supplier"""
)
def region_replace(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey") % 4
    body = F.when(k == 0, "before <s>old<e> after <s>x<e>").when(k == 1, "").when(k == 2, "prose\n\n\n").otherwise("<e> reversed <s>")
    return table(spark, sf_dir, "supplier").select("s_suppkey", N.region_replaced(body, cat(F.col("s_name"), "\n\n"), "<s>", "<e>").alias("body"))


@query("SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS text FROM documents WHERE text IS NOT NULL")
def squeezed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", N.squeezed(F.col("text")).alias("text"))


@query(
    """SELECT event_id, CASE WHEN event_id % 6 IN (3, 4) THEN NULL ELSE json_extract_string(props, '$.k') END AS k, CASE WHEN event_id % 6 = 4 THEN NULL ELSE event_type END AS kind,
    CASE WHEN event_id % 6 = 3 THEN 'skip:k' WHEN event_id % 6 = 4 THEN 'error' WHEN event_id % 6 = 5 THEN 'note,size' ELSE 'size' END AS state FROM events"""
)
def wobble_object(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id") % 6
    inner = F.regexp_extract("props", r"\{(.*)\}", 1)
    kind = cat('"kind":"', F.col("event_type"), '"')
    note = F.when(k == 5, ',"note":null').otherwise(',"note":"n"')
    whole = cat("{", F.when(k == 3, '"k":null').otherwise(inner), F.when(k == 4, "").otherwise(F.concat(F.lit(","), kind)), note, "}")
    raw = F.when(k == 1, cat("```json\n", whole, "\n``` trailing")).when(k == 2, cat("Sure: ", whole, " hope it helps")).otherwise(whole)
    policies = {"kind": Policy(STRICT), "k": Policy(SKIP), "note": Policy(DEFAULT, "none"), "size": Policy(DERIVE, derive=lambda d: len(d)), "extra": Policy(OPTIONAL)}
    rows = P.with_object(table(spark, sf_dir, "events").select("event_id", "event_type", raw.alias("raw")), "raw", policies, "events", "m1")
    o = F.col("outcome")
    state = F.when(o["error"].isNotNull(), "error").when(o["skipped"].isNotNull(), F.concat(F.lit("skip:"), o["skipped"])).otherwise(F.array_join(F.array_sort(o["recovered"]), ","))
    return rows.select("event_id", F.get_json_object(o["value"], "$.k").alias("k"), F.coalesce(F.get_json_object(o["value"], "$.kind"), F.when(k == 3, F.col("event_type"))).alias("kind"), state.alias("state"))


@query("SELECT event_id % 6 AS variant, field, tolerance, count(*) AS n FROM (SELECT event_id, unnest(['_envelope', 'k', 'note', 'size']) AS field, unnest(['derive', 'skip', 'default', 'derive']) AS tolerance FROM events) WHERE (field = '_envelope' AND event_id % 6 = 2) OR (field = 'k' AND event_id % 6 = 3) OR (field = 'note' AND event_id % 6 = 5) OR (field = 'size' AND event_id % 6 NOT IN (3, 4)) GROUP BY 1, 2, 3")
def wobble_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id") % 6
    whole = cat("{", F.when(k == 4, "").otherwise('"kind":"x"'), F.when(k == 4, "").otherwise(","), F.when(k == 3, '"k":null').otherwise('"k":1'), F.when(k == 5, "").otherwise(',"note":"n"'), "}")
    raw = F.when(k == 2, cat("Sure: ", whole)).otherwise(whole)
    policies = {"kind": Policy(STRICT), "k": Policy(SKIP), "note": Policy(DEFAULT, "none"), "size": Policy(DERIVE, derive=lambda d: len(d))}
    rows = P.with_object(table(spark, sf_dir, "events").select("event_id", raw.alias("raw")), "raw", policies, "events", "m1")
    return rows.select(k.alias("variant"), F.explode("outcome.events").alias("e")).groupBy("variant", F.col("e.field").alias("field"), F.col("e.tolerance").alias("tolerance")).agg(F.count("*").alias("n"))


@query(
    """SELECT event_id, CASE WHEN event_id % 4 = 3 THEN NULL ELSE '[' || CASE WHEN event_id % 4 = 2 THEN '' ELSE event_id::VARCHAR || ', ' END || (event_id + 1) || ']' END AS kept,
    CASE event_id % 4 WHEN 1 THEN '1' WHEN 2 THEN '0,1' ELSE '' END AS dropped, event_id % 4 = 3 AS failed FROM events"""
)
def wobble_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    i, k = F.col("event_id"), F.col("event_id") % 4
    first = F.when(k == 2, '"junk"').otherwise(cat('{"id":', i, "}"))
    junk = F.when(k == 1, ',{"no":1}').when(k == 2, ",{}").otherwise("")
    raw = F.when(k == 3, '{"id":1}').otherwise(cat("```json\n[", first, junk, ',{"id":', i + 1, "}]\n```"))
    rows = P.with_list(table(spark, sf_dir, "events").select("event_id", raw.alias("raw")), "raw", lambda d: d.get("id"), "items", "m1")
    o = F.col("outcome")
    return rows.select("event_id", o["value"].alias("kept"), F.array_join(o["recovered"], ",").alias("dropped"), o["error"].isNotNull().alias("failed"))


@query(
    """SELECT s_suppkey, CASE s_suppkey % 3 WHEN 0 THEN s_name || ' a' || chr(10) || chr(10) || 'b' WHEN 1 THEN s_name || chr(10) || '```python' || chr(10) || 'x = 1' || chr(10) || '```' || chr(10) || 'tail' || chr(10) || chr(10) || 'end' ELSE s_name END AS prose FROM supplier"""
)
def fence_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey") % 3
    json_block = '```json\n["a"]\n```'
    raw = F.when(k == 0, cat(F.col("s_name"), " a\n", json_block, "\nb")).when(k == 1, cat(F.col("s_name"), "\n```python\nx = 1\n```\ntail\n", json_block, "\nend")).otherwise(cat(" ", F.col("s_name"), "\n```\n{bad\n```\n"))
    rows = P.with_row_functions(table(spark, sf_dir, "supplier").select("s_suppkey", raw.alias("raw")), {"prose": ("raw", T.StringType(), without_fenced_blocks)})
    return rows.select("s_suppkey", "prose")


@query("SELECT s_suppkey, CASE s_suppkey % 3 WHEN 2 THEN 'plain ' || s_name ELSE s_name END AS body FROM supplier")
def unfenced(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey") % 3
    raw = F.when(k == 0, cat(" ```json\n", F.col("s_name"), "\n``` more")).when(k == 1, cat("```", F.col("s_name"), " ")).otherwise(cat("\tplain ", F.col("s_name"), "\n"))
    return table(spark, sf_dir, "supplier").select("s_suppkey", N.unfenced(raw).alias("body"))


@query("SELECT s_suppkey, 'go ' || s_name || ' to ${MISSING} and ' || CASE WHEN s_suppkey % 2 = 0 THEN 'here' ELSE 'there' END AS line FROM supplier")
def env_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = cat("go ", F.col("s_name"), " to ${MISSING} and ", F.when(F.col("s_suppkey") % 2 == 0, "${PLACE}").otherwise("t${PLACE}"))
    return table(spark, sf_dir, "supplier").select("s_suppkey", N.env_resolved(line, {"PLACE": "here", "OTHER": "${PLACE}"}).alias("line"))


@query("SELECT s_suppkey, 'lib' || s_suppkey AS name, s_suppkey % 6 < 3 AS bounded FROM supplier")
def dependency_specs(spark: SparkSession, sf_dir: str) -> DataFrame:
    tails = ["<2", "~=1.0", "[extra]==1.0; python_version>'3'", ">=1", " ; x", ""]
    spec = cat("lib", F.col("s_suppkey"), F.element_at(F.array(*map(F.lit, tails)), (F.col("s_suppkey") % 6 + 1).cast("int")))
    return table(spark, sf_dir, "supplier").select("s_suppkey", N.dependency_name(spec).alias("name"), N.has_upper_bound(spec).alias("bounded"))


@query("SELECT s_suppkey, s_suppkey % 3 = 0 AS conflict FROM supplier")
def conflict_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = F.when(F.col("s_suppkey") % 3 == 0, "a\n<<<<<<< x\nb\n>>>>>>> y").when(F.col("s_suppkey") % 3 == 1, "<<<<<<< only").otherwise(">>>>>> six")
    return table(spark, sf_dir, "supplier").select("s_suppkey", N.has_conflict_markers(body).alias("conflict"))
