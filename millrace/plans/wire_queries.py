"""Queries of rendered results, pruned values, sparse tables, views of any value, responses, bodies and chains of engines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions import native as N
from millrace.operators import cache, wire
from millrace.operators import pages as P
from millrace.operators.payloads import response_payload
from millrace.plans.registry import query, table
from millrace.plans.synth import cat
from millrace.sources.files import CONVERTED, ConversionError, converter


@query(
    """SELECT s_suppkey, 'json' AS format, CASE WHEN s_suppkey % 3 = 0 THEN plain ELSE '{"n":' || s_suppkey || ',"hits":"s_name\\n' || s_name || '\\n","notes":"a\\tb\\n","pairs":[["x","y"]],"none":"\\n","_hits_format":"tsv","_notes_format":"tsv","_none_format":"tsv"}' END AS text, plain AS structured
    FROM (SELECT *, '{"n":' || s_suppkey || ',"hits":[{"s_name":"' || s_name || '"}],"notes":"a\\tb\\n","pairs":[["x","y"]],"none":[]}' AS plain FROM supplier)"""
)
def rendered_envelopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A field left out, a finished table, a list that is no table and an empty one, for two consumers."""
    value = F.struct(
        F.col("s_suppkey").alias("n"), F.array(F.struct("s_name")).alias("hits"), F.lit("a\tb\n").alias("notes"), F.array(F.array(F.lit("x"), F.lit("y"))).alias("pairs"),
        F.lit(None).cast("array<struct<a:int>>").alias("gone"), F.array().cast("array<array<string>>").alias("none"),
    )
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", value.alias("v"))
    chosen = wire.Plan(wire.ENVELOPE, ("hits", "notes", "pairs", "gone", "none"))
    made = wire.rendered(F.col("v"), rows.schema["v"].dataType, F.when(F.col("s_suppkey") % 3 == 0, "code").otherwise("llm"), chosen)
    return rows.select("s_suppkey", made.alias("r")).select("s_suppkey", "r.format", "r.text", "r.structured")


@query(
    """SELECT n_regionkey, CASE WHEN n_regionkey % 2 = 0 THEN 'tsv' ELSE 'json' END AS format, CASE WHEN n_regionkey % 2 = 0 THEN 'n_nationkey' || chr(9) || 'n_name' || chr(10) || string_agg(n_nationkey || chr(9) || n_name || chr(10), '' ORDER BY n_nationkey)
    ELSE '[' || string_agg('{"n_nationkey":' || n_nationkey || ',"n_name":"' || n_name || '"}', ',' ORDER BY n_nationkey) || ']' END AS text FROM nation GROUP BY n_regionkey"""
)
def rendered_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.sort_array(F.collect_list(F.struct("n_nationkey", "n_name"))).alias("v"))
    made = wire.rendered(F.col("v"), rows.schema["v"].dataType, F.when(F.col("n_regionkey") % 2 == 0, "llm").otherwise("machine"))
    return rows.select("n_regionkey", made.alias("r")).select("n_regionkey", "r.format", "r.text")


@query(
    """SELECT s_suppkey, '{"zero":0,"off":false' || CASE WHEN s_suppkey % 2 = 0 THEN ',"inner":{"name":"' || s_name || '"}' ELSE '' END || ',"rows":[{},{"a":"x"}]}' AS text FROM supplier"""
)
def pruned_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    empty = F.lit("")
    inner = F.struct(F.when(F.col("s_suppkey") % 2 == 0, F.col("s_name")).otherwise("").alias("name"), F.array().cast("array<int>").alias("list"), F.struct(empty.alias("deep")).alias("deeper"))
    rows_of = F.array(F.struct(empty.alias("a")), F.struct(F.lit("x").alias("a")))
    value = F.struct(F.lit(0).alias("zero"), F.lit(False).alias("off"), empty.alias("blank"), inner.alias("inner"), F.create_map().cast("map<string,string>").alias("map"), rows_of.alias("rows"))
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", value.alias("v"))
    kind = rows.schema["v"].dataType
    return rows.select("s_suppkey", wire.json_text(wire.pruned(F.col("v"), kind), kind).alias("text"))


@query(
    """SELECT p_partkey, (SELECT CASE WHEN min(p_partkey) % 2 = 1 THEN 'odd' || chr(9) || 'name' ELSE 'name' || chr(9) || 'odd' END FROM part) AS header,
    CASE WHEN (SELECT min(p_partkey) FROM part) % 2 = 1 THEN CASE WHEN p_partkey % 2 = 1 THEN 'o\\tdd' ELSE '' END || chr(9) || p_name ELSE p_name || chr(9) || CASE WHEN p_partkey % 2 = 1 THEN 'o\\tdd' ELSE '' END END AS line FROM part"""
)
def sparse_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = F.map_filter(F.create_map(F.lit("odd"), F.when(F.col("p_partkey") % 2 == 1, "o\tdd"), F.lit("name"), F.col("p_name")), lambda _, v: v.isNotNull())
    return wire.sparse_table(table(spark, sf_dir, "part").select("p_partkey", fields.alias("m")), "m", "p_partkey")


@query(
    """SELECT n_regionkey, '[' || string_agg('{"n_name":"' || n_name || '"}', ',' ORDER BY n_nationkey) FILTER (place <= 2) || ']' AS list, '{"count":' || count(*) || '}' AS other
    FROM (SELECT *, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS place FROM nation) GROUP BY n_regionkey"""
)
def viewed_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A list is projected and cut; a value that is none passes."""
    rows = table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.sort_array(F.collect_list(F.struct("n_nationkey", "n_name"))).alias("v"), F.struct(F.count("*").alias("count")).alias("w"))
    seen = [F.to_json(wire.viewed(F.col(c), rows.schema[c].dataType, ["n_name", "absent"], 2)).alias(name) for c, name in (("v", "list"), ("w", "other"))]
    return rows.select("n_regionkey", *seen)


@query("SELECT s_suppkey, s_suppkey % 4 IN (1, 2) AS trips FROM supplier")
def breaker_trips(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey") % 4
    verdict = F.when(k == 0, N.fetch_verdict(F.lit(404))).when(k == 1, N.fetch_verdict(F.lit(503))).when(k == 2, "timeout").otherwise(N.fetch_verdict(F.lit(429)))
    return table(spark, sf_dir, "supplier").select("s_suppkey", N.trips_breaker(verdict).alias("trips"))


@query("SELECT s_suppkey, 'kept <s>' || chr(10) || s_name || ' (s)(e)' || chr(10) || '<e>!' AS body FROM supplier")
def region_escaped(spark: SparkSession, sf_dir: str) -> DataFrame:
    safe = lambda c: F.replace(F.replace(c, F.lit("<s>"), F.lit("(s)")), F.lit("<e>"), F.lit("(e)"))
    body = N.region_replaced(F.lit("kept <s>old<e>!"), cat(F.col("s_name"), " <s><e>\n"), "<s>", "<e>", safe)
    return table(spark, sf_dir, "supplier").select("s_suppkey", body.alias("body"))


@query("SELECT event_id, CASE WHEN event_id % 3 < 2 THEN 'generic' END AS source, CASE event_id % 3 WHEN 0 THEN length(props) WHEN 1 THEN length(props) + 6 END::BIGINT AS byte_size FROM events")
def response_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id") % 3
    rows = table(spark, sf_dir, "events").select("event_id", F.when(k == 0, F.col("props")).when(k == 1, cat(" \n[", F.col("props"), ",1]")).otherwise(" 42 ").alias("body"))
    kind = T.StructType.fromDDL("source string, byte_size long")
    read = lambda b: None if (p := response_payload(b or "")) is None else {"source": p.source, "byte_size": p.byte_size}
    return P.with_row_functions(rows, {"p": ("body", kind, read)}).select("event_id", "p.source", "p.byte_size")


@query("SELECT doc_id, text AS body, sha256(text) AS content_hash FROM documents")
def packed_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", F.col("text").cast("binary").alias("body"))
    return cache.unpacked_bodies(cache.packed_bodies(rows)).select("doc_id", F.col("body").cast("string").alias("body"), "content_hash")


@query("SELECT count(*) AS \"rows\" FROM (SELECT DISTINCT user_id, event_type FROM events)")
def cache_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("user_id", "event_type", F.col("event_id").alias("written"), F.lit(0).alias("expires_at"))
    return cache.counted(cache.upserted(rows, rows.limit(0), ["user_id", "event_type"], "written"))


@query(
    """SELECT s_suppkey, CASE s_suppkey % 4 WHEN 0 THEN 'strict' WHEN 1 THEN 'loose' WHEN 2 THEN 'loose' ELSE 'none' END AS engine, CASE s_suppkey % 4 WHEN 0 THEN s_name WHEN 1 THEN upper(s_name) ELSE '' END AS markdown,
    CASE WHEN s_suppkey % 4 >= 2 THEN 'all' ELSE '' END AS lost, CASE s_suppkey % 4 WHEN 2 THEN 'no mark,refused' WHEN 3 THEN 'unsupported_format:.zip' ELSE '' END AS warnings FROM supplier"""
)
def engine_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first engine serves, the second, none, and a kind without a chain."""

    def strict(body: bytes) -> str:
        if not body.startswith(b"+"):
            raise ConversionError("no mark")
        return body[1:].decode()

    def loose(body: bytes) -> str:
        if body.startswith(b"-"):
            raise ConversionError("refused")
        return body.decode().upper()

    k = F.col("s_suppkey") % 4
    path = F.when(k == 3, "/x/a.zip").otherwise("/x/a.HTML")
    body = cat(F.when(k == 0, "+").when(k == 2, "-").otherwise(""), F.col("s_name")).cast("binary")
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", F.struct(path.alias("path"), body.alias("content")).alias("d"))
    made = P.with_row_functions(rows, {"c": ("d", CONVERTED, converter({"html": [("strict", strict), ("loose", loose)]}))})
    return made.select("s_suppkey", "c.engine", "c.markdown", F.array_join("c.lost", ",").alias("lost"), F.array_join("c.warnings", ",").alias("warnings"))
