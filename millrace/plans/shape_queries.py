"""Queries of the row and envelope shapes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import shapes
from millrace.plans.registry import query, table
from millrace.plans.synth import cat


@query("SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN '/' ELSE '/p' END AS path, coalesce(CASE WHEN s_suppkey % 3 <> 0 THEN s_suppkey END, -1) AS expires, (s_suppkey % 2)::INTEGER AS is_secure, 0::INTEGER AS is_httponly, (['lax', 'strict', 'none', ''])[s_suppkey % 4 + 1] AS samesite FROM supplier")
def cookie_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    site = F.element_at(F.array(*map(F.lit, ("Lax", "STRICT", "none", "weird"))), (k % 4 + 1).cast("int"))
    row = shapes.cookie_row(F.lit(".h"), F.lit(None).cast("string"), F.col("s_name"), F.when(k % 2 == 1, "/p").otherwise(""), F.when(k % 3 != 0, k).otherwise(0), k % 2 == 1, F.lit(None).cast("boolean"), site)
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", row.alias("c"))
    return rows.select("s_suppkey", "c.path", F.coalesce("c.expires_utc", F.lit(-1)).alias("expires"), "c.is_secure", "c.is_httponly", F.coalesce("c.samesite", F.lit("")).alias("samesite"))


@query("SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN '' ELSE 'a b.txt,' || s_name END AS paths, CASE WHEN s_suppkey % 5 = 0 THEN 'HEAD' ELSE 'main' END AS branch, s_suppkey % 3 = 0 AS clean, CASE WHEN s_suppkey % 2 = 0 THEN s_suppkey ELSE 0 END AS ahead, CASE WHEN s_suppkey % 2 = 0 THEN 7 ELSE 0 END::BIGINT AS behind FROM supplier")
def sync_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    listing = F.when(k % 3 == 0, "\n").otherwise(cat(" M a b.txt\n\n?? ", F.col("s_name"), "\r\n"))
    counts = F.when(k % 2 == 0, cat("7\t", k, "\n")).otherwise("")
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", F.array_join(shapes.changed_paths(listing), ",").alias("paths"), shapes.sync_state(F.when(k % 5 != 0, " main\n"), listing, counts, F.lit(False)).alias("s"))
    return rows.select("s_suppkey", "paths", "s.branch", "s.clean", "s.ahead", "s.behind")


@query("SELECT s_suppkey, (['input', 'auth', 'policy', 'infra', 'infra', 'bug'])[s_suppkey % 7 + 1] AS base_kind, ([false, false, false, true, false, false])[s_suppkey % 7 + 1] AS retryable, ([400, 401, 403, 503, 503, NULL])[s_suppkey % 7 + 1]::INTEGER AS status FROM supplier WHERE s_suppkey % 7 < 6")
def error_envelopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.element_at(F.array(*map(F.lit, ("input", "auth", "policy", "infra", "rate_limit", "bug", "unknown"))), (F.col("s_suppkey") % 7 + 1).cast("int"))
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", shapes.error_envelope(kind, F.lit("E"), F.lit(None).cast("string"), {"rate_limit": ("infra", False)}).alias("e"))
    return rows.where("e IS NOT NULL").select("s_suppkey", "e.base_kind", "e.retryable", F.col("e.http_status").alias("status"))


@query("""SELECT s_suppkey, '{"resourceLogs":[{"resource":{"attributes":[{"key":"service.name","value":{"stringValue":"svc"}}]},"scopeLogs":[{"scope":{"name":"sc"},"logRecords":[{"attributes":[{"key":"subject","value":{"stringValue":"' || s_name || '"}}' || CASE WHEN s_suppkey % 2 = 0 THEN ',{"key":"wanted","value":{"stringValue":"more"}}' ELSE '' END || ']}]}]}]}' AS payload FROM supplier""")
def feedback_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = {"subject": F.col("s_name"), "wanted": F.when(F.col("s_suppkey") % 2 == 0, "more")}
    return table(spark, sf_dir, "supplier").select("s_suppkey", shapes.feedback_payload("svc", "sc", fields).alias("payload"))


@query("SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN 'cached' ELSE 'a' || chr(10) || chr(10) || 'b' END AS system, CASE WHEN s_suppkey % 2 = 0 THEN 'pre' || s_name ELSE 'ask' END AS \"user\" FROM supplier")
def flat_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    prefix = F.when(F.col("s_suppkey") % 2 == 0, "pre")
    p = shapes.flat_prompt(F.array(F.lit("a"), F.lit("b")), F.lit("ask"), F.lit("cached"), prefix, F.col("s_name"))
    return table(spark, sf_dir, "supplier").select("s_suppkey", p.alias("p")).select("s_suppkey", "p.system", "p.user")


@query("SELECT s_suppkey, (['text', 'tsv', '[3]', 'tsv', 'text'])[s_suppkey % 5 + 1] AS content, s_suppkey % 5 <> 1 AS has_structured FROM supplier")
def routed_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey") % 5
    mode = F.when(k == 1, "compact").when(k == 2, "strict").otherwise("dual")
    r = shapes.routed(F.lit("text"), F.lit("{}"), F.lit("tsv"), F.lit("[3]"), k == 0, F.when(k == 4, "machine").otherwise("llm"), mode)
    return table(spark, sf_dir, "supplier").select("s_suppkey", r.alias("r")).select("s_suppkey", "r.content", F.col("r.structured").isNotNull().alias("has_structured"))
