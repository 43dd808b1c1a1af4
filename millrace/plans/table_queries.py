"""Queries of table operators: encoding, views, caches, accounting, catalogs, duplicates, vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import native as N
from millrace.operators import accounting, cache, catalog, duplicates, wire
from millrace.plans.registry import query, table
from millrace.plans.synth import cat
from millrace.sources.files import engine_for

NOW = 1_700_000_000  # a fixed clock


@query("SELECT c_mktsegment AS segment, 'c_custkey' || chr(9) || 'c_name' || chr(9) || 'c_nationkey' || chr(10) || string_agg(c_custkey || chr(9) || c_name || chr(9) || c_nationkey || chr(10), '' ORDER BY c_custkey) AS tsv FROM customer GROUP BY 1")
def tsv_by_segment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wire.tables(table(spark, sf_dir, "customer"), ["c_mktsegment"], ["c_custkey", "c_name", "c_nationkey"], ["c_custkey"]).withColumnRenamed("c_mktsegment", "segment")


@query("SELECT s_suppkey, s_name || '\\t\\n\\r\\\\' || chr(9) || chr(9) || CASE WHEN s_suppkey % 2 = 0 THEN 'True' ELSE 'False' END || chr(9) || '[1,2]' || chr(9) AS line FROM supplier")
def tsv_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", F.concat("s_name", F.lit("\t\n\r\\")).alias("a"), F.lit(None).cast("string").alias("b"), (F.col("s_suppkey") % 2 == 0).alias("c"), F.array(F.lit(1), F.lit(2)).alias("d"))
    return rows.select("s_suppkey", wire.line(rows, ["a", "b", "c", "d", "absent"]).alias("line"))


@query(
    """SELECT r_regionkey, '{"items":"n_nationkey\\tn_name\\n' || string_agg(n_nationkey || '\\t' || n_name || '\\n', '' ORDER BY n_nationkey) || '","next_cursor":"' || r_regionkey || '","_items_format":"tsv"}' AS page
    FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY r_regionkey"""
)
def envelope_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "nation").groupBy(F.col("n_regionkey").alias("r_regionkey")).agg(F.sort_array(F.collect_list(F.struct("n_nationkey", "n_name"))).alias("items"))
    rows = rows.withColumn("next_cursor", F.col("r_regionkey").cast("string"))
    shape = rows.select("items", "next_cursor").schema
    assert wire.plan(shape).kind == wire.PAGE
    return rows.select("r_regionkey", wire.encoded(rows, ["items", "next_cursor"], ("items",)).alias("page"))


@query("SELECT 'list of flat rows' AS shape, 'tsv' AS kind, '' AS fields UNION ALL SELECT 'page', 'page-tsv', '' UNION ALL SELECT 'nested rows', 'json', '' UNION ALL SELECT 'envelope', 'envelope', 'hits,misses' UNION ALL SELECT 'scalar', 'json', ''")
def encoding_plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import types as T

    shapes = {
        "list of flat rows": "array<struct<id:int,title:string>>",
        "page": "struct<items:array<struct<id:int>>,next_cursor:string>",
        "nested rows": "array<struct<id:int,tags:array<string>>>",
        "envelope": "struct<n:int,hits:array<struct<id:int>>,misses:array<struct<a:string,b:date>>,tags:array<string>>",
        "scalar": "struct<a:int>",
    }
    plans = {name: wire.plan(T.StructType.fromDDL(f"x {ddl}")["x"].dataType) for name, ddl in shapes.items()}
    return spark.createDataFrame([(n, p.kind, ",".join(p.tsv_fields)) for n, p in plans.items()], "shape string, kind string, fields string")


@query("SELECT o_orderkey, o_orderstatus FROM orders ORDER BY o_orderkey LIMIT 25")
def list_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wire.list_view(table(spark, sf_dir, "orders"), ["o_orderkey", "absent", "o_orderstatus"], [F.col("o_orderkey")], 25)


@query(
    """WITH k AS (SELECT p_partkey, list_concat(list_concat(CASE WHEN p_partkey % 4 = 0 THEN ['d'] ELSE [] END, CASE WHEN p_partkey % 2 = 1 THEN ['a'] ELSE [] END), list_concat(CASE WHEN p_partkey % 2 = 0 THEN ['b'] ELSE [] END, CASE WHEN p_partkey % 3 = 0 THEN ['c'] ELSE [] END)) AS keys FROM part),
    x AS (SELECT p_partkey AS r, unnest(keys) AS c, unnest(range(len(keys))) AS a FROM k) SELECT c AS "column", min(r)::BIGINT AS "row", arg_min(a, r)::BIGINT AS "at" FROM x GROUP BY c"""
)
def sparse_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    entry = lambda name, keep: F.when(keep, F.create_map(F.lit(name), F.lit("v"))).otherwise(F.create_map().cast("map<string,string>"))
    fields = F.map_concat(entry("d", k % 4 == 0), entry("a", k % 2 == 1), entry("b", k % 2 == 0), entry("c", k % 3 == 0))
    rows = table(spark, sf_dir, "part").select("p_partkey", fields.alias("m"))
    found = wire.first_seen_columns(rows, "m", "p_partkey")
    return found.select("column", F.col("row").cast("long").alias("row"), F.col("at").cast("long").alias("at"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 2 = 1 THEN 'o\\tdd' ELSE '' END || chr(9) || CASE WHEN p_partkey % 3 = 0 THEN 'three' ELSE '' END AS line FROM part")
def sparse_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    fields = F.map_filter(F.create_map(F.lit("odd"), F.when(k % 2 == 1, "o\tdd"), F.lit("three"), F.when(k % 3 == 0, "three")), lambda _, v: v.isNotNull())
    return wire.sparse_lines(table(spark, sf_dir, "part").select("p_partkey", fields.alias("m")), "m", "p_partkey", ["odd", "three"])


@query("SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN 'kept,name,zero' ELSE 'name,zero' END AS keys FROM supplier")
def prune_empty(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = F.create_map(F.lit("zero"), F.lit("0"), F.lit("blank"), F.lit(""), F.lit("none"), F.lit(None).cast("string"), F.lit("name"), F.col("s_name"), F.lit("kept"), F.when(F.col("s_suppkey") % 2 == 0, "x"))
    return table(spark, sf_dir, "supplier").select("s_suppkey", F.array_join(F.array_sort(F.map_keys(N.pruned(fields))), ",").alias("keys"))


@query("SELECT n_nationkey, '| ' || n_nationkey || ' | a\\|b ' || n_name || ' |  |' AS line FROM nation")
def markdown_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "nation").select("n_nationkey", F.concat(F.lit("a|b\n"), "n_name").alias("x"), F.lit(None).cast("string").alias("y"))
    return rows.select("n_nationkey", wire.markdown_rows(rows, ["n_nationkey", "x", "y"]).alias("line"))


def _puts(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select("user_id", "event_type", F.col("event_id").alias("written"), F.round("value", 4).alias("value"), (F.lit(NOW) + (F.col("event_id") * 7919) % 1800 - 900).alias("expires_at"))


_LATEST = f"SELECT user_id, event_type, event_id AS written, round(value, 4) AS value, {NOW} + (event_id * 7919) % 1800 - 900 AS expires_at FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) = 1"


@query(_LATEST)
def cache_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _puts(spark, sf_dir)
    return cache.upserted(rows.where("written % 2 = 0"), rows.where("written % 2 = 1"), ["user_id", "event_type"], "written")


@query(f"WITH c AS ({_LATEST}) SELECT u.user_id, u.event_type, coalesce(c.written, -1) AS written, c.user_id IS NOT NULL AS hit FROM (SELECT DISTINCT user_id, t.event_type FROM events, (VALUES ('view'), ('error'), ('none')) t(event_type)) u LEFT JOIN c ON c.user_id = u.user_id AND c.event_type = u.event_type AND c.expires_at > {NOW}")
def cache_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _puts(spark, sf_dir)
    stored = cache.upserted(rows.where("written % 2 = 0"), rows.where("written % 2 = 1"), ["user_id", "event_type"], "written")
    asked = rows.select("user_id").distinct().select("user_id", F.explode(F.array(*map(F.lit, ("view", "error", "none")))).alias("event_type"))
    return cache.looked_up(asked, stored, ["user_id", "event_type"], F.lit(NOW)).select("user_id", "event_type", F.coalesce("written", F.lit(-1)).alias("written"), "hit")


@query(f"WITH c AS ({_LATEST}) SELECT count(*) FILTER (WHERE expires_at <= {NOW}) AS removed, count(*) FILTER (WHERE expires_at > {NOW}) AS kept FROM c")
def cache_evicted(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _puts(spark, sf_dir)
    kept, removed = cache.evicted(cache.upserted(rows, rows.limit(0), ["user_id", "event_type"], "written"), F.lit(NOW))
    return removed.crossJoin(kept.agg(F.count("*").alias("kept")))  # one row by one row


@query("SELECT s_suppkey, CASE s_suppkey % 4 WHEN 0 THEN '' WHEN 1 THEN 'If-None-Match=e' WHEN 2 THEN 'If-Modified-Since=m' ELSE 'If-Modified-Since=m,If-None-Match=e' END AS headers FROM supplier")
def conditional_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey") % 4
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", F.when(k.isin(1, 3), "e").when(k == 0, "").alias("etag"), F.when(k.isin(2, 3), "m").alias("last_modified"))
    entries = F.transform(F.map_entries("headers"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return cache.revalidation_headers(rows).select("s_suppkey", F.array_join(F.array_sort(entries), ",").alias("headers"))


@query("SELECT o_orderkey, CASE o_orderkey % 7 WHEN 0 THEN 'ok' WHEN 1 THEN 'ok' WHEN 2 THEN 'not_found' WHEN 3 THEN 'rate_limited' ELSE 'connection_error' END AS verdict, o_orderkey % 7 IN (3, 4) AS challenge FROM orders")
def fetch_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.element_at(F.array(*map(F.lit, (200, 304, 404, 429, 403, 500, 400))), (F.col("o_orderkey") % 7 + 1).cast("int"))
    return table(spark, sf_dir, "orders").select("o_orderkey", N.fetch_verdict(status).alias("verdict"), N.is_challenge(status, F.lit("xhr")).alias("challenge"))


#: Made-up models and prices per million tokens; callers bring their own table.
PRICES = [(0, "alpha-2", 1.0, 5.0), (1, "alpha", 3.0, 15.0), (2, "beta", 15.0, 75.0)]


@query(
    """WITH c AS (SELECT conv_id, turn, CASE role WHEN 'user' THEN 'alpha-2-x' WHEN 'assistant' THEN 'alpha' ELSE 'gamma' END AS model, length(text) AS n FROM conversations)
    SELECT model, sum(n * 2 + n % 5)::BIGINT AS prompt_total, round(sum(CASE model WHEN 'alpha-2-x' THEN n * 1.0 + n % 5 * 1.0 * 1.25 + n * 1.0 * 0.1 + n // 2 * 5.0 WHEN 'alpha' THEN n * 3.0 + n % 5 * 3.0 * 1.25 + n * 3.0 * 0.1 + n // 2 * 15.0 ELSE 0 END)::DOUBLE / 1000000, 9) AS cost FROM c GROUP BY 1"""
)
def token_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.length("text")
    model = F.when(F.col("role") == "user", "alpha-2-x").when(F.col("role") == "assistant", "alpha").otherwise("gamma")
    usage = table(spark, sf_dir, "conversations").select(model.alias("model"), n.alias("input_tokens"), (n % 5).alias("cache_creation_input_tokens"), n.alias("cache_read_input_tokens"), F.floor(n / 2).alias("output_tokens"))
    prices = spark.createDataFrame(PRICES, "place int, known string, input double, output double")
    return accounting.priced(usage, prices).groupBy("model").agg(F.sum("prompt_total").alias("prompt_total"), F.round(F.sum("cost_usd"), 9).alias("cost"))


@query("SELECT p_partkey, p_partkey % 6 IN (0, 2, 3) AS permitted FROM part")
def cost_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = [("flat", "ANY-Model"), ("metered", "big-model"), ("metered", "Big-Mini-7b"), ("gateway", "v1.nano"), ("gateway", "v1xnano"), ("unlisted", "mini")]
    pick = lambda i: F.element_at(F.array(*[F.lit(c[i]) for c in calls]), (F.col("p_partkey") % 6 + 1).cast("int"))
    policy = spark.createDataFrame([("flat", "*"), ("metered", "*mini*"), ("metered", "*[0-4]b"), ("gateway", "v?.nano")], "provider string, pattern string")
    return accounting.permitted(table(spark, sf_dir, "part").select("p_partkey", pick(0).alias("provider"), pick(1).alias("model")), policy).select("p_partkey", "permitted")


@query("SELECT n_nationkey, n_name, coalesce(string_agg(s_name, ', ' ORDER BY s_name), 'orphaned') AS consumers FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey AND s_acctbal > 5000 GROUP BY 1, 2")
def orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    uses = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("software"), F.col("s_name").alias("consumer"), F.when(F.col("s_acctbal") > 5000, "active").otherwise("ended").alias("status"))
    return catalog.with_consumers(table(spark, sf_dir, "nation").select("n_nationkey", "n_name"), uses, name="n_nationkey")


@query("SELECT 's' || s_suppkey AS name, CASE s_suppkey % 5 WHEN 0 THEN 'not on disk' WHEN 1 THEN 'not in catalog' ELSE 'stale release' END AS fault FROM supplier WHERE s_suppkey % 5 < 3")
def release_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("name"), (F.col("s_suppkey") % 5).alias("k"))
    listed = rows.where("k <> 1").select("name", F.concat("name", F.when(F.col("k") == 2, "-v0.9").otherwise("-v1.0")).alias("release"))
    return catalog.release_faults(listed, rows.where("k <> 0").select("name", F.lit("1.0").alias("version")))


@query("SELECT '| Name | Region |' || chr(10) || '| --- | --- |' || chr(10) || string_agg('| ' || n_name || ' | ' || n_regionkey || ' |' || chr(10), '' ORDER BY n_name) AS \"index\" FROM nation")
def catalog_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.index_text(table(spark, sf_dir, "nation"), ["n_name", "n_regionkey"], ["n_name"], ["Name", "Region"])


_BODY = "md5(lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))))"


@query(f"SELECT {_BODY} AS body, count(*) AS members, min(doc_id) AS least FROM documents WHERE text IS NOT NULL GROUP BY 1 HAVING count(*) > 1")
def dup_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", F.md5(F.lower(N.squeezed(F.col("text"))).cast("binary")).alias("body"))
    return duplicates.groups(docs, "body", "doc_id")


_FACTS = "SELECT p_partkey AS ord, p_brand AS package, p_type AS file, '_' || p_size AS name, p_partkey % 7 AS stmt_count, p_partkey % 11 = 0 AS is_dunder, p_size::VARCHAR || p_type AS body_hash FROM part"


def _facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    return p.select(k.alias("ord"), F.col("p_brand").alias("package"), F.col("p_type").alias("file"), cat("_", F.col("p_size")).alias("name"), (k % 7).alias("stmt_count"), (k % 11 == 0).alias("is_dunder"), (k % 11 != 0).alias("is_private"), F.concat(F.col("p_size").cast("string"), "p_brand").alias("body_hash"))


@query(f"WITH f AS ({_FACTS.replace('p_size::VARCHAR || p_type', 'p_size::VARCHAR || p_brand')}) SELECT a.ord AS a_ord, b.ord AS b_ord FROM f a JOIN f b ON a.body_hash = b.body_hash AND a.ord < b.ord AND a.file <> b.file AND a.package = b.package WHERE a.stmt_count >= 3 AND b.stmt_count >= 3 AND NOT a.is_dunder AND NOT b.is_dunder")
def duplicate_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicates.same_bodies(_facts(spark, sf_dir)).select("a_ord", "b_ord")


@query(f"WITH f AS ({_FACTS}) SELECT a.ord AS a_ord, b.ord AS b_ord FROM f a JOIN f b ON a.name = b.name AND a.ord < b.ord AND a.file <> b.file AND a.package <> b.package WHERE NOT a.is_dunder AND NOT b.is_dunder")
def name_collisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicates.same_names(_facts(spark, sf_dir), cross_package=True).select("a_ord", "b_ord")


@query("SELECT vec_id, round(1.0, 6) AS norm, round(list_cosine_similarity(embedding::DOUBLE[], list_transform(embedding, lambda x, i: CASE WHEN i % 2 = 0 THEN x ELSE 0 END)::DOUBLE[]), 5) AS even FROM embeddings")
def embed_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    unit = N.unit_vector(F.col("embedding"))
    half = N.unit_vector(F.transform(F.col("embedding"), lambda x, i: F.when(i % 2 == 1, x).otherwise(F.lit(0.0).cast("float"))))
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(N.dot(unit, unit), 6).alias("norm"), F.round(N.dot(unit, half), 5).alias("even"))


@query("SELECT s_suppkey, (['html', 'pdf', NULL, 'legacy'])[s_suppkey % 4 + 1] AS engine FROM supplier")
def engine_dispatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = cat("/a.b/f", F.col("s_suppkey"), F.element_at(F.array(*map(F.lit, (".HTM", ".x.pdf", ".txt", ".doc"))), (F.col("s_suppkey") % 4 + 1).cast("int")))
    return table(spark, sf_dir, "supplier").select("s_suppkey", engine_for(path).alias("engine"))


@query("SELECT s_suppkey, CASE s_suppkey % 3 WHEN 0 THEN '[' || s_suppkey || ' item(s)]' WHEN 1 THEN '<Thing>' ELSE '(see structuredContent)' END AS marker FROM supplier")
def short_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey") % 3
    return table(spark, sf_dir, "supplier").select("s_suppkey", wire.short_marker(F.col("s_suppkey"), k == 0, F.when(k == 1, "Thing")).alias("marker"))
