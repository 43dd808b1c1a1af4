"""Queries opN_<name> over whole tables, one for each operator of this folder, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from millrace.llm import chat, htmlextract, langid, media, mixing, ngramjoin, packing, quality, tokenstore, warc

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def word_tokenizer() -> str:
    """Place of the public vocabulary file that the queries use."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_media_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = media.with_features(media.with_headers(media.in_shard_order(media.stored(table(spark, sf_dir, "documents")))))
    return rows.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "width", "height", "format")


def op2_first_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"), word_tokenizer())


def op3_pareto_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(table(spark, sf_dir, "documents"))


def op4_preference_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.assembled(*chat.with_borrowed_answers(table(spark, sf_dir, "conversations")))


def op5_chunk_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenstore.read(tokenstore.write(table(spark, sf_dir, "documents"), word_tokenizer()))


def op6_language_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return langid.predicted(docs, langid.fit(docs))


def op7_rule_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality.judged(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "fail_bits")


def op8_tag_path_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmlextract.extracted(table(spark, sf_dir, "pages"))


def op9_warc_index_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = warc.written(table(spark, sf_dir, "pages"))
    return warc.read(index).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op10_shingle_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngramjoin.joined(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Query] = {
    "op1_media_shards": op1_media_shards,
    "op2_first_fit_packing": op2_first_fit_packing,
    "op3_pareto_mix": op3_pareto_mix,
    "op4_preference_pairs": op4_preference_pairs,
    "op5_chunk_store": op5_chunk_store,
    "op6_language_codes": op6_language_codes,
    "op7_rule_ledger": op7_rule_ledger,
    "op8_tag_path_text": op8_tag_path_text,
    "op9_warc_index_first": op9_warc_index_first,
    "op10_shingle_join": op10_shingle_join,
}

#: The word rule for SQL's regular expressions.
_WORD = r"[^\x20\x09-\x0D]+"

#: SQL for the queries that SQL can express; the others are tested against brute force, a round trip or held-out labels.
ORACLE: dict[str, str] = {
    "op4_preference_pairs": """
WITH e AS (
    SELECT conv_id AS pair_id, coalesce(turn, -1) AS turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS body FROM conversations WHERE conv_id IS NOT NULL
), l AS (SELECT pair_id, max(turn) AS last FROM e WHERE role = 'assistant' GROUP BY 1),
a AS (SELECT e.pair_id, last, count(*) AS n, max(body) AS answer FROM e JOIN l ON l.pair_id = e.pair_id AND turn = last WHERE role = 'assistant' GROUP BY 1, 2),
i AS (
    SELECT a.pair_id, a.last, b.answer AS lent, CASE WHEN a.n = 1 AND a.answer = b.answer THEN 9223372036854775807 ELSE a.last END AS cut
    FROM a LEFT JOIN a b ON b.pair_id = a.pair_id + 1
), p AS (
    SELECT e.*, CASE WHEN turn = last AND role = 'assistant' THEN 1 ELSE 3 END AS side, coalesce(cut, 9223372036854775807) AS cut
    FROM e LEFT JOIN i USING (pair_id) WHERE last IS NULL OR turn <= last
    UNION ALL SELECT pair_id, last, 'assistant', lent, 2, cut FROM i WHERE lent IS NOT NULL
), r AS (
    SELECT *, greatest(turn, 0) // 1024 AS part, '<|' || role || '|>' || chr(10) || body || '<|end|>' || chr(10) AS x, CASE WHEN role = 'assistant' THEN '1:' ELSE '0:' END AS bit FROM p
)
SELECT pair_id, part, 0::BIGINT AS piece, count(*) FILTER (WHERE side <> 2 AND turn < cut) AS n_prompt_turns,
    coalesce(string_agg(x, '' ORDER BY turn, role, body) FILTER (WHERE side <> 2 AND turn < cut), '') AS prompt,
    coalesce(string_agg(x, '' ORDER BY turn, role, body) FILTER (WHERE side <> 2 AND turn >= cut), '') AS chosen,
    coalesce(string_agg(bit || length(x), ',' ORDER BY turn, role, body) FILTER (WHERE side <> 2 AND turn >= cut), '') AS chosen_mask,
    coalesce(string_agg(x, '' ORDER BY turn, role, body) FILTER (WHERE side > 1 AND turn >= cut), '') AS rejected,
    coalesce(string_agg(bit || length(x), ',' ORDER BY turn, role, body) FILTER (WHERE side > 1 AND turn >= cut), '') AS rejected_mask
FROM r GROUP BY 1, 2
""",
    "op7_rule_ledger": f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS w FROM documents),
v AS (SELECT doc_id, unnest(range(1, len(w) - 1)) AS i, unnest(list_transform(range(1, len(w) - 1), lambda k: w[k] || ' ' || w[k + 1] || ' ' || w[k + 2])) AS g FROM d WHERE len(w) > 3),
c AS (SELECT doc_id, i FROM v QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
r AS (SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM c, (VALUES (0), (1), (2)) o(k) GROUP BY 1),
m AS (
    SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars, len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols,
        list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{_WORD}')) AS ls, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
        len(regexp_extract_all(t, '\\p{{L}}')) AS n_letters, len(regexp_extract_all(t, '\\p{{Lu}}')) AS n_upper,
        len(list_filter(w, lambda x: suffix(x, '!!'))) AS n_shouts, len(list_filter(w, lambda x: regexp_matches(x, '\\p{{L}}'))) AS n_letter_words
    FROM d LEFT JOIN r USING (doc_id)
), n AS (SELECT *, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, len(ls) AS n_lines FROM m),
b AS (
    SELECT *, (CASE WHEN n_words < 50 THEN 1 ELSE 0 END + CASE WHEN 100 * n_repeat_words > 50 * n_words THEN 2 ELSE 0 END + CASE WHEN 10 * n_symbols > n_words THEN 4 ELSE 0 END
        + CASE WHEN n_words > 0 AND (word_chars < 3 * n_words OR word_chars > 12 * n_words) THEN 8 ELSE 0 END + CASE WHEN n_dup_lines >= 4 AND 100 * n_dup_lines > 30 * n_lines THEN 16 ELSE 0 END
        + CASE WHEN 2 * n_upper > n_letters THEN 32 ELSE 0 END + CASE WHEN 100 * n_shouts > 30 * n_words THEN 64 ELSE 0 END + CASE WHEN 100 * n_letter_words < 70 * n_words THEN 128 ELSE 0 END)::BIGINT AS fail_bits
    FROM n
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, fail_bits & 3 <> 0 AS base_failed, fail_bits = 0 AS kept, fail_bits FROM b
""",
    "op10_shingle_join": f"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_WORD}') AS w FROM documents),
s AS (
    SELECT DISTINCT doc_id, unnest(list_transform(range(1, len(w) - 3), lambda k: w[k] || ' ' || w[k + 1] || ' ' || w[k + 2] || ' ' || w[k + 3] || ' ' || w[k + 4])) AS g FROM d WHERE len(w) >= 5
    UNION ALL SELECT doc_id, array_to_string(w, ' ') FROM d WHERE len(w) BETWEEN 1 AND 4
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
i AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM i JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * c >= 75 * (p.n + q.n - c)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
h(x, y) AS (SELECT x, y FROM e UNION SELECT h.x, e.y FROM h JOIN e ON h.y = e.x)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(min(h.y), d.doc_id)) AS component_id FROM d LEFT JOIN n USING (doc_id) LEFT JOIN h ON h.x = d.doc_id GROUP BY 1, 2
""",
}
