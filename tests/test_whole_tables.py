"""Queries over part read all of it: at sf0.01, against their SQL with any filter on ids taken out."""

import os
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from millrace.operators import duplicates
from millrace.plans.queries import ORACLE, QUERIES

MIDDLE = "/root/testdata/sf0.01"


def whole(name, folder):
    """The SQL's rows over all parts."""
    sql = re.sub(r" AND [ab]\.ord <= \d+", "", re.sub(r" WHERE p_partkey <= \d+", "", ORACLE[name]))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW part AS SELECT * FROM read_parquet('{folder}/part.parquet{'/*.parquet' if os.path.isdir(f'{folder}/part.parquet') else ''}')")
    return con.sql(sql)


def same_rows(spark, name, folder=MIDDLE):
    want = whole(name, folder)
    got = QUERIES[name](spark, folder).select(*want.columns).collect()
    assert sorted(map(tuple, got)) == sorted(want.fetchall())
    return got


def test_name_collisions_of_all_parts(spark):
    assert max(r.b_ord for r in same_rows(spark, "name_collisions")) > 300


def test_duplicate_functions_of_all_parts(spark, tmp_path):
    """sf0.01 has no part above 2000: its parts once more, 3003 ids higher."""
    parts = spark.read.parquet(f"{MIDDLE}/part.parquet")
    higher = parts.withColumn("p_partkey", (parts.p_partkey + 3003).cast(parts.schema["p_partkey"].dataType))
    parts.unionByName(higher).write.parquet(str(tmp_path / "part.parquet"))
    got = same_rows(spark, "duplicate_functions", str(tmp_path))
    assert max(r.b_ord for r in got) > 3003 and min(r.a_ord for r in got) < 2000


def test_payload_rank_of_all_parts(spark):
    assert max(r.p_partkey for r in same_rows(spark, "payload_rank")) > 500


@pytest.mark.parametrize("cross", [True, False])
def test_pairs_of_a_key_are_dealt_into_blocks(spark, monkeypatch, cross):
    """Keys above BLOCK members are compared block by block; no pair is lost or doubled, repeated ords and nulls included."""
    rows = [(None if i == 50 else i // 2 * (10**16 if i > 90 else 1), ["p", "q", None][i % 7 % 3], "fgh"[i % 5 % 3], "ab"[i % 3 % 2] if i % 29 else None) for i in range(100)]
    facts = spark.createDataFrame(rows, "ord long, package string, file string, name string").withColumn("is_private", F.lit(True))
    want = sorted((a[0], b[0]) for a in rows for b in rows if None not in (*a, *b) and a[3] == b[3] and a[0] < b[0] and a[2] != b[2] and (a[1] != b[1]) == cross)
    monkeypatch.setattr(duplicates, "BLOCK", 7)
    got = duplicates.same_names(facts, cross_package=cross)
    assert got.columns == ["key", *[f"{s}_{c}" for s in "ab" for c in ("ord", "package", "file", "name")]]
    assert sorted((r.a_ord, r.b_ord) for r in got.collect()) == want and len(want) > 100


def test_headings_cut_inside_a_reference(spark, tmp_path):
    titles = ["and&amp", "&amp;&am", "a &lt b", "&lt;b&gt; &quot;c&quot;", "x & y&", "&amp;lt; &copy; &#65;"]
    spark.createDataFrame([(i, f"<html><body><h1>{t}</h1><p>text</p></body></html>") for i, t in enumerate(titles)], "page_id long, html string").write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{tmp_path}/pages.parquet/*.parquet')")
    assert sorted(map(tuple, QUERIES["page_headings"](spark, str(tmp_path)).collect())) == sorted(con.sql(ORACLE["page_headings"]).fetchall())
