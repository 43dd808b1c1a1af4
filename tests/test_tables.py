"""DataFrame forms, sources, streaming, plans and registered queries."""

import contextlib
import io

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_module
from millrace.functions.dom import parse
from millrace.operators import content, pages
from millrace.plans.queries import ORACLE, QUERIES
from millrace.sources import files

SMALL = "/root/testdata/sf0.001"


def plan_of(df):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


def test_wrapper_equals_row_function(spark):
    rows = spark.read.parquet(f"{SMALL}/pages.parquet").select("page_id", "html")
    got = {r.page_id: [tuple(x) for x in r.links] for r in pages.parsed_pages(rows, ["links"]).collect()}
    want = {r.page_id: [(x.anchor, x.href, x.role) for x in content.links(parse(r.html))] for r in rows.collect()}
    assert got == want and any(got.values())


def test_null_and_empty_pages(spark):
    rows = spark.createDataFrame([(1, None), (2, ""), (3, "<h1>x")], "page_id long, html string")
    got = {r.page_id: (r.links, [tuple(h) for h in r.headings], r.metadata, r.payloads, r.main_content) for r in pages.parsed_pages(rows, ["links", "headings", "metadata", "payloads", "main_content"]).collect()}
    assert got[1] == got[2] == ([], [], {}, [], "") and got[3][1] == [(1, "x")]
    assert pages.with_records(rows).where("found IS NOT NULL").count() == 0


def test_one_python_pass_and_pruned_scan(spark):
    rows = spark.read.parquet(f"{SMALL}/pages.parquet").where("page_id > 3").select("page_id", "html")
    plan = plan_of(pages.parsed_pages(rows, ["links", "headings"]).select("page_id", F.size("links")))
    tree = plan[: plan.index("\n(1)")]
    assert tree.count("MapInArrow") == 1
    assert "ReadSchema: struct<page_id:bigint,html:string>" in plan and "GreaterThan(page_id,3)" in plan


def test_toml_directory(spark, tmp_path):
    (tmp_path / "b.toml").write_text('name = "b"\nseq = 2\ntags = ["x", "y"]\n')
    (tmp_path / "a.toml").write_text('name = "a"\n')
    (tmp_path / "c.txt").write_text("no")
    from pyspark.sql import types as T

    df = files.toml_directory(spark, str(tmp_path), {"name": T.StringType(), "seq": T.LongType(), "tags": T.StringType()})
    assert [tuple(r) for r in df.orderBy("file").collect()] == [("a.toml", "a", None, None), ("b.toml", "b", 2, "x, y")]


def test_text_sink_replaces_whole_files(tmp_path):
    path = tmp_path / "d" / "t.md"
    files.write_text(path, "é\r\n")
    files.write_text(path, "z")
    assert path.read_bytes() == b"z" and [p.name for p in path.parent.iterdir()] == ["t.md"]


def test_streamed_cache_keeps_the_latest(spark, tmp_path):
    from millrace.streaming.ttl_cache import latest_by_key

    source = tmp_path / "in"
    spark.createDataFrame([("a", 1, "x"), ("a", 3, "z"), ("a", 2, "y"), ("b", 1, "q")], "key string, written long, value string").coalesce(1).write.parquet(str(source))
    stream = spark.readStream.schema("key string, written long, value string").parquet(str(source))
    got = []
    q = latest_by_key(stream, 3_600_000).writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).foreachBatch(lambda df, _: got.extend(map(tuple, df.collect()))).start()
    q.awaitTermination(120)
    assert sorted(got) == [("a", 3, "z"), ("b", 1, "q")]


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE) and len(QUERIES) > 55


def test_entry_and_names(spark):
    assert entry_module.entry(spark).count() > 0
    assert set(QUERIES) <= set(entry_module.queries()) and set(ORACLE) <= set(entry_module.oracle_sql())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_its_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    df = QUERIES[name](spark, SMALL)
    want = con.sql(ORACLE[name])
    assert sorted(df.columns) == sorted(want.columns)
    columns = sorted(df.columns)
    order = [want.columns.index(c) for c in columns]
    simple = lambda v: round(float(v), 7) if isinstance(v, float) or type(v).__name__ == "Decimal" else v
    got_rows = sorted((tuple(simple(r[c]) for c in columns) for r in df.collect()), key=repr)
    want_rows = sorted((tuple(simple(r[i]) for i in order) for r in want.fetchall()), key=repr)
    assert got_rows == want_rows
