"""Rendered, pruned and viewed values, sparse tables, chains of engines, bodies, dates: nulls, empty values, plans that do not fit."""

import datetime

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions.dom import parse
from millrace.operators import cache, content, pages, wire
from millrace.operators.payloads import response_payload
from millrace.sources.files import ConversionError, converter


def rendered(spark, ddl, value, consumer="llm", plan=None):
    rows = spark.createDataFrame([(value,)], f"v {ddl}")
    return tuple(rows.select(wire.rendered(F.col("v"), rows.schema["v"].dataType, F.lit(consumer), plan).alias("r")).first().r)


def test_plans_that_do_not_fit_give_json(spark):
    assert rendered(spark, "int", 7) == ("7", "json", "7")
    assert rendered(spark, "string", 'a"b') == ('"a\\"b"', "json", '"a\\"b"')
    assert rendered(spark, "array<int>", [1, 2], plan=wire.Plan(wire.ENVELOPE, ("x",)))[0] == "[1,2]"
    assert rendered(spark, "int", 7, plan=wire.Plan(wire.TSV)) == ("\n", "tsv", "7")


def test_tables_and_pages(spark):
    assert rendered(spark, "array<struct<a:int,b:string>>", [(1, "x\ty"), (2, None)]) == ("a\tb\n1\tx\\ty\n2\t\n", "tsv", '[{"a":1,"b":"x\\ty"},{"a":2}]')
    assert rendered(spark, "array<struct<a:int>>", []) == ("\n", "tsv", "[]")
    page = "struct<items:array<struct<a:int>>,next_cursor:string>"
    assert rendered(spark, page, ([(1,)], "c")) == ('{"items":"a\\n1\\n","next_cursor":"c","_items_format":"tsv"}', "json", '{"items":[{"a":1}],"next_cursor":"c"}')
    assert rendered(spark, page, ([(1,)], None), "code") == ('{"items":[{"a":1}]}', "json", '{"items":[{"a":1}]}')


def test_null_results(spark):
    assert rendered(spark, "array<struct<a:int>>", None)[0] is None
    assert rendered(spark, "struct<a:int>", None, "machine") == (None, "json", None)


def test_pruning_goes_all_the_way_down(spark):
    ddl = "struct<a:struct<b:struct<c:string>,n:int>,l:array<struct<x:string>>,m:map<string,string>,s:string>"
    rows = spark.createDataFrame([(((("",), None), [], {}, ""),), (((("",), 0), [("",), None], {"k": None}, "t"),), (None,)], f"v {ddl}")
    kind = rows.schema["v"].dataType
    got = [r[0] for r in rows.select(wire.json_text(wire.pruned(F.col("v"), kind), kind)).collect()]
    assert got == [None, '{"a":{"n":0},"l":[{},null],"m":{"k":null},"s":"t"}', None]
    top = [r[0] for r in rows.limit(1).select(wire.json_text(wire.pruned(F.col("v"), kind, inner=False), kind)).collect()]
    assert top == ["{}"]


def test_sparse_table_of_escaped_and_missing_keys(spark):
    given = spark.createDataFrame([(2, ["b", "a\t"], ["2", None]), (1, [], []), (3, ["c"], ["x\ny"]), (4, None, None)], "id int, k array<string>, v array<string>")
    rows = given.select("id", F.map_from_arrays("k", "v").alias("m"))  # a map made from a dict would lose the order of its keys
    got = sorted(map(tuple, wire.sparse_table(rows, "m", "id").collect()))
    assert got == [(i, "b\ta\\t\tc", line) for i, line in ((1, "\t\t"), (2, "2\t\t"), (3, "\t\tx\\ny"), (4, "\t\t"))]
    assert wire.sparse_table(rows.limit(0), "m", "id").collect() == []


def test_views(spark):
    rows = spark.createDataFrame([([(1, "a"), (2, "b")], [1, 2])], "v array<struct<i:int,s:string>>, w array<int>")
    kind = rows.schema["v"].dataType
    see = lambda c, k, *a: rows.select(F.to_json(wire.viewed(F.col(c), k, *a))).first()[0]
    assert see("v", kind, ["s", "absent"], 1) == '[{"s":"a"}]'
    assert see("v", kind, [], 0) == '[{"i":1,"s":"a"},{"i":2,"s":"b"}]'
    assert see("v", kind, ["absent"]) == "[{},{}]"
    assert see("w", rows.schema["w"].dataType, ["s"], 1) == "[1,2]"


def test_bodies_come_back(spark):
    rows = spark.createDataFrame([(1, b""), (2, None), (3, b"x" * 100_000), (4, b"x" * 100_000)], "id int, body binary")
    packed = {r.id: r for r in cache.packed_bodies(rows).collect()}
    assert packed[2].body is None and packed[2].content_hash is None
    assert packed[3].body == packed[4].body and len(packed[3].body) < 1000
    back = {r.id: r.body for r in cache.unpacked_bodies(cache.packed_bodies(rows)).collect()}
    assert back == {1: b"", 2: None, 3: b"x" * 100_000, 4: b"x" * 100_000}


def test_counted_keeps_expired_rows(spark):
    assert cache.counted(spark.createDataFrame([(1, 0), (2, 9)], "k int, expires_at int")).first()[0] == 2


def test_chains():
    def refuses(body):
        raise ConversionError("broken")

    def crashes(body):
        raise KeyError("bug")

    run = converter({"pdf": [("a", refuses), ("b", bytes.decode)], "doc": [("a", refuses)], "xls": [("c", crashes)]})
    assert run({"path": "x/y.PDF", "content": b"t"}) == {"markdown": "t", "engine": "b", "fidelity": None, "lost": [], "warnings": []}
    assert run({"path": "y.doc", "content": b"t"}) == {"markdown": "", "engine": "a", "fidelity": "failed", "lost": ["all"], "warnings": ["broken"]}
    assert run({"path": "y", "content": b"t"})["warnings"] == ["unsupported_format:none"]
    with pytest.raises(KeyError):
        run({"path": "y.xls", "content": b""})


@pytest.mark.parametrize(("text", "size"), [("{}", 2), (" [1]\n", 5), ("", None), ("  ", None), ("3", None), ("{", None), ('"x"', None), ("[" * 100_000, None)])
def test_response_payload(text, size):
    found = response_payload(text)
    assert (found and found.byte_size) == size and (found is None or found.source == "generic")


def test_dates():
    assert content.published(parse("")) is None
    assert content.published(parse("<time datetime='2024-02-30'>x</time><time datetime='2024-02-29T01:02'>x</time>")) == datetime.date(2024, 2, 29)
    assert content.published(parse("<script type='application/ld+json'>{\"datePublished\": \"never\"}</script><meta name='date' content='2020-01-02'>")) == datetime.date(2020, 1, 2)


def test_conversions_of_null_and_long_pages(spark):
    long = "<main>" + "<p>word " * 20_000 + "</main>"
    rows = spark.createDataFrame([(1, None), (2, " "), (3, long), (4, "<script>x</script>")], "id int, html string")
    got = {r.id: r for r in pages.converted_pages(rows).collect()}
    assert all(got[i].fidelity == "failed" and got[i].lost == ["all"] and got[i].warnings == ["conversion_failed"] for i in (1, 2, 4))
    assert got[3].engine == "main" and got[3].markdown.count("word") == 20_000


def test_document_parts(spark):
    rows = spark.createDataFrame([(1, "<main><h1>T</h1><a href='/x'>l</a></main>"), (2, None)], "id int, html string")
    got = pages.parsed_pages(rows, pages.DOCUMENT)
    assert got.columns == ["id", *pages.DOCUMENT] and isinstance(got.schema["published"].dataType, T.DateType)
    one = {r.id: r for r in got.collect()}
    assert one[1].headings[0].text == "T" and one[1].links[0].href == "/x" and one[2].main_content == ""
