"""Column expressions against plain Python."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from millrace.functions import native as N
from millrace.operators import accounting, cache, catalog, duplicates, wire


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'string' if isinstance(v, str) or v is None else 'bigint' if isinstance(v, int) else 'double'}" for k, v in values.items()))
    return df.select(column.alias("x")).first()["x"]


def duration(ms):
    if ms < 1000:
        return f"{ms}ms"
    if ms < 7000:
        return f"{ms / 1000:.1f}s"
    return f"{ms // 1000}s" if ms < 60000 else f"{ms // 60000}m{ms // 1000 % 60:02d}s"


def test_durations(spark):
    rows = spark.range(-3, 130_000).select("id", N.duration(F.col("id")).alias("x")).collect()
    assert all(r.x == duration(r.id) for r in rows)


def test_white_space_rules_agree_with_python(spark):
    texts = [f"{chr(c)} a{chr(c)}{chr(c)}b {chr(c)}" for c in range(0x3100) if not 0xD800 <= c < 0xE000]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", N.squeezed(F.col("t")).alias("s"), N.stripped(F.col("t")).alias("p"), F.size(N.text_lines(F.col("t"))).alias("n")).collect()
    for r in rows:
        assert r.s == " ".join(r.t.split()) and r.p == r.t.strip() and r.n == sum(bool(x.strip()) for x in r.t.splitlines()), repr(r.t)


def grade(text, size):
    if not text.strip():
        return "failed"
    lines = [x for x in text.splitlines() if x.strip()]
    share = lambda p: sum(bool(re.search(p, x)) for x in lines) / max(1, len(lines))
    if len(re.findall("[�\x00-\x08\x0b\x0c\x0e-\x1f]", text)) / len(text) > 0.02 or share(r"\(cid:\d+\)") > 0.03:
        return "partial"
    if len(lines) >= 20 and share(r"^\s*[\d,.\-()%$¥€]{1,20}\s*$") > 0.35 or size > 4096 and len(text) < size * 0.02:
        return "partial"
    plain = not re.search(r"^\s*\|.*\|\s*$", text, re.M) and not re.search(r"^#{1,6}\s", text, re.M)
    return "partial" if size > 32768 and plain else "high"


@pytest.mark.parametrize("size", [0, 5000, 40000])
def test_grade(spark, size):
    texts = ["", " \n", "clean", "x� y", "a (cid:٣) b", "12\n" * 30, "12\n" * 10, "| 1 |\n" * 30, "# T\nx", "a\r| b |\rc", "a\n| b |\nc", "￥1\n" * 25, "#x\n" * 2000, "word " * 2000, "\x0b" * 3]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", N.grade(F.col("t"), F.lit(size))["fidelity"].alias("g")).collect()
    assert {r.t: r.g for r in rows} == {t: grade(t, size) for t in texts}


def test_regions(spark):
    col = N.region_replaced(F.col("b"), F.col("c"), "<s>", "<e>")
    assert one(spark, col, b="a<s>old<e>b<s><e>", c="new\n") == "a<s>\nnew\n<e>b<s><e>"
    assert one(spark, col, b="", c="n") == "<s>\nn\n<e>\n"
    assert one(spark, col, b="p\n\n", c="n") == "p\n\n<s>\nn\n<e>\n"
    again = one(spark, col, b="p\n\n<s>\nn\n<e>\n", c="n")
    assert again == "p\n\n<s>\nn\n<e>\n"


def test_cells_are_one_line_and_reversible(spark):
    text = "a\tb\nc\rd\\te"
    cell = one(spark, N.escaped_cell(F.col("t")), t=text)
    assert not set(cell) & set("\t\n\r")
    assert re.sub(r"\\(.)", lambda m: {"t": "\t", "n": "\n", "r": "\r"}.get(m[1], m[1]), cell) == text


def test_keys(spark):
    key = one(spark, N.text_key(F.col("a"), F.col("b")), a="é", b="")
    assert key == ":".join(hashlib.sha256(x.encode()).hexdigest() for x in ("é", ""))


@pytest.mark.parametrize(("kind", "is_json"), [(None, False), ("application/json; charset=x", True), ("TEXT/JSON", True), ("application/a+json", True), ("application/json5", False), ("", False)])
def test_content_types(spark, kind, is_json):
    assert one(spark, N.is_json_type(F.col("t")), t=kind) is is_json


def test_env_references_are_not_expanded_twice(spark):
    assert one(spark, N.env_resolved(F.col("t"), {"A": "${B}", "B": "x"}), t="${A}-${B}-${C}-$A\n") == "${B}-x-${C}-$A\n"


def test_plans_from_schemas(spark):
    shape = lambda ddl: spark.createDataFrame([], f"x {ddl}").schema["x"].dataType
    assert wire.plan(shape("array<struct<a:int>>")) == wire.Plan("tsv")
    assert wire.plan(shape("array<struct<a:array<int>>>")) == wire.Plan("json")
    assert wire.plan(shape("struct<items:array<struct<a:int>>,next_cursor:string>")).kind == "page-tsv"
    assert wire.plan(shape("struct<x:int,hits:array<struct<a:int>>>")) == wire.Plan("envelope", ("hits",))


def test_envelope_guards(spark):
    rows = spark.createDataFrame([(1, [], "n"), (2, None, "n"), (3, [(7, "a\tb")], "n")], "k int, hits array<struct<i:int,t:string>>, note string")
    got = {r.k: r.e for r in rows.select("k", wire.encoded(rows, ["hits", "note"], ("hits",)).alias("e")).collect()}
    assert got[1] == '{"hits":"\\n","note":"n","_hits_format":"tsv"}'
    assert got[2] == '{"note":"n"}'
    assert got[3] == '{"hits":"i\\tt\\n7\\ta\\\\tb\\n","note":"n","_hits_format":"tsv"}'


def test_cache_tables(spark):
    puts = spark.createDataFrame([("a", 1, "x", 10), ("a", 2, "y", 5), ("b", 1, "z", 20)], "k string, w int, v string, expires_at int")
    stored = cache.upserted(puts, puts.limit(0), ["k"], "w")
    assert sorted(map(tuple, stored.collect())) == [("a", 2, "y", 5), ("b", 1, "z", 20)]
    asked = spark.createDataFrame([("a",), ("b",), ("c",)], "k string")
    assert {r.k: (r.hit, r.v) for r in cache.looked_up(asked, stored, ["k"], F.lit(5)).collect()} == {"a": (False, None), "b": (True, "z"), "c": (False, None)}
    kept, removed = cache.evicted(stored, F.lit(5))
    assert kept.count() == 1 and removed.first()[0] == 1


def test_prices_prefer_the_exact_name_then_the_first_prefix(spark):
    usage = spark.createDataFrame([("m-2", 1_000_000), ("m-2-x", 1_000_000), ("m-9", 1_000_000), ("other", 5)], "model string, input_tokens long")
    prices = spark.createDataFrame([(0, "m", 1.0, 0.0), (1, "m-2", 2.0, 0.0)], "place int, known string, input double, output double")
    assert {r.model: r.cost_usd for r in accounting.priced(usage, prices).collect()} == {"m-2": 2.0, "m-2-x": 1.0, "m-9": 1.0, "other": 0.0}


def test_catalog_and_duplicates(spark):
    names = spark.createDataFrame([("a",), ("b",)], "name string")
    uses = spark.createDataFrame([("a", "y", "active"), ("a", "x", "active"), ("b", "z", "ended")], "software string, consumer string, status string")
    assert {r.name: r.consumers for r in catalog.with_consumers(names, uses).collect()} == {"a": "x, y", "b": "orphaned"}
    facts = spark.createDataFrame([(1, "p", "f", "_n", True, False, 3, "h"), (2, "p", "g", "_n", True, False, 3, "h"), (3, "q", "k", "_n", True, False, 9, "h"), (4, "p", "m", "x", False, False, 2, "h")], "ord int, package string, file string, name string, is_private boolean, is_dunder boolean, stmt_count int, body_hash string")
    pair = lambda df: sorted((r.a_ord, r.b_ord) for r in df.collect())
    assert pair(duplicates.same_bodies(facts)) == [(1, 2)] and pair(duplicates.same_bodies(facts, True)) == [(1, 3), (2, 3)] and pair(duplicates.same_names(facts)) == [(1, 2)]
