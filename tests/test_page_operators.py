import json

import pytest
from hypothesis import given
from hypothesis import strategies as st

from millrace.functions.dom import parse
from millrace.operators import content, fragment, payloads, records, schema, wobble
from millrace.operators.wobble import DEFAULT, DERIVE, OPTIONAL, SKIP, STRICT, Policy

CARD = "<article class='stall old'><a href='/s{i}'>Visit</a><h2><a href='/r{i}'>Market stall {i}</a></h2><p>A description of reasonable length, number {i}.</p></article>"


def test_flat_listing():
    found = records.records("<div id=list>" + "".join(CARD.format(i=i) for i in range(8)) + "</div>", "http://h/")
    assert (len(found.records), found.max_depth, found.child_signature, found.container) == (8, 0, "article.stall", "div.-")
    first = found.records[0]
    assert first.heading_text == "Market stall 0" and first.heading_link == ("Market stall 0", "http://h/r0")
    assert first.markdown == "- [Market stall 0](http://h/r0)\n  Visit A description of reasonable length, number 0\n  [Visit](http://h/s0)"
    assert found.markdown().startswith("### Listing (8 records)\n\n- [")


def comment(i, inner=""):
    return f"<li class='comment'><h4 class='byline'><a href='/u{i}'>user{i}</a></h4><div class='comment_text'>Text of comment number {i}.</div><ol class='comments'>{inner}</ol></li>"


def test_threaded_discussion_keeps_document_order_and_own_text():
    page = "<ol class='comments'>" + "".join(comment(i, comment(i + 10)) for i in range(3)) + "</ol>"
    found = records.records(page)
    assert [r.depth for r in found.records] == [0, 1] * 3
    assert [r.heading_text for r in found.records] == ["user0", "user10", "user1", "user11", "user2", "user12"]
    assert "number 10" not in found.records[0].text and found.markdown().startswith("### Discussion (6 comments)")


@pytest.mark.parametrize("page", ["", "   ", "<html><body><div id=root></div></body></html>", "".join(f"<section><h2>t{i}</h2><p>words and <a href=x>link</a> here, long enough</p></section>" for i in range(8))])
def test_no_region(page):
    assert records.records(page) is None


def test_heading_spellings_and_their_control():
    card = "<div class=card><{0}>Title {1} <a href=/{1}>go</a></{0}><p>long enough body text here</p></div>"
    for tag in ("h1", "h6"):
        assert len(records.records("".join(card.format(tag, i) for i in range(8))).records) == 8
    roles = "".join(f"<div class=card><div role=heading>T{i}</div><a href=/x>go</a> long enough body text here</div>" for i in range(8))
    assert len(records.records(roles).records) == 8
    assert records.records("".join(card.format("span", i) for i in range(8))) is None


@pytest.mark.parametrize(("n", "kept"), [(12, 12), (2, None), (60, 50)])
def test_definition_lists(n, kept):
    page = "<dl>" + "".join(f"<dt><a href='/lot/{i}'>[{i}]</a><dd><div><span>Title</span><span>words of the paper {i}</span></div>" for i in range(n)) + "</dl>"
    found = records.records(page)
    assert (found and len(found.records)) == kept
    if found:
        assert found.records[1].heading_text == "[1]" and found.records[1].text == "Title words of the paper 1" and found.child_signature == "dt/dd"


@given(st.text(max_size=80), st.integers(0, 3), st.one_of(st.none(), st.text(min_size=1, max_size=10)))
def test_rendered_lines_are_indented_by_depth(text, depth, heading):
    text = records.squeezed(text)
    heading = records.squeezed(heading or "") or None
    assert all(line.startswith("  " * depth) for line in records.rendered(text, (("a", "/x"),), depth, heading, None).split("\n"))


def test_payload_detectors_in_order():
    page = """<meta property="og:title" content="t"><script id="__NEXT_DATA__">{"a":1}</script><script type="application/ld+json" id=k>[{"@type":"Thing"}]</script>
    <script type="application/ld+json">{bad</script><script type="application/json">[1]</script><script type="application/json">3</script>
    <div itemscope itemtype="https://schema.org/Product"><b itemprop="name brand">N</b><i itemprop=name>M</i><p itemprop=offers itemscope><data itemprop=price value=5></data></p></div>
    <script>window.state = {"s": "}{", "q": '"'}; window.__DATA__ = {"x": [1, {"y": 2}]};</script><script>window.foo = {"aaaaaaaaaaaaaaaaaaaaaaaaaa": 1}</script>"""
    found = payloads.payloads(parse(page))
    assert [p.source for p in found] == ["next_data", "ld_json", "generic", "microdata", "opengraph", "window_var"]
    assert found[1].script_id == "k" and found[-1].script_id == "__DATA__" and found[-1].byte_size == len('{"x": [1, {"y": 2}]}')
    assert found[3].data == [{"type": ["https://schema.org/Product"], "properties": {"name": ["N", "M"], "brand": "N", "offers": {"type": [], "properties": {"price": "5"}}}}]
    assert [p.source for p in payloads.ranked(found)] == ["microdata", "next_data", "opengraph", "ld_json", "window_var", "generic"]


def test_answers_need_a_type_and_three_fields():
    product = {"@type": "Product", "a": 1, "b": 0, "c": False}
    assert payloads.answers("ld_json", product) and payloads.answers("ld_json", {"@graph": [product]}) and payloads.answers("ld_json", [1, product])
    assert not payloads.answers("generic", product) and not payloads.answers("ld_json", product | {"c": ""}) and not payloads.answers("ld_json", product | {"@type": "Thing"})
    assert payloads.microdata_as_ld({"type": ["x/Product"], "properties": {"n": 1}}) == [{"@type": ["Product"], "n": 1}]
    assert payloads.ld_entries({"@graph": [1, {"a": 1}]}) == [{"a": 1}] and payloads.ld_entries([{"b": 1}, 2]) == [{"b": 1}] and payloads.ld_entries({"c": 1}) == [{"c": 1}]


@given(st.recursive(st.none() | st.booleans() | st.text(max_size=5), lambda c: st.lists(c, max_size=3) | st.dictionaries(st.text(max_size=3), c, max_size=3), max_leaves=8))
def test_balanced_takes_back_any_json_object(value):
    text = json.dumps({"k": value})
    assert payloads.balanced(text + "; tail }", 0, quotes='"') == text


def test_sniffing():
    assert payloads.sniffed(b' \n{"a":1}') and not payloads.sniffed(b"<html>") and not payloads.sniffed(b"{cut") and not payloads.sniffed(b"") and not payloads.sniffed(b" " * 64 + b"[]")


def test_schema_verdicts():
    s = schema.Schema("dl#articles", "dt", {"id": schema.Field("a", None, "id:", True), "t": schema.Field("div.t")}, "dd")
    page = "<dl id=articles><dt><a>id: 7</a><dd><div class=t> A  b</div><dt><i>none</i></dl>"
    got = schema.extract(page, s)
    assert got.verdict == schema.OK and got.rows == ({"id": "7", "t": "A b"},) and got.missing == {"id": 1}
    assert schema.extract("<dl id=articles></dl>", s).verdict == schema.EMPTY
    assert schema.extract("<p>", s).verdict == schema.ROT
    assert schema.extract("<dl id=articles><dt><dd></dl>", s).verdict == schema.ROT


def test_fragments():
    assert fragment.to_text("a&nbsp;b  <b>c</b>\t&amp;amp; d\n e") == "a b c & d\n e"
    assert fragment.to_text(" ") == "" and fragment.to_markdown(None) == ""
    assert fragment.to_markdown("<p>a <em>b</em></p><p>c<br>d</p><ul><li>x<li>y</ul>") == "a *b*\n\nc\nd\n\n- x\n\n- y"
    assert fragment.to_markdown("foo<p>bar</p>") == "foobar"
    assert fragment.to_markdown("<a href='q'> z </a><a>w</a>", "http://h/p/") == "[z](http://h/p/q)w"


def test_content_parts():
    root = parse("<nav><a href=/n>n</a></nav><div role=contentinfo><a href='tel:+1?x'> </a></div><h2> A </h2><h3></h3><a href=''>e</a><aside><article><a href=/p>p</a></article></aside>")
    assert content.headings(root) == [(2, "A")]
    assert [(x.anchor, x.role) for x in content.links(root)] == [("n", "nav"), ("+1", "footer"), ("p", "primary")]


def test_main_content_options():
    root = parse("<article><p>Body <a href=/x>l</a></p><table><tr><td>1</table><div class=comments>said</div></article>")
    assert content.main_content(root) == "Body l\n\n| 1 |\n| --- |"
    assert content.main_content(root, content.Options(True, True, False)) == "Body [l](/x)\n\nsaid"


POLICIES = {"a": Policy(STRICT), "b": Policy(DEFAULT, 5), "c": Policy(OPTIONAL, 6), "d": Policy(DERIVE, derive=lambda p: p["a"] + 1)}


def test_object_policies():
    got = wobble.parse_object('{"a":1,"b":null,"z":9}', POLICIES, "x", "m")
    assert got.value == {"a": 1, "b": 5, "c": 6, "d": 2, "z": 9} and got.recovered == ["b", "d"] and [e.field for e in got.events] == ["b", "d"]
    assert wobble.parse_object('{"b":1}', POLICIES, "x", "m").error == "x: missing required field: 'a'"
    assert wobble.parse_object("{}", {"s": Policy(SKIP)}, "x", "m").skipped == "s"
    assert wobble.parse_object("[1]", {}, "x", "m").error == "x: expected JSON object, got list"
    assert wobble.parse_object("nothing", {}, "x", "m").error and wobble.parse_object(None, {}, "x", "m").error


def test_envelope_recovery_is_an_event_but_no_recovered_field():
    got = wobble.parse_object('Here: {"a": "}"} bye', {}, "x", "m")
    assert got.value == {"a": "}"} and got.recovered == [] and [e.field for e in got.events] == [wobble.ENVELOPE]
    assert wobble.parse_object('```json\n{"a":1}\n``` tail', {}, "x", "m").events == []


def test_lists_drop_and_name_bad_entries():
    got = wobble.parse_list('[{"i":1},2,{}]', lambda d: d.get("i"), "x", "m")
    assert got.value == [1] and got.recovered == ["1", "2"] and got.events[0].field == "items[1,2]"
    assert wobble.parse_list('{"i":1}', lambda d: d, "x", "m").error


def test_fences():
    text = "a\n```python\nx=1\n```\nb\n```json\n[1\n```\nc"
    assert wobble.without_fenced_blocks(text) == "a\n```python\nx=1\n```\nb\n\nc"
    assert wobble.without_fenced_blocks(text, json_only=False) == "a\n\nb\n\nc"


def test_deep_pages_do_not_raise():
    deep = "<div>" * 5_000 + "x" + "</div>" * 5_000
    assert fragment.to_markdown(deep) == "x" and fragment.to_text(deep) == "x"
    nested = "<div itemscope itemprop=a>" * 3_000 + "x"
    payloads.payloads(parse(nested))
    held = "<section><div class=r><b>" + "<i>" * 5_000 + "Deep text of a record</div></section>"
    assert "Deep text" in records.own_text(parse(held).children[1], records.NO_KIND)
