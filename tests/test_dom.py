import pytest
from hypothesis import given
from hypothesis import strategies as st

from millrace.functions.dom import fragment_root, parse, select


def texts(page, css):
    return [n.text() for n in select(parse(page), css)]


def test_unclosed_paragraphs_and_list_items():
    assert texts("<ul><li>one<li>two <b>x</ul><p>a<p>b<div>c", "li, p") == ["one", "two x", "a", "b"]


def test_script_text_is_raw_and_comments_have_no_text():
    root = parse('<script>var t="</p>";</script><p>a<!-- no --> b</p>')
    assert [s.text() for s in select(root, "script")] == ['var t="</p>";']
    assert texts("<p>a<!-- no --> b</p>", "p") == ["a b"]


def test_first_of_equal_attributes_stands_and_entities_are_decoded():
    (a,) = select(parse("<a href='/x?a=1&amp;b' HREF=/y>l &lt;</a>"), "a")
    assert a.attrs["href"] == "/x?a=1&b" and a.text() == "l <"


def test_unmatched_end_tags_are_ignored():
    assert texts("</article><article><p><b>x<br></article><p>y", "p") == ["x", "y"]


@pytest.mark.parametrize(
    ("css", "n"),
    [("a", 2), ("#m a", 1), (".k", 1), ("[href]", 2), ("[href='/a']", 1), ("a[href^='/']", 2), ("nav > a", 1), ("div.k, nav", 2), ("*.k", 1), ("[href^='']", 0)],
)
def test_selectors(css, n):
    assert len(list(select(parse("<nav id=m><a href=/a>x</a></nav><div class='j k'><a href=/b>y</a></div>"), css))) == n


@pytest.mark.parametrize("css", ["a:hover", "", "a + b", "a[b~=c]"])
def test_other_selectors_raise(css):
    with pytest.raises(ValueError):
        list(select(parse("<a>"), css))


def test_fragment_roots():
    assert fragment_root("<p>x</p>").tag == "p"
    assert fragment_root("<p>x</p><p>y</p>").tag == "div"
    assert fragment_root("x <i>y</i>").tag == "span"
    assert fragment_root("<html><p>x</p></html>").tag == "html"


@given(st.text(alphabet="<>/ap='\"! -&;x\n", max_size=60))
def test_never_raises_and_loses_no_plain_text(page):
    root = parse(page)
    if "<" not in page and "&" not in page:
        assert root.text() == page or root.text() == page.lstrip() or not page.strip()
