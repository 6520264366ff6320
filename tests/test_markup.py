import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quire.operators import markup as M


def test_figures_are_one_object_and_numbers_run_by_kind():
    text, held = M.protect('<p>a</p><img src="3"/><figure><img src="1"/><img src="2"/></figure><pre><code>x</code></pre><svg/>')
    assert list(held) == ["[[IMG_1]]", "[[IMG_2]]", "[[CODE_3]]", "[[MEDIA_4]]"] or list(held)[:3] == ["[[IMG_1]]", "[[IMG_2]]", "[[CODE_3]]"]
    assert text.index("[[IMG_2]]") < text.index("[[IMG_1]]")
    assert M.image_attributes(M.restore(text, held)) == M.image_attributes('<img src="3"/><img src="1"/><img src="2"/>')


def test_nested_placeholders_come_back_in_two_passes():
    source = '<pre>a <img src="x"/> b</pre>'
    text, held = M.protect(source)
    assert M.TOKEN.findall(text) == ["[[CODE_2]]"]
    assert '<img src="x"/>' in M.restore(text, held)


def test_reserved_and_unknown_placeholders_raise():
    with pytest.raises(ValueError):
        M.protect("<p>[[IMG_1]]</p>")
    with pytest.raises(ValueError):
        M.restore("<p>[[IMG_9]]</p>", {})


def test_blocks_leave_paragraphs():
    assert M.restore("<p>a [[IMG_1]] b</p>", {"[[IMG_1]]": "<figure>f</figure>"}) == "a <figure>f</figure> b"


def test_canonicalize():
    assert M.canonicalize('<p title="[[IMG_1]]">x [[IMG_2]] [[IMG_2]] [[IMG_7]]</p>', ["[[IMG_1]]", "[[IMG_2]]"]) == "<p>x [[IMG_1]] [[IMG_2]] </p>"
    assert M.canonicalize("<p>x</p>", ["[[IMG_1]]"]).endswith("\n[[IMG_1]]\n")


def test_token_error_and_repair():
    e = ["[[IMG_1]]", "[[IMG_2]]"]
    assert M.token_error("[[IMG_1]][[IMG_2]]", e) is None
    assert "out of order: True" in M.token_error("[[IMG_2]][[IMG_1]]", e)


def test_split_keeps_all_text_and_ids_once():
    body = '<section id="s">' + "".join(f"<h2>{i}</h2><p>{'word ' * 80}</p>" for i in range(12)) + "</section>"
    parts = M.split_chapter(body, 600)
    assert len(parts) > 1 and "".join(parts).count("word ") == 960 and sum('id="s"' in p for p in parts) == 1
    assert all(M.parse(p).inner() == p for p in parts)
    assert M.split_chapter("<p>short</p>", 600) == ["<p>short</p>"]
    with pytest.raises(ValueError):
        M.split_chapter(f"<p>{'word ' * 400}</p>", 100)


def test_a_heading_begins_a_part():
    body = f"<p>{'a ' * 100}</p><h1>x</h1><p>{'b ' * 100}</p>"
    assert [p[:4] for p in M.split_chapter(body, 130)] == ["<p>a", "<h1>"]


GOOD = '<section data-role="summary" data-title="T"><p>b</p></section><dl data-role="glossary"><dt>queue</dt><dd>line</dd></dl>'


def test_responses():
    assert M.parse_response(GOOD, {}) == ("<p>b</p>", "T", {"queue": "line"})
    for bad in ("```xml\n" + GOOD, GOOD + "<p/>", GOOD.replace("<p>b</p>", "<script/>"), GOOD.replace("<p>", '<p onclick="x">'), GOOD.replace("<dd>line</dd>", ""), "<!DOCTYPE x>" + GOOD, GOOD.replace(' data-title="T"', ""), GOOD.replace("line", " "), GOOD.replace("<p>b</p>", '<a href="JavaScript:x">b</a>')):
        with pytest.raises(ValueError):
            M.parse_response(bad, {})
    with pytest.raises(ValueError, match="conflict"):
        M.parse_response(GOOD, {"queue": "row"})
    assert M.parse_response(GOOD.replace("<p>b</p>", "<p>b<code>b</code></p>"), {}, lambda s: s.replace("b", "B"))[0] == "<p>B<code>b</code></p>"


def test_anchors():
    out = M.ensure_anchors('<h1>a</h1><p id="x">1</p><p id="x">2</p>', '<p id="x"/><p id="old"/>', 3)
    assert out == '<span id="old"/><h1 id="c3-heading-1">a</h1><p id="x">1</p><p>2</p>'


tokens = st.lists(st.sampled_from(["[[IMG_1]]", "[[CODE_2]]", "[[MEDIA_3]]", "text ", "<b>b</b>"]), max_size=8)


@settings(max_examples=60, deadline=None)
@given(tokens, st.lists(st.sampled_from(["[[IMG_1]]", "[[CODE_2]]"]), unique=True))
def test_canonical_fragments_have_the_expected_tokens(parts, expected):
    assert M.TOKEN.findall(M.canonicalize("".join(parts), expected)) == expected


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from(["<p>t</p>", '<img src="a"/>', "<pre>c  d</pre>", "<figure><img/></figure>", "<code>&lt;</code>"]), max_size=8))
def test_restore_undoes_protect(parts):
    source = "".join(parts)
    text, held = M.protect(source)
    assert M.restore(text, held).replace("\n", "") == M.parse(source).inner()


def test_references_without_semicolon_stay_as_written():
    root = M.parse('<h1 title="a&lt">b &amp; c&#x27; &bogus; d&amp</h1>')
    assert root.text() == "b & c' &bogus; d&amp" and root.find("h1")[0].attrs["title"] == "a&lt"
    assert M.parse(root.inner()).text() == root.text()


@pytest.mark.parametrize("depth", [900, 20_000])
def test_trees_are_as_deep_as_a_page_leaves_elements_open(depth):
    root = M.parse("<body>" + '<div><img src="a"> x ' * depth + "</body>")
    body = root.find("body")[0]
    assert len(body.find("img")) == depth and body.text(" ", True) == " ".join("x" * depth) and body.text("-").count("-") == depth - 1
    assert body.markup() == "<body>" + '<div><img src="a"> x ' * depth + "</img></div>" * depth + "</body>"
    assert M.canonicalize("<b>" * depth + "[[IMG_2]]", ["[[IMG_1]]"]) == "<b>" * depth + "[[IMG_1]]" + "</b>" * depth


def test_wrappers_are_cut_at_any_depth():
    parts = M.split_chapter("<div>" * 1500 + "a" * 3000 + "</div>" * 1500 + "<p>b</p>", 20_000)
    assert len(parts) == 1
    with pytest.raises(ValueError, match="can't be divided"):
        M.split_chapter("<div>" * 1500 + "a" * 3000 + "</div>" * 1500, 100)
