"""Tokenizer, character references, input errors."""

import pytest

from tagloom.core.charrefs import decode
from tagloom.core.document import parse, parse_error_id, parse_error_spec_ref, tokenize


def brief(html, **options):
    out = []
    for kind, name, attributes, closing, value, public, system, quirks in tokenize(html, **options):
        out.append({"startTag": (name, attributes, closing), "endTag": (f"/{name}",), "chars": value, "comment": ("!", value), "doctype": ("doctype", name, public, system, quirks), "eof": "eof"}[kind])
    return out


@pytest.mark.parametrize(
    ("html", "expected"),
    [
        ("<p>alpha</p>", [("p", [], False), "alpha", ("/p",), "eof"]),
        ("<A B=C d='e' f>", [("a", [("b", "C"), ("d", "e"), ("f", "")], False), "eof"]),
        ("<a a=1 a=2/>", [("a", [("a", "1")], False), "eof"]),
        ("<br/>", [("br", [], True), "eof"]),
        ("<a/ b>", [("a", [("b", "")], False), "eof"]),
        ("<a =b>", [("a", [("=b", "")], False), "eof"]),
        ("<a b='x", ["eof"]),
        ("a<1>b", ["a<1>b", "eof"]),
        ("</>x</ y>", ["x", ("!", " y"), "eof"]),
        ("<!-->x<!--->y<!---->z", [("!", ""), "x", ("!", ""), "y", ("!", ""), "z", "eof"]),
        ("<!-- a --!>b", [("!", " a "), "b", "eof"]),
        ("<!-- a --", [("!", " a "), "eof"]),
        ("<!-- a -", [("!", " a "), "eof"]),
        ("<?pi?>", [("!", "?pi?"), "eof"]),
        ("<!x>", [("!", "x"), "eof"]),
        ("<![CDATA[x]]>", [("!", "[CDATA[x]]"), "eof"]),
        ("<!DOCTYPE HTML>", [("doctype", "html", None, None, False), "eof"]),
        ("<!doctype>", [("doctype", "", None, None, True), "eof"]),
        ("<!doctype html public 'a' \"b\">", [("doctype", "html", "a", "b", False), "eof"]),
        ("<!doctype html system 'b'>", [("doctype", "html", None, "b", False), "eof"]),
        ("<!doctype html public>", [("doctype", "html", None, None, True), "eof"]),
        ("<!doctype html x>", [("doctype", "html", None, None, True), "eof"]),
        ('<script>"</p>"</script>', [("script", [], False), '"', ("/p",), '"', ("/script",), "eof"]),
        ("a\r\nb\rc", ["a\nb\nc", "eof"]),
        ("a\0b", ["a\0b", "eof"]),
    ],
)
def test_tokens(html, expected):
    assert brief(html) == expected


def test_initial_states():
    assert brief("a<b>&amp;</title >x", state="rcdata", last_start_tag="title") == ["a<b>&", ("/title",), "x", "eof"]
    assert brief("a&amp;</style>", state="rawtext", last_start_tag="STYLE") == ["a&amp;", ("/style",), "eof"]
    assert brief("<!--<script></script>--></script>", state="script", last_start_tag="script") == ["<!--<script></script>-->", ("/script",), "eof"]
    assert brief("<p>\0", state="plaintext") == ["<p>�", "eof"]
    assert brief("a]]>b", state="cdata") == ["ab", "eof"]


def test_soft_limits_and_modes():
    errors: list = []
    tokenize("abc<a a a>", errors=errors, max_text=2)
    assert [e[0] for e in errors] == ["duplicate-attribute", "max-text-bytes-exceeded"]
    errors.clear()
    tokenize("<p>", errors=errors, max_token=len('{"type":"StartTag","name":"p","attributes":{},"selfClosing":false}'))
    assert not errors
    tokenize("<p>", errors=errors, max_token=60)
    assert errors == [("max-token-bytes-exceeded", 0)]
    errors.clear()
    tokenize("<a a a a>", errors=errors, max_errors=1)
    assert len(errors) == 1
    assert brief("a\f<!--b--c-->", xml_violations=True) == ["a ", ("!", "b- -c"), "eof"]
    assert brief("a\0\\u0000", double_escaped=True) == ["a�\\uFFFD", "eof"]


@pytest.mark.parametrize(
    ("text", "in_attribute", "expected"),
    [
        ("&amp;&lt;&quot;", False, '&<"'),
        ("&copy;&middot;", False, "©·"),
        ("&notit;", False, "¬it;"),
        ("&not=", True, "&not="),
        ("&notit", True, "&notit"),
        ("&not;", True, "¬"),
        ("&amp", False, "&"),
        ("&am", False, "&am"),
        ("&", False, "&"),
        ("&unknown;", False, "&unknown;"),
        ("&#65;&#x42;&#X43", False, "ABC"),
        ("&#0;&#xD800;&#x110000;&#99999999999;", False, "����"),
        ("&#128;&#x81;", False, "€\x81"),
        ("&#;&#x;", False, "&#;&#x;"),
        ("&NotEqualTilde;", False, "≂̸"),
        ("&CounterClockwiseContourIntegral;", False, "∳"),
    ],
)
def test_references(text, in_attribute, expected):
    assert decode(text, in_attribute) == expected


def test_errors_have_ids_and_places():
    found = parse("<p a a>\x01</b>").errors
    assert [e["parse_error_id"] for e in found] == ["missing-doctype", "duplicate-attribute", "control-character-in-input-stream", "end-tag-without-matching-open-element"]
    assert all(0 <= e["start"] <= e["end"] for e in found)
    assert found == parse("<p a a>\x01</b>").errors
    assert not parse("<!doctype html><title>x</title><p>y</p>").errors
    assert parse_error_id(" ") == "vendor:unknown"
    assert parse_error_id("a-b1") == "a-b1"
    assert parse_error_id("A b") == "vendor:A b"
    assert parse_error_spec_ref("x").startswith("https://html.spec.whatwg.org/")
