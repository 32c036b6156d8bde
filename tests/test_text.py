"""Visible text, its tokens and sources; outlines, chunks, text content."""

import json
import os
from pathlib import Path

import pytest

from tagloom.core import structure, utf16
from tagloom.core import text as T
from tagloom.core.document import parse

#: A folder of golden cases, visible-text/v1 and visible-text-fallback/v1, if there is one.
GOLDEN = Path(os.environ.get("TAGLOOM_GOLDEN", "/nonexistent"))


def fragment(raw):
    return parse(raw, context="body").root.children


def visible(html, **options):
    return T.visible_text(parse(html).root.children, T.TextOptions(**options), fragment)


def sourced(html, **options):
    return T.sourced_tokens(parse(html).root.children, T.TextOptions(**options), fragment)


@pytest.mark.parametrize(
    ("html", "expected"),
    [
        ("<h1>Hello</h1><p>World</p>", "Hello\n\nWorld"),
        ("<p>a<br>b</p>", "a\nb"),
        ("<ul><li>a<li>b</ul>", "a\n\nb"),
        ("<table><tr><td>a<td>b<tr><th>c", "a\tb\n\nc"),
        ("<pre>a  b\n   c</pre>", "a b\nc"),
        ("<div>a \n\t b</div>", "a b"),
        ("x<span hidden>y</span>z", "xz"),
        ("x<span style='Display: NONE'>y</span>z", "xz"),
        ("x<span aria-hidden=' TRUE '>y</span>z", "xz"),
        ("x<span aria-hidden=false>y</span>z", "xyz"),
        ("<img alt='a  b'><img alt=''><img>", "a b"),
        ("<input type=submit value=Go><input value=no><input type=hidden value=no>", "Go"),
        ("<button value=v>inner</button><button>inner</button>", "vinner"),
        ("<select><option>x</select>y", "y"),
        ("<p><noscript><p>a<b>b</b></p></noscript>", "ab"),
        ("<p><noscript>plain</noscript>", "plain"),
        ("<template>x</template><title>t</title>", ""),
        ("\xa0﻿x ", "x"),
    ],
)
def test_visible_text(html, expected):
    assert visible(html) == expected


def test_options():
    assert visible("x<i hidden>y</i>", skip_hidden_subtrees=False) == "xy"
    assert visible("<img alt=a><input type=submit value=b><button value=c>d</button>", include_control_values=False) == "d"
    label = "<input aria-label=' name '><input type=hidden aria-label=no><input type=submit value=v aria-label=no>"
    assert visible(label) == "v"
    assert visible(label, include_accessible_name_fallback=True) == "namev"
    assert visible("<p>x</p>", trim=False) == "\nx\n\n"


def test_tokens_and_sources():
    html = "<p>a<b>b</b></p><table><tr><td>c<td>d</table><img alt=e><noscript><i>f</i></noscript>"
    text = visible(html)
    assert T.tokens("a\n\nb\n\tc") == [("text", "a"), ("paragraphBreak", "\n\n"), ("text", "b"), ("lineBreak", "\n"), ("tab", "\t"), ("text", "c")]
    found = sourced(html)
    assert "".join(t[1] for t in found) == text
    assert [(t[1], t[4]) for t in found if t[0] == "text"] == [("a", "text-node"), ("b", "text-node"), ("c", "text-node"), ("d", "text-node"), ("e", "img-alt"), ("f", "noscript-fallback")]
    assert all(t[4] == "structure-break" for t in found if t[0] != "text")
    runs = [t for t in sourced("<p>a<b>b</b>c") if t[0] == "text"]
    assert len({t[2] for t in runs}) == 3


@pytest.mark.skipif(not (GOLDEN / "visible-text/v1").is_dir(), reason="golden cases are not here")
def test_golden_cases():
    def expected(path):
        return path.read_text(newline="").removesuffix("\n") if path.exists() else ""

    cases = sorted((GOLDEN / "visible-text/v1").iterdir())
    assert len(cases) >= 112
    for case in cases:
        html = (case / "input.html").read_text(newline="")
        assert visible(html) == expected(case / "expected.txt"), case.name
        tokens = [(t["kind"], t["value"]) for t in json.loads((case / "expected.tokens.json").read_text())]
        assert T.tokens(visible(html)) == tokens, case.name
        assert "".join(t[1] for t in sourced(html)) == visible(html)
    for case in sorted((GOLDEN / "visible-text-fallback/v1").iterdir()):
        html = (case / "input.html").read_text(newline="")
        assert visible(html) == expected(case / "expected.default.txt"), case.name
        assert visible(html, include_accessible_name_fallback=True) == expected(case / "expected.fallback.txt"), case.name
        tokens = [(t["kind"], t["value"]) for t in json.loads((case / "expected.fallback.tokens.json").read_text())]
        assert T.tokens(visible(html, include_accessible_name_fallback=True)) == tokens, case.name


def test_text_content_and_outline():
    root = parse("<p>x<!-- no -->hello<b>world</b></p>").root
    assert T.text_content(root) == "xhelloworld"
    top = parse("<body><main><article><h1>" + "é😀" * 100 + "</h1><h2>b</h2></article></main>").root.children
    found = structure.outline(top)
    assert [(d, t) for _, d, t, _ in found] == [(3, "article"), (4, "h1"), (4, "h2")]
    assert utf16.length(found[1][3]) == 200
    assert not structure.outline(parse("<p>smoke</p>").root.children)


def test_chunks():
    assert [(i, n) for i, _, _, n in structure.chunks(parse("<p>smoke</p>").root.children)] == [(0, 5)]
    top = fragment("<p>a</p><p>bb</p><p>ccc</p>")
    assert [c[2] for c in structure.chunks(top, max_bytes=20)] == ["<p>a</p><p>bb</p>", "<p>ccc</p>"]
    assert [c[3] for c in structure.chunks(top, max_nodes=2)] == [2, 2, 2]
    assert [c[2] for c in structure.chunks(top, max_chars=1)] == ["<p>a</p>", "<p>bb</p>", "<p>ccc</p>"]
    assert [c[1] for c in structure.chunks(top, max_nodes=4)] == [top[0].id, top[2].id]
    assert structure.chunks([]) == []


def test_utf16():
    assert utf16.length("a😀é") == 4
    assert utf16.Units("a😀b").slice(0, 1) == "a"
    assert utf16.Units("a😀b").slice(3, 4) == "b"
    assert utf16.head("😀", 1) == "�"
    offsets = utf16.Offsets("a\r\nb😀c\rd")
    assert [offsets(i) for i in range(7)] == [0, 1, 3, 4, 6, 7, 8]
    assert len(utf16.JS_SPACE) == len(set(utf16.JS_SPACE)) == 25


def test_token_f1():
    assert T.token_f1("", " - ") == 1.0
    assert T.token_f1("a", "") == 0.0
    assert T.token_f1("a b b", "B, a") == pytest.approx(0.8)
