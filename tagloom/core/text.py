"""Text of trees: text content, visible text, its tokens and where they come from."""

from __future__ import annotations

import re
from dataclasses import dataclass

from . import utf16
from .tree import ELEMENT, TEXT, Node, words

# What visible text skips and where it breaks lines.
SKIPPED = words("head script style template title optgroup option")
BUTTON_TYPES = words("button submit reset")
BREAKING = words(
    "address article aside blockquote div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header li main nav ol section table "
    "tbody thead tfoot ul"
)
_RUN = re.compile(r"[ \t\n\f\r]+")
_NOT_BLANK = re.compile(r"[\t\n\f\r]|  ")
_JS_SPACES = re.compile(f"[{utf16.JS_SPACE}]+")
#: What the finished text drops, in this order; linear however long a run is.
_CLEAN = tuple(map(re.compile, (r"(?<![ \t\f])[ \t\f]+(?=\n)", r"(?<=\n)[ \t\f]+", r"(?<=\n\n)\n+", r"(?<= ) +", r"(?<=\t)\t+")))
#: Without one of these in it, a text has nothing of the kind to drop.
_SIGNS = ((" \n", "\t\n", "\f\n"), ("\n ", "\n\t", "\n\f"), ("\n\n\n",), ("  ",), ("\t\t",))
_TOKEN = re.compile(r"\n\n|\n|\t|[^\n\t]+")
BREAK_KINDS = {"\n\n": "paragraphBreak", "\n": "lineBreak", "\t": "tab"}


@dataclass(frozen=True)
class TextOptions:
    skip_hidden_subtrees: bool = True
    include_control_values: bool = True
    include_accessible_name_fallback: bool = False
    trim: bool = True


DEFAULTS = TextOptions()


def text_content(node: Node) -> str:
    """All text below a node (or of a text node), in order."""
    if node.kind is TEXT:
        return "".join(node.data)
    parts: list[str] = []
    stack = list(reversed(node.children))
    while stack:
        node = stack.pop()
        if node.kind is TEXT:
            parts += node.data
        elif node.children:
            stack += reversed(node.children)
    return "".join(parts)


def attribute(node: Node, name: str) -> str | None:
    """The first attribute of that name in any case."""
    value = node.attrs.get(name)
    if value is not None and next(iter(node.attrs)) == name:
        return value
    for key, value in node.attrs.items():
        if key == name or key.lower() == name:
            return value
    return None


#: Declarations that hide, in a style without white space, and values of aria-hidden that do.
HIDING, ARIA_HIDDEN = "display:none|visibility:hidden", ("", "true", "1")


def hidden(node: Node) -> bool:
    """Whether an element's own attributes hide its subtree."""
    if not node.attrs:
        return False
    style, aria = attribute(node, "style"), attribute(node, "aria-hidden")
    by_style = style is not None and re.search(HIDING, _JS_SPACES.sub("", style.lower()))
    return attribute(node, "hidden") is not None or bool(by_style) or (aria is not None and aria.strip(utf16.JS_SPACE).lower() in ARIA_HIDDEN)


def _segment(value: str, keep: bool) -> str:
    if keep:
        return value.replace("\r\n", "\n").replace("\r", "\n") if "\r" in value else value
    return _RUN.sub(" ", value) if _NOT_BLANK.search(value) else value


def pieces(top: list[Node], options: TextOptions = DEFAULTS, parse_fragment=None) -> list[tuple[str, Node, str]]:
    """The text before it is cleaned, as (value, node, role)."""
    out: list[tuple[str, Node, str]] = []
    add = out.append
    # nodes still to visit, with whether white space is kept and a role that overrides; or pieces to put out
    stack: list[tuple] = [(node, False, None) for node in reversed(top)]
    while stack:
        item = stack.pop()
        node, keep, forced = item
        if type(node) is str:
            add((node, keep, forced))
            continue
        if node.kind is TEXT:
            value = _segment("".join(node.data), keep)
            if value:
                add((value, node, forced or "text-node"))
            continue
        if node.kind is not ELEMENT:
            continue
        if node.attrs and options.skip_hidden_subtrees and hidden(node):
            continue
        tag = node.tag.lower()
        if tag in SKIPPED:
            continue
        children = node.children
        if tag == "noscript" and len(children) == 1 and children[0].kind is TEXT:
            raw = "".join(children[0].data)
            if "<" in raw and ">" in raw:
                stack += [(child, keep, "noscript-fallback") for child in reversed(parse_fragment(raw))]
                continue
        if tag == "br":
            add(("\n", node, forced or "structure-break"))
            continue
        if tag == "img" and options.include_control_values:
            alt = attribute(node, "alt")
            if alt:
                add((_segment(alt, False), node, forced or "img-alt"))
            continue
        if tag == "input" and options.include_control_values:
            kind = attribute(node, "type")
            kind = "text" if kind is None else kind
            if kind.lower() != "hidden":
                value = attribute(node, "value")
                if kind.lower() in BUTTON_TYPES and value:
                    add((_segment(value, False), node, forced or "input-value"))
                elif options.include_accessible_name_fallback and kind.strip(utf16.JS_SPACE).lower() != "hidden":
                    label = (attribute(node, "aria-label") or "").strip(utf16.JS_SPACE)
                    if label:
                        add((_segment(label, False), node, forced or "input-aria-label"))
            continue
        if tag == "select":
            continue
        if tag == "button" and options.include_control_values:
            value = attribute(node, "value")
            if value:
                add((_segment(value, False), node, forced or "button-value"))
                continue
        role = forced or "structure-break"
        if tag == "tr":
            add(("\n", node, role))
            stack.append(("\n", node, role))
            row: list[tuple] = []
            cells = False
            for child in children:
                if child.kind is ELEMENT and child.tag.lower() in ("td", "th"):
                    if cells:
                        row.append(("\t", node, role))
                    cells = True
                row.append((child, keep, forced))
            stack += reversed(row)
            continue
        if tag not in ("td", "th"):
            keep = keep or tag in ("pre", "textarea")
            if tag == "p" or tag in BREAKING:
                add(("\n", node, role))
                stack.append(("\n\n" if tag == "p" else "\n", node, role))
        for child in reversed(children):
            stack.append((child, keep, forced))
    return out


def _trimmed(text: str, trim: bool) -> str:
    return text.strip(utf16.JS_SPACE) if trim else text


def clean(text: str, trim: bool = True) -> str:
    if "\r" in text:
        text = text.replace("\r\n", "\n").replace("\r", "\n")
    for pattern, signs in zip(_CLEAN, _SIGNS, strict=True):
        if any(sign in text for sign in signs):
            text = pattern.sub("", text)
    return _trimmed(text, trim)


def visible_text(top: list[Node], options: TextOptions = DEFAULTS, parse_fragment=None) -> str:
    return clean("".join([p[0] for p in pieces(top, options, parse_fragment)]), options.trim)


def tokens(text: str) -> list[tuple[str, str]]:
    """(kind, value) of a visible text."""
    return [(BREAK_KINDS.get(v, "text"), v) for v in _TOKEN.findall(text)]


def sourced_tokens(top: list[Node], options: TextOptions = DEFAULTS, parse_fragment=None) -> list[tuple]:
    """(kind, value, node id, node kind, role); a run of text also ends where its source changes."""
    found = pieces(top, options, parse_fragment)
    source: list[int] = []
    for i, (value, _, _) in enumerate(found):
        source += [i] * len(value)
    raw = "".join([p[0] for p in found])
    for pattern in _CLEAN:
        kept, at = [], 0
        spans = [m.span() for m in pattern.finditer(raw)]
        if not spans:
            continue
        for a, b in spans:
            kept.append((at, a))
            at = b
        kept.append((at, len(raw)))
        source = [s for a, b in kept for s in source[a:b]]
        raw = "".join([raw[a:b] for a, b in kept])
    if options.trim:
        lead = len(raw) - len(raw.lstrip(utf16.JS_SPACE))
        raw = raw.strip(utf16.JS_SPACE)
        source = source[lead : lead + len(raw)]
    key = [(p[1].id, p[1].kind, p[2]) for p in found]
    out = []
    for m in _TOKEN.finditer(raw):
        value, at = m.group(), m.start()
        if value in BREAK_KINDS:
            out.append((BREAK_KINDS[value], value, *key[source[at]]))
            continue
        begin = at
        for i in range(at + 1, m.end() + 1):
            if i == m.end() or key[source[i]] != key[source[begin]]:
                out.append(("text", raw[begin:i], *key[source[begin]]))
                begin = i
    return out


_NOT_WORD = re.compile(r"[^\w]|_")


def token_f1(expected: str, actual: str) -> float:
    """F1 of the multisets of words of two texts; 1 if neither has words."""
    from collections import Counter

    a, b = (Counter(_NOT_WORD.sub(" ", t.lower()).split()) for t in (expected, actual))
    if not a and not b:
        return 1.0
    both = sum((a & b).values())
    if not both:
        return 0.0
    precision, recall = both / sum(b.values()), both / sum(a.values())
    return 2 * precision * recall / (precision + recall)
