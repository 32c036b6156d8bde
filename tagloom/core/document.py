"""Parsing one document or fragment: tree, errors, trace and budgets."""

from __future__ import annotations

import json
import re
import time
from dataclasses import dataclass
from functools import cached_property

from . import utf16
from .budgets import UNLIMITED, Budgets
from .tokenizer import DATA, Tag, Tokenizer, lower, normalise_newlines
from .tree import ELEMENT, Node, TreeBuilder

SPEC_URL = "https://html.spec.whatwg.org/multipage/parsing.html#parse-errors"
_STANDARD_ID = re.compile(r"[a-z0-9]+(?:-[a-z0-9]+)*\Z")


def parse_error_spec_ref(_parse_error_id: str | None = None) -> str:
    """Where parse errors are specified; the same for every id."""
    return SPEC_URL


def parse_error_id(code: str) -> str:
    code = code.strip(utf16.JS_SPACE)
    return "vendor:unknown" if not code else code if _STANDARD_ID.match(code) else f"vendor:{code}"


class Trace:
    """Bounded list of events; sizes are counted as they come."""

    def __init__(self, budgets: Budgets):
        self.budgets, self.events, self.bytes = budgets, [], 0

    def push(self, kind: str, **fields) -> None:
        event = {"seq": len(self.events) + 1, "kind": kind, **fields}
        self.events.append(event)
        self.budgets.enforce("maxTraceEvents", len(self.events))
        self.bytes += utf16.length(json.dumps(event, separators=(",", ":"), ensure_ascii=False))
        self.budgets.enforce("maxTraceBytes", self.bytes)

    def budget(self, name: str, actual: int) -> None:
        limit = getattr(self.budgets, name)
        self.push("budget", budget=name, limit=limit, actual=actual, status="ok" if limit is None or actual <= limit else "exceeded")


@dataclass
class Document:
    """A parsed document (kind "document") or fragment (kind "fragment")."""

    kind: str
    root: Node
    html: str
    found: list[tuple[str, int, int]]
    spans: bool = False
    context: str | None = None
    trace: Trace | None = None
    nodes: int = 0
    max_depth: int = 1

    @cached_property
    def offsets(self) -> utf16.Offsets:
        return utf16.Offsets(self.html)

    @cached_property
    def errors(self) -> list[dict]:
        place = self.offsets
        return [{"code": "PARSER_ERROR", "parse_error_id": parse_error_id(code), "message": code, "start": place(start), "end": place(end)} for code, start, end in self.found]


def number(root: Node) -> tuple[int, int]:
    """Give ids: the root 1, all others in post-order from 2. Returns the number of nodes and the greatest depth."""
    root.id = 1
    following, deepest = 2, 1
    stack = [(root, iter(root.children))]
    while stack:
        node, children = stack[-1]
        child = next(children, None)
        if child is None:
            stack.pop()
            if node is not root:
                node.id = following
                following += 1
        elif child.kind is ELEMENT and child.children:
            stack.append((child, iter(child.children)))
            deepest = max(deepest, len(stack))
        else:
            child.id = following
            following += 1
            deepest = max(deepest, len(stack) + 1)
    return following - 1, deepest


def parse(html: str, *, context: str | None = None, spans: bool = False, trace: bool = False, budgets: Budgets = UNLIMITED, scripting: bool = True, numbered: bool = True) -> Document:
    """Parse a document, or with ``context`` the fragment that an element of that name would hold.

    numbered=False leaves out ids and counts, for those who need neither.
    """
    began = time.monotonic()
    if context is not None:
        context = context.strip(utf16.JS_SPACE).lower()
        if not context:
            raise ValueError("contextTagName must be a non-empty tag name")
    budgeted = budgets is not UNLIMITED
    events = Trace(budgets) if trace else None
    if budgeted or events:
        size = utf16.length(html)
        budgets.enforce("maxInputBytes", size)
    if events:
        events.push("decode", source="input", encoding="utf-8", sniffSource="input")
        events.budget("maxInputBytes", size)
    text = normalise_newlines(html)
    if events:
        events.push("token", count=len(tokenize(html)))
    builder = TreeBuilder(text, context, scripting, spans, trace).run()
    nodes, depth = number(builder.root) if numbered or budgeted or events else (0, 1)
    document = Document("document" if context is None else "fragment", builder.root, html, builder.errors, spans, context, events, nodes, depth)
    if budgeted:
        budgets.enforce("maxNodes", nodes)
        budgets.enforce("maxDepth", depth)
        budgets.enforce("maxTimeMs", int((time.monotonic() - began) * 1000))
    if events:
        offsets, errors = document.offsets, document.errors
        events.push("tree-mutation", nodeCount=nodes, errorCount=len(errors))
        for before, after, kind, name, start, end in builder.modes:
            events.push("insertionModeTransition", fromMode=before, toMode=after, tokenContext={"type": kind, "tagName": name, "startOffset": offsets(start), "endOffset": offsets(end)})
        for e in errors:
            events.push("parseError", parseErrorId=e["parse_error_id"], startOffset=e["start"], endOffset=e["end"])
        events.budget("maxNodes", nodes)
        events.budget("maxDepth", depth)
    return document


def soft_tree_errors(root: Node, max_nodes: int | None = None, max_depth: int | None = None, max_attributes: int | None = None, max_attribute_units: int | None = None) -> list[str]:
    """Codes of the limits a tree goes beyond, once for each node that does; nothing is raised.

    Here nodes are counted without the root and top nodes have depth 0; an element's attributes are looked at after its
    children.
    """
    out: list[str] = []
    count = 0
    stack: list[tuple[Node, int, bool]] = [(node, 0, False) for node in reversed(root.children)]
    while stack:
        node, depth, left = stack.pop()
        if left:
            if max_attributes is not None and len(node.attrs) > max_attributes:
                out.append("max-attributes-per-element-exceeded")
            if max_attribute_units is not None and sum(utf16.length(k) + utf16.length(v) for k, v in node.attrs.items()) > max_attribute_units:
                out.append("max-attribute-bytes-exceeded")
            continue
        count += 1
        if max_depth is not None and depth > max_depth:
            out.append("max-depth-exceeded")
        if max_nodes is not None and count > max_nodes:
            out.append("max-nodes-exceeded")
        if node.kind is ELEMENT:
            stack.append((node, depth, True))
            stack += [(child, depth + 1, False) for child in reversed(node.children)]
    return out


# --- tokens -----------------------------------------------------------------------------------------------------------


class _Collector:
    def __init__(self):
        self.tokens: list[tuple] = []
        self.errors: list[tuple[str, int]] = []
        self.run: list[str] = []
        self.foreign = False

    def flush(self) -> None:
        if self.run:
            self.tokens.append(("chars", None, None, False, "".join(self.run), None, None, False))
            self.run = []

    def characters(self, text: str, _start: int, _end: int) -> None:
        self.run.append(text)

    def start_tag(self, tag: Tag) -> None:
        self.flush()
        self.tokens.append(("startTag", tag.name, list(tag.attrs.items()), tag.self_closing, None, None, None, False))

    def end_tag(self, tag: Tag) -> None:
        self.flush()
        self.tokens.append(("endTag", tag.name, None, False, None, None, None, False))

    def comment(self, data: str, _start: int, _end: int) -> None:
        self.flush()
        self.tokens.append(("comment", None, None, False, data, None, None, False))

    def doctype(self, name, public, system, quirks, _start, _end) -> None:
        self.flush()
        self.tokens.append(("doctype", name or "", None, False, None, public, system, quirks))

    def in_foreign(self) -> bool:
        return self.foreign

    def error(self, code: str, start: int, _end: int) -> None:
        self.errors.append((code, start))


TOKEN_FIELDS = ("kind", "name", "attributes", "self_closing", "value", "public_id", "system_id", "force_quirks")


def tokenize(html: str, state: str = DATA, last_start_tag: str = "", errors: list | None = None, xml_violations: bool = False, double_escaped: bool = False, max_text: int | None = None, max_token: int | None = None, max_errors: int | None = None) -> list[tuple]:
    """Tokens as tuples of TOKEN_FIELDS, without a tree's feedback: bodies of script, style or title are markup like any.

    ``errors`` receives (code, place). The limits are soft: they add or hold back errors. max_text counts all
    characters, max_token the JSON of one token.
    """
    sink = _Collector()
    sink.foreign = state == "cdata"
    run = Tokenizer(normalise_newlines(html), sink, next(s for s in _STATES if s == state), lower(last_start_tag))
    run.input_errors()
    run.run()
    sink.flush()
    tokens = sink.tokens
    if double_escaped and html.startswith("<!----!") and html.endswith("-->") and len(tokens) == 1 and tokens[0][0] == "chars":
        tokens = [("comment", None, None, False, html[4:-3], None, None, False)]
    if xml_violations or double_escaped:
        tokens = [_restated(t, html, state, xml_violations, double_escaped) for t in tokens]
    if errors is not None:
        found = sink.errors[: len(sink.errors) if max_errors is None else max_errors]
        errors += found
        size = sum(utf16.length(t[4]) for t in tokens if t[0] == "chars")
        if max_text is not None and size > max_text:
            errors.append(("max-text-bytes-exceeded", size))
        if max_token is not None and any(_json_size(t) > max_token for t in tokens):
            errors.append(("max-token-bytes-exceeded", 0))
    return [*tokens, ("eof", None, None, False, None, None, None, False)]


_STATES = ("data", "rcdata", "rawtext", "script", "plaintext", "cdata")


def _json_size(token: tuple) -> int:
    kind, name, attributes, self_closing, value, public, system, quirks = token
    body = {
        "startTag": lambda: {"type": "StartTag", "name": name, "attributes": dict(attributes), "selfClosing": self_closing},
        "endTag": lambda: {"type": "EndTag", "name": name},
        "chars": lambda: {"type": "Character", "data": value},
        "comment": lambda: {"type": "Comment", "data": value},
        "doctype": lambda: {"type": "Doctype", "name": name, "publicId": public, "systemId": system, "forceQuirks": quirks},
    }[kind]()
    return utf16.length(json.dumps(body, separators=(",", ":"), ensure_ascii=False))


def _restated(token: tuple, html: str, state: str, xml_violations: bool, double_escaped: bool) -> tuple:
    """Character and comment data as the XML-violation and double-escaped modes of conformance cases have them."""
    kind, value = token[0], token[4]
    if kind not in ("chars", "comment"):
        return token
    if double_escaped and (kind == "comment" or state != "cdata"):
        value = value.replace("\0", "�").replace("\\u0000", "\\uFFFD")
    if xml_violations:
        value = re.sub("[￾￿]", "�", value).replace("\f", " ") if kind == "chars" else value.replace("--", "- -")
    if kind == "chars" and double_escaped and state == "cdata" and html.endswith("]]>") and value.endswith("]]>"):
        value = value[:-3]
    return (*token[:4], value, *token[5:])
