"""Outlines and chunks of trees, and trees as rows."""

from __future__ import annotations

import re
from dataclasses import dataclass

from . import utf16
from .document import Document
from .serialize import serialize
from .text import hidden, text_content
from .tree import COMMENT, DOCTYPE, ELEMENT, TEXT, Node

_OUTLINED = re.compile(r"(?:h[1-6]|section|article)\Z")
OUTLINE_UNITS = 200


def walk(top: list[Node]):
    """(node, depth) in document order; top nodes have depth 0."""
    stack = [(node, 0) for node in reversed(top)]
    while stack:
        node, depth = stack.pop()
        yield node, depth
        if node.children:
            stack += [(child, depth + 1) for child in reversed(node.children)]


@dataclass(frozen=True)
class Selector:
    """Elements by name in any case (not_tags: by what they are not), by attribute, and by its value, both exact."""

    tag: str | None = None
    attribute: str | None = None
    value: str | None = None
    not_tags: tuple[str, ...] = ()

    def matches(self, node: Node) -> bool:
        if node.kind is not ELEMENT or (self.tag is not None and node.tag.lower() != self.tag.lower()) or node.tag in self.not_tags:
            return False
        return self.attribute is None or (self.attribute in node.attrs and self.value in (None, node.attrs[self.attribute]))


def select(document: Document, where: Selector, fields: tuple[str, ...]) -> list[tuple]:
    """The fields of each element that the selector finds, in document order: ord (from 1), node_id, depth, tag_name,
    attributes (name, value, no span), subtree_nodes, text."""
    made = {
        "node_id": lambda n, d: n.id, "depth": lambda n, d: d, "tag_name": lambda n, d: n.tag, "subtree_nodes": lambda n, d: count_nodes(n),
        "attributes": lambda n, d: [(k, v, None) for k, v in n.attrs.items()], "text": lambda n, d: text_content(n),
    }
    found = [x for x in walk(document.root.children) if where.matches(x[0])]
    return [tuple(i if f == "ord" else made[f](node, depth) for f in fields) for i, (node, depth) in enumerate(found, 1)]


def visible(top: list[Node]):
    """(node, depth) in document order without the subtrees that attributes hide."""
    stack = [(node, 0) for node in reversed(top)]
    while stack:
        node, depth = stack.pop()
        if node.kind is ELEMENT and hidden(node):
            continue
        yield node, depth
        stack += [(child, depth + 1) for child in reversed(node.children)]


def count_nodes(node: Node) -> int:
    return sum(1 for _ in walk([node]))


def outline(top: list[Node]) -> list[tuple[int, int, str, str]]:
    """(node id, depth, tag name, first 200 units of text) of headings, sections and articles."""
    return [(n.id, d, n.tag, utf16.head(text_content(n), OUTLINE_UNITS)) for n, d in walk(top) if n.kind is ELEMENT and _OUTLINED.match(n.tag.lower())]


def chunks(top: list[Node], max_chars: int = 8192, max_nodes: int = 256, max_bytes: int | None = None) -> list[tuple[int, int, str, int]]:
    """(index, id of the first node, content, nodes): top nodes packed in order, each chunk as full as the limits let it.

    A node that alone exceeds a limit is a chunk by itself.
    """
    out: list[tuple[int, int, str, int]] = []
    held: list[str] = []
    first, chars, nodes, size = None, 0, 0, 0

    def flush():
        out.append((len(out), first, "".join(held), nodes))

    for node in top:
        content = serialize([node])
        n, units, raw = count_nodes(node), utf16.length(content), len(content.encode("utf-8", "replace")) if max_bytes is not None else 0
        if first is not None and (chars + units > max_chars or nodes + n > max_nodes or (max_bytes is not None and size + raw > max_bytes)):
            flush()
            held, first, chars, nodes, size = [], None, 0, 0, 0
        first = node.id if first is None else first
        held.append(content)
        chars, nodes, size = chars + units, nodes + n, size + raw
    if first is not None:
        flush()
    return out


NODE_FIELDS = ("node_id", "parent_id", "child_ix", "pre", "pre_end", "depth", "kind", "namespace", "tag_name", "attributes", "value", "name", "public_id", "system_id", "span", "span_provenance")


def rows(document: Document, with_attributes: bool = True) -> list[list]:
    """NODE_FIELDS of each node below the root, in document order."""
    spans, offsets = document.spans, document.offsets
    out: list = []
    stack = [(node, 1, i, 0) for i, node in zip(range(len(document.root.children) - 1, -1, -1), reversed(document.root.children), strict=True)]
    ends: list[tuple[int, int]] = []  # place in out, depth
    while stack:
        node, parent, index, depth = stack.pop()
        while ends and ends[-1][1] >= depth:
            place, _ = ends.pop()
            out[place][4] = len(out)
        kind = node.kind
        if not spans:
            span, provenance = None, "none"
        elif node.start is None:
            span, provenance = None, "inferred"
        else:
            span, provenance = (offsets(node.start), offsets(node.end)), "input"
        attributes = tag = namespace = value = name = public = system = None
        if kind is ELEMENT:
            tag, namespace = node.tag, node.ns
            own = node.spans or {}
            if with_attributes:
                attributes = [(k, v, (offsets(own[k][0]), offsets(own[k][1])) if spans and own.get(k) else None) for k, v in node.attrs.items()]
        elif kind is TEXT:
            value = "".join(node.data)
        elif kind is COMMENT:
            value = node.data
        elif kind is DOCTYPE:
            name, public, system = node.data, node.public or None, node.system or None
        pre = len(out) + 1
        out.append([node.id, parent, index, pre, pre, depth, kind, namespace, tag, attributes, value, name, public, system, span, provenance])
        if node.children:
            ends.append((pre - 1, depth))
            stack += [(child, node.id, i, depth + 1) for i, child in zip(range(len(node.children) - 1, -1, -1), reversed(node.children), strict=True)]
    for place, _ in ends:
        out[place][4] = len(out)
    return out
