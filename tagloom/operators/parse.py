"""Generators: from a table of documents to tables of nodes, tokens, errors and trace events.

All are map-only: documents are independent, so no shuffle is needed, whatever the size of the input. With ``mode``
"PERMISSIVE" (the default) a document that exceeds its budget gives no rows here and shows up in :func:`budget_errors`;
"FAILFAST" raises.
"""

from __future__ import annotations

from operator import itemgetter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schemas
from ..core import encoding
from ..core.budgets import UNLIMITED, BudgetExceededError, Budgets
from ..core.document import Document, parse, soft_tree_errors, tokenize
from ..core.structure import Selector, rows, select, visible
from .arrow import budget_error, generate, schema_of


def _input(column, context) -> list[Column]:
    column = F.col(column) if isinstance(column, str) else column
    return [column, context if isinstance(context, Column) else F.lit(context).cast("string")]


def _parser(mode: str, **options):
    """parse() on one value, text or bytes; None where a budget was exceeded and that is permitted."""
    transport = options.pop("transport", None)

    def run(value, context) -> tuple[Document | None, tuple | None]:
        try:
            return _parse(value, context, transport, options), None
        except BudgetExceededError as e:
            if mode == "FAILFAST":
                raise
            return None, budget_error(e)

    return run


def _parse(value, context, transport, options) -> Document:
    if isinstance(value, str):
        return parse(value, context=context, **options)
    budgets = options.get("budgets", UNLIMITED)
    budgets.enforce("maxInputBytes", len(value))
    text, name, source = encoding.decode_html(bytes(value), transport)
    document = parse(text, context=context, **options)
    if document.trace:
        document.trace.push("decode", source="sniff", encoding=name, sniffSource=source)
    return document


def parse_nodes(df: DataFrame, keys: list[str], html="html", context=None, spans: bool = False, budgets: Budgets = UNLIMITED, mode: str = "PERMISSIVE", transport: str | None = None, columns: list[str] | None = None) -> DataFrame:
    """keys and schemas.NODES: one row for each node below the root.

    columns names the ones wanted; others are neither built nor sent to the JVM, which no optimizer rule could see to.

    html is a column of text or of bytes, which are sniffed and decoded; context (a name or a column of names) makes
    fragments. node_id is in post-order after the root's 1; pre is the place in document order and pre_end that of the last
    descendant, so b is below a if a.pre < b.pre <= a.pre_end in one document.
    """
    run = _parser(mode, spans=spans, budgets=budgets, transport=transport)
    names = schema_of(schemas.NODES).names
    wanted = [n for n in names if columns is None or n in columns]
    pick = itemgetter(*map(names.index, wanted)) if len(wanted) > 1 else lambda r, i=names.index(wanted[0]): (r[i],)
    with_attributes = "attributes" in wanted

    def nodes(value, name):
        document, _ = run(value, name)
        return map(pick, rows(document, with_attributes)) if document else ()

    return generate(df, _input(html, context), keys, schemas.subset(schemas.NODES, wanted), nodes)


SELECTED = {
    "ord": "int", "node_id": "int", "depth": "int", "tag_name": "string", "attributes": "array<struct<name:string,value:string,span:struct<start:int,end:int>>>",
    "subtree_nodes": "int", "text": "string",
}


def select_elements(df: DataFrame, keys: list[str], where: Selector, fields: list[str], html="html", context=None, budgets: Budgets = UNLIMITED, mode: str = "PERMISSIVE", transport: str | None = None) -> DataFrame:
    """keys and fields (of SELECTED) of the elements that a selector finds, in document order.

    A document is whole in its worker, so that places, attributes and texts need no shuffle, and only what was found
    crosses to the JVM; operators.nodes does the same on node tables that are stored.
    """
    run = _parser(mode, budgets=budgets, transport=transport)

    def found(value, name):
        document, _ = run(value, name)
        return select(document, where, tuple(fields)) if document else ()

    return generate(df, _input(html, context), keys, ", ".join(f"`{f}` {SELECTED[f]}" for f in fields), found)


def tag_counts(df: DataFrame, keys: list[str], html="html", context=None, budgets: Budgets = UNLIMITED, mode: str = "PERMISSIVE", transport: str | None = None) -> DataFrame:
    """keys, tag_name, n: the elements of each document by name, counted in its worker."""
    from collections import Counter

    run = _parser(mode, budgets=budgets, transport=transport)

    def counts(value, name):
        document, _ = run(value, name)
        return Counter(t for (t,) in select(document, Selector(), ("tag_name",))).items() if document else ()

    return generate(df, _input(html, context), keys, "tag_name string, n bigint", counts)


def visible_nodes(df: DataFrame, keys: list[str], html="html", context=None, budgets: Budgets = UNLIMITED, mode: str = "PERMISSIVE", transport: str | None = None) -> DataFrame:
    """keys, node_id, depth, kind, tag_name, value (of texts) of the nodes outside subtrees that attributes hide."""
    run = _parser(mode, budgets=budgets, transport=transport)

    def nodes(value, name):
        document, _ = run(value, name)
        return [(n.id, d, n.kind, n.tag or None, "".join(n.data) if n.kind == "text" else None) for n, d in visible(document.root.children)] if document else ()

    return generate(df, _input(html, context), keys, "node_id int, depth int, kind string, tag_name string, value string", nodes)


def parse_errors(df: DataFrame, keys: list[str], html="html", context=None, budgets: Budgets = UNLIMITED, mode: str = "PERMISSIVE", transport: str | None = None) -> DataFrame:
    """keys and schemas.ERRORS: one row for each parse error."""
    run = _parser(mode, budgets=budgets, transport=transport)

    def errors(value, name):
        document, _ = run(value, name)
        return [(i, e["code"], e["parse_error_id"], e["message"], (e["start"], e["end"])) for i, e in enumerate(document.errors)] if document else ()

    return generate(df, _input(html, context), keys, schemas.ERRORS, errors)


def tokenizer_errors(df: DataFrame, keys: list[str], html="html", state: str = "data", last_start_tag: str = "", **limits) -> DataFrame:
    """keys, pos, parse_error_id, place: what the tokenizer alone finds, and its soft limits max_text, max_token, max_errors."""

    def errors(value, _):
        found: list = []
        tokenize(value, state, last_start_tag, errors=found, **limits)
        return [(i, code, place) for i, (code, place) in enumerate(found)]

    return generate(df, _input(html, None), keys, "pos int, parse_error_id string, place int", errors)


def soft_limit_errors(df: DataFrame, keys: list[str], html="html", context=None, **limits) -> DataFrame:
    """keys, parse_error_id, n: limits that trees go beyond, and at how many nodes; limits as in core.document.soft_tree_errors."""

    def errors(value, name):
        from collections import Counter

        return Counter(soft_tree_errors(parse(value, context=name, numbered=False).root, **limits)).items()

    return generate(df, _input(html, context), keys, "parse_error_id string, n bigint", errors)


def trace_row(e: dict) -> tuple:
    c = e.get("tokenContext")
    context = (c["type"], c["tagName"], c["startOffset"], c["endOffset"]) if c else None
    names = ("seq", "kind", "source", "encoding", "sniffSource", "count", "fromMode", "toMode")
    more = ("nodeCount", "errorCount", "parseErrorId", "startOffset", "endOffset", "budget", "limit", "actual", "status", "bytesRead")
    return (*(e.get(n) for n in names), context, *(e.get(n) for n in more))


def parse_trace(df: DataFrame, keys: list[str], html="html", context=None, spans: bool = False, budgets: Budgets = UNLIMITED, mode: str = "PERMISSIVE", transport: str | None = None) -> DataFrame:
    """keys and schemas.TRACE: what happened while parsing, in order."""
    run = _parser(mode, spans=spans, trace=True, budgets=budgets, transport=transport)

    def trace(value, name):
        document, _ = run(value, name)
        return map(trace_row, document.trace.events) if document else ()

    return generate(df, _input(html, context), keys, schemas.TRACE, trace)


def document_metrics(df: DataFrame, keys: list[str], html="html", context=None, budgets: Budgets = UNLIMITED, mode: str = "PERMISSIVE", transport: str | None = None) -> DataFrame:
    """keys, node_count (the root counts), max_depth (the root is 1), error_count, budget_error: one row a document."""
    run = _parser(mode, budgets=budgets, transport=transport)

    def metrics(value, name):
        document, error = run(value, name)
        return [(None, None, None, error) if error else (document.nodes, document.max_depth, len(document.errors), None)]

    return generate(df, _input(html, context), keys, f"node_count int, max_depth int, error_count int, budget_error {schemas.BUDGET_ERROR}", metrics)


def budget_errors(df: DataFrame, keys: list[str], html="html", context=None, budgets: Budgets = UNLIMITED, transport: str | None = None) -> DataFrame:
    """keys, budget, limit, actual of the documents that exceed a budget."""
    found = document_metrics(df, keys, html, context, budgets, "PERMISSIVE", transport)
    return found.where(F.col("budget_error").isNotNull()).select(*keys, "budget_error.budget", "budget_error.limit", "budget_error.actual")


def tokenize_html(df: DataFrame, keys: list[str], html="html", state: str = "data", last_start_tag: str = "", xml_violations: bool = False, double_escaped: bool = False, transport: str | None = None) -> DataFrame:
    """keys and schemas.TOKENS: flat tokens without a tree's feedback, adjacent characters merged, eof last."""

    def tokens(value, _):
        value = value if isinstance(value, str) else encoding.decode_html(bytes(value), transport)[0]
        return [(i, *t) for i, t in enumerate(tokenize(value, state, last_start_tag, xml_violations=xml_violations, double_escaped=double_escaped))]

    return generate(df, _input(html, None), keys, schemas.TOKENS, tokens)
