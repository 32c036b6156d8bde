"""Column functions over HTML: each parses in an Arrow-batched Python worker and returns one value per row.

Nothing but the result crosses back to the JVM, so these are the way to take when the node table itself is not needed.
A null input gives a null result.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import schemas
from ..core import encoding, patch, serialize, structure, text, utf16
from ..core.budgets import UNLIMITED, BudgetExceededError, Budgets
from ..core.document import SPEC_URL, parse, tokenize
from ..operators.arrow import budget_error, scalar


def _column(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _one(ddl: str, function, column) -> Column:
    return scalar(ddl, function)[0](_column(column))


def _fragment(raw: str):
    return parse(raw, context="body").root.children


def _top(html: str, context: str | None, numbered: bool = False):
    return parse(html, context=context, numbered=numbered).root.children


# --- bytes and encodings ----------------------------------------------------------------------------------------------


def sniff_encoding(data, transport: str | None = None) -> Column:
    """struct<encoding,source> of a binary column; only the bytes that a prescan may look at reach Python."""
    head = F.substring(_column(data), 1, encoding.PRESCAN_BYTES)
    return _one("struct<encoding:string,source:string>", lambda b: encoding.sniff(bytes(b), transport), head)


def decode_html(data, transport: str | None = None) -> Column:
    """struct<text,encoding,source> of a binary column."""
    return _one("struct<text:string,encoding:string,source:string>", lambda b: encoding.decode_html(bytes(b), transport), data)


def decode_chunks(chunks, transport: str | None = None, budgets: Budgets = UNLIMITED, mode: str = "PERMISSIVE") -> Column:
    """struct<text,encoding,source,bytes_read,max_buffered,budget_error> of an ordered array of binary chunks."""

    def decode(parts):
        try:
            return (*encoding.decode_chunks([bytes(p) for p in parts if p is not None], transport, budgets), None)
        except BudgetExceededError as e:
            if mode == "FAILFAST":
                raise
            return None, None, None, None, None, budget_error(e)

    return _one(f"struct<text:string,encoding:string,source:string,bytes_read:bigint,max_buffered:bigint,budget_error:{schemas.BUDGET_ERROR}>", decode, chunks)


# --- text -------------------------------------------------------------------------------------------------------------


def visible_text(html, context: str | None = None, **options) -> Column:
    """The text a reader sees. Options: skip_hidden_subtrees, include_control_values, include_accessible_name_fallback, trim."""
    chosen = text.TextOptions(**options)
    return _one("string", lambda h: text.visible_text(_top(h, context), chosen, _fragment), html)


def visible_text_sourced(html, context: str | None = None, **options) -> Column:
    """array<struct<kind,value,source_node_id,source_node_kind,source_role>>: visible-text tokens with their sources."""
    chosen = text.TextOptions(**options)
    kind = "array<struct<kind:string,value:string,source_node_id:int,source_node_kind:string,source_role:string>>"
    return _one(kind, lambda h: text.sourced_tokens(_top(h, context, True), chosen, _fragment), html)


def visible_text_tokens(visible) -> Column:
    """array<struct<kind,value>> of a visible text; JVM-side."""
    values = F.regexp_extract_all(_column(visible), F.lit(r"\n\n|\n|\t|[^\n\t]+"), F.lit(0))
    kind = lambda v: F.when(v == "\n\n", "paragraphBreak").when(v == "\n", "lineBreak").when(v == "\t", "tab").otherwise("text")
    return F.transform(values, lambda v: F.struct(kind(v).alias("kind"), v.alias("value")))


def text_content(html, context: str | None = None) -> Column:
    return _one("string", lambda h: text.text_content(parse(h, context=context, numbered=False).root), html)


# --- structure --------------------------------------------------------------------------------------------------------


def outline(html) -> Column:
    return _one("array<struct<node_id:int,depth:int,tag_name:string,text:string>>", lambda h: structure.outline(_top(h, None, True)), html)


def chunk(html, context: str | None = None, max_chars: int = 8192, max_nodes: int = 256, max_bytes: int | None = None) -> Column:
    """array<struct<index,node_id,content,nodes>>."""
    return _one(f"array<{schemas.as_struct(schemas.CHUNKS)}>", lambda h: structure.chunks(_top(h, context, True), max_chars, max_nodes, max_bytes), html)


def serialize_html(html, context: str | None = None, style: str = "plain") -> Column:
    """The parsed tree as HTML again; style "compact" leaves out quotes where it can."""
    return _one("string", lambda h: serialize.serialize(_top(h, context), style == "compact"), html)


def normalize_tree(html, context: str | None = None) -> Column:
    """The tree as an indented dump."""
    return _one("string", lambda h: serialize.dump(_top(h, context)), html)


def serialize_tokens(tokens, **options) -> Column:
    """HTML of an array of serializer tokens; options as in core.serialize.OPTIONS."""
    return _one("string", lambda ts: serialize.serialize_tokens([{**t, "attributes": t["attributes"] or []} for t in ts], **options), tokens)


def reserialize_tokens(html, **options) -> Column:
    """A document's own tokens through the token serializer; options as in core.serialize.OPTIONS.

    The tokens stay in the worker, one document's at a time."""
    return _one("string", lambda h: serialize.serialize_tokens(serialize.serializer_tokens(tokenize(h)), **options), html)


def rebuild(html) -> Column:
    """The tree that the document's own tokens build when they are written out and parsed again, as HTML."""
    return _one("string", lambda h: serialize.serialize(_top(serialize.tokens_as_html(tokenize(h)), None)), html)


# --- patching ---------------------------------------------------------------------------------------------------------


_PATCH = f"struct<steps:{schemas.STEPS},result:string,error:{schemas.PATCH_ERROR}>"


def _patch_error(e: Exception) -> tuple:
    return (e.payload["code"], e.payload["target"], e.payload["detail"]) if isinstance(e, patch.PatchPlanningError) else ("INVALID_PLAN", None, str(e))


def compute_patch(html, edits, mode: str = "PERMISSIVE") -> Column:
    """struct<steps,result,error> of an array of edits (kind, target, name, value, html); see core.patch.plan."""

    def run(original, wanted):
        try:
            steps, result = patch.plan(original, [patch.Edit(**e) for e in wanted or []])
            return steps, result, None
        except (patch.PatchPlanningError, ValueError) as e:
            if mode == "FAILFAST":
                raise
            return None, None, _patch_error(e)

    return scalar(_PATCH, run)[1](_column(html), _column(edits))


def patch_where(html, rules: list[patch.Rule], mode: str = "PERMISSIVE") -> Column:
    """The same for edits of the elements that selectors find: one parse finds the targets and plans the patch."""

    def run(original):
        try:
            document = parse(original, spans=True)
            steps, result = patch.plan(original, patch.edits_of(document, rules), document)
            return steps, result, None
        except (patch.PatchPlanningError, ValueError) as e:
            if mode == "FAILFAST":
                raise
            return None, None, _patch_error(e)

    return _one(_PATCH, run, html)


def apply_patch_plan(html, steps) -> Column:
    """The text that a plan's steps make; JVM-side. A step that goes back or inserts elsewhere than at the cursor fails.

    Offsets are UTF-16 units; texts with characters beyond the basic plane go through UTF-16 bytes.
    """
    html, steps = _column(html), _column(steps)
    raw = F.encode(html, "UTF-16BE")
    size = (F.octet_length(raw) / 2).cast("int")
    start = F.struct(F.lit(0).alias("cursor"), F.array().cast("array<string>").alias("out"), F.lit(True).alias("ok"))

    def step(state: Column, x: Column) -> Column:
        is_slice = x["kind"] == "slice"
        ok = F.when(is_slice, (x["start"] >= state["cursor"]) & (x["end"] >= x["start"]) & (x["end"] <= size)).otherwise((x["at"] == state["cursor"]) & (x["at"] <= size))
        taken = F.decode(F.substring(raw, x["start"] * 2 + 1, (x["end"] - x["start"]) * 2), "UTF-16BE")
        part = F.when(~ok, "").when(is_slice, taken).otherwise(x["text"])
        return F.struct(F.when(is_slice, x["end"]).otherwise(state["cursor"]).alias("cursor"), F.concat(state["out"], F.array(part)).alias("out"), (state["ok"] & ok).alias("ok"))

    done = F.aggregate(steps, start, step, lambda s: F.when(s["ok"], F.array_join(s["out"], "")).otherwise(F.raise_error(F.lit("invalid patch plan")).cast("string")))
    return F.when(html.isNotNull(), done)


# --- plain expressions ------------------------------------------------------------------------------------------------


def escape_text(value) -> Column:
    return F.replace(F.replace(F.replace(_column(value), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def escape_attribute(value) -> Column:
    return F.replace(F.replace(_column(value), F.lit("&"), F.lit("&amp;")), F.lit('"'), F.lit("&quot;"))


def utf16_length(value) -> Column:
    """Length in UTF-16 units."""
    return (F.octet_length(F.encode(_column(value), "UTF-16BE")) / 2).cast("int")


def parse_error_spec_ref(parse_error_id=None) -> Column:
    """Where parse errors are specified."""
    return F.lit(SPEC_URL)


def parse_error_id(code) -> Column:
    """A parse error's public id; JVM-side."""
    trimmed = F.trim(_column(code), F.lit(utf16.JS_SPACE))
    return F.when(trimmed == "", "vendor:unknown").when(trimmed.rlike(r"\A[a-z0-9]+(?:-[a-z0-9]+)*\z"), trimmed).otherwise(F.concat(F.lit("vendor:"), trimmed))


def attribute_value(attributes, name: str) -> Column:
    """The value of the first attribute of that name in any case, or null."""
    return F.get(F.filter(_column(attributes), lambda a: F.lower(a["name"]) == name.lower()), F.lit(0))["value"]


def is_hidden(attributes) -> Column:
    """Whether an element's own attributes hide its subtree."""
    style = F.regexp_replace(F.lower(attribute_value(attributes, "style")), f"[{utf16.JS_SPACE}]+", "")
    aria = F.lower(F.trim(attribute_value(attributes, "aria-hidden"), F.lit(utf16.JS_SPACE)))
    return attribute_value(attributes, "hidden").isNotNull() | F.coalesce(style.rlike(text.HIDING), F.lit(False)) | F.coalesce(aria.isin(*text.ARIA_HIDDEN), F.lit(False))


def decode_references(value, in_attribute: bool = False) -> Column:
    """Character references replaced by what they stand for."""
    from ..core.charrefs import decode

    return _one("string", lambda v: decode(v, in_attribute), value)


def token_f1_score(expected, actual) -> Column:
    """F1 of two texts' words, row by row; operators.text.token_f1 is the relational form for large texts."""
    return scalar("double", lambda a, b: text.token_f1(a, b or ""))[1](_column(expected), _column(actual))
