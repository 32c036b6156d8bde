"""SQL surface: scalar functions, and table functions for LATERAL.

Rows of table functions are pickled, since Spark 4.1 refuses Arrow table functions on the right of a lateral join; large
jobs take operators.parse, which gives the same tables in Arrow batches.
"""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..core import encoding, serialize, structure, text
from ..core.document import SPEC_URL, parse, tokenize


def _fragment(raw: str):
    return parse(raw, context="body").root.children


def _text_tokens(html: str):
    found = text.sourced_tokens(parse(html).root.children, text.DEFAULTS, _fragment)
    return ((i, *t) for i, t in enumerate(found))


SCALARS = {
    "html_visible_text": ("string", lambda h: text.visible_text(parse(h, numbered=False).root.children, text.DEFAULTS, _fragment)),
    "html_text_content": ("string", lambda h: text.text_content(parse(h, numbered=False).root)),
    "html_serialize": ("string", lambda h: serialize.serialize(parse(h, numbered=False).root.children)),
    "html_tree": ("string", lambda h: serialize.dump(parse(h, numbered=False).root.children)),
}
BINARY_SCALARS = {
    "html_encoding": ("string", lambda b: encoding.sniff(bytes(b))[0]),
    "html_decode": ("string", lambda b: encoding.decode_html(bytes(b))[0]),
}
TABLES = {
    "html_nodes": (schemas.NODES, lambda h: structure.rows(parse(h, spans=True))),
    "html_tokens": (schemas.TOKENS, lambda h: ((i, *t) for i, t in enumerate(tokenize(h)))),
    "html_errors": (schemas.ERRORS, lambda h: ((i, e["code"], e["parse_error_id"], e["message"], (e["start"], e["end"])) for i, e in enumerate(parse(h).errors))),
    "html_outline": (schemas.OUTLINE, lambda h: ((i, *e) for i, e in enumerate(structure.outline(parse(h).root.children)))),
    "html_chunks": (schemas.CHUNKS, lambda h: structure.chunks(parse(h).root.children)),
    "html_text_tokens": (schemas.TEXT_TOKENS, _text_tokens),
}


def _table_function(ddl: str, rows):
    class Function:
        def eval(self, html: str):
            if html is not None:
                yield from rows(html)

    return F.udtf(Function, returnType=ddl)


def register(spark: SparkSession) -> None:
    """Make all functions known to SQL: ``SELECT html_visible_text(html) ...``, ``FROM pages, LATERAL html_nodes(html)``."""
    from ..operators.arrow import scalar

    for name, (ddl, function) in (SCALARS | BINARY_SCALARS).items():
        spark.udf.register(name, scalar(ddl, function)[0])
    for name, (ddl, rows) in TABLES.items():
        spark.udtf.register(name, _table_function(ddl, rows))
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION html_parse_error_spec_ref(id STRING) RETURNS STRING RETURN '{SPEC_URL}'")
