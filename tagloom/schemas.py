"""Schemas of the engine's tables, as DDL."""

SPAN = "struct<start:int,end:int>"
ATTRIBUTES = f"array<struct<name:string,value:string,span:{SPAN}>>"
NODES = (
    f"node_id int, parent_id int, child_ix int, pre int, pre_end int, depth int, kind string, namespace string, tag_name string, attributes {ATTRIBUTES}, "
    f"value string, name string, public_id string, system_id string, span {SPAN}, span_provenance string"
)
TOKENS = "pos int, kind string, name string, attributes array<struct<name:string,value:string>>, self_closing boolean, value string, public_id string, system_id string, force_quirks boolean"
ERRORS = f"pos int, code string, parse_error_id string, message string, span {SPAN}"
TRACE = (
    "seq int, kind string, source string, encoding string, sniff_source string, count int, from_mode string, to_mode string, "
    "token_context struct<type:string,tag_name:string,start_offset:int,end_offset:int>, node_count int, error_count int, parse_error_id string, "
    "start_offset int, end_offset int, budget string, `limit` bigint, actual bigint, status string, bytes_read bigint"
)
OUTLINE = "pos int, node_id int, depth int, tag_name string, text string"
CHUNKS = "index int, node_id int, content string, nodes int"
TEXT_TOKENS = "pos int, kind string, value string, source_node_id int, source_node_kind string, source_role string"
BUDGET_ERROR = "struct<code:string,budget:string,limit:bigint,actual:bigint>"
STEPS = "array<struct<kind:string,start:int,end:int,at:int,text:string>>"
PATCH_ERROR = "struct<code:string,target:int,detail:string>"
EDITS = "array<struct<kind:string,target:int,name:string,value:string,html:string>>"
SERIALIZER_TOKENS = "array<struct<type:string,namespace:string,name:string,attributes:array<struct<namespace:string,name:string,value:string>>,data:string,public_id:string,system_id:string>>"


def _fields(ddl: str) -> list[str]:
    parts, depth, current = [], 0, ""
    for c in ddl:
        depth += {"<": 1, ">": -1}.get(c, 0)
        if c == "," and not depth:
            parts.append(current.strip())
            current = ""
        else:
            current += c
    return [*parts, current.strip()]


def as_struct(ddl: str) -> str:
    """A table's schema as the type of one of its rows."""
    return "struct<" + ",".join(":".join(p.split(" ", 1)) for p in _fields(ddl)) + ">"


def subset(ddl: str, names: list[str]) -> str:
    """A table's schema with these columns only."""
    return ", ".join(p for p in _fields(ddl) if p.split(" ", 1)[0] in names)
