"""Named queries over the ``pages`` table, with the DuckDB SQL each is compared with.

The SQL works on the text of the pages with regular expressions, which the regular template of that table allows; counts
of ``b`` elements depend on error recovery, so no SQL can give them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..core.budgets import Budgets
from ..core.patch import Rule
from ..core.structure import Selector
from ..functions import html as H
from ..operators import nodes as N
from ..operators import parse as P
from ..operators import text as V
from ..operators.arrow import spread
from ..sources.files import scratch_dir, split_bytes, write_html, write_json_report
from ..streaming import chunks as C

KEY = ["page_id"]
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def _query(name: str, sql: str | None = None):
    def add(function):
        QUERIES[name] = function
        if sql is not None:
            ORACLE_SQL[name] = sql
        return function

    return add


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "html"))


def page_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages(spark, sf_dir).select("page_id", F.encode("html", "UTF-8").alias("bytes"))


def _slice(pattern: str):
    return F.regexp_extract("html", f"(?s){pattern}", 0)


# --- SQL over the template --------------------------------------------------------------------------------------------

_BARE = "regexp_replace(regexp_replace(html, '<script>.*?</script>', '', 'gs'), '<!--.*?-->', '', 'gs')"
_BODY = "regexp_replace(regexp_replace(html, '<head>.*?</head>', '', 'gs'), '<!--.*?-->', '', 'gs')"


def _cut(pattern: str, group: int = 1) -> str:
    return f"regexp_extract(html, '{pattern}', {group}, 's')"


def _decoded(sql: str) -> str:
    for name, char in (("lt", "<"), ("gt", ">"), ("quot", '"'), ("copy", "©"), ("middot", "·"), ("amp", "&")):
        sql = f"replace({sql}, '&{name};', '{char}')"
    return sql


_SPACED = f"regexp_replace({_BODY}, '[ \\t\\n\\f\\r]+', ' ', 'g')"
_BROKEN = f"replace({_SPACED}, '</p>', chr(10) || chr(10))"
_BROKEN = f"regexp_replace({_BROKEN}, '<br>|<p>', chr(10), 'g')"
_BROKEN = f"regexp_replace({_BROKEN}, '</?(nav|ul|li|div|article|h1|footer)( [^>]*)?>', chr(10), 'g')"
_BROKEN = f"regexp_replace({_BROKEN}, '<[/a-zA-Z!][^>]*>', '', 'g')"
_VISIBLE = _decoded(_BROKEN)
for _pattern, _by in (("[ \\t\\f]+\\n", "chr(10)"), ("\\n[ \\t\\f]+", "chr(10)"), ("\\n{3,}", "chr(10) || chr(10)"), (" {2,}", "' '")):
    _VISIBLE = f"regexp_replace({_VISIBLE}, '{_pattern}', {_by}, 'g')"
_TRIMMED = f"trim({_VISIBLE}, ' ' || chr(10) || chr(9))"
_H1 = _decoded(_cut("<h1>(.*?)</h1>"))
_NAV = _cut("<nav>.*?</nav>", 0)
_PLACED_LI = f"len(regexp_extract_all({_NAV}, '<li>'))"
_AD = _cut('<div class="ad">(.*?)</div>')


# --- sources ----------------------------------------------------------------------------------------------------------


@_query("sc1_html_source", "SELECT page_id, length(html) AS n_chars, html IS NOT NULL AS read FROM pages")
def html_source(spark, sf_dir):
    return pages(spark, sf_dir).select("page_id", F.length("html").cast("long").alias("n_chars"), F.col("html").isNotNull().alias("read"))


@_query("sc2_parse_bytes_title", f"SELECT page_id, {_decoded(_cut('<title>(.*?)</title>'))} AS text FROM pages")
def parse_bytes_title(spark, sf_dir):
    return P.select_elements(page_bytes(spark, sf_dir), KEY, Selector("title"), ["text"], "bytes")


@_query("sc3_stream_reassembly", "SELECT page_id, html AS text, strlen(html) AS bytes_read, 'utf-8' AS encoding, 'meta' AS source FROM pages")
def stream_reassembly(spark, sf_dir):
    chunks = split_bytes(page_bytes(spark, sf_dir), KEY, 1000)
    return C.assemble(chunks, KEY).select("page_id", "text", "bytes_read", "encoding", "source")


@_query("sc4_sniff_encoding", "SELECT page_id, 'utf-8' AS encoding, 'meta' AS source FROM pages")
def sniff_encoding(spark, sf_dir):
    return page_bytes(spark, sf_dir).select("page_id", H.sniff_encoding("bytes").alias("e")).select("page_id", "e.encoding", "e.source")


@_query("sc4b_transport_label", "SELECT page_id, 'windows-1252' AS encoding, 'transport' AS source FROM pages")
def transport_label(spark, sf_dir):
    return page_bytes(spark, sf_dir).select("page_id", H.sniff_encoding("bytes", ' "ISO-8859-1" ').alias("e")).select("page_id", "e.encoding", "e.source")


@_query("sc4a_byte_order_mark", "SELECT page_id, 'utf-8' AS encoding, 'bom' AS source, html AS text FROM pages")
def byte_order_mark(spark, sf_dir):
    marked = page_bytes(spark, sf_dir).select("page_id", F.concat(F.unhex(F.lit("EFBBBF")), "bytes").alias("bytes"))
    return marked.select("page_id", H.decode_html("bytes", "koi8-r").alias("d")).select("page_id", "d.encoding", "d.source", "d.text")


@_query("sc4c_meta_prescan", "SELECT page_id, 'koi8-r' AS encoding, 'meta' AS source FROM pages")
def meta_prescan(spark, sf_dir):
    """A declaration in a comment does not count, one in an http-equiv does, and comes before the page's own."""
    head = F.lit('<!-- <meta charset=big5> --><meta http-equiv="Content-Type" content="text/html; charset=koi8-r">')
    data = pages(spark, sf_dir).select("page_id", F.encode(F.concat(head, "html"), "UTF-8").alias("bytes"))
    return data.select("page_id", H.sniff_encoding("bytes").alias("e")).select("page_id", "e.encoding", "e.source")


@_query("sc5_decode_bytes", "SELECT page_id, html AS text FROM pages")
def decode_bytes(spark, sf_dir):
    return page_bytes(spark, sf_dir).select("page_id", H.decode_html("bytes")["text"].alias("text"))


@_query("sk1_write_html", "SELECT page_id, html AS part FROM (SELECT page_id, " + _NAV + " AS html FROM pages)")
def write_serialized(spark, sf_dir):
    """Serialized documents written as Parquet and read again."""
    where = scratch_dir(spark)
    write_html(pages(spark, sf_dir).select("page_id", H.serialize_html(_slice("<nav>.*?</nav>"), context="body").alias("part")), where, "part", KEY)
    return spark.read.parquet(where)


@_query("sk2_write_json_report", f"SELECT page_id, CAST({_PLACED_LI} AS BIGINT) AS n_li FROM pages")
def write_report(spark, sf_dir):
    """A report of counts written as JSON and read again."""
    where = scratch_dir(spark)
    counts = P.tag_counts(pages(spark, sf_dir), KEY, _slice("<nav>.*?</nav>"), context="body")
    write_json_report(counts.where("tag_name = 'li'").select("page_id", F.col("n").alias("n_li")), where)
    return spark.read.schema("page_id long, n_li long").json(where)


# --- parsing ----------------------------------------------------------------------------------------------------------

_TAG_ROWS = f"""
SELECT page_id, tag_name, count(*) AS n FROM (
  SELECT page_id, unnest(regexp_extract_all({_BARE}, '<([a-z][a-z0-9]*)[ >]', 1)) AS tag_name FROM pages
  UNION ALL SELECT page_id, 'script' AS tag_name FROM pages) WHERE tag_name <> 'b' GROUP BY page_id, tag_name
"""


@_query("p1_parse_tag_counts", _TAG_ROWS)
def parse_tag_counts(spark, sf_dir):
    """Elements of each page by name, but b."""
    return P.tag_counts(pages(spark, sf_dir), KEY).where("tag_name <> 'b'")


@_query("p1_parse_nodes")
def parse_nodes(spark, sf_dir):
    """The whole node table with spans."""
    return P.parse_nodes(pages(spark, sf_dir), KEY, spans=True)


_FRAGMENT = f"SELECT page_id, len(regexp_extract_all({_NAV}, '<li>')) AS n_li, len(regexp_extract_all({_NAV}, '<a ')) AS n_a FROM pages"


@_query("p2_parse_fragment_nav", _FRAGMENT)
def parse_fragment_nav(spark, sf_dir):
    counts = P.tag_counts(pages(spark, sf_dir), KEY, _slice("<nav>.*?</nav>"), context="body")
    count = lambda tag: F.coalesce(F.sum(F.when(F.col("tag_name") == tag, F.col("n"))), F.lit(0))
    return counts.groupBy("page_id").agg(count("li").alias("n_li"), count("a").alias("n_a"))


@_query("p3_parse_bytes_h1", f"SELECT page_id, {_H1} AS text FROM pages")
def parse_bytes_h1(spark, sf_dir):
    return P.select_elements(page_bytes(spark, sf_dir), KEY, Selector("h1"), ["text"], "bytes")


@_query("p4_parse_stream_h1", f"SELECT page_id, {_H1} AS text FROM pages")
def parse_stream_h1(spark, sf_dir):
    whole = C.assemble(split_bytes(page_bytes(spark, sf_dir), KEY, 777), KEY)
    return P.select_elements(whole, KEY, Selector("h1"), ["text"], "text")


_NO_COMMENT = "regexp_replace(html, '<!--.*?-->', '', 'gs')"
_TOKENS = f"""
SELECT page_id, kind, n FROM (
  SELECT page_id, 'startTag' AS kind, len(regexp_extract_all({_NO_COMMENT}, '<[a-z]')) AS n FROM pages
  UNION ALL SELECT page_id, 'endTag', len(regexp_extract_all({_NO_COMMENT}, '</[a-z]')) FROM pages
  UNION ALL SELECT page_id, 'comment', len(regexp_extract_all(html, '<!--')) FROM pages
  UNION ALL SELECT page_id, 'doctype', 1 FROM pages UNION ALL SELECT page_id, 'eof', 1 FROM pages) WHERE n > 0
"""


@_query("p5_tokenize_counts", _TOKENS)
def tokenize_counts(spark, sf_dir):
    """Tokens of each page by kind, but characters; an end tag in the script is a token here."""
    return P.tokenize_html(pages(spark, sf_dir), KEY).where("kind <> 'chars'").groupBy("page_id", "kind").agg(F.count("*").alias("n"))


@_query("p5_tokenize")
def tokenize(spark, sf_dir):
    return P.tokenize_html(pages(spark, sf_dir), KEY)


@_query("p5b_tokenize_rcdata", "SELECT page_id, 'chars' AS kind, " + _decoded("html") + " AS value FROM pages UNION ALL SELECT page_id, 'eof', NULL FROM pages")
def tokenize_rcdata(spark, sf_dir):
    """All pages as the text of an element that knows only references. The SQL does not know those without a semicolon, such
    as ``&amp`` where a title was cut."""
    return P.tokenize_html(pages(spark, sf_dir), KEY, state="rcdata", last_start_tag="none").select("page_id", "kind", "value")


@_query("p5b_tokenize_rcdata_pages")
def tokenize_rcdata_pages(spark, sf_dir):
    """All pages as the text of an element that knows only references, also those without a semicolon."""
    return P.tokenize_html(pages(spark, sf_dir), KEY, state="rcdata", last_start_tag="none").select("page_id", "kind", "value")


@_query("p5_tokenize_stream_counts", _TOKENS)
def tokenize_stream_counts(spark, sf_dir):
    tokens = C.tokenize_stream(split_bytes(page_bytes(spark, sf_dir), KEY, 4096), KEY)
    return tokens.where("kind <> 'chars'").groupBy("page_id", "kind").agg(F.count("*").alias("n"))


_LANG = _cut('<html lang="([^"]*)"')


def _lang():
    return F.regexp_extract("html", '<html lang="([^"]*)"', 1)


@_query("p5c_xml_violations", f"SELECT page_id, 'x- -' || {_LANG} AS value FROM pages")
def xml_violations(spark, sf_dir):
    part = F.concat(F.lit("<!--x--"), _lang(), F.lit("-->"))
    tokens = P.tokenize_html(pages(spark, sf_dir).select("page_id", part.alias("part")), KEY, "part", xml_violations=True)
    return tokens.where("kind = 'comment'").select("page_id", "value")


@_query("p5d_tokenizer_limits", f"SELECT page_id, 'max-text-bytes-exceeded' AS parse_error_id, CAST(length({_AD}) AS INT) AS place FROM pages WHERE NOT contains({_AD}, '&') AND length({_AD}) > 5")
def tokenizer_limits(spark, sf_dir):
    ad = _slice('<div class="ad">.*?</div>')
    return P.tokenizer_errors(pages(spark, sf_dir).where(~ad.contains("&")), KEY, ad, max_text=5).select("page_id", "parse_error_id", "place")


@_query("p9_select_adoption", f"SELECT page_id, '<html><head></head><body><select><b><option>' || {_LANG} || '</option></b></select><b><option></option></b>z</body></html>' AS html FROM pages")
def select_adoption(spark, sf_dir):
    part = F.concat(F.lit("<select><option>"), _lang(), F.lit("</option></select><option>z</option>"))
    return pages(spark, sf_dir).select("page_id", H.serialize_html(part).alias("html"))


_NAV_NODES = f"(2 + 2 * len(regexp_extract_all({_NAV}, '<li>')) + len(regexp_extract_all({_NAV}, '<a [^>]*>[^<]')))"


@_query("p11_soft_tree_limits", f"SELECT page_id, 'max-nodes-exceeded' AS parse_error_id, {_NAV_NODES} - 12 AS n FROM pages WHERE {_NAV_NODES} > 12")
def soft_tree_limits(spark, sf_dir):
    return P.soft_limit_errors(pages(spark, sf_dir), KEY, _slice("<nav>.*?</nav>"), context="body", max_nodes=12, max_depth=9)


@_query("p7_character_references", f"SELECT page_id, {_decoded(_cut('<footer>([^<]*)'))} AS text FROM pages WHERE html LIKE '%</footer>%'")
def character_references(spark, sf_dir):
    whole = pages(spark, sf_dir).where(F.col("html").contains("</footer>"))
    return whole.select("page_id", H.decode_references(F.regexp_extract("html", "<footer>([^<]*)", 1)).alias("text"))


@_query("p8_rebuild_from_tokens")
def rebuild_from_tokens(spark, sf_dir):
    return pages(spark, sf_dir).select("page_id", H.rebuild("html").alias("html"))


@_query("p8_rebuild_nav", f"SELECT page_id, '<html><head></head><body>' || {_NAV} || '</body></html>' AS html FROM pages")
def rebuild_nav(spark, sf_dir):
    return pages(spark, sf_dir).select("page_id", H.rebuild(_slice("<nav>.*?</nav>")).alias("html"))


@_query("p10_attributes", "SELECT page_id, 'a' AS tag_name, ord, 'href' AS name, href AS value FROM (SELECT page_id, unnest(regexp_extract_all(html, '<a href=\"([^\"]*)\"', 1)) AS href, generate_subscripts(regexp_extract_all(html, '<a href=\"([^\"]*)\"', 1), 1) AS ord FROM pages)")
def attributes(spark, sf_dir):
    links = P.select_elements(pages(spark, sf_dir), KEY, Selector("a"), ["tag_name", "ord", "attributes"])
    return links.select("page_id", "tag_name", F.col("ord").cast("long").alias("ord"), F.explode("attributes").alias("x")).select("page_id", "tag_name", "ord", "x.name", "x.value")


@_query("p12_normalize_tree")
def normalize_tree(spark, sf_dir):
    return pages(spark, sf_dir).select("page_id", H.normalize_tree("html").alias("dump"))


_DUMP = f"""
SELECT page_id, '| <nav>' || chr(10) || '|   <ul>' || string_agg(chr(10) || '|     <li>' || chr(10) || '|       <a>' || chr(10) || '|         href="' || {_decoded("regexp_extract(item, 'href=\"([^\"]*)\"', 1)")} || '"'
  || CASE WHEN regexp_extract(item, '<a [^>]*>([^<]*)', 1) = '' THEN '' ELSE chr(10) || '|         "' || {_decoded("regexp_extract(item, '<a [^>]*>([^<]*)', 1)")} || '"' END, '' ORDER BY ord) AS dump
FROM (SELECT page_id, unnest(t) AS item, generate_subscripts(t, 1) AS ord FROM (SELECT page_id, regexp_extract_all({_NAV}, '<li>.*?</li>', 0, 's') AS t FROM pages)) GROUP BY page_id
"""


@_query("p12_normalize_nav", _DUMP)
def normalize_nav(spark, sf_dir):
    return pages(spark, sf_dir).select("page_id", H.normalize_tree(_slice("<nav>.*?</nav>"), context="body").alias("dump"))


# --- projections ------------------------------------------------------------------------------------------------------


@_query("s1_serialize_fragment_nav", f"SELECT page_id, {_NAV} AS html FROM pages")
def serialize_fragment_nav(spark, sf_dir):
    return pages(spark, sf_dir).select("page_id", H.serialize_html(_slice("<nav>.*?</nav>"), context="body").alias("html"))


@_query("s1_serialize")
def serialize(spark, sf_dir):
    return pages(spark, sf_dir).select("page_id", H.serialize_html("html").alias("html"))


_COMPACT_AD = f"""replace({_cut('<div class="ad">.*?</div>', 0)}, '"ad"', 'ad')"""


@_query("s2_serialize_compact_ad", f"SELECT page_id, {_COMPACT_AD} AS html FROM pages")
def serialize_compact_ad(spark, sf_dir):
    return pages(spark, sf_dir).select("page_id", H.serialize_html(_slice('<div class="ad">.*?</div>'), context="body", style="compact").alias("html"))


@_query("s3_serialize_tokens_nav", f"SELECT page_id, replace(replace({_NAV}, '</li>', ''), chr(34), chr(39)) AS html FROM pages")
def serialize_tokens_nav(spark, sf_dir):
    """End tags of list items may go; values are quoted by apostrophes."""
    return pages(spark, sf_dir).select("page_id", H.reserialize_tokens(_slice("<nav>.*?</nav>"), quote_char="'", quote_attr_values=True).alias("html"))


@_query("s3e_serialize_tokens_whitespace", f"SELECT page_id, '<!DOCTYPE html PUBLIC \"a\" \"b\"><div class=ad>' || regexp_replace({_AD}, '[ \\t\\n\\f\\r]+', ' ', 'g') || '</div>' AS html FROM pages WHERE NOT regexp_matches({_AD}, '[&>]')")
def serialize_tokens_whitespace(spark, sf_dir):
    """Doctypes with both ids, and white space collapsed outside elements that keep it."""
    ad = F.regexp_extract("html", '(?s)<div class="ad">(.*?)</div>', 1)
    part = F.concat(F.lit("<!doctype html public 'a' 'b'><div class=ad>"), ad, F.lit("</div>"))
    plain = pages(spark, sf_dir).where(~ad.rlike("[&>]"))
    return plain.select("page_id", H.reserialize_tokens(part, strip_whitespace=True).alias("html"))


@_query("s3d_inject_meta_charset", f"SELECT page_id, '<meta charset=koi8-r>' || {_cut('<title>.*?</title>', 0)} AS html FROM pages")
def inject_meta_charset(spark, sf_dir):
    """A head whose declaration of the encoding is rewritten; its own tags may go."""
    part = F.concat(F.lit('<head><meta charset="utf-8">'), _slice("<title>.*?</title>"), F.lit("</head>"))
    return pages(spark, sf_dir).select("page_id", H.reserialize_tokens(part, inject_meta_charset=True, encoding="koi8-r").alias("html"))


@_query("s3c_attribute_order", f"SELECT page_id, '<input -x=1 checked Class=' || {_LANG} || ' disabled readonly=no value=\"a ' || {_LANG} || '\">' AS html FROM pages")
def attribute_order(spark, sf_dir):
    """Attributes in a locale's order, those that are equal to their name without a value."""
    null = F.lit(None).cast("string")
    attribute = lambda n, v: F.struct(null.alias("namespace"), F.lit(n).alias("name"), v.alias("value"))
    given = F.array(*[attribute(n, v) for n, v in (("value", F.concat(F.lit("a "), _lang())), ("disabled", F.lit("DISABLED")), ("Class", _lang()), ("-x", F.lit("1")), ("readonly", F.lit("no")), ("checked", F.lit("checked")))])
    token = F.struct(F.lit("StartTag").alias("type"), null.alias("namespace"), F.lit("input").alias("name"), given.alias("attributes"), F.lit("").alias("data"), F.lit("").alias("public_id"), F.lit("").alias("system_id"))
    return pages(spark, sf_dir).select("page_id", H.serialize_tokens(F.array(token)).alias("html"))


@_query("s4_text_content_h1", f"SELECT page_id, {_H1} AS text FROM pages")
def text_content_h1(spark, sf_dir):
    return P.select_elements(pages(spark, sf_dir), KEY, Selector("h1"), ["text"])


@_query("s5_escape", "SELECT page_id, replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS as_text, replace(replace(html, '&', '&amp;'), chr(34), '&quot;') AS as_attribute FROM pages")
def escape(spark, sf_dir):
    return pages(spark, sf_dir).select("page_id", H.escape_text("html").alias("as_text"), H.escape_attribute("html").alias("as_attribute"))


@_query("s6_parse_error_spec_ref", "SELECT page_id, 'https://html.spec.whatwg.org/multipage/parsing.html#parse-errors' AS url FROM pages")
def parse_error_spec_ref(spark, sf_dir):
    return pages(spark, sf_dir).select("page_id", H.parse_error_spec_ref().alias("url"))


@_query("s7_parse_errors")
def parse_errors(spark, sf_dir):
    return P.parse_errors(pages(spark, sf_dir), KEY)


@_query("s7_parse_error_id", "SELECT page_id, 'vendor:' || trim(regexp_extract(html, '<h1>([^<]*)', 1)) AS id FROM pages")
def parse_error_id(spark, sf_dir):
    return pages(spark, sf_dir).select("page_id", H.parse_error_id(F.regexp_extract("html", "<h1>([^<]*)", 1)).alias("id"))


@_query("s8_metrics")
def metrics(spark, sf_dir):
    return P.document_metrics(pages(spark, sf_dir), KEY).drop("budget_error")


@_query("s8_subtree_nodes_nav", f"SELECT page_id, {_NAV_NODES} AS subtree_nodes FROM pages")
def subtree_nodes_nav(spark, sf_dir):
    found = P.select_elements(pages(spark, sf_dir), KEY, Selector("nav"), ["subtree_nodes"])
    return found.select("page_id", F.col("subtree_nodes").cast("long").alias("subtree_nodes"))


# --- lookups ----------------------------------------------------------------------------------------------------------


_ORDER = f"""
SELECT page_id, CAST(generate_subscripts(t, 1) AS INT) AS ord, unnest(t) AS tag_name
FROM (SELECT page_id, [x FOR x IN regexp_extract_all({_BARE}, '<([a-z][a-z0-9]*)[ >]', 1) IF x <> 'b'] AS t FROM pages)
"""


@_query("f1_walk_elements_order", _ORDER)
def walk_elements_order(spark, sf_dir):
    """Elements of each page in document order, but b and script, which the SQL cannot place."""
    return P.select_elements(pages(spark, sf_dir), KEY, Selector(not_tags=("b", "script")), ["ord", "tag_name"])


@_query("f1_walk_order")
def walk_order(spark, sf_dir):
    return N.walk(P.parse_nodes(pages(spark, sf_dir), KEY, columns=["pre", "depth", "kind", "tag_name"]), KEY)


@_query("f2_walk_elements_tag_counts", _TAG_ROWS)
def walk_elements(spark, sf_dir):
    """The same by walking each document's elements, which the worker leaves out by name."""
    walked = P.select_elements(pages(spark, sf_dir), KEY, Selector(not_tags=("b",)), ["tag_name"])
    return walked.groupBy("page_id", "tag_name").agg(F.count("*").alias("n"))


@_query("f3_find_by_id", "SELECT page_id, 'doctype' AS kind, 'html' AS name FROM pages")
def find_by_id(spark, sf_dir):
    """Ids begin behind the root's 1, so 2 is the first leaf: the doctype."""
    return N.find_by_id(P.parse_nodes(pages(spark, sf_dir), KEY, columns=["node_id", "kind", "name"]), 2).select("page_id", "kind", "name")


_LINKS = """
SELECT page_id, ord, href FROM (SELECT page_id, unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS href,
  generate_subscripts(regexp_extract_all(html, '<a href="([^"]*)"', 1), 1) AS ord FROM pages)
"""


@_query("f4_find_all_by_tag_a", _LINKS)
def find_all_by_tag_a(spark, sf_dir):
    links = P.select_elements(pages(spark, sf_dir), KEY, Selector("A"), ["ord", "attributes"])
    return links.select("page_id", F.col("ord").cast("long").alias("ord"), H.attribute_value("attributes", "href").alias("href"))


@_query("f5_find_all_by_attr_class_ad", f"SELECT page_id, 'div' AS tag_name, {_decoded(_AD)} AS text FROM pages")
def find_all_by_attr(spark, sf_dir):
    return P.select_elements(pages(spark, sf_dir), KEY, Selector(attribute="class", value="ad"), ["tag_name", "text"])


@_query("f6_attribute_value", "SELECT page_id, regexp_extract(html, '<html lang=\"([^\"]*)\"', 1) AS lang FROM pages")
def attribute_value(spark, sf_dir):
    found = P.select_elements(pages(spark, sf_dir), KEY, Selector(attribute="lang"), ["attributes"])
    return found.select("page_id", H.attribute_value("attributes", "LANG").alias("lang"))


@_query("f7_visible_nodes", f"SELECT page_id, {_H1} AS text FROM pages")
def visible_nodes(spark, sf_dir):
    """The heading and the advertisement, which is hidden first: only the heading's text is left."""
    part = F.concat(F.lit('<div style="DISPLAY : none"><i>'), _slice('<div class="ad">.*?</div>'), F.lit("</i></div>"), _slice("<h1>.*?</h1>"))
    nodes = P.visible_nodes(pages(spark, sf_dir), KEY, part, context="body")
    return nodes.where("kind = 'text'").select("page_id", F.col("value").alias("text"))


# --- text -------------------------------------------------------------------------------------------------------------


@_query("v1_visible_text", f"SELECT page_id, {_TRIMMED} AS text FROM pages")
def visible_text(spark, sf_dir):
    return pages(spark, sf_dir).select("page_id", H.visible_text("html").alias("text"))


@_query("v1_visible_text_no_trim", f"SELECT page_id, {_VISIBLE} AS text FROM pages")
def visible_text_no_trim(spark, sf_dir):
    return pages(spark, sf_dir).select("page_id", H.visible_text("html", trim=False).alias("text"))


@_query("v1e_control_values", f"SELECT page_id, {_LANG} || {_LANG} || 'x' AS text FROM pages")
def control_values(spark, sf_dir):
    part = F.concat(F.lit('<img alt="'), _lang(), F.lit('"><input type=submit value="'), _lang(), F.lit('"><input value=no><button value=x>y</button><select><option>z</select>'))
    return pages(spark, sf_dir).select("page_id", H.visible_text(part).alias("text"))


@_query("v1g_noscript_markup", f"SELECT page_id, 'a' || chr(10) || {_LANG} AS text FROM pages")
def noscript_markup(spark, sf_dir):
    part = F.concat(F.lit("<body>a<noscript><p>"), _lang(), F.lit("</p></noscript>"))
    return pages(spark, sf_dir).select("page_id", H.visible_text(part).alias("text"))


@_query("v1f_accessible_names", f"""SELECT page_id, {_decoded(_cut('href="([^"]*)"'))} AS text FROM pages""")
def accessible_names(spark, sf_dir):
    part = F.concat(F.lit('<input aria-label="'), F.regexp_extract("html", 'href="([^"]*)"', 1), F.lit('">'))
    return pages(spark, sf_dir).select("page_id", H.visible_text(part, include_accessible_name_fallback=True).alias("text"))


_TEXT_TOKENS = f"""
SELECT page_id, CAST(pos - 1 AS INT) AS pos, CASE value WHEN chr(10) || chr(10) THEN 'paragraphBreak' WHEN chr(10) THEN 'lineBreak' WHEN chr(9) THEN 'tab' ELSE 'text' END AS kind, value
FROM (SELECT page_id, unnest(t) AS value, generate_subscripts(t, 1) AS pos FROM (SELECT page_id, regexp_extract_all({_TRIMMED}, '\\n\\n|\\n|\\t|[^\\n\\t]+') AS t FROM pages))
"""


@_query("v2_visible_text_tokens", _TEXT_TOKENS)
def visible_text_tokens(spark, sf_dir):
    return V.visible_text_tokens(visible_text(spark, sf_dir), KEY)


@_query("v3_visible_text_provenance")
def visible_text_provenance(spark, sf_dir):
    return V.visible_text_sourced(pages(spark, sf_dir), KEY)


@_query("v3_provenance_text", f"SELECT page_id, {_TRIMMED} AS text FROM pages")
def provenance_text(spark, sf_dir):
    """The tokens' values put together again."""
    found = pages(spark, sf_dir).select("page_id", H.visible_text_sourced("html").alias("t"))
    return found.select("page_id", F.array_join(F.transform("t", lambda x: x["value"]), "").alias("text"))


@_query("v3a_text_sources", f"SELECT page_id, unnest([0, 1, 2]) AS pos, unnest(['text', 'text', 'text']) AS kind, unnest(['a', {_LANG}, 'v']) AS value, CAST(unnest([3, 4, 5]) AS INT) AS source_node_id, unnest(['text', 'element', 'element']) AS source_node_kind, unnest(['text-node', 'img-alt', 'input-value']) AS source_role FROM pages")
def text_sources(spark, sf_dir):
    part = F.concat(F.lit('<body>a<img alt="'), _lang(), F.lit('"><input type=submit value=v>'))
    return V.visible_text_sourced(pages(spark, sf_dir), KEY, part)


_F1 = f"""
WITH t AS (SELECT page_id, {_H1} AS a, {_decoded(_AD)} AS b FROM pages),
w AS (SELECT page_id, 'a' AS side, unnest(string_split(regexp_replace(lower(a), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'), ' ')) AS word FROM t
      UNION ALL SELECT page_id, 'b', unnest(string_split(regexp_replace(lower(b), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'), ' ')) FROM t),
c AS (SELECT page_id, word, count(*) FILTER (side = 'a') AS a, count(*) FILTER (side = 'b') AS b FROM w WHERE word <> '' GROUP BY ALL),
s AS (SELECT page_id, sum(least(a, b)) AS both_n, sum(a) AS na, sum(b) AS nb FROM c GROUP BY page_id)
SELECT t.page_id, CASE WHEN na IS NULL THEN 1.0 WHEN na = 0 OR nb = 0 OR both_n = 0 THEN 0.0 ELSE 2 * (both_n / nb) * (both_n / na) / ((both_n / nb) + (both_n / na)) END AS f1
FROM t LEFT JOIN s ON t.page_id = s.page_id
"""


@_query("v4_token_f1", _F1)
def token_f1(spark, sf_dir):
    part = lambda p: H.decode_references(F.regexp_extract("html", f"(?s){p}", 1))
    texts = pages(spark, sf_dir).select("page_id", part("<h1>(.*?)</h1>").alias("a"), part('<div class="ad">(.*?)</div>').alias("b"))
    return V.token_f1(texts, KEY, "a", "b")


# --- summaries --------------------------------------------------------------------------------------------------------


@_query("a1_outline_headings", f"SELECT page_id, 3 AS depth, 'h1' AS tag_name, left({_H1}, 200) AS text FROM pages")
def outline_headings(spark, sf_dir):
    found = pages(spark, sf_dir).select("page_id", F.explode(H.outline("html")).alias("o")).select("page_id", "o.*")
    return found.where("tag_name = 'h1'").select("page_id", "depth", "tag_name", "text")


@_query("a1_outline_nodes", f"SELECT page_id, 3 AS depth, 'h1' AS tag_name, left({_H1}, 200) AS text FROM pages")
def outline_nodes(spark, sf_dir):
    """The same by selecting the headings."""
    found = P.select_elements(pages(spark, sf_dir), KEY, Selector("h1"), ["depth", "tag_name", "text"])
    return found.select("page_id", "depth", "tag_name", F.substring("text", 1, 200).alias("text"))


_CHUNKS = f"""
WITH i AS (SELECT page_id, regexp_extract_all({_NAV}, '<li>.*?</li>', 0, 's') AS t FROM pages),
r AS (SELECT page_id, unnest(t) AS item, generate_subscripts(t, 1) AS ord FROM i)
SELECT page_id, CAST((ord - 1) // 2 AS INT) AS index, string_agg(item, '' ORDER BY ord) AS content,
       CAST(sum(2 + CASE WHEN regexp_matches(item, '<a [^>]*>[^<]') THEN 1 ELSE 0 END) AS INT) AS nodes
FROM r GROUP BY page_id, (ord - 1) // 2
"""


@_query("a2_chunk_nav_items", _CHUNKS)
def chunk_nav_items(spark, sf_dir):
    """List items in chunks of six nodes at most: two items each."""
    part = F.array_join(F.regexp_extract_all(_slice("<nav>.*?</nav>"), F.lit("(?s)<li>.*?</li>"), F.lit(0)), "")
    found = pages(spark, sf_dir).select("page_id", F.explode(H.chunk(part, context="ul", max_nodes=6)).alias("c"))
    return found.select("page_id", "c.index", "c.content", "c.nodes")


@_query("a2_chunk")
def chunk(spark, sf_dir):
    return pages(spark, sf_dir).select("page_id", F.explode(H.chunk("html", max_chars=2000)).alias("c")).select("page_id", "c.*")


@_query("a3_counts")
def counts(spark, sf_dir):
    nodes = P.parse_nodes(pages(spark, sf_dir), KEY, columns=["kind"])
    return nodes.groupBy("kind").agg(F.count("*").alias("n"))


@_query("a3_counts_of_kinds", f"SELECT kind, CAST(sum(n) AS BIGINT) AS n FROM (SELECT 'doctype' AS kind, 1 AS n FROM pages UNION ALL SELECT 'comment', len(regexp_extract_all(html, '<!--')) FROM pages UNION ALL SELECT 'element', 1 + len([x FOR x IN regexp_extract_all({_BARE}, '<([a-z][a-z0-9]*)[ >]', 1) IF x <> 'b']) FROM pages) GROUP BY kind")
def counts_of_kinds(spark, sf_dir):
    """All but texts and b elements, whose number depends on error recovery."""
    nodes = P.parse_nodes(pages(spark, sf_dir), KEY, columns=["kind", "tag_name"])
    return nodes.where("kind <> 'text' AND NOT tag_name <=> 'b'").groupBy("kind").agg(F.count("*").alias("n"))


# --- patches ----------------------------------------------------------------------------------------------------------


def _patched(spark, sf_dir, *rules: Rule) -> DataFrame:
    """page_id, html, steps, result, error: targets are found and patches planned by one parse."""
    docs = pages(spark, sf_dir)
    return docs.select("*", H.patch_where("html", list(rules)).alias("_p")).select("page_id", "html", "_p.steps", "_p.result", "_p.error")


_NAVS, _ADS = Selector("nav"), Selector(attribute="class", value="ad")
_NEW_H1 = Rule(Selector("h1"), "replaceText", value="A <new> & short title", only_text=True)


_REPLACED = "regexp_replace(html, '<h1>.*?</h1>', '<h1>A &lt;new&gt; &amp; short title</h1>', 's')"


@_query("x1b_patch_replace_h1", f"SELECT page_id, {_REPLACED} AS result FROM pages")
def patch_replace_h1(spark, sf_dir):
    return _patched(spark, sf_dir, _NEW_H1).select("page_id", "result")


@_query("x1c_patch_set_attr_ad", "SELECT page_id, replace(replace(html, '<div class=\"ad\">', '<div class=\"x\">'), '<nav>', '<nav data-k=\"a&amp;b\">') AS result FROM pages")
def patch_set_attr_ad(spark, sf_dir):
    """One attribute is replaced, and one added elsewhere."""
    return _patched(spark, sf_dir, Rule(_ADS, "setAttr", name="class", value="x"), Rule(_NAVS, "setAttr", name="data-k", value="a&b")).select("page_id", "result")


@_query("x1d_patch_remove_attr_ad", "SELECT page_id, replace(html, '<div class=\"ad\">', '<div>') AS result FROM pages")
def patch_remove_attr_ad(spark, sf_dir):
    return _patched(spark, sf_dir, Rule(_ADS, "removeAttr", name="class")).select("page_id", "result")


@_query("x1a_patch_remove_node_nav", "SELECT page_id, regexp_replace(html, '<nav>.*?</nav>', '', 's') AS result FROM pages")
def patch_remove_node_nav(spark, sf_dir):
    return _patched(spark, sf_dir, Rule(_NAVS, "removeNode")).select("page_id", "result")


@_query("x1e_patch_insert_before_after", "SELECT page_id, replace(replace(html, '<nav>', '<hr><nav>'), '</nav>', '</nav><p>after</p>') AS result FROM pages")
def patch_insert(spark, sf_dir):
    return _patched(spark, sf_dir, Rule(_NAVS, "insertHtmlBefore", html="<hr>"), Rule(_NAVS, "insertHtmlAfter", html="<p>after</p>")).select("page_id", "result")


@_query("x2_apply_patch_plan", f"SELECT page_id, {_REPLACED} AS result FROM pages")
def apply_patch_plan(spark, sf_dir):
    """A plan is applied by Catalyst's own functions."""
    return _patched(spark, sf_dir, _NEW_H1).select("page_id", H.apply_patch_plan("html", "steps").alias("result"))


@_query("x3_patch_errors", "SELECT page_id, 'ATTRIBUTE_NOT_FOUND' AS code, 'id' AS detail FROM pages")
def patch_errors(spark, sf_dir):
    return _patched(spark, sf_dir, Rule(_ADS, "removeAttr", name="id")).select("page_id", "error.code", "error.detail")


@_query("x3_patch_touching_edits", "SELECT page_id, 'INVALID_PLAN' AS code, 'invalid patch insertion offset' AS detail FROM pages")
def patch_touching_edits(spark, sf_dir):
    """An insertion right behind a replacement has no slice to stand after."""
    both = Rule(_ADS, "setAttr", name="class", value="x"), Rule(_ADS, "setAttr", name="k", value="v")
    return _patched(spark, sf_dir, *both).select("page_id", "error.code", "error.detail")


_ERRORS = """
SELECT page_id, unnest(['NODE_NOT_FOUND', 'MISSING_NODE_SPAN', 'INVALID_EDIT_TARGET', 'INVALID_EDIT_TARGET', 'NON_INPUT_SPAN_PROVENANCE', 'OVERLAPPING_EDITS']) AS code,
  CAST(unnest([999, 999, 5, 4, 6, 4]) AS INT) AS target,
  unnest([NULL, NULL, 'expected text node target', 'expected element node target', 'inferred', NULL]) AS detail FROM pages
"""


@_query("x3_patch_error_codes", _ERRORS)
def patch_error_codes(spark, sf_dir):
    """Tables of edits that cannot be planned, with targets by id: 6 is the body, which has no tag of its own, 5 the paragraph
    and 4 its text."""
    part = F.concat(F.lit("<!doctype html><p>"), F.coalesce(F.nullif(_lang(), F.lit("")), F.lit("x")), F.lit("</p>"))
    docs = pages(spark, sf_dir).select("page_id", part.alias("html"))
    kinds = [("replaceText", 999), ("removeNode", 999), ("replaceText", 5), ("setAttr", 4), ("removeNode", 6)]
    edit = lambda kind, target: F.struct(F.lit(kind).alias("kind"), F.lit(target).alias("target"), F.lit("k").alias("name"), F.lit("v").alias("value"), F.lit("").alias("html"))
    sets = F.array(*[F.array(edit(k, t)) for k, t in kinds], F.array(edit("removeNode", 5), edit("replaceText", 4)))
    each = docs.select("page_id", "html", F.explode(sets).alias("edits"))
    return each.select("page_id", H.compute_patch("html", "edits")["error"].alias("e")).select("page_id", "e.code", "e.target", "e.detail")


# --- budgets and traces -----------------------------------------------------------------------------------------------


@_query("b1_budget_permissive", "SELECT page_id, 'maxInputBytes' AS budget, CAST(3000 AS BIGINT) AS \"limit\", length(html) AS actual FROM pages WHERE length(html) > 3000")
def budget_permissive(spark, sf_dir):
    return P.budget_errors(pages(spark, sf_dir), KEY, budgets=Budgets(maxInputBytes=3000))


@_query("b2_budget_nodes", f"SELECT page_id, 'maxNodes' AS budget, CAST(20 AS BIGINT) AS \"limit\", {_NAV_NODES} + 1 AS actual FROM pages WHERE {_NAV_NODES} + 1 > 20")
def budget_nodes(spark, sf_dir):
    """Nodes are counted with the root, after the size of the input and before the depth."""
    return P.budget_errors(pages(spark, sf_dir), KEY, _slice("<nav>.*?</nav>"), context="body", budgets=Budgets(maxInputBytes=10**9, maxNodes=20, maxDepth=9))


@_query("b3_stream_budget", "SELECT page_id, CASE WHEN strlen(html) > 2048 THEN 'maxBufferedBytes' END AS budget FROM pages")
def stream_budget(spark, sf_dir):
    chunks = split_bytes(page_bytes(spark, sf_dir), KEY, 1024)
    return C.assemble(chunks, KEY, budgets=Budgets(maxBufferedBytes=2048)).select("page_id", "budget_error.budget")


@_query("b4_trace_kinds")
def trace_kinds(spark, sf_dir):
    trace = P.parse_trace(pages(spark, sf_dir), KEY)
    return trace.groupBy("page_id", "kind").agg(F.count("*").alias("n"))


@_query("b4_stream_trace", "SELECT page_id, unnest(['decode', 'stream', 'budget', 'token', 'tree-mutation']) AS kind, CAST(unnest([2, 1, 4, 1, 1]) AS BIGINT) AS n FROM pages")
def stream_trace(spark, sf_dir):
    trace = C.parse_stream_trace(split_bytes(page_bytes(spark, sf_dir), KEY, 1500), KEY)
    return trace.where("kind NOT IN ('insertionModeTransition', 'parseError')").groupBy("page_id", "kind").agg(F.count("*").alias("n"))


@_query("b5_trace_bounded", "SELECT page_id, 'maxTraceEvents' AS budget, CAST(5 AS BIGINT) AS \"limit\", CAST(6 AS BIGINT) AS actual FROM pages")
def trace_bounded(spark, sf_dir):
    """Traces are cut short where they exceed their budget."""
    from ..core.budgets import BudgetExceededError
    from ..core.document import parse
    from ..operators.arrow import generate

    def over(html):
        try:
            parse(html, trace=True, budgets=Budgets(maxTraceEvents=5))
        except BudgetExceededError as e:
            return [(e.payload["budget"], e.payload["limit"], e.payload["actual"])]
        return ()

    return generate(pages(spark, sf_dir), [F.col("html")], KEY, "budget string, `limit` bigint, actual bigint", over)


# --- whole pages, beyond SQL --------------------------------------------------------------------------------------------


@_query("p5_tokenize_stream_pages")
def tokenize_stream_pages(spark, sf_dir):
    return C.tokenize_stream(split_bytes(page_bytes(spark, sf_dir), KEY, 4096), KEY)


@_query("p5c_xml_violations_pages")
def xml_violations_pages(spark, sf_dir):
    return P.tokenize_html(pages(spark, sf_dir), KEY, xml_violations=True)


@_query("p5d_tokenizer_limits_pages")
def tokenizer_limits_pages(spark, sf_dir):
    return P.tokenizer_errors(pages(spark, sf_dir), KEY, max_text=400, max_token=64, max_errors=20)


@_query("p7_character_references_pages")
def character_references_pages(spark, sf_dir):
    return pages(spark, sf_dir).select("page_id", H.decode_references("html").alias("text"), H.decode_references("html", in_attribute=True).alias("as_attribute"))


@_query("p11_soft_tree_limits_pages")
def soft_tree_limits_pages(spark, sf_dir):
    return P.soft_limit_errors(pages(spark, sf_dir), KEY, max_nodes=40, max_depth=5, max_attributes=1)


@_query("s3_serialize_tokens_pages")
def serialize_tokens_pages(spark, sf_dir):
    return pages(spark, sf_dir).select("page_id", H.reserialize_tokens("html", strip_whitespace=True, inject_meta_charset=True, encoding="utf-8").alias("html"))


@_query("a1_outline")
def outline(spark, sf_dir):
    return pages(spark, sf_dir).select("page_id", F.explode(H.outline("html")).alias("o")).select("page_id", "o.*")


@_query("f7_visible_nodes_pages")
def visible_nodes_pages(spark, sf_dir):
    return P.visible_nodes(pages(spark, sf_dir), KEY)


@_query("b4_stream_trace_pages")
def stream_trace_pages(spark, sf_dir):
    return C.parse_stream_trace(split_bytes(page_bytes(spark, sf_dir), KEY, 1500), KEY)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return visible_text(spark, sf_dir)
