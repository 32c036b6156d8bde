"""The Spark operators against the core, whatever the partitioning."""

import pytest
from pyspark.sql import functions as F

from tagloom.core import structure
from tagloom.core.budgets import Budgets
from tagloom.core.document import parse
from tagloom.functions import html as H
from tagloom.functions.register import register
from tagloom.operators import nodes as N
from tagloom.operators import parse as P
from tagloom.operators import patch as X
from tagloom.operators import text as V
from tagloom.sources import files
from tagloom.streaming import chunks as C

DOCS = [
    (1, "<!doctype html><title>t</title><p class=a>x<b>y</b></p><div hidden>no<i>z</i></div>"),
    (2, "<ul><li>1<li>2<ul><li>3</ul></ul>é😀<!-- c -->"),
    (3, ""),
    (4, None),
    (5, "<table>a<tr><td>b<td>c</table>" * 3),
    (6, "<section><h1>A</h1><article><h2>B<i>C</i></h2></article></section>"),
    (6, "<p>same id</p>"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(DOCS, "doc long, html string")


def rows(df):
    return sorted(map(repr, df.collect()))


def test_node_table_matches_core_and_partitioning(spark, docs):
    found = P.parse_nodes(docs, ["doc"], spans=True)
    expected = sum(len(structure.rows(parse(h, spans=True))) for _, h in DOCS if h is not None)
    assert found.count() == expected
    assert rows(found) == rows(P.parse_nodes(docs.repartition(1), ["doc"], spans=True)) == rows(P.parse_nodes(docs.repartition(5), ["doc"], spans=True))
    third = found.where("doc = 1 AND tag_name = 'p'").first()
    assert (third.span.start, third.attributes[0].name, third.attributes[0].value) == (31, "class", "a")
    assert DOCS[0][1][third.attributes[0].span.start : third.attributes[0].span.end] == "class=a"


def test_empty_table(spark, docs):
    none = docs.where("false")
    for made in (P.parse_nodes(none, ["doc"]), P.parse_errors(none, ["doc"]), P.tokenize_html(none, ["doc"]), P.parse_trace(none, ["doc"]), P.document_metrics(none, ["doc"])):
        assert made.count() == 0


def test_lookups(docs):
    nodes = P.parse_nodes(docs.where("doc < 6"), ["doc"])
    assert [r.tag_name for r in N.walk_elements(nodes.where("doc = 1"), ["doc"]).collect()] == ["html", "head", "title", "body", "p", "b", "div", "i"]
    assert N.find_all_by_tag_name(nodes, "LI").count() == 3
    assert N.find_all_by_attr(nodes, "class", "a").count() == 1
    assert N.find_all_by_attr(nodes, "CLASS").count() == 0
    assert N.find_by_id(nodes, 1).count() == 0
    assert N.find_by_id(nodes.where("doc = 2"), 2).first().tag_name == "head"
    assert [r.v for r in nodes.where("tag_name = 'p'").select(H.attribute_value("attributes", "CLASS").alias("v")).collect()] == ["a"]
    seen = N.visible_nodes(nodes.where("doc = 1"), ["doc"])
    assert "no" not in [r.value for r in seen.collect()]
    assert {r.tag_name for r in seen.collect()} >= {"p", "b", "title"}
    sizes = {r.tag_name: r.subtree_nodes for r in N.subtree_size(nodes.where("doc = 1")).collect()}
    assert sizes["p"] == 4
    m = {r.doc: (r.node_count, r.max_depth) for r in N.metrics(nodes, ["doc"]).collect()}
    direct = {r.doc: (r.node_count, r.max_depth) for r in P.document_metrics(docs.where("doc < 6"), ["doc"]).collect()}
    assert m == direct


def test_text_and_outline_by_joins(docs):
    nodes = P.parse_nodes(docs.where("doc <> 6 OR html LIKE '<section%'"), ["doc"])
    texts = N.text_content(nodes, nodes, ["doc"])
    found = {(r.doc, r.node_id): r.text for r in texts.collect()}
    from tagloom.core.text import text_content

    for doc, html in DOCS[:6]:
        if html is None:
            continue
        for node, _ in structure.walk(parse(html).root.children):
            assert found[doc, node.id] == ("" if node.kind in ("comment", "doctype") else text_content(node))
    outlined = N.outline(nodes.where("doc = 6"), ["doc"]).orderBy("pre").collect()
    assert [(r.node_id, r.depth, r.tag_name, r.text) for r in outlined] == structure.outline(parse(DOCS[5][1]).root.children)


def test_texts_of_nested_elements(spark):
    rows = [(1, "<p>a<b>x</b>c<p>d"), (2, ""), (3, "<div>" * 100 + "t" + "</div>u" * 100), (None, "<div class=x>a<div>b</div>c</div>d")]
    nodes = P.parse_nodes(spark.createDataFrame(rows, "doc long, html string"), ["doc"])
    wanted = F.col("tag_name").isin("div", "p", "b", "body")
    found = N.text_content_where(nodes, wanted, ["doc"], ("node_id", "attributes")).collect()
    joined = N.text_content(nodes.where((F.col("kind") == "element") & wanted), nodes, ["doc"]).collect()
    assert len(found) == 4 + 1 + 101 + 3
    assert sorted(((r.doc or 0, r.pre, r.node_id, r.text) for r in found)) == sorted(((r.doc or 0, r.pre, r.node_id, r.text) for r in joined))
    assert N.text_content_where(nodes.where("false"), wanted, ["doc"]).count() == 0


def test_functions(spark, docs):
    one = docs.where("doc = 1")
    row = one.select(
        H.visible_text("html").alias("v"), H.text_content("html").alias("t"), H.serialize_html("html").alias("s"), H.rebuild("html").alias("r"), H.normalize_tree("html").alias("n"), H.utf16_length(F.lit("a😀")).alias("u")
    ).first()
    assert row.v == "xy"
    assert row.t == "txynoz"
    assert row.s == row.r
    assert row.n.startswith("| <!DOCTYPE html>")
    assert row.u == 3
    assert docs.where("doc = 4").select(H.visible_text("html").alias("v"), H.outline("html").alias("o")).first() == (None, None)
    pairs = spark.createDataFrame([(1, "a b b", "B, a"), (2, "", "-"), (3, "x", ""), (4, "x", "y")], "doc long, a string, b string")
    relational = {r.doc: r.f1 for r in V.token_f1(pairs, ["doc"], "a", "b").collect()}
    direct = {r.doc: r.f1 for r in pairs.select("doc", H.token_f1_score("a", "b").alias("f1")).collect()}
    assert relational == pytest.approx(direct)
    assert direct == pytest.approx({1: 0.8, 2: 1.0, 3: 0.0, 4: 0.0})
    ids = spark.createDataFrame([(" ",), ("a-b",), ("A b",)], "c string").select(H.parse_error_id("c").alias("i"))
    assert [r.i for r in ids.collect()] == ["vendor:unknown", "a-b", "vendor:A b"]
    tokens = V.visible_text_tokens(spark.createDataFrame([(1, "a\n\nb\tc\nd")], "doc long, text string"), ["doc"])
    assert [(r.pos, r.kind) for r in tokens.collect()] == [(0, "text"), (1, "paragraphBreak"), (2, "text"), (3, "tab"), (4, "text"), (5, "lineBreak"), (6, "text")]


def test_one_parse_for_one_use(docs):
    plan = docs.select("doc", H.visible_text("html").alias("v")).select("doc")._jdf.queryExecution().executedPlan().toString()
    assert "Arrow" not in plan


def test_budgets(docs):
    tight = Budgets(maxNodes=10)
    errors = {r.doc: (r.budget, r.limit) for r in P.budget_errors(docs, ["doc"], budgets=tight).collect()}
    assert errors == {d: ("maxNodes", 10) for d in (1, 2, 5, 6)}
    kept = {r.doc for r in P.parse_nodes(docs, ["doc"], budgets=tight).collect()}
    assert kept == {3, 6}
    with pytest.raises(Exception, match="Budget exceeded: maxNodes limit=10"):
        P.parse_nodes(docs, ["doc"], budgets=tight, mode="FAILFAST").count()


def test_bytes(spark):
    data = spark.createDataFrame([(1, bytearray(b"<meta charset=windows-1252><p>\xe9")), (2, bytearray(b"\xef\xbb\xbf<p>x"))], "doc long, bytes binary")
    texts = {r.doc: r.value for r in P.parse_nodes(data, ["doc"], "bytes").where("kind = 'text'").collect()}
    assert texts == {1: "é", 2: "x"}
    trace = P.parse_trace(data.where("doc = 1"), ["doc"], "bytes").orderBy(F.desc("seq")).first()
    assert (trace.kind, trace.encoding, trace.sniff_source) == ("decode", "windows-1252", "meta")
    assert [r.kind for r in P.tokenize_html(data.where("doc = 2"), ["doc"], "bytes").collect()] == ["startTag", "chars", "eof"]
    for size in (1, 7, 1000):
        parts = files.split_bytes(data, ["doc"], size)
        assert rows(C.parse_stream_nodes(parts, ["doc"])) == rows(P.parse_nodes(data, ["doc"], "bytes"))
    kinds = [r.kind for r in C.parse_stream_trace(files.split_bytes(data.where("doc = 1"), ["doc"], 7), ["doc"]).orderBy("seq").collect()]
    assert kinds[-3:] == ["decode", "stream", "budget"]


def test_patches(spark):
    docs = spark.createDataFrame([(1, "<p class=a>x</p>"), (2, "y"), (3, "<p>😀z</p>")], "doc long, html string")
    nodes = P.parse_nodes(docs, ["doc"])
    edits = N.find_all_by_tag_name(nodes, "p").select("doc", F.lit(0).alias("source_index"), F.lit("setAttr").alias("kind"), F.col("node_id").alias("target"), F.lit("class").alias("name"), F.lit("b").alias("value"))
    out = X.compute_patches(docs, edits, ["doc"])
    found = {r.doc: r.result for r in out.collect()}
    assert found == {1: '<p class="b">x</p>', 2: "y", 3: '<p class="b">😀z</p>'}
    assert {r.doc: r.again for r in out.select("doc", H.apply_patch_plan("html", "steps").alias("again")).collect()} == found
    bad = edits.withColumn("target", F.lit(77))
    assert {r.doc: r.error.code for r in X.compute_patches(docs, bad, ["doc"], how="inner").collect()} == {1: "NODE_NOT_FOUND", 3: "NODE_NOT_FOUND"}
    with pytest.raises(Exception, match="NODE_NOT_FOUND"):
        X.compute_patches(docs, bad, ["doc"], how="inner", mode="FAILFAST").collect()
    wrong = docs.where("doc = 2").withColumn("steps", F.expr("array(named_struct('kind', 'slice', 'start', 0, 'end', 9, 'at', cast(null as int), 'text', cast(null as string)))"))
    with pytest.raises(Exception, match="invalid patch plan"):
        wrong.select(H.apply_patch_plan("html", "steps")).collect()


def test_sql_surface(spark, docs):
    register(spark)
    docs.createOrReplaceTempView("docs")
    assert spark.sql("SELECT html_visible_text(html) v, html_parse_error_spec_ref('x') u FROM docs WHERE doc = 1").first().v == "xy"
    found = spark.sql("SELECT doc, n.tag_name FROM docs, LATERAL html_nodes(html) n WHERE n.tag_name = 'li'")
    assert found.count() == 3
    for name in ("html_tokens", "html_errors", "html_outline", "html_chunks", "html_text_tokens"):
        assert spark.sql(f"SELECT doc, n.* FROM docs, LATERAL {name}(html) n").count() > 0
    assert spark.sql("SELECT html_encoding(encode(html, 'UTF-8')) e FROM docs WHERE doc = 1").first().e == "windows-1252"


def test_files(spark, tmp_path):
    (tmp_path / "a.html").write_bytes(b"<meta charset=koi8-r><p>\xd6\n")
    (tmp_path / "b.html").write_bytes(b"<p>b")
    assert files.read_html(spark, str(tmp_path)).count() == 2
    texts = P.parse_nodes(files.read_html_bytes(spark, str(tmp_path), "*.html"), ["path"], "bytes").where("kind = 'text'")
    assert {r.value for r in texts.collect()} == {"ж\n", "b"}
    out = str(tmp_path / "out")
    files.write_html(spark.createDataFrame([(1, "<p>")], "doc long, html string"), out, keys=["doc"])
    assert spark.read.parquet(out).first() == (1, "<p>")
    files.write_json_report(spark.createDataFrame([(1,)], "n long"), out)
    assert spark.read.json(out).first().n == 1


def test_structured_streaming(spark, tmp_path):
    data = spark.createDataFrame([(1, bytearray(b"<meta charset=windows-1252>\xe9" * 3)), (2, bytearray("é".encode())), (3, bytearray(b"a" * 50))], "doc long, bytes binary")
    parts = files.split_bytes(data, ["doc"], 20)
    source = tmp_path / "chunks"
    # the second file holds what comes first: chunks may be out of order
    parts.where("seq % 2 = 1").coalesce(1).write.parquet(str(source / "1"))
    parts.where("seq % 2 = 0").coalesce(1).write.parquet(str(source / "2"))
    stream = spark.readStream.schema(parts.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(source))
    whole = C.assemble_stream(stream, ["doc"], budgets=Budgets(maxInputBytes=100))
    query = whole.writeStream.format("memory").queryName("assembled").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    query.processAllAvailable()
    query.stop()
    streamed = {r.doc: (r.text, r.encoding, r.bytes_read) for r in spark.table("assembled").collect()}
    batch = {r.doc: (r.text, r.encoding, r.bytes_read) for r in C.assemble(parts, ["doc"]).collect()}
    assert streamed == batch
    over = C.assemble_stream(stream, ["doc"], budgets=Budgets(maxInputBytes=30))
    query = over.writeStream.format("memory").queryName("over").outputMode("append").option("checkpointLocation", str(tmp_path / "cp2")).start()
    query.processAllAvailable()
    query.stop()
    assert {r.doc: r.budget_error and r.budget_error.budget for r in spark.table("over").collect()} == {1: "maxInputBytes", 2: None, 3: "maxInputBytes"}


def test_chunks_repeated_and_missing(spark):
    rows = [(1, 0, b"<p>a", False), (1, 1, b"bc", True), (1, 0, b"<p>a", False), (2, 0, b"x", False), (2, 2, b"z", True), (3, 0, b"y", False), (4, 0, b"", True)]
    chunks = spark.createDataFrame(rows, "doc long, seq int, bytes binary, is_last boolean").repartition(3)
    assert {r.doc: (r.text, r.bytes_read) for r in C.assemble(chunks, ["doc"]).collect()} == {1: ("<p>abc", 6), 4: ("", 0)}
    assert {r.doc: r.text for r in C.assemble(chunks, ["doc"], incomplete=True).collect()} == {1: "<p>abc", 2: "xz", 3: "y", 4: ""}


def test_time_budget_of_chunks(monkeypatch):
    from tagloom.core import encoding
    from tagloom.core.budgets import BudgetExceededError

    clock = iter(range(100))
    monkeypatch.setattr(encoding.time, "monotonic", lambda: next(clock))
    with pytest.raises(BudgetExceededError) as caught:
        encoding.decode_chunks([b"a"] * 9, None, Budgets(maxTimeMs=2500))
    assert caught.value.payload == {"code": "BUDGET_EXCEEDED", "budget": "maxTimeMs", "limit": 2500, "actual": 3000}


def test_selected_elements_and_patches(spark):
    from tagloom.core.patch import Rule
    from tagloom.core.structure import Selector
    from tagloom.functions import html as H

    docs = spark.createDataFrame([(1, "<ul><li class=a>x<b>y</b><li>z</ul>"), (2, None), (3, "<p hidden>h<p>v")], "doc long, html string").repartition(2)
    found = P.select_elements(docs, ["doc"], Selector("li"), ["ord", "depth", "tag_name", "subtree_nodes", "text", "attributes"]).orderBy("ord").collect()
    assert [(r.doc, r.ord, r.depth, r.tag_name, r.subtree_nodes, r.text, [(a.name, a.value) for a in r.attributes]) for r in found] == [(1, 1, 3, "li", 4, "xy", [("class", "a")]), (1, 2, 3, "li", 2, "z", [])]
    assert {(r.doc, r.tag_name): r.n for r in P.tag_counts(docs, ["doc"]).collect()}[1, "li"] == 2
    assert [r.value for r in P.visible_nodes(docs, ["doc"]).where("doc = 3 AND kind = 'text'").collect()] == ["v"]
    made = {r.doc: r.p for r in docs.select("doc", H.patch_where("html", [Rule(Selector("li"), "setAttr", name="k", value="v")]).alias("p")).collect()}
    assert made[1].result == '<ul><li class=a k="v">x<b>y</b><li k="v">z</ul>'
    assert made[2] is None
    assert made[3].result == "<p hidden>h<p>v"


def test_column_functions_hold_few_rows_at_a_time(spark):
    import tracemalloc

    import pyarrow as pa

    from tagloom.core import serialize
    from tagloom.operators.arrow import scalar

    rows = [[serialize.token("StartTag", "p", {"k": str(i)}), *[serialize.token("Characters", data=f"{i}")] * 40] if i % 7 else None for i in range(2000)]
    batch = pa.array(rows)
    expected = [None if r is None else serialize.serialize_tokens(r) for r in rows]
    function = scalar("string", lambda ts: serialize.serialize_tokens(ts))[0].func
    tracemalloc.start()
    found = function(batch)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found.to_pylist() == expected
    assert peak < 8_000_000  # all rows at once take over 40 MB
    assert function(batch.slice(0, 0)).to_pylist() == []
    nested = scalar("array<struct<a:int,b:string>>", lambda x: [(x, str(x))] * (x % 3))[0].func
    assert nested(pa.array([*range(200), None])).to_pylist() == [*([{"a": x, "b": str(x)}] * (x % 3) for x in range(200)), None]
