"""Every HTML query runs, and gives the rows of its SQL where it has one."""

from pathlib import Path

import pytest

from tagloom.plans.html_queries import ORACLE_SQL, QUERIES

from .compare import canonical, sql_rows

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).is_dir(), reason="no test data here")


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    found = canonical(QUERIES[name](spark, SF).toPandas())
    assert found[1]
    if name in ORACLE_SQL:
        assert found == sql_rows(SF, ORACLE_SQL[name])


def test_rcdata_of_all_pages(spark, tmp_path):
    from html import unescape

    texts = ["<p>a &amp; b</p>", "&ampx &amp", "x &am", "&a", "&", "no reference", "&copy; &amp;lt; &middot", "</p>&quot;</none"]
    spark.createDataFrame(list(enumerate(texts)), "page_id long, html string").write.parquet(str(tmp_path / "pages.parquet"))
    for sf_dir in (str(tmp_path), SF):
        html = {r.page_id: r.html for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
        found = QUERIES["p5b_tokenize_rcdata_pages"](spark, sf_dir).collect()
        assert sorted(r.page_id for r in found if r.kind == "eof") == sorted(html)
        for page_id, text in html.items():
            assert "".join(r.value for r in found if r.page_id == page_id and r.kind == "chars") == unescape(text)


def test_entry_names():
    import __spark_entry__ as entry

    assert set(QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_token_serializer_of_odd_pages(spark, tmp_path):
    """Pages without the part, without text and with an id that another has: one row each, as in the SQL."""
    nav = '<nav><ul><li><a href="/%s">a</a></li><li><a href="/b"></a></li></ul></nav>'
    texts = [(1, "<p>none</p>"), (2, ""), (3, None), (4, nav % "x"), (5, nav % "y"), (5, "<b>" + nav % "z" * 2)]
    spark.createDataFrame(texts, "page_id long, html string").write.parquet(str(tmp_path / "pages.parquet"))
    connection_path = f"{tmp_path}/pages.parquet/*.parquet"
    sql = ORACLE_SQL["s3_serialize_tokens_nav"].replace("FROM pages", f"FROM read_parquet('{connection_path}')")
    found = QUERIES["s3_serialize_tokens_nav"](spark, str(tmp_path))
    assert canonical(found.toPandas()) == sql_rows(str(tmp_path / "none"), sql)
    whole = QUERIES["s3_serialize_tokens_pages"](spark, str(tmp_path))
    assert sorted((r.page_id, r.html is None) for r in whole.collect()) == sorted((i, t is None) for i, t in texts)
    for name in ("s3_serialize_tokens_nav", "s3_serialize_tokens_pages", "s3d_inject_meta_charset", "s3e_serialize_tokens_whitespace"):
        plan = QUERIES[name](spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
        assert "collect_list" not in plan  # a document's tokens never cross to the JVM and back


def test_rcdata_leaves_no_page_out(spark, tmp_path):
    """No filter in the query nor in its SQL, which agree on pages whose references have semicolons."""
    from html import unescape

    whole = ["<p>a &amp; b</p>", "&amp;amp; &lt;", "x & y", "&", "&quot;q&quot; &copy;&middot;", "plain"]
    cut = ["<h1>a&amp</h1>", "<h1>a&quot</h1>", "<h1>a&am</h1>", "x &am", "&a"]
    for name, texts in (("whole", whole), ("cut", cut)):
        sf_dir = tmp_path / name
        spark.createDataFrame(list(enumerate(texts)), "page_id long, html string").coalesce(1).write.parquet(str(sf_dir / "parts"))
        next((sf_dir / "parts").glob("*.parquet")).rename(sf_dir / "pages.parquet")
        found = QUERIES["p5b_tokenize_rcdata"](spark, str(sf_dir))
        assert {r.page_id: r.value for r in found.collect() if r.kind == "chars"} == {i: unescape(t) for i, t in enumerate(texts)}
        assert found.where("kind = 'eof'").count() == len(texts)
        if name == "whole":
            assert canonical(found.toPandas()) == sql_rows(str(sf_dir), ORACLE_SQL["p5b_tokenize_rcdata"])
    assert "WHERE" not in ORACLE_SQL["p5b_tokenize_rcdata"]


CUT = (
    "a1_outline_headings", "a1_outline_nodes", "f7_visible_nodes", "p3_parse_bytes_h1", "p4_parse_stream_h1", "p5b_tokenize_rcdata", "s4_text_content_h1",
    "sc2_parse_bytes_title", "v1_visible_text", "v1_visible_text_no_trim", "v2_visible_text_tokens", "v3_provenance_text",
)


def test_references_without_semicolon(spark, tmp_path):
    """Titles cut within a reference: the SQL, if references are decoded as the HTML Standard has it (by html.unescape)."""
    import re
    from html import unescape

    import duckdb

    from tagloom.plans import html_queries as Q

    ends = ["&amp;&amp", "&quot;x &quot", "&am", "&", "&copy", "&amp;lt"]
    pages = duckdb.execute(f"SELECT page_id, html FROM read_parquet('{SF}/pages.parquet') ORDER BY page_id LIMIT 12").fetchall()
    pages = [(i, re.sub("</(title|h1)>", lambda m: ends[n % len(ends)] + m.group(), h)) for n, (i, h) in enumerate(pages)]  # noqa: B023
    spark.createDataFrame(pages, "page_id long, html string").coalesce(1).write.parquet(str(tmp_path / "pages.parquet"))
    connection = duckdb.connect()
    connection.create_function("unescape", lambda text: unescape(text), ["VARCHAR"], "VARCHAR")
    connection.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{tmp_path}/pages.parquet/*.parquet')")
    title = Q._cut("<title>(.*?)</title>")
    for name in CUT:
        sql = ORACLE_SQL[name]
        for part in (Q._BROKEN, Q._cut("<h1>(.*?)</h1>"), title, "html"):
            sql = sql.replace(Q._decoded(part), f"unescape({part})")
        assert "unescape" in sql
        assert "&amp;" not in sql
        assert canonical(QUERIES[name](spark, str(tmp_path)).toPandas()) == canonical(connection.execute(sql).df()), name
    # serialized again, a quotation mark of the text stays one, and an ampersand is written as a reference
    sql = f"SELECT page_id, '<meta charset=koi8-r><title>' || replace(replace(replace(unescape({title}), '&', '&amp;'), '<', '&lt;'), '>', '&gt;') || '</title>' AS html FROM pages"
    assert canonical(QUERIES["s3d_inject_meta_charset"](spark, str(tmp_path)).toPandas()) == canonical(connection.execute(sql).df())
