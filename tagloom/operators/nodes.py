"""Queries on node tables: traversal, lookup, text, outlines, metrics. All are Catalyst plans.

keys are the columns that tell documents apart. Joins of nodes with nodes always have the keys as equality, so they are
hash or merge joins with the interval test on top, never nested loops; bucketing or partitioning a stored node table by
its keys makes them shuffle-free.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import html as H


def walk(nodes: DataFrame, keys: list[str]) -> DataFrame:
    """All nodes in document order."""
    return nodes.orderBy(*keys, "pre")


def elements(nodes: DataFrame) -> DataFrame:
    return nodes.where(F.col("kind") == "element")


def walk_elements(nodes: DataFrame, keys: list[str]) -> DataFrame:
    """All elements in document order."""
    return walk(elements(nodes), keys)


def find_by_id(nodes: DataFrame, node_id: int) -> DataFrame:
    """The node of that id in each document; the root, id 1, is not in the table and is not found."""
    return nodes.where(F.col("node_id") == node_id)


def find_all_by_tag_name(nodes: DataFrame, tag: str) -> DataFrame:
    """Elements of that name in any case."""
    return elements(nodes).where(F.lower("tag_name") == tag.lower())


def has_attr(name: str, value: str | None = None) -> Column:
    """Whether a node has an attribute of exactly that name and, if given, that value."""
    same = lambda a: (a["name"] == name) if value is None else (a["name"] == name) & (a["value"] == value)
    return F.exists("attributes", same)


def find_all_by_attr(nodes: DataFrame, name: str, value: str | None = None) -> DataFrame:
    """Elements with an attribute of exactly that name and, if given, that value."""
    return elements(nodes).where(has_attr(name, value))


def with_order(nodes: DataFrame, keys: list[str], name: str = "ord") -> DataFrame:
    """Numbers rows of each document from 1 in document order."""
    from pyspark.sql import Window as W

    return nodes.withColumn(name, F.row_number().over(W.partitionBy(*keys).orderBy("pre")))


def _same(keys: list[str], left: str, right: str) -> Column:
    out = F.lit(True)
    for k in keys:
        out = out & F.col(f"{left}.{k}").eqNullSafe(F.col(f"{right}.{k}"))
    return out


def below(ancestors: DataFrame, nodes: DataFrame, keys: list[str]) -> DataFrame:
    """Pairs (a, d) of an ancestor and a node below it, as two structs."""
    a, d = ancestors.alias("a"), nodes.alias("d")
    inside = (F.col("d.pre") > F.col("a.pre")) & (F.col("d.pre") <= F.col("a.pre_end"))
    both = a.join(d, _same(keys, "a", "d") & inside)
    return both.select(F.struct(*[F.col(f"a.{c}") for c in ancestors.columns]).alias("a"), F.struct(*[F.col(f"d.{c}") for c in nodes.columns]).alias("d"))


def visible_nodes(nodes: DataFrame, keys: list[str]) -> DataFrame:
    """Nodes outside subtrees that attributes hide."""
    hidden = elements(nodes).where(H.is_hidden("attributes")).select(*keys, "pre", "pre_end").alias("a")
    inside = (F.col("d.pre") >= F.col("a.pre")) & (F.col("d.pre") <= F.col("a.pre_end"))
    return nodes.alias("d").join(hidden, _same(keys, "a", "d") & inside, "left_anti")


def text_content(targets: DataFrame, nodes: DataFrame, keys: list[str]) -> DataFrame:
    """targets with a column text: all text below each, in order; a text node's own value, nothing for comments."""
    pieces = nodes.where(F.col("kind") == "text").select(*keys, "pre", "value")
    pairs = below(targets.where(F.col("kind") == "element").select(*keys, "pre", "pre_end"), pieces, keys)
    joined = pairs.groupBy(*[F.col(f"a.{k}").alias(k) for k in keys], F.col("a.pre").alias("pre")).agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("d.pre", "d.value"))), lambda x: x["value"]), "").alias("text")
    )
    own = F.when(F.col("t.kind") == "text", F.col("t.value")).otherwise(F.coalesce("j.text", F.lit("")))
    both = targets.alias("t").join(joined.alias("j"), _same(keys, "t", "j") & (F.col("t.pre") == F.col("j.pre")), "left")
    return both.select("t.*", own.alias("text"))


def text_content_where(nodes: DataFrame, wanted: Column, keys: list[str], fields: tuple[str, ...] = ()) -> DataFrame:
    """keys, pre, fields, text of the elements for which ``wanted`` holds, in one pass over the nodes.

    Where the node table comes straight from a parser, a join of it with itself would parse twice. Here the texts and the
    wanted elements of a document meet in one row, which is never larger than the document.
    """
    is_text, is_wanted = F.col("kind") == "text", (F.col("kind") == "element") & F.coalesce(wanted, F.lit(False))
    row = F.struct("pre", F.when(is_text, F.col("value")).alias("value"), F.when(is_wanted, F.struct("pre_end", *fields)).alias("target"))
    by_pre = lambda a, b: F.when(a["pre"] < b["pre"], -1).otherwise((a["pre"] > b["pre"]).cast("int"))
    one = nodes.where(is_text | is_wanted).groupBy(*keys).agg(F.collect_list(row).alias("_rows")).withColumn("_rows", F.array_sort("_rows", by_pre))

    def target(x: Column, i: Column) -> Column:
        """The element and its text: a subtree's rows follow it and are no more than its nodes, so no target looks at all texts."""
        end = x["target"]["pre_end"]
        under = F.filter(F.slice("_rows", i + 2, (end - x["pre"]).cast("int")), lambda y: y["pre"] <= end)
        text = F.array_join(F.transform(under, lambda y: y["value"]), "")
        return F.when(x["target"].isNotNull(), F.struct(x["pre"].alias("pre"), x["target"].alias("target"), text.alias("text")))

    found = one.select(*keys, F.explode(F.filter(F.transform("_rows", target), lambda x: x.isNotNull())).alias("_found"))
    return found.select(*keys, "_found.pre", *[F.col(f"_found.target.{c}").alias(c) for c in fields], "_found.text")


def outline(nodes: DataFrame, keys: list[str]) -> DataFrame:
    """keys, pre, node_id, depth, tag_name, text of headings, sections and articles; text has 200 UTF-16 units at most."""
    wanted = F.lower("tag_name").rlike(r"\A(?:h[1-6]|section|article)\z")
    raw = F.encode(F.substring("text", 1, 200), "UTF-16BE")
    cut = F.when(F.octet_length(raw) <= 400, F.substring("text", 1, 200)).otherwise(F.decode(F.substring(raw, 1, 400), "UTF-16BE"))
    found = text_content_where(nodes, wanted, keys, ("node_id", "depth", "tag_name"))
    return found.select(*keys, "pre", "node_id", "depth", "tag_name", cut.alias("text"))


def metrics(nodes: DataFrame, keys: list[str]) -> DataFrame:
    """keys, node_count (the root counts), max_depth (the root is 1) of documents that have nodes."""
    return nodes.groupBy(*keys).agg((F.count("*") + 1).alias("node_count"), (F.max("depth") + 2).alias("max_depth"))


def subtree_size(nodes: DataFrame) -> DataFrame:
    """nodes with subtree_nodes: how many nodes each subtree has, itself included."""
    return nodes.withColumn("subtree_nodes", F.col("pre_end") - F.col("pre") + 1)


def tag_counts(nodes: DataFrame, keys: list[str]) -> DataFrame:
    return elements(nodes).groupBy(*keys, "tag_name").agg(F.count("*").alias("n"))
