"""Relational text operators: tokens of visible texts as rows, and similarity of texts by their words."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import html as H


def visible_text_tokens(texts: DataFrame, keys: list[str], visible="text") -> DataFrame:
    """keys, pos, kind, value: the runs and breaks of a visible text; JVM-side."""
    return texts.select(*keys, F.posexplode(H.visible_text_tokens(visible)).alias("pos", "token")).select(*keys, "pos", "token.kind", "token.value")


def visible_text_sourced(df: DataFrame, keys: list[str], html="html", **options) -> DataFrame:
    """keys, pos, kind, value, source_node_id, source_node_kind, source_role."""
    found = df.select(*keys, F.posexplode(H.visible_text_sourced(html, **options)).alias("pos", "t"))
    return found.select(*keys, "pos", "t.*")


def _words(text: str, first: bool):
    plain = F.regexp_replace(F.lower(F.coalesce(F.col(text), F.lit(""))), r"[^\p{L}\p{N}]+", " ")
    return F.transform(F.filter(F.split(plain, " "), lambda w: w != ""), lambda w: F.struct(F.lit(first).alias("first"), w.alias("word")))


def token_f1(df: DataFrame, keys: list[str], expected: str, actual: str) -> DataFrame:
    """keys, f1 of the multisets of words of two text columns: 1 if neither has any, 0 if one has none.

    Keys tell rows apart. One pass over the texts; words are counted on each task before they are shuffled.
    """
    each = df.select(*keys, F.explode_outer(F.concat(_words(expected, True), _words(actual, False))).alias("w"))
    counts = each.groupBy(*keys, F.col("w.word").alias("_word")).agg(F.count_if("w.first").alias("_a"), F.count_if(~F.col("w.first")).alias("_b"))
    sums = counts.groupBy(*keys).agg(F.sum(F.least("_a", "_b")).alias("_both"), F.sum("_a").alias("_na"), F.sum("_b").alias("_nb"))
    precision, recall = F.col("_both") / F.col("_nb"), F.col("_both") / F.col("_na")
    f1 = F.when(F.col("_na") + F.col("_nb") == 0, 1.0).when(F.col("_both") == 0, 0.0).otherwise(2 * precision * recall / (precision + recall))
    return sums.select(*keys, f1.alias("f1"))
