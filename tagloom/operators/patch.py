"""Applying tables of edits to tables of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schemas
from ..functions import html as H


def edits_by_document(edits: DataFrame, keys: list[str]) -> DataFrame:
    """keys, edits: the edits of each document in the order of source_index.

    edits has keys, source_index, kind, target and, as the kind needs them, name, value, html.
    """
    have = set(edits.columns)
    fields = [F.col(c) if c in have else F.lit(None).cast("string").alias(c) for c in ("name", "value", "html")]
    row = F.struct("source_index", F.struct(F.col("kind"), F.col("target").cast("int").alias("target"), *fields).alias("edit"))
    gathered = edits.groupBy(*keys).agg(F.sort_array(F.collect_list(row)).alias("rows"))
    return gathered.select(*keys, F.transform("rows", lambda r: r["edit"]).cast(schemas.EDITS).alias("edits"))


def compute_patches(docs: DataFrame, edits: DataFrame, keys: list[str], html: str = "html", how: str = "left", mode: str = "PERMISSIVE") -> DataFrame:
    """docs with steps, result, error. Documents without edits keep their text; how="inner" leaves them out.

    What cannot be planned has an error (code, target, detail) and no result; mode="FAILFAST" raises instead.
    """
    both = docs.join(edits_by_document(edits, keys), keys, how)
    return both.withColumn("_patch", H.compute_patch(html, "edits", mode)).drop("edits").select(*docs.columns, "_patch.steps", "_patch.result", "_patch.error")
