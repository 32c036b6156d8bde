"""Corpus preparation in stages, each written as Parquet and read again by the next.

Documents that the quality classifier rejects go; of each group of near duplicates one document stays; benchmark
passages are cut out (documents that are mostly benchmark go); personal data is replaced by marks; what is left is encoded.
Every stage works on all that its predecessor kept and returns the columns of documents, but for the last, which returns
the token ids.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagloom.llm import op05_pii, op06_simhash, op07_decontaminate, op09_quality, op10_pieces
from tagloom.llm.shared import shared_dir, table


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, taught by labels on the documents at hand, scores as good."""
    return op09_quality.keep_good(docs, op09_quality.train(docs, table(spark, sf_dir, "labels")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return op06_simhash.drop_near_duplicates(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return op07_decontaminate.remove_contamination(docs, table(spark, sf_dir, "benchmark"))


def sanitise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return op05_pii.sanitise(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang and source with n_tokens, ids, and checksums of the ids and of the text that they decode to."""
    import public_tokenizers

    docs = docs.withColumn("doc_id", F.col("doc_id").cast("long"))
    return op10_pieces.round_trip(docs, public_tokenizers.path("piece_bpe_32k.model"), ("doc_id", "lang", "source"), with_ids=True)


STAGES = [
    ("quality", keep_quality),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", decontaminate),
    ("pii", sanitise),
    ("pieces", encode),
]

#: Trees, components and tokenizers are beyond SQL; the tests compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in turn over documents; what a stage wrote goes once the next has written, the last one's with the session."""
    where = f"{shared_dir(spark).rstrip('/')}/tagloom-pipeline-{uuid.uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path
    files = path(where).getFileSystem(spark._jsc.hadoopConfiguration())
    files.deleteOnExit(path(where))
    docs, before = table(spark, sf_dir, "documents"), None
    for number, (name, stage) in enumerate(STAGES):
        out = f"{where}/{number}_{name}"
        stage(spark, docs, sf_dir).write.parquet(out)
        docs = spark.read.parquet(out)
        if before:
            files.delete(path(before), True)
        before = out
    return docs
