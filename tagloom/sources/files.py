"""Reading documents and writing results."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_html(spark: SparkSession, path: str) -> DataFrame:
    """path, html: files as UTF-8 text, one row a file."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("html"))


def read_html_bytes(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """path, bytes: files as they are, for sniffing and decoding."""
    reader = spark.read.format("binaryFile")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.load(path).select("path", F.col("content").alias("bytes"))


def split_bytes(df: DataFrame, keys: list[str], size: int, data="bytes") -> DataFrame:
    """keys, seq, bytes, is_last: the chunks of a binary column as a stream would bring them."""
    data = F.col(data) if isinstance(data, str) else data
    last = F.greatest(F.ceil(F.octet_length(data) / F.lit(size)).cast("int") - 1, F.lit(0))
    parts = df.select(*keys, data.alias("_data"), last.alias("_last"), F.explode(F.sequence(F.lit(0), last)).alias("seq"))
    return parts.select(*keys, "seq", F.substring("_data", F.col("seq") * size + 1, F.lit(size)).alias("bytes"), (F.col("seq") == F.col("_last")).alias("is_last"))


def scratch_dir(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir, gone with the session; where that is unset, on this machine, which only a
    driver that is its own executor may use."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not base:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("on a cluster, spark.checkpoint.dir must name a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="tagloom-")
    where = f"{base.rstrip('/')}/tagloom-{uuid.uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path(where)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
    return where


def write_html(df: DataFrame, path: str, column: str = "html", keys: list[str] | None = None) -> None:
    """Serialized documents with their keys as Parquet: one file a document would not survive large corpora."""
    df.select(*(keys or []), column).write.mode("overwrite").parquet(path)


def write_json_report(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)
