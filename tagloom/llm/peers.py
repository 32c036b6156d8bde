"""Comparing rows that share a key, without putting an unbounded group into one task.

A key with more than BLOCK rows is dealt into blocks by the hash of its rows, and every pair of blocks becomes a group of
its own; so a group never has more than about twice BLOCK rows, and each pair of rows meets in exactly one group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a key that are compared within one group.
BLOCK = 2048


def grouped(keyed: DataFrame, tie: str, block: int = BLOCK) -> DataFrame:
    """keyed has a column key (long). Adds p, q, own and deals rows so that those of a group (key, p, q) are adjacent.

    own is the row's block; p = q = own = 0 unless the key is split.
    """
    heavy = keyed.groupBy("key").agg(F.count("*").alias("rows")).where(F.col("rows") > block)
    blocks = F.coalesce(F.ceil(F.col("rows") / F.lit(block)), F.lit(1)).cast("int")
    dealt = keyed.join(heavy, "key", "left").withColumn("own", F.pmod(F.xxhash64(F.lit(7), F.col(tie)), blocks).cast("int"))
    pairs = F.transform(F.sequence(F.lit(0), blocks - 1), lambda b: F.struct(F.least(b, F.col("own")).alias("p"), F.greatest(b, F.col("own")).alias("q")))
    dealt = dealt.select(*keyed.columns, "own", F.explode(pairs).alias("pq")).select(*keyed.columns, "own", "pq.p", "pq.q")
    return dealt.repartition("key", "p", "q").sortWithinPartitions("key", "p", "q", tie)


def whole_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Runs of rows that hold whole groups, and where each group begins, with the number of rows at the end."""
    held: list[pa.RecordBatch] = []

    def edges(t) -> np.ndarray:
        change = np.zeros(t.num_rows, bool)
        change[:1] = True
        for name in ("key", "p", "q"):
            c = t.column(name).to_numpy()
            change[1:] |= c[1:] != c[:-1]
        return np.flatnonzero(change)

    for batch in batches:
        held.append(batch)
        table = pa.Table.from_batches(held)
        begins = edges(table)
        if len(begins) > 1:
            last = int(begins[-1])
            yield table.slice(0, last), begins
            held = table.slice(last).to_batches()
    if held and (table := pa.Table.from_batches(held)).num_rows:
        yield table, np.append(edges(table), table.num_rows)
