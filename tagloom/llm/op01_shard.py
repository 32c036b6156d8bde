"""Sharding: minimax contiguous partition of ordered atomic groups.

Rows with equal texts form one atomic group (null counts as the empty text). Groups stand in the order of the 64-bit
hash of their text, so "contiguous" means a range of hashes and the finished plan assigns a shard to a row without a
join. The smallest feasible capacity is found by binary search, each candidate checked by the greedy walk; the sums the
walk needs are held for ranges of hashes, and only ranges in which a cut may fall are split further. Driver and tasks
therefore hold a bounded number of sums however many groups there are, and the capacity and cuts found are exact.

Defined cases: an empty table gives no rows; a null text has size 1 and the checksum of the empty text; repeated rows
and rows with null ids each get their own slot; columns other than doc_id and text are ignored. Two texts whose 64-bit
hashes collide merely travel together.
"""

from __future__ import annotations

from bisect import bisect_right

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import cut, text_or_empty

#: Ranges of hashes held at once: 2^12 to begin with; those that a cut may hit are split into 2^9 each time.
FIRST_BITS, NEXT_BITS = 12, 9
#: Rows that a bucket of slots is meant to hold.
SLOT_ROWS = 100_000


class _Sums:
    """Prefix sums over ascending ranges; a range that holds one group is an atom and cannot be cut inside."""

    def __init__(self, ranges: list[tuple[int, int, int, int, bool]]):
        self.ranges = sorted(ranges)  # (lowest key, bits below the prefix, prefix, size, atom)
        self.before = [0]
        for r in self.ranges:
            self.before.append(self.before[-1] + r[3])
        self.total = self.before[-1]

    def reach(self, target: int) -> tuple[int, int, int]:
        """Bounds of the last group boundary at or below target, and the range in which it lies."""
        if target >= self.total:
            return self.total, self.total, len(self.ranges)
        i = bisect_right(self.before, target) - 1
        return self.before[i], self.before[i] if self.ranges[i][4] else target, i

    def walk(self, capacity: int, shards: int) -> tuple[int, int, list[tuple[int, int]]]:
        """Greedy cuts under a capacity: sure and possible sums covered, and the ranges the cuts may lie in."""
        low = high = 0
        at = []
        for _ in range(shards):
            low, _, i = self.reach(low + capacity)
            _, high, j = self.reach(high + capacity)
            at.append((i, j))
        return low, high, at

    def bounds(self, shards: int) -> tuple[int, int]:
        """The largest capacity that surely fails, and the smallest that surely holds."""

        def least(ok) -> int:
            lo, hi = 0, self.total
            while lo < hi:
                mid = (lo + hi) // 2
                lo, hi = (lo, mid) if ok(mid) else (mid + 1, hi)
            return lo

        return least(lambda c: self.walk(c, shards)[1] >= self.total) - 1, least(lambda c: self.walk(c, shards)[0] >= self.total)


def minimax_cuts(groups: DataFrame, shards: int) -> tuple[int, list[int]]:
    """The smallest capacity under which contiguous shards hold all groups, and the first key of shards 1, 2, ...

    groups has one row per key: key long, size long.
    """

    def ranges(df: DataFrame, shift: int) -> list:
        prefix = F.shiftright("key", shift)
        rows = df.groupBy(prefix.alias("p")).agg(F.min("key").alias("lo"), F.max("key").alias("hi"), F.sum("size").alias("size")).collect()
        return [(r.lo, shift, r.p, r.size, r.lo == r.hi) for r in rows]

    shift = 64 - FIRST_BITS
    sums = _Sums(ranges(groups, shift))
    while True:
        fails, holds = sums.bounds(shards)
        open_ranges = set()
        spans = list(zip(sums.walk(max(fails, 0), shards)[2], sums.walk(holds, shards)[2], strict=True))
        for (a, b), (c, d) in spans:
            for i in range(min(a, c), min(max(b, d) + 1, len(sums.ranges))):
                if not sums.ranges[i][4]:
                    open_ranges.add(i)
        if not open_ranges:
            break
        split = [sums.ranges[i] for i in open_ranges]
        widest = max(r[1] for r in split)
        split = [r for r in split if r[1] == widest]
        shift = max(0, widest - NEXT_BITS)
        inside = groups.where(F.shiftright("key", widest).isin([r[2] for r in split]))
        gone = {(r[1], r[2]) for r in split}
        sums = _Sums([r for r in sums.ranges if (r[1], r[2]) not in gone] + ranges(inside, shift))
    cuts, at = [], 0
    for _ in range(shards - 1):
        at, _, i = sums.reach(at + holds)
        if i >= len(sums.ranges):
            break
        cuts.append(sums.ranges[i][0])
    return holds, cuts


def shard(docs: DataFrame, shards: int = 16) -> DataFrame:
    """Rows (doc_id, size, text_crc32, shard, slot): shard sizes are minimax over groups of equal texts.

    slot is gapless from 0 in each shard, in an order shuffled by hash, so that no shard is sorted in a single task.
    """
    text = text_or_empty()
    rows = cut(
        docs.select(
            "doc_id",
            (F.octet_length(text).cast("long") + 1).alias("size"),
            F.crc32(text).alias("text_crc32"),
            F.xxhash64(text).alias("key"),
        )
    )
    groups = cut(rows.groupBy("key").agg(F.sum("size").alias("size"), F.count("*").alias("n")))
    n = groups.agg(F.sum("n")).first()[0] or 0
    _, cuts = minimax_cuts(groups, shards)
    number = F.lit(0)
    for c in cuts:
        number = number + (F.col("key") >= F.lit(c)).cast("int")
    buckets = max(4, -(-n // (shards * SLOT_ROWS)))
    placed = rows.select("*", number.alias("shard"), F.pmod(F.xxhash64("doc_id", "key"), F.lit(buckets)).alias("bucket"))
    counts = placed.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
    before = counts.select("shard", "bucket", (F.sum("n").over(W.partitionBy("shard").orderBy("bucket")) - F.col("n")).alias("before"))
    ranked = placed.withColumn("rank", F.row_number().over(W.partitionBy("shard", "bucket").orderBy("doc_id", "key")))
    return ranked.join(before, ["shard", "bucket"]).select(
        "doc_id", "size", "text_crc32", "shard", (F.col("before") + F.col("rank") - 1).cast("long").alias("slot")
    )


def query(spark, sf_dir: str) -> DataFrame:
    """All documents over 16 shards under the law `bytes`."""
    out = shard(spark.read.parquet(f"{sf_dir}/documents.parquet"), 16)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
