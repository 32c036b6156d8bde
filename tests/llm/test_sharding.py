import random
import zlib

from pyspark.sql import functions as F

from tagloom.llm.op01_shard import _Sums, minimax_cuts, shard


def brute_capacity(sizes, shards):
    def fits(capacity):
        used, left = 1, capacity
        for s in sizes:
            if s > capacity:
                return False
            if s > left:
                used, left = used + 1, capacity
            left -= s
        return used <= shards

    low, high = 0, sum(sizes)
    while low < high:
        mid = (low + high) // 2
        low, high = (low, mid) if fits(mid) else (mid + 1, high)
    return low


def test_minimax_cuts_are_exact(spark):
    rng = random.Random(1)
    for n, shards in ((1, 3), (5, 2), (300, 7), (2000, 16)):
        keys = sorted({rng.randrange(-(2**63), 2**63) for _ in range(n)} | {2**63 - 1})
        if n == 300:  # neighbours that share most of their bits
            keys = sorted(set(keys) | {keys[0] + i for i in range(1, 50)})
        sizes = [rng.choice((1, 10, 1000, 50_000)) for _ in keys]
        groups = spark.createDataFrame(list(zip(keys, sizes, strict=True)), "key long, size long")
        capacity, cuts = minimax_cuts(groups, shards)
        assert capacity == brute_capacity(sizes, shards)
        bounds = [-(2**63), *cuts, 2**63]
        assert max(sum(s for k, s in zip(keys, sizes, strict=True) if a <= k < b) for a, b in zip(bounds, bounds[1:], strict=False)) == capacity


def test_documents(spark):
    rng = random.Random(2)
    rows = [(i, rng.choice(["same", "é😀" * rng.randrange(50), "x" * rng.randrange(3000)]), "s", 9) for i in range(400)]
    rows += [(None, None, None, None), (5, "", "s", 1), (5, "", "s", 1), (400, "y" * 200_000, "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, shard string, slot long")
    found = shard(docs, 6).collect()
    assert len(found) == len(rows)
    texts = {}
    for r in rows:
        texts.setdefault(r[0], set()).add(r[1] or "")
    where = {}
    for r in found:
        assert any(len(t.encode()) + 1 == r["size"] and zlib.crc32(t.encode()) == r.text_crc32 for t in texts[r.doc_id])
        assert where.setdefault((r.text_crc32, r["size"]), r.shard) == r.shard
    for s in {r.shard for r in found}:
        assert sorted(r.slot for r in found if r.shard == s) == list(range(sum(r.shard == s for r in found)))
    groups = docs.select(F.xxhash64(F.coalesce("text", F.lit(""))).alias("key"), (F.octet_length(F.coalesce("text", F.lit(""))) + 1).alias("size")).groupBy("key").agg(F.sum("size").alias("size")).orderBy("key").collect()
    largest = max(sum(r["size"] for r in found if r.shard == s) for s in {r.shard for r in found})
    assert largest == brute_capacity([g["size"] for g in groups], 6)


def test_empty_and_tied(spark):
    assert shard(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    one = shard(spark.createDataFrame([(i, "tie") for i in range(50)], "doc_id long, text string"), 16).collect()
    assert len({r.shard for r in one}) == 1
    assert sorted(r.slot for r in one) == list(range(50))
    assert _Sums([]).bounds(3)[1] == 0
