"""SimHash near-duplicates by the generalised pigeonhole principle.

Fingerprints of 64 bits over the XXH64 of 4-word shingles are linked at four or fewer differing bits. The bits are split
into partitions that keep correlated bits together; partitions get thresholds t (-1: unused) with sum(t + 1) = 5, so a
linked pair differs in at most t bits of some partition. Number of partitions and thresholds minimise the keys written
and the candidates they are estimated to bring (dynamic programming over bit statistics of all distinct fingerprints). A
threshold of t bits is probed by one key for each choice of t bits left out, under which pairs within t meet exactly.
Rows that share a key are verified on all 64 bits and only the edges of a spanning forest leave a group: no pair list of
a dense group is ever made. A key that many fingerprints share is split again by the same principle over the bits that it
leaves free, which pairs within the distance still survive; what is dense even then is compared in blocks. Components
follow by alternating stars over nodes that sort by their first document, so that a component is known by it at once.

Defined cases: null and empty texts have the fingerprint zero and are linked like any other; equal fingerprints are one
class however many rows share them; repeated rows and rows with null ids keep their own rows, a null id is never the
least; an empty table gives no rows. Other columns are ignored, and passed through by :func:`drop_near_duplicates`.
"""

from __future__ import annotations

from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .peers import BLOCK, grouped, whole_groups
from .segments import slices
from .shared import cut, documents, packed, unpacked

SHINGLE, SEED, DISTANCE = 4, 42, 4
#: A written key against one comparison of two fingerprints, in time.
KEY_COST = 40.0
SMALL = 24
#: Masks that splitting hot keys makes at most, about; and what names a node: its least row, whose null id sorts last.
MASKS = 4096
NODE = ["none", "id", "tie", "fp"]


def fingerprint_batch(texts: list[str | None], shingle: int = SHINGLE) -> np.ndarray:
    """Fingerprints as unsigned 64-bit integers."""
    from xxhash import xxh64_intdigest

    hashes: list[int] = []
    counts = []
    out = np.zeros(len(texts), np.uint64)

    def fold(first: int, last: int) -> None:
        nonlocal hashes, counts
        if hashes:
            sizes = np.array(counts)
            some = np.flatnonzero(sizes)
            bits = np.unpackbits(np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            sums = np.add.reduceat(bits, (np.cumsum(sizes) - sizes)[some], axis=0, dtype=np.int64)
            out[first:last][some] = np.packbits(2 * sums > sizes[some][:, None], axis=1, bitorder="little").view("<u8")[:, 0]
        hashes, counts = [], []

    at = 0
    for i, text in enumerate(texts):
        words = (text or "").encode().lower().split()
        before = len(hashes)
        if len(words) > 200_000:  # very long: fold it in pieces
            fold(at, i)
            at, before = i + 1, 0
            total, sums = len(words) - shingle + 1, np.zeros(64, np.int64)
            for k in range(0, total, 50_000):
                part = words[k : min(k + 50_000, total) + shingle - 1]
                h = [xxh64_intdigest(b" ".join(part[j : j + shingle]), SEED) for j in range(len(part) - shingle + 1)]
                sums += np.unpackbits(np.array(h, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
            out[i] = np.packbits(2 * sums > total, bitorder="little").view("<u8")[0]
            continue
        if words:
            body = b" ".join(words)
            if len(words) <= shingle:
                hashes.append(xxh64_intdigest(body, SEED))
            else:
                size = np.fromiter(map(len, words), np.int64, len(words)) + 1
                ends = np.cumsum(size) - 1
                starts = (ends - size + 1)[: len(words) - shingle + 1].tolist()
                hashes += [xxh64_intdigest(body[s:e], SEED) for s, e in zip(starts, ends[shingle - 1 :].tolist(), strict=True)]
        counts.append(len(hashes) - before)
        if len(hashes) > 200_000:
            fold(at, i + 1)
            at = i + 1
    fold(at, len(texts))
    return out


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """Rows (doc_id, tie, fp): fp is the fingerprint as a signed long, tie the hash of the text."""

    def run(batches):
        for batch in batches:
            for some in slices(batch, "text"):
                fp = fingerprint_batch(some.column("text").to_pylist(), shingle).view(np.int64)
                yield pa.RecordBatch.from_arrays([some.column("doc_id"), some.column("tie"), pa.array(fp)], ["doc_id", "tie", "fp"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("tie"), "text")
    return rows.mapInArrow(run, "doc_id long, tie long, fp long")


# --- planning ---------------------------------------------------------------------------------------------------------


def bit_statistics(distinct: DataFrame) -> tuple[int, np.ndarray]:
    """The number of fingerprints, and for bits i, j how many have both set; 2,081 sums reach the driver."""

    def run(batches):
        total, n = np.zeros((64, 64)), 0
        for batch in batches:
            fp = batch.column("fp").to_numpy().view(np.uint64)
            for at in range(0, len(fp), 1 << 16):
                bits = np.unpackbits(fp[at : at + (1 << 16)].copy().view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
                total += bits.T @ bits
                n += len(bits)
        i, j = np.triu_indices(64)
        yield pa.RecordBatch.from_arrays([pa.array([*(i * 64 + j).tolist(), -1], pa.int32()), pa.array([*total[i, j].astype(np.int64).tolist(), n], pa.int64())], ["place", "n"])

    rows = distinct.select("fp").mapInArrow(run, "place int, n long").groupBy("place").agg(F.sum("n").alias("n")).collect()
    both, n = np.zeros((64, 64)), 0
    for r in rows:
        if r.place < 0:
            n = r.n
        else:
            both[r.place // 64, r.place % 64] = both[r.place % 64, r.place // 64] = r.n
    return n, both


def plan(n: int, both: np.ndarray, distance: int = DISTANCE) -> list[tuple[list[int], int]]:
    """Partitions of the bits with their thresholds, those of threshold -1 left out."""
    n = max(n, 1)
    p = np.diag(both) / n
    pair = both / n
    agree = p**2 + (1 - p) ** 2
    with np.errstate(divide="ignore", invalid="ignore"):
        corr = np.abs(np.nan_to_num((pair - np.outer(p, p)) / np.sqrt(np.outer(p * (1 - p), p * (1 - p)))))
    np.fill_diagonal(corr, 0)
    agree_both = pair**2 + (p[:, None] - pair) ** 2 + (p[None, :] - pair) ** 2 + (1 - p[:, None] - p[None, :] + pair) ** 2
    lift = np.log(np.maximum(agree_both, 1e-12)) - np.log(np.maximum(np.outer(agree, agree), 1e-12))

    def partitions(m: int) -> list[list[int]]:
        left, out = set(range(64)), []
        for k in range(m):
            size = len(left) // (m - k)
            part = [max(left, key=lambda b: (corr[b, list(left)].sum(), -b))]
            left.discard(part[0])
            while len(part) < size:
                best = max(left, key=lambda b: (corr[b, part].mean(), -b))
                part.append(best)
                left.discard(best)
            out.append(sorted(part))
        return out

    def log_agree(part: list[int]) -> float:
        """Of the chance that two fingerprints agree on the partition: bits joined by a tree of the strongest lifts."""
        total, done = np.log(agree[part[0]]), [part[0]]
        for _ in part[1:]:
            b, gain = max(((b, lift[b, done].max()) for b in part if b not in done), key=lambda x: x[1])
            total += np.log(agree[b]) + gain
            done.append(b)
        return min(total, 0.0)

    def cost(part: list[int], t: int, base: float) -> float:
        if t < 0:
            return 0.0
        if t >= len(part):
            return float("inf")
        ways = comb(len(part), t)
        candidates = n * (n - 1) / 2 * np.exp(base - t * np.mean(np.log(agree[part])))
        return n * ways * KEY_COST + ways * candidates

    best: tuple[float, list] = (float("inf"), [])
    for m in range(1, 9):
        parts = partitions(m)
        table: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
        for part in parts:
            base = log_agree(part)
            after: dict[int, tuple[float, list[int]]] = {}
            for spent, (total, chosen) in table.items():
                for t in range(-1, distance - spent + 1):
                    key, value = spent + t + 1, total + cost(part, t, base)
                    if key <= distance + 1 and value < after.get(key, (float("inf"),))[0]:
                        after[key] = value, [*chosen, t]
            table = after
        if distance + 1 in table and table[distance + 1][0] < best[0]:
            best = table[distance + 1][0], [(x, t) for x, t in zip(parts, table[distance + 1][1], strict=True) if t >= 0]
    return best[1]


def masks(planned: list[tuple[list[int], int]]) -> list[int]:
    """For every partition and every choice of t of its bits, the mask of its other bits, as signed longs."""
    out = []
    for part, t in planned:
        for gone in combinations(part, t):
            mask = sum(1 << b for b in part if b not in gone)
            out.append(_signed(mask))
    return out


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


# --- verifying --------------------------------------------------------------------------------------------------------


def _forest(fp: np.ndarray, distance: int) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
    """Edges of a spanning forest of the links among fp, and each one's tree."""
    left = np.arange(len(fp))
    tree = np.zeros(len(fp), np.int64)
    ours, theirs, number = [], [], 0
    while len(left):
        frontier = [int(left[0])]
        tree[left[0]] = number
        left = left[1:]
        while frontier and len(left):
            x = frontier.pop()
            near = np.bitwise_count(fp[left] ^ fp[x]) <= distance
            if near.any():
                found = left[near]
                left = left[~near]
                tree[found] = number
                ours.append(np.full(len(found), x))
                theirs.append(found)
                frontier += found.tolist()
        number += 1
    return ours, theirs, tree


def _across(fp: np.ndarray, own: np.ndarray, distance: int) -> tuple[list[int], list[int]]:
    """Between two blocks, only links that join trees of the blocks which are not yet joined."""
    sides = [np.flatnonzero(own == own.min()), np.flatnonzero(own != own.min())]
    if not len(sides[1]):
        return [], []
    tree_a, tree_b = (_forest(fp[s], distance)[2] for s in sides)
    root = list(range(int(tree_a.max()) + 1 + int(tree_b.max()) + 1))
    shift = int(tree_a.max()) + 1

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    ours, theirs = [], []
    a, b = fp[sides[0]], fp[sides[1]]
    for i in range(len(a)):
        near = np.flatnonzero(np.bitwise_count(b ^ a[i]) <= distance)
        if not len(near):
            continue
        for t, j in zip(*np.unique(tree_b[near], return_index=True), strict=True):
            x, y = find(int(tree_a[i])), find(shift + int(t))
            if x != y:
                root[max(x, y)] = min(x, y)
                ours.append(int(sides[0][i]))
                theirs.append(int(sides[1][near[j]]))
    return ours, theirs


def forest_edges(keyed: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """Edges (a, b) between nodes (none, id, tie, fp) that connect all fingerprints of a key that are linked."""

    def run(batches):
        for table, begins in whole_groups(batches):
            signed = table.column("fp").to_numpy()
            fp = signed.view(np.uint64)
            own = table.column("own").to_numpy()
            p, q = table.column("p").to_numpy(), table.column("q").to_numpy()
            size = np.diff(begins)
            ours, theirs = [], []
            # small groups side by side: compare rows i and i + s
            begin_of = np.repeat(begins[:-1], size)
            end_of = begin_of + np.repeat(size, size)
            small = np.repeat(size <= SMALL, size) & (np.repeat(size, size) > 1)
            at = np.flatnonzero(small)
            linked_i, linked_j = [], []
            for s in range(1, SMALL):
                at = at[at + s < end_of[at]]
                if not len(at):
                    break
                near = np.bitwise_count(fp[at] ^ fp[at + s]) <= distance
                linked_i.append(at[near])
                linked_j.append(at[near] + s)
            if linked_i:
                ours.append(np.concatenate(linked_i))
                theirs.append(np.concatenate(linked_j))
            for g in np.flatnonzero(size > SMALL).tolist():
                a, b = int(begins[g]), int(begins[g + 1])
                if p[a] == q[a]:
                    x, y, _ = _forest(fp[a:b], distance)
                else:
                    x, y = ([np.array(v, np.int64)] for v in _across(fp[a:b], own[a:b], distance))
                ours += [v + a for v in x]
                theirs += [v + a for v in y]
            if ours:
                i, j = np.concatenate(ours).astype(np.int64), np.concatenate(theirs).astype(np.int64)
                if len(i):
                    node = pa.StructArray.from_arrays([table.column(c).combine_chunks() for c in NODE], NODE)
                    yield pa.RecordBatch.from_arrays([node.take(pa.array(i)), node.take(pa.array(j))], ["a", "b"])

    kind = "struct<none:boolean,id:bigint,tie:bigint,fp:bigint>"
    return grouped(keyed, "fp").select("key", "p", "q", "own", *NODE).mapInArrow(run, f"a {kind}, b {kind}")


def split_hot(keyed: DataFrame, chosen: list[int], distance: int, block: int = BLOCK) -> DataFrame:
    """keyed with the keys of more than ``block`` fingerprints replaced by finer ones; column t tells a key's mask.

    Two fingerprints within the distance that agree on a mask agree on one of distance + 1 parts of the other bits, too.
    """
    while len(chosen) < MASKS:
        heavy = cut(keyed.groupBy("t", "key").agg(F.count("*").alias("n")).where(F.col("n") > block).select("t", "key"))
        known = sorted(r.t for r in heavy.select("t").distinct().collect())  # of MASKS at most
        finer = []
        for t in known:
            free = [b for b in range(64) if not chosen[t] >> b & 1]
            if 1 << len(free) > block:
                for part in range(distance + 1):
                    finer.append((t, len(chosen), _signed(chosen[t] % (1 << 64) | sum(1 << b for b in free[part :: distance + 1]))))
                    chosen = [*chosen, finer[-1][2]]
        if not finer:
            return keyed
        table = F.broadcast(keyed.sparkSession.createDataFrame(finer, "t int, t2 int, mask long"))
        split = heavy.join(table.select("t").distinct(), "t", "left_semi")
        again = keyed.join(split, ["t", "key"], "left_semi").join(table, "t").select(*NODE, F.col("t2").alias("t"), F.xxhash64("t2", F.col("fp").bitwiseAND(F.col("mask"))).alias("key"))
        keyed = cut(keyed.join(split, ["t", "key"], "left_anti").select(*NODE, "t", "key").unionByName(again))
    return keyed


def classes(prints: DataFrame, distance: int = DISTANCE, block: int = BLOCK) -> DataFrame:
    """Rows (none, id, tie, fp, root) for every distinct fingerprint: its least row, and the least node of its component."""
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), "tie"))
    distinct = cut(prints.groupBy("fp").agg(least.alias("row")).select("row.*", "fp"))
    n, both = bit_statistics(distinct)
    own = F.struct(*NODE)
    if n < 2:
        return distinct.withColumn("root", own)
    chosen = masks(plan(n, both, distance))
    keys = F.array(*[F.struct(F.lit(t).alias("t"), F.xxhash64(F.lit(t), F.col("fp").bitwiseAND(F.lit(m))).alias("key")) for t, m in enumerate(chosen)])
    keyed = cut(distinct.select(*NODE, F.explode(keys).alias("k")).select(*NODE, "k.t", "k.key"))
    found = components(forest_edges(split_hot(keyed, chosen, distance, block), distance))
    found = found.select(F.col("node.fp").alias("_fp"), "root")
    return distinct.join(found, distinct.fp == found["_fp"], "left").select(*NODE, F.coalesce("root", own).alias("root"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, fingerprint, component_id); component_id is the least doc_id reachable over links."""
    prints = cut(fingerprints(docs))
    labels = cut(classes(prints).select("fp", F.col("root.id").alias("component_id")))
    return prints.join(labels, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """The documents without near duplicates: of each component the row with the least doc_id stays, one of repeated rows."""
    prints = cut(fingerprints(docs))
    kept = cut(classes(prints).where(F.struct(*NODE) == F.col("root")).select(F.col("id").alias("_id"), F.col("tie").alias("_tie")))
    marked = packed(docs).withColumns({"_id": F.col("rest.doc_id").cast("long"), "_tie": F.xxhash64("text")})
    stay = marked.join(kept, marked["_id"].eqNullSafe(kept["_id"]) & (marked["_tie"] == kept["_tie"]), "left_semi")
    return unpacked(stay.dropDuplicates(["_id", "_tie"]), docs.columns)


def query(spark, sf_dir: str) -> DataFrame:
    """All documents."""
    return near_duplicates(documents(spark, sf_dir))
