"""Embedding near-duplicates by Euclidean p-stable hashing and exact cosine checks.

Vectors are normalised and hashed in several tables by k quantised random projections each; width, k and the number of
tables minimise keys written plus expected far collisions, such that a pair at exactly the threshold meets with
probability RECALL. Equal vectors of a label are one class, compared once. What is written under every key is a sketch, the
components in eight bits with a bound of what the rounding changes; the groups of a key tell which of their vectors may
have a partner there, with no link missed, and only those are fetched and checked by cosine in double precision. A pair is counted only in the first table in which it meets, so that groups send out a
count for each vector and the edges of a spanning forest: nothing of the size of all pairs, however dense a group is.
The projections are integers, and so exact: both sides of that rule see the same keys.

Defined cases: vectors that are null, empty or zero or hold null or non-finite components, and rows with null labels or
null ids, link with nothing; vectors of other lengths never link; repeated vectors link with each other, rows that repeat
an id as well; an empty table gives no rows. Columns other than vec_id, label and embedding are ignored.
"""

from __future__ import annotations

from math import ceil, erf, exp, log, pi, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .peers import grouped, whole_groups
from .shared import cut, mix

COSINE, RECALL = 0.93, 0.999
#: A written key against the comparison of two vectors, in time.
KEY_COST = 60.0
BLOCK, SMALL = 1024, 16
VECTOR_BITS, PROJECTION_BITS = 20, 12


def collision(distance: float, width: float) -> float:
    """Chance that one quantised projection is equal for two vectors at this distance."""
    r = width / distance
    return erf(r / sqrt(2)) - 2 / (sqrt(2 * pi) * r) * (1 - exp(-r * r / 2))


def plan(n: int, cosine: float = COSINE, recall: float = RECALL) -> tuple[float, int, int]:
    """Width, projections a table and tables for groups of about n vectors."""
    best = None
    for width in (0.75, 1.0, 1.5, 2.0, 3.0):
        near, far = collision(sqrt(2 - 2 * cosine), width), collision(sqrt(2), width)
        for k in range(1, 33):
            tables = ceil(log(1 - recall) / log(1 - near**k)) if near**k < 1 else 1
            if tables > 512:
                break
            cost = tables * (n * KEY_COST + n * n / 2 * far**k)
            if best is None or cost < best[0]:
                best = cost, width, k, tables
    return best[1:]


_projections: dict = {}


def keys(vectors: np.ndarray, lab: np.ndarray, width: float, k: int, tables: int) -> np.ndarray:
    """Keys (rows x tables) of vectors; lab keeps labels apart."""
    dim = vectors.shape[1]
    if (dim, width, k, tables) not in _projections:
        rng = np.random.default_rng(42)
        a = np.rint(rng.standard_normal((dim, k * tables)) * 2**PROJECTION_BITS)
        unit = width * 2.0 ** (VECTOR_BITS + PROJECTION_BITS)
        _projections[dim, width, k, tables] = a, np.rint(rng.random(k * tables) * unit), unit
    a, b, unit = _projections[dim, width, k, tables]
    norm = np.sqrt((vectors * vectors).sum(axis=1))
    whole = np.rint(vectors / norm[:, None] * 2**VECTOR_BITS)
    cell = np.floor((whole @ a + b) / unit).astype(np.int64).view(np.uint64).reshape(len(vectors), tables, k)
    out = mix(lab.view(np.uint64))[:, None] ^ mix(np.arange(1, tables + 1, dtype=np.uint64))[None, :]
    with np.errstate(over="ignore"):
        for j in range(k):
            out = mix(out * np.uint64(0x9E3779B97F4A7C15) + cell[:, :, j])
    return out.view(np.int64)


def _classes(vectors: DataFrame) -> DataFrame:
    """Rows (cls, label, embedding, id, weight, h, g): equal vectors of a label, with their least id, number and hashes."""
    e = F.col("embedding")
    fit = (F.size(e) > 0) & F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(e, lambda x: x != 0)
    ok = vectors.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & e.isNotNull()).where(F.coalesce(fit, F.lit(False)))
    found = ok.groupBy("label", "embedding").agg(F.min("vec_id").alias("id"), F.count("*").alias("weight"))
    return found.withColumn("cls", F.monotonically_increasing_id()).selectExpr("*", *_HASHES)


#: Two hashes of a label and a vector; and a number of label and length, as vectors that differ in either never link.
_HASHES = "xxhash64(label, embedding) AS h", "xxhash64(1, label, embedding) AS g"
_LAB = "xxhash64(label, size(embedding)) AS lab"


def _by_length(batch: pa.RecordBatch):
    """(rows, vectors in double precision), some rows of one length at a time."""
    column = batch.column("embedding").cast(pa.list_(pa.float64()))
    sizes = column.value_lengths().to_numpy()
    flat, at = column.flatten().to_numpy(), np.cumsum(sizes) - sizes
    for dim in np.unique(sizes).tolist():
        rows = np.flatnonzero(sizes == dim)
        for some in np.array_split(rows, -(-len(rows) // 512)):
            yield some, flat[at[some][:, None] + np.arange(dim)]


def _binary(rows: np.ndarray) -> pa.Array:
    size = rows.shape[1] * rows.itemsize
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(np.arange(len(rows) + 1, dtype=np.int32) * size), pa.py_buffer(np.ascontiguousarray(rows))])


def _matrices(column: pa.ChunkedArray, kind: str):
    """(rows, matrix of their values) for each length of the binary values."""
    bodies = column.combine_chunks()
    if isinstance(bodies, pa.ChunkedArray):
        bodies = bodies.chunk(0)
    length = np.frombuffer(bodies.buffers()[1], np.int32)[bodies.offset : bodies.offset + len(bodies) + 1]
    raw, length = np.frombuffer(bodies.buffers()[2], np.uint8)[length[0] : length[-1]], length - length[0]
    for dim in np.unique(np.diff(length)).tolist():
        rows = np.flatnonzero(np.diff(length) == dim)
        yield rows, raw.view(kind).reshape(len(bodies), -1) if len(rows) == len(bodies) else np.ascontiguousarray(raw[length[rows][:, None] + np.arange(dim)]).view(kind)


def sketches(v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Components in eight bits, their unit, and a bound of the length of what the rounding leaves, for v made of length 1."""
    u = v / np.abs(v).max(axis=1)[:, None]
    u /= np.sqrt((u * u).sum(axis=1))[:, None]
    unit = (np.abs(u).max(axis=1) / 127).astype(np.float32)
    q = np.clip(np.rint(u / unit[:, None]), -127, 127)
    rest = np.sqrt(((u - q * unit[:, None].astype(np.float64)) ** 2).sum(axis=1))
    return q.astype(np.int8), unit, (rest * 1.001 + 1e-6).astype(np.float32)


def _sketched(classes: DataFrame, width: float, k: int, tables: int) -> DataFrame:
    """Rows (key, cls, t, unit, rest, body) for every table."""

    def run(batches):
        for batch in batches:
            cls, lab = (batch.column(c).to_numpy() for c in ("cls", "lab"))
            for some, v in _by_length(batch):
                made = keys(v, lab[some], width, k, tables).reshape(-1)
                body, unit, rest = sketches(v)
                each = np.repeat(np.arange(len(some)), tables)
                t = np.tile(np.arange(tables, dtype=np.int16), len(some))
                yield pa.RecordBatch.from_arrays([*map(pa.array, (made, cls[some][each], t, unit[each], rest[each])), _binary(body[each])], ["key", "cls", "t", "unit", "rest", "body"])

    return classes.selectExpr("cls", _LAB, "embedding").mapInArrow(run, "key long, cls long, t short, unit float, rest float, body binary")


def _promising(sketched: DataFrame, cosine: float) -> DataFrame:
    """Rows (key, cls, t) of the vectors that may have a partner under a key; repeated where a key is split in blocks."""

    def lacking(unit, rest, i, j):
        """What the product of the sketches of rows i and j must reach at least."""
        return (cosine - 1e-5 - rest[i] * (1 + rest[j]) - rest[j] * (1 + rest[i]) - rest[i] * rest[j]) / (unit[i] * unit[j])

    def hopeful(table, begins):
        units, rests, own, p, q = (table.column(c).to_numpy() for c in ("unit", "rest", "own", "p", "q"))
        group_of = np.repeat(np.arange(len(begins) - 1), np.diff(begins))
        may = np.zeros(table.num_rows, bool)
        for rows, body in _matrices(table.column("body"), "i1"):
            v = body.astype(np.float32)  # whole numbers, so that products of up to 1,000 components are exact
            unit, rest, group = units[rows].astype(np.float64), rests[rows].astype(np.float64), group_of[rows]
            edge = np.flatnonzero(np.diff(group, prepend=-1))
            size = np.diff(np.append(edge, len(group)))
            end = np.repeat(edge + size, size)
            at = np.flatnonzero(np.repeat((size <= SMALL) & (size > 1), size))
            for s in range(1, SMALL):
                at = at[at + s < end[at]]
                if not len(at):
                    break
                for i in np.array_split(at, -(-len(at) // 8192)):
                    i = i[np.einsum("ij,ij->i", v[i], v[i + s]) >= lacking(unit, rest, i, i + s)]
                    may[rows[i]] = may[rows[i + s]] = True
            for a, n in zip(edge[size > SMALL].tolist(), size[size > SMALL].tolist(), strict=True):
                some = np.arange(a, a + n)
                link = v[some] @ v[some].T >= lacking(unit, rest, some[:, None], some[None, :])
                np.fill_diagonal(link, False)
                head = int(begins[group[a]])
                if p[head] != q[head]:
                    link &= own[rows[some]][:, None] != own[rows[some]][None, :]
                may[rows[some[link.any(axis=1)]]] = True
        return may

    def run(batches):
        for table, begins in whole_groups(batches):
            yield from table.select(["key", "cls", "t"]).filter(pa.array(hopeful(table, begins))).to_batches()

    return grouped(sketched, "cls", BLOCK).select("key", "p", "q", "own", "cls", "t", "unit", "rest", "body").mapInArrow(run, "key long, cls long, t short")


def _keyed(classes: DataFrame, promising: DataFrame) -> DataFrame:
    """Rows (key, id, weight, lab, t, v): v holds the components as they are in the table."""
    kind = "<f4" if classes.schema["embedding"].dataType.elementType.simpleString() == "float" else "<f8"

    def run(batches):
        for batch in batches:
            for some, v in _by_length(batch):
                part = batch.take(pa.array(some))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("cls", "id", "weight", "lab")), _binary(v.astype(kind))], ["cls", "id", "weight", "lab", "v"])

    wanted = promising.distinct()
    fetched = classes.selectExpr("cls", "id", "weight", _LAB, "embedding").join(wanted.select("cls").distinct(), "cls", "left_semi")
    packed = fetched.mapInArrow(run, "cls long, id long, weight long, lab long, v binary")
    return packed.join(wanted, "cls").select("key", "id", "weight", "lab", "t", "v", F.lit(kind).alias("kind"))


def _tree(link: np.ndarray) -> tuple[list[int], list[int]]:
    """Edges of a spanning forest of a symmetric matrix of links."""
    left = np.flatnonzero(link.any(axis=1))
    ours, theirs = [], []
    while len(left):
        frontier, left = [int(left[0])], left[1:]
        while frontier and len(left):
            x = frontier.pop()
            near = link[x, left]
            found, left = left[near].tolist(), left[~near]
            ours += [x] * len(found)
            theirs += found
            frontier += found
    return ours, theirs


def _compare(keyed: DataFrame, width: float, k: int, tables: int, cosine: float) -> DataFrame:
    """Rows (a, b, n): an edge if b is not null, else n more vectors linked with a."""

    def first_met(v, lab, t, i, j):
        """Of the pairs (i, j) of rows of table t, those that meet in no earlier table."""
        used, back = np.unique(np.concatenate([i, j]), return_inverse=True)
        own = keys(v[used], lab[used], width, k, tables)
        a, b = own[back[: len(i)]], own[back[len(i) :]]
        return ((a == b) & (np.arange(tables) < t[:, None])).sum(axis=1) == 0

    def checked(table, begins):
        ids, weight, lab, t, own, p, q = (table.column(c).to_numpy() for c in ("id", "weight", "lab", "t", "own", "p", "q"))
        kind = table.column("kind")[0].as_py()
        size = np.diff(begins)
        for rows, body in _matrices(table.column("v"), kind):  # rows of a group that differ in length differ in lab
            yield from compared(body.astype(np.float64), *(x[rows] for x in (ids, weight, lab, t, own)), np.repeat(np.arange(len(size)), size)[rows], (p, q, begins))

    def compared(v, ids, weight, lab, t, own, group, where):
        p, q, begins = where
        norm = np.sqrt((v * v).sum(axis=1))
        edge = np.flatnonzero(np.diff(group, prepend=-1))
        size = np.diff(np.append(edge, len(group)))
        end = np.repeat(edge + size, size)
        pairs_i, pairs_j, edges = [], [], []
        at = np.flatnonzero(np.repeat((size <= SMALL) & (size > 1), size))
        for s in range(1, SMALL):
            at = at[at + s < end[at]]
            if not len(at):
                break
            for some in np.array_split(at, -(-len(at) // 8192)):
                near = (np.einsum("ij,ij->i", v[some], v[some + s]) / (norm[some] * norm[some + s]) >= cosine) & (lab[some] == lab[some + s])
                pairs_i.append(some[near])
                pairs_j.append(some[near] + s)
        if pairs_i:
            i, j = np.concatenate(pairs_i), np.concatenate(pairs_j)
            if len(i):
                keep = first_met(v, lab, t[i], i, j)
                pairs_i, pairs_j = [i[keep]], [j[keep]]
                edges.append((i[keep], j[keep]))
        for g in np.flatnonzero(size > SMALL).tolist():
            a, b = int(edge[g]), int(edge[g] + size[g])
            head = int(begins[group[a]])
            w = v[a:b]
            link = (w @ w.T / np.outer(norm[a:b], norm[a:b]) >= cosine) & (lab[a:b, None] == lab[None, a:b])
            np.fill_diagonal(link, False)
            if p[head] != q[head]:
                link &= own[a:b, None] != own[None, a:b]
            i, j = np.nonzero(np.triu(link))
            if not len(i):
                continue
            keep = np.concatenate([first_met(w, lab[a:b], t[a + i[c : c + 65536]], i[c : c + 65536], j[c : c + 65536]) for c in range(0, len(i), 65536)])
            i, j = i[keep], j[keep]
            if not len(i):
                continue
            link[:] = False
            link[i, j] = link[j, i] = True
            pairs_i.append(i + a)
            pairs_j.append(j + a)
            x, y = _tree(link)
            edges.append((np.array(x, np.int64) + a, np.array(y, np.int64) + a))
        if not edges:
            return
        i, j = np.concatenate(pairs_i), np.concatenate(pairs_j)
        more = np.zeros(len(ids), np.int64)
        np.add.at(more, i, weight[j])
        np.add.at(more, j, weight[i])
        some = np.flatnonzero(more)
        x, y = np.concatenate([e[0] for e in edges]), np.concatenate([e[1] for e in edges])
        yield pa.RecordBatch.from_arrays([pa.array(ids[some]), pa.nulls(len(some), pa.int64()), pa.array(more[some])], ["a", "b", "n"])
        yield pa.RecordBatch.from_arrays([pa.array(ids[x]), pa.array(ids[y]), pa.array(np.zeros(len(x), np.int64))], ["a", "b", "n"])

    def run(batches):
        for table, begins in whole_groups(batches):
            yield from checked(table, begins)

    dealt = grouped(keyed, "id", BLOCK).select("key", "p", "q", "own", "id", "weight", "lab", "t", "v", "kind")
    return dealt.mapInArrow(run, "a long, b long, n long")


def near_duplicates(vectors: DataFrame, cosine: float = COSINE, recall: float = RECALL) -> DataFrame:
    """Rows (vec_id, n_links, component_id, kept), one for each vector."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "label", "embedding")
    classes = cut(_classes(rows))
    n = classes.groupBy("label").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    width, k, tables = plan(max(n, 2), cosine, recall)
    promising = cut(_promising(_sketched(classes, width, k, tables), cosine))
    found = cut(_compare(cut(_keyed(classes, promising)), width, k, tables, cosine))
    more = found.where("b IS NULL").groupBy("a").agg(F.sum("n").alias("n"))
    roots = components(found.where("b IS NOT NULL").select("a", "b"))
    told = classes.join(more, classes.id == more.a, "left").join(roots, classes.id == roots.node, "left")
    told = cut(told.select("label", "embedding", "h", "g", (F.col("weight") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), F.coalesce("root", "id").alias("component_id")))
    # hashes stand for the vectors if no two vectors share them
    same = classes.groupBy("h", "g").agg(F.count("*").alias("n")).where("n > 1").isEmpty()
    by, told = (["h", "g"], told.drop("label", "embedding")) if same else (["label", "embedding"], told.drop("h", "g"))
    rows = rows.selectExpr("*", *_HASHES).select("vec_id", *by)
    keep = F.coalesce("component_id", "vec_id")
    out = rows.join(told, by, "left").select("vec_id", F.when(F.col("vec_id").isNull(), 0).otherwise(F.coalesce("n_links", F.lit(0))).cast("long").alias("n_links"), F.when(F.col("vec_id").isNotNull(), keep).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def query(spark, sf_dir: str) -> DataFrame:
    """All embeddings at cosine 0.93."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


ORACLE_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
p AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
      WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
r AS (SELECT vec_id AS a, vec_id AS c FROM v UNION SELECT r.a, p.b FROM r JOIN p ON r.c = p.a),
m AS (SELECT a, min(c) AS component_id FROM r GROUP BY a),
n AS (SELECT a, count(*) AS n FROM p GROUP BY a)
SELECT v.vec_id, coalesce(n.n, 0) AS n_links, m.component_id, v.vec_id = m.component_id AS kept
FROM v JOIN m ON m.a = v.vec_id LEFT JOIN n ON n.a = v.vec_id
"""
