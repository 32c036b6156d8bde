import random
import re
from pathlib import Path

import numpy as np
import pytest
from xxhash import xxh64_intdigest

from tagloom.llm import op06_simhash as S
from tagloom.llm import op08_embeddings as E
from tagloom.llm.components import components

from ..compare import canonical, sql_rows

SF = "/root/testdata/sf0.001"


class Union:
    def __init__(self):
        self.up = {}

    def find(self, x):
        self.up.setdefault(x, x)
        while self.up[x] != x:
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = sorted((self.find(a), self.find(b)))
        self.up[b] = a


def fingerprint(text):
    text = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    words = re.findall("[^\x20\x09-\x0d]+", text)
    if not words:
        return 0
    grams = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def near_copies(rng, n):
    base = [f"word{i}" for i in range(400)]
    docs = []
    for _ in range(n):
        words = rng.choices(base, k=rng.randrange(1, 120))
        docs.append(" ".join(words))
        for _ in range(rng.choice((0, 0, 1, 3))):
            copy = list(words)
            for _ in range(rng.randrange(3)):
                copy[rng.randrange(len(copy))] = rng.choice(base)
            docs.append(" ".join(copy))
    return docs


def classes(fps):
    joined = Union()
    distinct = sorted(set(fps))
    for i, a in enumerate(distinct):
        joined.find(a)
        for b in distinct[i + 1 :]:
            if (a ^ b).bit_count() <= 4:
                joined.join(a, b)
    return {a: joined.find(a) for a in distinct}


def test_simhash_against_all_pairs(spark):
    rng = random.Random(9)
    texts = [None, "", "  \n", "One", "ONE", "a b c", "É É é x y", "x\x0by\x1cz w v u", *near_copies(rng, 150), "long " * 210_000 + "end"]
    texts += ["copy of the same text again and again"] * 40
    rows = list(enumerate(texts)) + [(None, texts[10]), (7, "repeated id"), (7, "repeated id")]
    docs = spark.createDataFrame([(*r, "c") for r in rows], "doc_id long, text string, fingerprint string").repartition(3)
    fps = [fingerprint(t) if len(t or "") < 100_000 else None for _, t in rows]
    found = S.near_duplicates(docs).collect()
    long = next(r.fingerprint for r in found if r.doc_id == len(texts) - 41)
    fps = [int(long, 16) if f is None else f for f in fps]
    root = classes(fps)
    least = {}
    for (i, _), f in zip(rows, fps, strict=True):
        if i is not None:
            least[root[f]] = min(i, least.get(root[f], i))
    want = sorted(((i, f"{f:016x}", least[root[f]]) for (i, _), f in zip(rows, fps, strict=True)), key=repr)
    assert sorted(((r.doc_id, r.fingerprint, r.component_id) for r in found), key=repr) == want
    kept = S.drop_near_duplicates(docs)
    assert kept.schema.names == docs.schema.names
    stay = kept.collect()
    assert len(stay) == len(set(root.values()))
    assert {r.doc_id for r in stay} == set(least.values())
    none = docs.where("false")
    assert S.near_duplicates(none).count() == S.drop_near_duplicates(none).count() == 0


def test_long_text_in_pieces():
    words = [f"w{i % 977}" for i in range(200_050)]
    text = " ".join(words)
    small = S.fingerprint_batch([text])[0]
    hashes = np.array([xxh64_intdigest(" ".join(words[i : i + 4]).encode(), 42) for i in range(len(words) - 3)], "<u8")
    bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0)
    assert small == sum(1 << b for b in range(64) if 2 * int(bits[b]) > len(hashes))


def test_pigeonhole_plan_covers_all_pairs():
    rng = np.random.default_rng(3)
    fps = rng.integers(0, 2**63, 3000, dtype=np.uint64)
    bits = np.unpackbits(fps.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float64)
    for both in (bits.T @ bits, np.eye(64) * 1500):
        planned = S.plan(3000, both)
        assert sum(t + 1 for _, t in planned) == 5
        used = [b for part, _ in planned for b in part]
        assert len(used) == len(set(used))
        masks = np.array([m & (2**64 - 1) for m in S.masks(planned)], np.uint64)
        for _ in range(300):
            flip = sum(1 << int(b) for b in rng.choice(64, 4, replace=False))
            x = int(fps[0])
            assert any((x & int(m)) == ((x ^ flip) & int(m)) for m in masks)


def test_dense_groups_are_split(spark):
    rng = random.Random(4)
    fps = sorted({0xF0F0F0F0F0F0F0F0 ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for _ in range(1500)})
    keyed = spark.createDataFrame([(f - 2**64 if f >> 63 else f, f % 1000, 5, False, 0, 0) for f in fps], "fp long, id long, key long, none boolean, tie long, t int")
    from tagloom.llm import peers

    finer = S.split_hot(keyed, [0], 4, block=300)
    assert finer.groupBy("t", "key").count().agg({"count": "max"}).first()[0] < 1500
    found = components(S.forest_edges(finer))
    assert found.select("root").distinct().count() == 1
    assert found.count() == len(fps)

    old, peers.grouped.__defaults__ = peers.grouped.__defaults__, (200,)
    try:
        found = components(S.forest_edges(keyed))
        assert found.select("root").distinct().count() == 1
        assert found.count() == len(fps)
    finally:
        peers.grouped.__defaults__ = old


def test_sketches_bound_the_cosine():
    rng = np.random.default_rng(8)
    v = rng.standard_normal((400, 24)) * 10.0 ** rng.integers(-30, 30, 400)[:, None]
    v[::5] = 0
    v[::5, 3] = 1e-20
    q, unit, rest = E.sketches(v)
    u = v / np.sqrt((v * v).sum(axis=1))[:, None]
    about = (q.astype(float) @ q.T.astype(float)) * unit[:, None] * unit[None, :]
    bound = rest[:, None] * (1 + rest[None, :]) + rest[None, :] * (1 + rest[:, None]) + rest[:, None] * rest[None, :]
    assert (np.abs(u @ u.T - about) <= bound + 1e-9).all() and bound.max() < 0.05


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(250)] + [(i, i + 1) for i in range(1000, 1200)] + [(5, 5), (None, 3), (2000, 2001), (2001, 2000)]
    joined = Union()
    for a, b in edges:
        if a is not None and a != b:
            joined.join(a, b)
    df = spark.createDataFrame(edges, "a long, b long")
    assert {r.node: r.root for r in components(df).collect()} == {x: joined.find(x) for x in joined.up}
    assert components(df.where("false")).count() == 0


def brute_embeddings(rows):
    def fit(r):
        i, label, v = r
        return i is not None and label is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)

    joined, links = Union(), [0] * len(rows)
    for i, a in enumerate(rows):
        for j in range(i):
            b = rows[j]
            if fit(a) and fit(b) and a[1] == b[1] and len(a[2]) == len(b[2]):
                x, y = np.array(a[2], np.float64), np.array(b[2], np.float64)
                if x @ y / (np.linalg.norm(x) * np.linalg.norm(y)) >= 0.93:
                    links[i] += 1
                    links[j] += 1
                    joined.join(a[0], b[0])
    return sorted(((r[0], n, None if r[0] is None else joined.find(r[0]), r[0] is not None and joined.find(r[0]) == r[0]) for r, n in zip(rows, links, strict=True)), key=repr)


def test_embeddings_against_all_pairs(spark):
    rng = np.random.default_rng(5)
    rows = []
    centres = rng.standard_normal((12, 16))
    for i in range(300):
        v = centres[i % 12] + rng.standard_normal(16) * rng.choice((0.02, 0.25, 0.6))
        rows.append((i, int(i % 3), [float(np.float32(x)) for x in v]))
    rows += [(300 + i, 1, rows[0][2]) for i in range(3)] + [(310 + i, 0, rows[0][2]) for i in range(30)]
    rows += [(400, None, rows[0][2]), (None, 0, rows[0][2]), (401, 0, None), (402, 0, []), (403, 0, [0.0] * 16), (404, 0, [float("nan")] * 16), (405, 0, [None, *rows[0][2][1:]]), (406, 0, [float("inf")] * 16), (407, 0, rows[0][2][:8])]
    vectors = spark.createDataFrame([(*r, "k") for r in rows], "vec_id long, label int, embedding array<float>, kept string").repartition(3)
    found = sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in E.near_duplicates(vectors).collect()), key=repr)
    assert found == brute_embeddings(rows)
    assert E.near_duplicates(vectors.where("false")).count() == 0


@pytest.mark.skipif(not Path(SF).is_dir(), reason="no test data here")
def test_embeddings_sql(spark):
    assert canonical(E.query(spark, SF).toPandas()) == sql_rows(SF, E.ORACLE_SQL)
