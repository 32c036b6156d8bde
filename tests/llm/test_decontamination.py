import hashlib
import random
import re
from pathlib import Path

import pytest

from tagloom.llm import op07_decontaminate as D

from ..compare import canonical, sql_rows

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


def windows(items):
    found = {}
    for item, text in items:
        own = words(text)
        k = min(10, len(own))
        for i in range(len(own) - k + 1 if k else 0):
            found.setdefault(tuple(own[i : i + k]), set()).add(item)
    return found


def brute(text, items):
    own, held = words(text), windows(items)
    hit, names = set(), set()
    for k in {len(w) for w in held}:
        for i in range(len(own) - k + 1):
            if (w := tuple(own[i : i + k])) in held:
                hit.update(range(i, i + k))
                names |= {str(x) for x in held[w] if x is not None}
    digest = hashlib.sha256(",".join(sorted(names)).encode()).hexdigest()
    return len(own), len(hit), len(names), digest, bool(hit)


def fixture():
    rng = random.Random(11)
    vocabulary = [f"w{i}" for i in range(30)] + ["É", "日本", "it"]
    make = lambda n: " ".join(rng.choices(vocabulary, k=n))
    items = [(i, make(rng.randrange(1, 25))) for i in range(40)] + [(100, None), (101, ""), (102, " - ."), (None, make(12)), (3, make(11)), (103, "single")]
    docs = [(0, None), (1, ""), (2, "...")]
    for i in range(3, 200):
        parts = [make(rng.randrange(30))]
        for _ in range(rng.choice((0, 0, 1, 2))):
            body = rng.choice(items)[1] or ""
            parts += [rng.choice((body, body.upper().replace(" ", ", "), body[: len(body) // 2])), make(rng.randrange(30))]
        docs.append((i, " ".join(parts)))
    docs += [docs[-1]] * 2 + [(None, items[5][1]), (300, make(20_000) + " " + items[7][1] + " " + make(20_000))]
    return docs, items


def frames(spark, docs, items):
    d = spark.createDataFrame([(*r, 1, "x") for r in docs], "doc_id long, text string, _words long, hits string").repartition(3)
    return d, spark.createDataFrame([(*r, 1) for r in items], "item_id long, text string, part int")


@pytest.mark.parametrize("limit", [D.SET_BYTES, 8000])
def test_against_brute_force(spark, limit):
    docs, items = fixture()
    d, b = frames(spark, docs, items)
    found = D.digest(D.contamination(d, b, limit=limit)).collect()
    want = sorted(((i, *brute(t, items)) for i, t in docs), key=repr)
    assert sorted((tuple(r) for r in found), key=repr) == want


@pytest.mark.parametrize("limit", [D.SET_BYTES, 8000])
def test_removal(spark, limit):
    docs, items = fixture()
    items = [x for x in items if len(words(x[1])) >= 8]
    d, b = frames(spark, docs, items)
    out = D.remove_contamination(d, b, limit=limit)
    assert out.schema.names == d.schema.names
    left = {}
    for r in out.collect():
        left.setdefault(r.doc_id, []).append(r.text)
        assert not brute(r.text, items)[4]
    for i, text in docs:
        n, hit, *_ = brute(text, items)
        if not hit:
            assert text in left[i]
        if n and hit > D.REMOVE_SHARE * n:
            assert i not in left


def test_parts_do_not_change_texts(spark):
    rng = random.Random(5)
    long = [f"q{rng.randrange(10**6)}" for _ in range(400)]
    items = [(0, " ".join(f"w{i}" for i in range(12))), (1, " ".join(f"w{i}" for i in range(8, 20))), (2, " ".join(long))] + [(3, "e1 e2 e3 e4 e5 e6 e7 e8 e9 e10")] * 500
    split = "e1 e2 e3 e4 " + " ".join(f"w{i}" for i in range(12)) + " e5 e6 e7 e8 e9 e10"  # whole again once the middle is cut
    rest = " ".join(f"r{i}" for i in range(60))
    docs = [(0, " ".join(f"w{i}" for i in range(20)) + " " + rest), (1, split + " " + rest), (2, " ".join(long[150:260]) + " " + rest * 3), (3, "a  b\n" + rest), (4, split), (5, None)]
    d, b = frames(spark, docs, items)
    want = {0: " " + rest, 1: " " + rest, 3: "a  b\n" + rest, 5: None}
    for limit in (60, 8000, 4 << 20):
        parts = D.Parts(b, limit=limit)
        assert (parts.count > 1) == (limit < 4 << 20)
        if parts.count > 1:  # repeated rows and the long item are dealt, and no part is beyond the limit
            assert max(len(s.words.raw) + D.WINDOW_BYTES * len(s.words.starts) for s in parts) <= parts.limit
        got = {r.doc_id: r.text for r in D.remove_contamination(d, b, limit=limit).collect()}
        assert {k: got.get(k, 0) for k in want} == want and 4 not in got
        assert len(words(got.get(2, rest * 3))) == len(words(rest * 3))
        found = D.digest(D.contamination(d, b, limit=limit)).collect()
        assert sorted((tuple(r) for r in found), key=repr) == sorted(((i, *brute(t, items)) for i, t in docs), key=repr)


def test_empty(spark):
    docs, items = fixture()
    d, b = frames(spark, docs, items)
    assert D.contamination(d.where("false"), b).count() == 0
    assert D.digest(D.contamination(d, b.where("false"))).where("contaminated").count() == 0
    assert D.remove_contamination(d, b.where("false")).count() == len(docs)


@pytest.mark.skipif(not Path(SF).is_dir(), reason="no test data here")
def test_sql(spark):
    assert canonical(D.query(spark, SF).toPandas()) == sql_rows(SF, D.ORACLE_SQL)
