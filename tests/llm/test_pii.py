import hashlib
import math
import random
import re
from collections import Counter

from pyspark.sql import functions as F

from tagloom.llm import op05_pii as I

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        d = 2 * d - 9 * (2 * d > 9) if i % 2 else d
        total += d
    return total % 10 == 0


def valid(kind, match):
    digits = re.sub("[^0-9]", "", match)
    if kind == "ip":
        return all(int(p) <= 255 for p in match.split("."))
    if kind == "card":
        return 13 <= len(digits) <= 19 and luhn(digits)
    return kind != "phone" or 9 <= len(digits) <= 15


def brute(text):
    return {k: [(m.start(), m.end(), m.group()) for m in re.finditer(p, text or "") if valid(k, m.group())] for k, p in BASE.items()}


def random_texts(seed, n):
    rng = random.Random(seed)
    parts = ["a.b@c.de", "x@y", "x@y.z_q@r.st", "1.2.3.4", "256.1.1.1", "1.2.3.4.5.6.7.8", "4111 1111 1111 1111", "4111-1111-1111-1112", "+49 (30) 1234-567", "+1", "+12345678901234567", "é", "😀", " ", "\n", "@", ".", "-", "12", "0000 0000 0000 000", "word", "+", "%", "_"]
    return ["".join(rng.choice(parts) for _ in range(rng.randrange(14))) for _ in range(n)]


def test_base_spans(spark):
    long = "7" * 2000 + " a@b.cd " + "x" * 2000 + " 10.0.0.1 " + "1 " * 2000 + "+1" + "(" * 2000
    texts = [None, "", *random_texts(1, 600), long, "a@b.cd " * 2000]
    docs = spark.createDataFrame([(i, t, "e", 1) for i, t in enumerate(texts)] + [(None, "a@b.cd", "e", 1)] * 2, "doc_id long, text string, email string, _row int").repartition(4)
    found = I.find(docs).collect()
    assert len(found) == len(texts) + 2
    for r in found:
        want = brute("a@b.cd" if r.doc_id is None else texts[r.doc_id])
        assert {k: [tuple(s) for s in r[k]] for k in I.KINDS} == want
    assert I.find(docs.where("false")).count() == 0


def test_very_long_texts(spark):
    long = "7" * 300_000 + " a@b.cd " + "x" * 300_000 + " 10.0.0.1 " + "1 " * 100_000 + "+1" + "(" * 100_000
    docs = spark.createDataFrame([(1, long), (2, "a@b.cd " * 20_000)], "doc_id long, text string")
    found = {r.doc_id: r for r in I.find(docs).collect()}
    assert [[s.value for s in found[1][k]] for k in I.KINDS] == [["a@b.cd"], ["10.0.0.1"], [], []]
    assert [s.start for s in found[2].email] == list(range(0, 140_000, 7))


def brute_terms(texts):
    """(value, term) pairs that disclose, by counting documents."""
    n = len(texts)
    c_e, c_t, c_et = Counter(), Counter(), Counter()
    letters = re.compile(r"[^\W\d_]{3,}")
    for text in texts:
        text = text or ""
        c_t.update(set(letters.findall(text.lower())))
        spans = brute(text)
        values, pairs = set(), set()
        for kind, found in spans.items():
            for a, b, v in found:
                others = [(x, y) for x, y, _ in [(m.start(), m.end(), 0) for m in re.finditer(BASE[kind], text)]]
                left_from = max([y for x, y in others if y <= a], default=0)
                right_to = min([x for x, y in others if x >= b], default=len(text))
                left, right = text[left_from:a], text[b:right_to]
                if len(left) > I.CONTEXT:
                    left = re.sub(r"^[^\W\d_]+", "", left[-I.CONTEXT :])
                if len(right) > I.CONTEXT:
                    right = re.sub(r"[^\W\d_]+$", "", right[: I.CONTEXT])
                values.add(f"{kind}:{v}")
                pairs |= {(f"{kind}:{v}", t) for t in letters.findall(left.lower()) + letters.findall(right.lower())}
        c_e.update(values)
        c_et.update(pairs)
    out = set()
    for (e, t), k in c_et.items():
        if k >= I.SUPPORT and c_e[e] >= I.SUPPORT and c_e[e] < n:
            if math.log(n * k / (c_e[e] * c_t[t])) >= I.DISCLOSURE * math.log(n / c_e[e]) - 1e-12:
                out.add((e, t))
    return out


def corpus():
    rng = random.Random(8)
    names = ["Zelenka", "Ormond", "Quispe"]
    texts = []
    for i in range(400):
        words = [rng.choice(["alpha", "beta", "gamma", "delta"]) for _ in range(30)]
        if i % 10 < 3:
            k = i % 10
            words[5:5] = ["write", "to", names[k], f"person{k}@mail.example.org", "soon"]
        texts.append(" ".join(words) if i % 37 else None)
    return texts


def test_terms_that_disclose(spark):
    texts = corpus()
    want = brute_terms(texts)
    assert {t for _, t in want} == {"zelenka", "ormond", "quispe"}
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    for r in I.find(docs).collect():
        text = texts[r.doc_id] or ""
        held = {t for e, t in want for k in I.KINDS for s in brute(text)[k] if e == f"{k}:{s[2]}"}
        terms = [(m.start(), m.end()) for m in re.finditer(r"[^\W\d_]{3,}", text) if m.group().lower() in held]
        assert [(s.start, s.end) for s in r.term] == terms


def test_sanitise(spark):
    texts = corpus()
    rows = [(i, t, "en", i) for i, t in enumerate(texts)] + [(None, "call +49 30 1234567 now, 4111 1111 1111 1111 or 300.1.1.1", "x", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, terms string, _row long")
    out = I.sanitise(docs)
    assert out.schema.names == docs.schema.names
    got = {r.doc_id: r for r in out.collect()}
    assert len(got) == len(rows)
    assert got[None].text == "call [PHONE] now, [CARD] or 300.1.1.1"
    assert all((g.text is None) == (texts[i] is None) and g.terms == "en" and g._row == i for i, g in got.items() if i is not None)
    joined = " ".join(g.text or "" for g in got.values())
    assert "@" not in joined
    assert "Zelenka" not in joined
    assert "[EMAIL]" in joined
    assert "[TERM]" in joined
    assert all(got[i].text == t for i, t in enumerate(texts) if t and "@" not in t)
    assert I.sanitise(docs.where("false")).count() == 0


def test_terms_of_rare_values(spark):
    rng = random.Random(4)
    texts = [" ".join(rng.choice(["alpha", "beta", "gamma", "delta"]) for _ in range(20)) for _ in range(3000)]
    texts[7] = "alpha beta Zelenka ze@mail.example.org gamma " + "delta " * 20 + "Faraway"
    for i in (20, 30, 40):
        texts[i] = f"beta Ormond or@mail.example.org gamma {i}"
    texts[50] = "beta Quispe qu@mail.example.org gamma"
    texts[60:80] = ["Quispe alpha beta"] * 20
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    found = {r.doc_id: [s.value for s in r.term] for r in I.find(docs).collect() if r.term}
    assert found == {7: ["Zelenka"], 20: ["Ormond"], 30: ["Ormond"], 40: ["Ormond"]}
    got = {r.doc_id: r.text for r in I.sanitise(docs).collect()}
    assert got[7] == texts[7].replace("Zelenka ze@mail.example.org", "[TERM] [EMAIL]")
    assert got[50] == "beta Quispe [EMAIL] gamma"


def test_whole_documents_as_context(spark):
    texts = ["alpha beta"] * 40 + ["Zelenka " + "beta " * 60 + "ze@mail.example.org"] * 6
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    near = {r.doc_id: [s.value for s in r.term] for r in I.find(docs).collect() if r.term}
    far = {r.doc_id: [s.value for s in r.term] for r in I.find(docs, context=None, support=1).collect() if r.term}
    assert near == {}
    assert far == {i: ["Zelenka"] for i in range(40, 46)}


def test_sanitise_cuts_the_spans_that_are_found(spark):
    texts = ["ring +33.1.42.68.53.00 now", "1.2.3.4@x.yz", "", None, "é +33.1.42.68.53.00, a@b.cd", *random_texts(6, 300), "a@b.cd 1.2.3.4 " * 1500]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.text for r in I.sanitise(docs).collect()}
    assert got[0] == "ring [PHONE] now"
    assert got[1] == "[EMAIL]"
    for r in I.find(docs).collect():
        spans = sorted((s.start, -s.end, I.MARK[k]) for k in (*I.KINDS, "term") for s in r[k])
        out, reach = [], 0
        for start, end, mark in spans:
            if start >= reach:
                out += [texts[r.doc_id][reach:start], mark]
            reach = max(reach, -end)
        assert got[r.doc_id] == (None if texts[r.doc_id] is None else "".join(out) + texts[r.doc_id][reach:])


def test_query_columns(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a@b.cd and 1.2.3.4"), (2, None)], "doc_id int, text string")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r for r in I.query(spark, str(tmp_path)).collect()}
    assert (got[1].n_email, got[1].n_ip, got[1].n_card, got[1].n_phone) == (1, 1, 0, 0)
    assert got[1].spans == "email:0:6,ip:11:18"
    assert got[1].base_sha256 == hashlib.sha256(b"email:0:6,ip:11:18").hexdigest()
    assert got[2].base_sha256 == hashlib.sha256(b"").hexdigest()
    assert dict(I.query(spark, str(tmp_path)).dtypes)["doc_id"] == "bigint"
    assert F  # the module is native: functions only
