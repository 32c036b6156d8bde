import random
import re

import pytest

from tagloom.llm import op04_licenses as L

WORD = re.compile(rb"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def shingles(text):
    words = WORD.findall((text or "").encode().lower())
    return [tuple(words[i : i + 5]) for i in range(len(words) - 4)]


def brute(text, templates):
    """Licenses by the definition: in windows of the template's class, joined where they overlap, read from the left."""
    own, found = shingles(text), []
    for name in sorted(templates):
        wanted = set(shingles(templates[name]))
        step, long = L.grid(len(wanted).bit_length() - 1)
        inside, last = set(), 0
        stretches = []
        for start in range(0, max(0, -(-(len(own) - long) // step)) * step + 1, step):
            if len(wanted & set(own[start : start + long])) >= 0.8 * len(wanted):
                stretch = range(start, min(start + long, len(own)))
                if stretches and start < last:
                    stretches[-1] |= set(stretch)
                else:
                    stretches.append(set(stretch))
                last = start + long
        for inside in stretches:
            runs = [[]]
            for i in sorted(inside):
                if own[i] in wanted:
                    have = {own[j] for j in runs[-1]}
                    if own[i] in have and len(have) >= 0.8 * len(wanted):
                        runs.append([])
                    runs[-1].append(i)
            for run in runs:
                if len({own[i] for i in run}) >= 0.8 * len(wanted):
                    found.append((name, run[0], run[-1] + 5, len({own[i] for i in run}) / len(wanted)))
    return found


def test_against_brute_force(spark):
    rng = random.Random(4)
    filler = [f"w{i}" for i in range(300)]
    rows = [(0, None), (1, ""), (2, "four words are few"), (None, "Released under the MIT License.")]
    for i in range(3, 160):
        words = rng.choices(filler, k=rng.randrange(400))
        for name in rng.sample(sorted(L.TEMPLATES), rng.randrange(4)):
            body = L.TEMPLATES[name].split()
            for _ in range(rng.choice((0, 0, 1, len(body) // 12))):
                body[rng.randrange(len(body))] = "changed"
            at = rng.randrange(len(words) + 1)
            words[at:at] = body
        rows.append((i, " ".join(words).upper() if i % 5 == 0 else " ".join(words)))
    rows.append((500, "x " * 100_000 + L.TEMPLATES["MIT/text"] + " y" * 100_000))
    rows.append((501, " ".join([L.TEMPLATES["ISC/text"]] * 3 + ["x"] * 90 + [L.TEMPLATES["MIT/line"]] * 4 + ["y"] * 30 + [L.TEMPLATES["MIT/line"]])))
    rows += [rows[-3]] * 2
    docs = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, licenses string").repartition(3)
    want = sorted(((d, brute(t, L.TEMPLATES)) for d, t in rows), key=repr)
    assert [len([x for x in w if x[0] == n]) for d, w in want if d == 501 for n in ("ISC/text", "MIT/line")] == [3, 5]
    for limit in (L.TEMPLATE_BYTES, 3000):  # in one part, and in several
        assert (len(L.parts(L.TEMPLATES, limit)) > 1) == (limit == 3000)
        found = sorted(((r.doc_id, [tuple(x) for x in r.licenses]) for r in L.licenses(docs, limit=limit).collect()), key=repr)
        assert found == want
    assert L.licenses(docs.where("false")).count() == 0


def test_bands_find_all_that_windows_hold():
    import pyarrow as pa

    rng = random.Random(6)
    texts = []
    for _ in range(300):
        name = rng.choice(sorted(L.TEMPLATES))
        body = [w for w in L.TEMPLATES[name].split() if rng.random() > 0.02]
        texts.append(" ".join(["pre"] * rng.randrange(200) + body + ["post"] * rng.randrange(200)))
    assert L.Scanner(L.TEMPLATES).scan(pa.array(texts)) == L.Scanner(L.TEMPLATES, bands=False).scan(pa.array(texts))


def test_bands_are_computed_near_their_shingles_only(monkeypatch):
    import pyarrow as pa

    scanner = L.Scanner(L.TEMPLATES)
    body, plain = L.TEMPLATES["MIT/text"], " ".join(f"w{i % 977}" for i in range(50_000))
    permuted, asked = L.Templates.permuted, []
    monkeypatch.setattr(L.Templates, "permuted", lambda self, h, k: asked.append(len(h)) or permuted(self, h, k))
    assert scanner.scan(pa.array([plain, None, ""])) == [[], [], []]
    assert not asked
    found = scanner.scan(pa.array([plain, f"{plain} {body} {plain}"]))
    assert [[x[0] for x in doc] for doc in found] == [[], ["MIT/text"]]
    assert asked and max(asked) < 3000


def test_bands_near_their_shingles_give_the_pairs_of_all_windows():
    import numpy as np
    import pyarrow as pa

    rng = random.Random(8)
    few = "a b c d e f".split()  # shingles repeat within and across templates and texts
    store = {f"t{i:02d}": " ".join(rng.choices(few, k=rng.randrange(5, 60))) for i in range(30)}
    for templates in (store, L.TEMPLATES):
        scanner, texts = L.Scanner(templates), [None, "", "a b c", "x y z u v w"]
        for _ in range(100):
            body = templates[rng.choice(sorted(templates))].split()
            a = rng.randrange(len(body))
            texts.append(" ".join(rng.choices([*few, "x", "y"], k=rng.randrange(60)) + body[a : a + rng.randrange(5, 200)] + ["z"] * rng.randrange(90)))
        texts.append(" ".join(templates[n] for n in sorted(templates)) + " y" * 20_000)
        rng.shuffle(texts)
        words = L.Words(pa.array([*texts, "", None]))
        hashes, first = words.window_hashes(5), words.first[:-1]
        size = np.maximum(np.diff(words.first) - 4, 0)
        places, near = scanner.own.least.find(hashes), 0
        for c in scanner.own.classes:
            at = np.flatnonzero(places >= 0)
            windows = L.Scanner._near(first, size, c, at[scanner.own.least_of[c][places[at]]]), L.Scanner._windows(first, size, c)
            pairs = [[(int(doc[w]), int(start[w]), int(end[w]), t) for w, t in scanner._retrieved(c, hashes, start, end)] for doc, start, end in windows]
            assert pairs[0] == pairs[1]
            near += len(pairs[0])
        assert near > 200


def test_a_large_store():
    import pyarrow as pa

    rng = random.Random(3)
    store = {f"t{i:03d}": " ".join(f"v{rng.randrange(50_000)}" for _ in range(rng.randrange(6, 500))) for i in range(400)}
    texts = [" ".join(["a"] * 30 + store[n].split() + ["b"] * 40 + store[m].split() * 2) for n, m in (rng.sample(sorted(store), 2) for _ in range(40))]
    assert L.Scanner(store).scan(pa.array(texts)) == [brute(t, store) for t in texts]


def test_spans_and_own_templates(spark, tmp_path):
    (tmp_path / "Own-1.0.txt").write_text("under the mit license c")
    assert L.read_templates(str(tmp_path)) == {"Own-1.0": "under the mit license c"}
    docs = spark.createDataFrame([(1, "a b Released under the MIT License. c")], "doc_id long, text string")
    assert [tuple(x) for x in L.licenses(docs).first().licenses] == [("MIT/line", 2, 7, 1.0)]
    assert [x.license for x in L.licenses(docs, {"own": "under the mit license c"}).first().licenses] == ["own"]
    with pytest.raises(ValueError, match="fewer than 5"):
        L.licenses(docs, {"short": "too few words here"})
