import random
import shutil

import pytest

pytest.importorskip("public_tokenizers")

import corpus_pipeline  # noqa: E402
from tagloom.llm import op07_decontaminate, op09_quality  # noqa: E402

from .test_decontamination import brute as contaminated  # noqa: E402
from .test_near_duplicates import classes, fingerprint  # noqa: E402
from .test_pii import brute as personal  # noqa: E402
from .test_tokens import sentencepiece_rows  # noqa: E402

NAMES = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(21)
    base = [f"word{i}" for i in range(200)]
    good = lambda n: " ".join(rng.choices(base, k=n)).capitalize() + "."
    items = [(i, good(14)) for i in range(6)]
    docs, labels = [], []
    for i in range(240):
        kind = i % 8
        text = good(60)
        if kind == 0:
            text = "".join(rng.choice("%$#@! xX") for _ in range(300))
        elif kind == 1:
            text = docs[-3][1] if len(docs) > 5 and docs[-3][1] else text
        elif kind == 2:
            text = good(30) + " " + rng.choice(items)[1] + " " + good(30)
        elif kind == 3:
            text = rng.choice(items)[1]
        elif kind == 4:
            text = good(40) + f" mail me{i}@mail.example.org or +49 30 {1000000 + i} " + good(10)
        docs.append((i, text, "en", "src", len(text)))
        labels.append((i, int(kind != 0), 0))
    docs += [(240, None, None, None, None), (241, "", "en", "src", 0), (None, good(30), "en", "src", 1), docs[4]]
    where = tmp_path_factory.mktemp("sf")
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{where}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{where}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{where}/benchmark.parquet")
    yield str(where), docs, items
    shutil.rmtree(where)


def collected(df):
    return [tuple(r) for r in df.select(*NAMES).collect()]


def test_stages_against_brute_force(spark, folder, tmp_path):
    where, docs, items = folder
    stage = dict(corpus_pipeline.STAGES)
    assert list(stage) == ["quality", "near_duplicates", "decontamination", "pii", "pieces"]

    def step(name, df):
        stage[name](spark, df, where).write.parquet(f"{tmp_path}/{name}")
        return spark.read.parquet(f"{tmp_path}/{name}")

    before = spark.read.parquet(f"{where}/documents.parquet")
    after = step("quality", before)
    assert after.columns == NAMES
    model = op09_quality.train(before, spark.read.parquet(f"{where}/labels.parquet"))
    scores = {(r.doc_id, r.text): r._score for r in op09_quality.score(before, model, ("doc_id", "text")).collect()}
    assert sorted(collected(after), key=repr) == sorted((d for d in docs if scores[d[0], d[1]] >= 0.3), key=repr)
    assert all(scores[d[0], d[1]] < 0.3 for d in docs if d[0] is not None and d[0] < 240 and d[0] % 8 == 0)

    rows, before = collected(after), after
    after = step("near_duplicates", before)
    root = classes([fingerprint(r[1]) for r in rows])
    best = {}
    for r in rows:
        c = root[fingerprint(r[1])]
        if c not in best or (r[0] is None, r[0] or 0) < (best[c][0] is None, best[c][0] or 0):
            best[c] = r
    assert sorted(collected(after), key=repr) == sorted(best.values(), key=repr)

    rows, before = collected(after), after
    after = step("decontamination", before)
    left = {r[0]: r for r in collected(after)}
    for r in rows:
        n, hit, *_ = contaminated(r[1], items)
        if not hit:
            assert left[r[0]] == r
        elif hit > op07_decontaminate.REMOVE_SHARE * n:
            assert r[0] not in left
        else:
            assert not contaminated(left[r[0]][1], items)[4]
            assert len(left[r[0]][1]) < len(r[1])

    rows, before = collected(after), after
    after = step("pii", before)
    clean = {r[0]: r for r in collected(after)}
    assert len(clean) == len(rows)
    for r in rows:
        spans = sorted((a, b, k) for k, found in personal(r[1]).items() for a, b, _ in found)
        if not spans:
            assert clean[r[0]] == r
        else:
            assert not any(personal(clean[r[0]][1]).values())

    rows = collected(after)
    final = {r.doc_id: r for r in step("pieces", after).collect()}
    for r, (n, ids, decoded) in zip(rows, sentencepiece_rows([r[1] for r in rows]), strict=True):
        f = final[r[0]]
        assert (f.n_tokens, f.ids_sha256, f.decoded_sha256, f.lang, f.source) == (n, ids, decoded, r[2], r[3])

    whole = {r.doc_id: r.ids_sha256 for r in corpus_pipeline.run(spark, where).collect()}
    assert whole == {i: r.ids_sha256 for i, r in final.items()}


def test_empty_documents(spark, folder, tmp_path):
    where, _, _ = folder
    shutil.copytree(where, tmp_path / "none", ignore=shutil.ignore_patterns("documents.parquet"))
    spark.read.parquet(f"{where}/documents.parquet").where("false").write.parquet(str(tmp_path / "none/documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).count() == 0
