import random
import zlib
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tagloom.llm import op09_quality as Q

SF = "/root/testdata/sf0.01"


def test_trees_against_plain_walks():
    rng = np.random.default_rng(1)
    x = rng.standard_normal((500, Q.FEATURES))
    y = ((x[:, 0] > 0.3) ^ (x[:, 1] > 0)).astype(float)
    model = Q.fit(x, y)
    binned = model.bins(x)

    def walk(row):
        total = model.base
        for feature, cut, value in zip(model.feature, model.cut, model.value, strict=True):
            node = 0
            for _ in range(Q.DEPTH):
                node = 2 * node + 1 + int(row[feature[node]] > cut[node])
            total += value[node - (2**Q.DEPTH - 1)]
        return total

    assert np.allclose([walk(r) for r in binned], model.margin(binned))
    assert ((model.score(x) > 0.5) == y).mean() > 0.97
    again = Q.fit(x, y)
    assert np.array_equal(model.score(x), again.score(x))


def plain_fit(x, y):
    """The same boosting, in loops over rows, statistics and cuts; gives the margin of every row."""
    rows, rate = range(len(y)), (sum(y) + 0.5) / (len(y) + 1)
    edges = [sorted(np.quantile(x[:, f], q) for q in np.linspace(0, 1, Q.BINS + 1)[1:-1]) for f in range(x.shape[1])]
    binned = [[sum(e < v for e in edges[f]) for f, v in enumerate(row)] for row in x]
    margin = [float(np.log(rate / (1 - rate)))] * len(y)
    for _ in range(Q.TREES):
        p = [1 / (1 + np.exp(-m)) for m in margin]
        grad, hess = [p[i] - y[i] for i in rows], [max(p[i] * (1 - p[i]), 1e-6) for i in rows]

        def grow(some, depth):
            g, h = sum(grad[i] for i in some), sum(hess[i] for i in some)
            best = (1e-6, None, None)
            for f in range(x.shape[1]) if depth < Q.DEPTH else ():
                for c in range(Q.BINS - 1):
                    left = [i for i in some if binned[i][f] <= c]
                    gl, hl = sum(grad[i] for i in left), sum(hess[i] for i in left)
                    gain = gl**2 / (hl + 1) + (g - gl) ** 2 / (h - hl + 1) - g**2 / (h + 1)
                    if hl >= 1 and h - hl >= 1 and gain > best[0] + 1e-12:
                        best = gain, f, c
            if best[1] is None:
                for i in some:
                    margin[i] += -Q.RATE * g / (h + 1)
                return
            grow([i for i in some if binned[i][best[1]] <= best[2]], depth + 1)
            grow([i for i in some if binned[i][best[1]] > best[2]], depth + 1)

        grow(list(rows), 0)
    return margin


def test_fit_against_plain_loops(monkeypatch):
    for name, value in (("TREES", 6), ("DEPTH", 2), ("BINS", 8), ("FEATURES", 3)):
        monkeypatch.setattr(Q, name, value)
    rng = np.random.default_rng(4)
    x = rng.standard_normal((50, 3))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.2)).astype(float)
    model = Q.fit(x, y)
    assert np.allclose(model.margin(model.bins(x)), plain_fit(x, y))


def test_training_is_bounded_for_repeated_ids(spark):
    docs = spark.range(3000).selectExpr("7L AS doc_id", "concat('word ', id) AS text").union(spark.range(50).selectExpr("id AS doc_id", "'some text' AS text"))
    labels = spark.createDataFrame([(i, i % 2) for i in range(50)], "doc_id long, quality int")
    seen = []
    fit, Q.fit = Q.fit, lambda x, y: seen.append(len(y)) or fit(x, y)
    try:
        Q.train(docs, labels, rows=100)
    finally:
        Q.fit = fit
    assert seen == [100]


def test_bins_of_tied_values():
    model = Q.fit(np.tile([[1.0]], (20, Q.FEATURES)), np.array([0.0, 1.0] * 10))
    assert np.allclose(model.score(np.ones((3, Q.FEATURES))), 0.5, atol=0.05)
    assert Q.fit(np.zeros((0, Q.FEATURES)), np.zeros(0)).score(np.ones((2, Q.FEATURES))).tolist() == [0.5, 0.5]
    assert Q.fit(np.ones((4, Q.FEATURES)), np.ones(4)).score(np.ones((1, Q.FEATURES)))[0] > 0.8


def test_statistics_of_odd_texts():
    x = Q.statistics(pa.array([None, "", " ", "\n\n", "a", "é" * 10, "word " * 100_000, "A.!!! %%"]))
    assert np.isfinite(x).all()
    assert not x[:2].any()


def documents(spark):
    rng = random.Random(3)
    good = lambda: " ".join(rng.choice(["The", "cat", "sat", "on", "mats", "while", "dogs", "ran."]) for _ in range(rng.randrange(20, 60)))
    junk = lambda: "".join(rng.choice("%$#@!xX9 ") for _ in range(rng.randrange(50, 200)))
    rows, labels = [], []
    for i in range(600):
        q = i % 2
        rows.append((i, good() if q else junk(), "s", 0.5))
        labels.append((i, q, 0))
    rows += [(600, None, "s", None), (601, "", None, None), (None, good(), "s", None), (5, good(), "s", None)]
    labels += [(None, 1, 0), (9999, 1, 0), (3, None, 0), (7, 1, 0)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, _score double").repartition(3), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), rows


def test_scores(spark):
    docs, labels, rows = documents(spark)
    model = Q.train(docs, labels)
    found = Q.score(docs.drop("_score"), model).collect()
    assert len(found) == len(rows)
    assert all(0 <= r._score <= 1 for r in found)
    right = [(r._score >= 0.3) == bool(r.doc_id % 2) for r in found if r.doc_id is not None and r.doc_id < 600 and r.doc_id != 5]
    assert sum(right) >= 0.98 * len(right)
    held = {r.doc_id: r.h for r in docs.select("doc_id", Q.held_out().alias("h")).collect()}
    assert all(h == (i is not None and zlib.crc32(str(i).encode()) % 5 == 0) for i, h in held.items())
    # labels of rows held out teach nothing
    flipped = labels.withColumn("quality", F.when(Q.held_out(), 1 - F.col("quality")).otherwise(F.col("quality")))
    other = Q.train(docs, flipped)
    assert np.array_equal(other.value, model.value)
    kept = Q.keep_good(docs, model)
    assert kept.schema.names == docs.schema.names
    assert kept.count() == sum(r._score >= Q.THRESHOLD for r in found)
    assert Q.score(docs.drop("_score").where("false"), model).count() == 0
    nothing = Q.train(docs, labels.where("false"))
    assert {r._score for r in Q.score(docs.drop("_score"), nothing).collect()} == {0.5}
    assert Q.train(docs.where("false"), labels).score(np.zeros((1, Q.FEATURES)))[0] == 0.5


@pytest.mark.skipif(not Path(SF).is_dir(), reason="no test data here")
def test_held_out_accuracy(spark):
    found = Q.query(spark, SF).where("held_out").join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").collect()
    assert len(found) > 50
    right = sum(r.predicted == r.quality for r in found) / len(found)
    assert right >= 0.9, right
