"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics are counted from the bytes and words of the whole text; labels, lang, source and doc_id are no inputs. The
trees are grown on the driver over binned statistics of a bounded sample of labelled rows (TRAIN_ROWS at most, chosen by the
hash of doc_id and, if an id has many rows, by that of the row, never rows held out), flattened into arrays and broadcast (some 100 kB), and walked by numpy for whole Arrow
batches at once.

Defined cases: null and empty texts have all-zero statistics and a score like any other; rows of labels with null
doc_id or quality, or without a document, teach nothing; several labels of one document all teach; without labels the score is 0.5, and
with labels of one class the score is near that class; repeated documents are each scored; an empty table gives no rows.
Columns other than doc_id and text are passed through by :func:`keep_good` and ignored by :func:`score`.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .segments import slices
from .shared import cut, documents, packed, table, unpacked, utf8

#: Labelled rows that training uses at most; trees, depth, bins, learning rate; score from which a document is good.
TRAIN_ROWS, TREES, DEPTH, BINS, RATE, THRESHOLD = 20_000, 80, 4, 64, 0.15, 0.3
FOLDS = 5
#: Chosen labels (id and label, 12 bytes) that are broadcast; more of them, as when ids repeat, are joined otherwise.
BROADCAST_ROWS = 200_000

_KIND = np.zeros((256, 8), np.int64)  # letters lower, upper, digits, spaces, newlines, sentence marks, other ASCII, beyond ASCII
for _b in range(256):
    _c = chr(_b)
    _KIND[_b, 7 if _b >= 128 else 0 if _c.islower() else 1 if _c.isupper() else 2 if _c.isdigit() else 4 if _c == "\n" else 3 if _c.isspace() else 5 if _c in ".,;:?'\"()-" else 6] = 1
_SYMBOL = _KIND[:, 6].tolist()  # ASCII marks that end no sentence and open or close nothing
FEATURES = 27


def statistics(column: pa.Array) -> np.ndarray:
    """One row of statistics for each text."""
    data, offsets = utf8(column)
    out = np.zeros((len(column), FEATURES))
    body = data.tobytes()
    for i, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
        if a == b:
            continue
        n = b - a
        counts = np.bincount(data[a:b], minlength=256)
        kinds = counts @ _KIND
        letters = max(1, int(kinds[0] + kinds[1] + kinds[7]))
        share = counts[counts > 0] / n
        text = body[a:b]
        words = text.split()
        m = max(1, len(words))
        lengths = np.fromiter(map(len, words), np.int64, len(words)) if words else np.zeros(1, np.int64)
        distinct = len(set(words))
        same_next = sum(map(bytes.__eq__, words, words[1:]))
        lines = text.split(b"\n")
        filled = [x for x in lines if x.strip()]
        tails = sum(_SYMBOL[w[-1]] for w in words)
        repeated = sum(len(w) > 1 and w[-1] == w[-2] and not w[-1:].isalnum() for w in words)
        out[i] = [
            np.log1p(n), np.log1p(len(words)), *(kinds / n).tolist(),
            kinds[1] / letters, -(share * np.log2(share)).sum(), counts.max() / n,
            lengths.mean(), lengths.std(), lengths.max(), distinct / m, distinct / np.sqrt(m), same_next / m,
            np.log1p(len(lines)), len(set(filled)) / max(1, len(filled)), n / max(1, len(filled)) / 100.0,
            tails / m, repeated / m, sum(w[:1].isupper() for w in words) / m, sum(w.isupper() for w in words) / m, (lengths == 1).sum() / m,
        ]
    return out


# --- trees ------------------------------------------------------------------------------------------------------------


class Boosted:
    """Complete binary trees in arrays: node i has children 2i + 1 and 2i + 2; a row goes right where bin > cut."""

    def __init__(self, base: float = 0.0, edges: np.ndarray | None = None):
        self.base = base
        self.edges = np.zeros((FEATURES, BINS - 1)) if edges is None else edges
        self.feature = np.zeros((0, 2**DEPTH - 1), np.int16)
        self.cut = np.zeros((0, 2**DEPTH - 1), np.int16)
        self.value = np.zeros((0, 2**DEPTH))

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(self.edges)], axis=1).astype(np.int16)

    def margin(self, binned: np.ndarray) -> np.ndarray:
        rows, total = np.arange(len(binned)), np.full(len(binned), self.base)
        for feature, cut, value in zip(self.feature, self.cut, self.value, strict=True):
            node = np.zeros(len(binned), np.int64)
            for _ in range(DEPTH):
                node = 2 * node + 1 + (binned[rows, feature[node]] > cut[node])
            total += value[node - (2**DEPTH - 1)]
        return total

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.margin(self.bins(x)))) if len(x) else np.zeros(0)


def fit(x: np.ndarray, y: np.ndarray) -> Boosted:
    """Boost logistic loss with second-order leaf values."""
    if not len(y):
        return Boosted(0.0)
    rate = (y.sum() + 0.5) / (len(y) + 1)
    edges = np.quantile(x, np.linspace(0, 1, BINS + 1)[1:-1], axis=0).T.copy()
    model = Boosted(float(np.log(rate / (1 - rate))), edges)
    if y.min() == y.max():
        return model
    binned = model.bins(x)
    flat = binned.astype(np.int64) + np.arange(FEATURES) * BINS
    margin = np.full(len(y), model.base)
    features, cuts, values = [], [], []
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-margin))
        grad, hess = p - y, np.maximum(p * (1 - p), 1e-6)
        feature, cut = np.zeros(2**DEPTH - 1, np.int16), np.full(2**DEPTH - 1, BINS, np.int16)
        node = np.zeros(len(y), np.int64)
        for level in range(DEPTH):
            width = 2**level
            place = (node[:, None] * (FEATURES * BINS) + flat).reshape(-1)
            g, h = (np.bincount(place, np.repeat(v, FEATURES), width * FEATURES * BINS).reshape(width, FEATURES, BINS) for v in (grad, hess))
            gl, hl = g.cumsum(axis=2)[:, :, :-1], h.cumsum(axis=2)[:, :, :-1]
            gt, ht = g.sum(axis=2, keepdims=True), h.sum(axis=2, keepdims=True)
            gain = gl**2 / (hl + 1) + (gt - gl) ** 2 / (ht - hl + 1) - gt**2 / (ht + 1)
            gain[(hl < 1) | (ht - hl < 1)] = 0
            best = gain.reshape(width, -1).argmax(axis=1)
            for i in range(width):
                if gain[i].reshape(-1)[best[i]] > 1e-6:
                    feature[width - 1 + i], cut[width - 1 + i] = divmod(int(best[i]), BINS - 1)
            at = node + width - 1
            node = 2 * node + (binned[np.arange(len(y)), feature[at]] > cut[at])
        g, h = np.bincount(node, grad, 2**DEPTH), np.bincount(node, hess, 2**DEPTH)
        value = -RATE * g / (h + 1)
        margin += value[node]
        features.append(feature)
        cuts.append(cut)
        values.append(value)
    model.feature, model.cut, model.value = np.array(features), np.array(cuts), np.array(values)
    return model


# --- Spark ------------------------------------------------------------------------------------------------------------


def held_out():
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(FOLDS)) == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Boosted:
    """Fit on labelled documents that are not held out."""
    usable = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).where("doc_id IS NOT NULL AND quality IN (0, 1)").where(~held_out())
    n = usable.count()
    if not n:
        return fit(np.zeros((0, FEATURES)), np.zeros(0))
    share = min(1.0, rows / n)
    chosen = cut(usable.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < F.lit(round(share * (1 << 20)))))
    if chosen.count() <= BROADCAST_ROWS:
        chosen = F.broadcast(chosen)
    taught = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(chosen, "doc_id")
    taught = taught.select("quality", F.xxhash64("doc_id", "quality", "text").alias("order"), "text")

    def run(batches):
        for batch in batches:
            for some in slices(batch, "text"):
                x = statistics(some.column("text")).astype("<f8")
                yield pa.RecordBatch.from_arrays([some.column("quality"), some.column("order"), pa.array([r.tobytes() for r in x], pa.binary())], ["quality", "order", "x"])

    made = taught.mapInArrow(run, "quality int, order long, x binary")
    got = made.orderBy("order", "quality", "x").limit(rows).collect()  # bounded, however many rows an id has
    got = sorted((bytes(r.x), r.quality) for r in got)  # the same trees whatever the order of rows
    x = np.frombuffer(b"".join(a for a, _ in got), "<f8").reshape(-1, FEATURES)
    return fit(x, np.array([q for _, q in got], np.float64))


def score(docs: DataFrame, model: Boosted, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The carried columns with the score of each document."""
    from pyspark.sql import types as T

    held = docs.sparkSession.sparkContext.broadcast(model)
    kept = docs.select(*carry).schema.fields
    schema = T.StructType([*kept, T.StructField("_score", T.DoubleType())])

    def run(batches):
        for batch in batches:
            for some in slices(batch, "_text"):
                made = held.value.score(statistics(some.column("_text")))
                yield pa.RecordBatch.from_arrays([*(some.column(f.name) for f in kept), pa.array(made)], [f.name for f in schema.fields])

    return docs.select(*carry, F.col("text").alias("_text")).mapInArrow(run, schema)


def keep_good(docs: DataFrame, model: Boosted) -> DataFrame:
    """The documents with a score of THRESHOLD or more, with all their columns."""
    return unpacked(score(packed(docs), model, ("rest", "text")).where(F.col("_score") >= THRESHOLD), docs.columns)


def query(spark, sf_dir: str) -> DataFrame:
    """All documents, learnt from the labels."""
    docs, labels = documents(spark, sf_dir), table(spark, sf_dir, "labels")
    docs = docs.withColumn("doc_id", F.col("doc_id").cast("long"))
    scored = score(docs, train(docs, labels))
    return scored.select("doc_id", held_out().alias("held_out"), F.col("_score").alias("score"), (F.col("_score") >= THRESHOLD).cast("int").alias("predicted"))
