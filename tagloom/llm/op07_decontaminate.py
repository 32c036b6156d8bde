"""Benchmark decontamination: a broadcast hash set of the test items' word windows against every training token window.

Words are maximal runs of ASCII letters, digits and characters beyond ASCII, with A-Z lower-cased; a window is ten
consecutive words of an item, or all of a shorter item's. Hash hits are verified on the words themselves. One broadcast
holds at most SET_BYTES: windows cost WINDOW_BYTES each, and their words are kept once an item. A larger benchmark is
made distinct, long items are cut into pieces that overlap by a window less one word, and the pieces are dealt by hash into
parts, more of them until each is within the bound. Every part is scanned over the same texts, the hits are united by
document, and only then is anything removed, so results do not depend on the number of parts; a part's broadcast is
destroyed once its hits are written.

Defined cases: null texts and texts without words have no hits; items without words give no window; several rows of one
item_id are one item; hits of an item whose id is null count as hits but it is not listed; repeated documents are each
reported; an empty benchmark hits nothing. Columns other than those named are passed through by
:func:`remove_contamination` and ignored by :func:`contamination`.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .segments import slices
from .shared import HashIndex, cut, documents, lower_ascii, mix, packed, release, runs, span_hashes, table, unpacked, utf8

WINDOW = 10
#: Bytes of one broadcast set, and of one window in it (hash, place, item, length, index).
SET_BYTES, WINDOW_BYTES = 32 << 20, 40
#: A document of which more than this share of words is hit is removed, else its hit spans are.
REMOVE_SHARE = 0.5

_WORD = np.zeros(256, bool)
_WORD[48:58] = _WORD[97:123] = _WORD[128:] = True


class Words:
    """The words of a column of texts: lower-cased bytes, spans, hashes, and the first word of each document."""

    def __init__(self, column: pa.Array):
        self.raw, offsets = utf8(column)
        self.data = lower_ascii(self.raw)
        self.starts, self.ends, self.first = runs(_WORD[self.data], offsets)
        self.hashes = span_hashes(self.data, self.starts, self.ends)
        self.offsets = offsets

    def window_hashes(self, k: int) -> np.ndarray:
        n = len(self.hashes) - k + 1
        if n <= 0:
            return np.zeros(0, np.uint64)
        total = np.zeros(n, np.uint64)
        with np.errstate(over="ignore"):
            for j in range(k):
                total = total * np.uint64(0x9E3779B97F4A7C15) + self.hashes[j : j + n]
        return mix(total)

    def key(self, i: int, k: int) -> bytes:
        return b" ".join(self.data[s:e].tobytes() for s, e in zip(self.starts[i : i + k].tolist(), self.ends[i : i + k].tolist(), strict=True))


class WindowSet:
    """Windows of benchmark items: by length, their hashes in order, and for each the places in the items' words."""

    def __init__(self, items: list[tuple[str | None, str | None]], window: int = WINDOW):
        self.names = [item for item, _ in items]
        self.words = Words(pa.array([t for _, t in items], pa.string()))
        size = np.diff(self.words.first)
        lengths = np.minimum(size, window)
        self.groups: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for k in np.unique(lengths[lengths > 0]).tolist():
            own = np.flatnonzero(lengths == k)
            count = size[own] - k + 1
            item = np.repeat(own, count)
            at = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(self.words.first[own], count)
            hashes = self.words.window_hashes(k)[at]
            order = np.lexsort((at, item, hashes))
            hashes, item, at = hashes[order], item[order], at[order]
            again = np.flatnonzero((hashes[1:] == hashes[:-1]) & (item[1:] == item[:-1])) + 1
            keep = np.ones(len(at), bool)
            keep[[i for i in again.tolist() if self.words.key(int(at[i]), k) == self.words.key(int(at[i - 1]), k)]] = False
            self.groups[k] = hashes[keep], item[keep].astype(np.int32), at[keep].astype(np.int32)
        self._index: dict[int, tuple[HashIndex, np.ndarray]] | None = None

    def __getstate__(self):
        return {**self.__dict__, "_index": None}

    def items(self, k: int, place: int, key: bytes) -> tuple | None:
        """The ids of the items that hold this window, of those with the place-th hash; None if no item does."""
        _, item, at = self.groups[k]
        first = self._index[k][1]
        same = [i for i in range(int(first[place]), int(first[place + 1])) if self.words.key(int(at[i]), k) == key]
        return tuple({self.names[item[i]] for i in same} - {None}) if same else None

    def scan(self, words: Words) -> tuple[np.ndarray, list[tuple[int, str]]]:
        """Which words are hit, and (document, item) for each verified window."""
        if self._index is None:
            self._index = {}
            for k, (hashes, _, _) in self.groups.items():
                distinct, first = np.unique(hashes, return_index=True)
                index = HashIndex(12)
                index.add(distinct)
                self._index[k] = index, np.append(first, len(hashes))
        hit = np.zeros(len(words.starts) + 1, np.int32)
        found: set[tuple[int, str]] = set()
        seen: dict[tuple[int, bytes], tuple | None] = {}
        for k, (index, _) in self._index.items():
            places = index.find(words.window_hashes(k))
            at = np.flatnonzero(places >= 0)
            if not len(at):
                continue
            doc = np.searchsorted(words.first, at, side="right") - 1
            inside = at + k <= words.first[doc + 1]
            for i, d in zip(at[inside].tolist(), doc[inside].tolist(), strict=True):
                raw = k, words.data[words.starts[i] : words.ends[i + k - 1]].tobytes()
                if raw not in seen:
                    seen[raw] = self.items(k, int(places[i]), words.key(i, k))
                if (items := seen[raw]) is None:
                    continue
                hit[i] += 1
                hit[i + k] -= 1
                found.update((d, x) for x in items)
        return np.cumsum(hit[:-1]) > 0, sorted(found)


class Parts:
    """The benchmark in window sets of at most ``limit`` bytes each."""

    def __init__(self, benchmark: DataFrame, window: int = WINDOW, limit: int = SET_BYTES):
        self.window, self.pieces, self.count, self.limit = window, None, 1, limit
        rows = benchmark.select(F.col("item_id").cast("string").alias("item"), "text").where(F.col("text").isNotNull())
        bound = F.octet_length("text").cast("long") * (WINDOW_BYTES // 2 + 2)  # a word takes two bytes at least
        self.rows, total = rows, rows.agg(F.sum(bound)).first()[0] or 0
        if total <= limit:
            return
        # the bound of the bytes may be far off: weigh the words themselves
        w = F.regexp_extract_all(F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"), F.lit(0))
        words = rows.distinct().select("item", w.alias("w")).where(F.size("w") > 0)
        step = max(window, limit // (8 * (WINDOW_BYTES + 8)))
        starts = F.sequence(F.lit(0), F.greatest(F.size("w") - window, F.lit(0)), F.lit(step))
        piece = F.slice("w", F.col("s") + 1, step + window - 1)
        pieces = words.select("item", "w", F.explode(starts).alias("s")).select("item", F.array_join(piece, " ").alias("text"), F.size(piece).alias("n")).distinct()
        self.pieces = cut(pieces.select("item", "text", (F.octet_length("text") + F.col("n") * WINDOW_BYTES).cast("long").alias("bytes"), F.xxhash64("item", "text").alias("h")))
        total, longest = self.pieces.agg(F.sum("bytes"), F.max("bytes")).first()
        self.limit = limit = max(limit, 8 * (longest or 0))  # if words are very long
        self.count = max(1, -(-2 * (total or 0) // limit))
        while self.count > 1 and self.pieces.groupBy(self._part()).agg(F.sum("bytes").alias("b")).agg(F.max("b")).first()[0] > limit:
            self.count = -(-self.count * 5 // 4)

    def _part(self):
        return F.pmod(F.col("h"), F.lit(self.count))

    def __iter__(self):
        for p in range(self.count):
            some = self.rows if self.pieces is None else self.pieces.where(self._part() == p)
            yield WindowSet([tuple(r) for r in some.select("item", "text").distinct().collect()], self.window)

    def close(self) -> None:
        if self.pieces is not None:
            release(self.pieces)


def _scan(docs: DataFrame, key: str, held, only_hits: bool = False) -> DataFrame:
    """(key, n_words, hits, items) of each document, or of those with hits only; held is a broadcast WindowSet."""

    def run(batches):
        for batch in batches:
            for some in slices(batch, "text"):
                words = Words(some.column("text"))
                hit, found = held.value.scan(words)
                at = np.flatnonzero(hit)
                hits = pa.ListArray.from_arrays(pa.array(np.searchsorted(at, words.first), pa.int32()), pa.array(at - words.first[np.searchsorted(words.first, at, side="right") - 1], pa.int64()))
                docs_found = np.array([d for d, _ in found], np.int64)
                items = pa.ListArray.from_arrays(pa.array(np.searchsorted(docs_found, np.arange(some.num_rows + 1)), pa.int32()), pa.array([x for _, x in found], pa.string()))
                out = pa.RecordBatch.from_arrays([some.column(key), pa.array(np.diff(words.first), pa.int64()), hits, items], [key, "n_words", "hits", "items"])
                yield out.filter(pa.array(hits.value_lengths().to_numpy() > 0)) if only_hits else out

    return docs.select(F.col(key).cast("long").alias(key), "text").mapInArrow(run, f"{key} long, n_words long, hits array<bigint>, items array<string>")


def _united(rows: DataFrame, parts: Parts) -> DataFrame:
    """(_row, hits, items) of the rows that any part hits, all parts taken together."""
    context = rows.sparkSession.sparkContext
    passes = []
    for windows in parts:
        held = context.broadcast(windows)
        passes.append(cut(_scan(rows, "_row", held, only_hits=True)))
        held.destroy()
    every = reduce(DataFrame.unionByName, passes)
    united = cut(every.groupBy("_row").agg(*[F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c) for c in ("hits", "items")]))
    for p in passes:
        release(p)
    return united


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, limit: int = SET_BYTES) -> DataFrame:
    """Per document: doc_id, n_words, hits (places of hit words) and items (ids of items with occurring windows)."""
    parts = Parts(benchmark, window, limit)
    context = docs.sparkSession.sparkContext
    if parts.count == 1:
        return _scan(docs, "doc_id", context.broadcast(next(iter(parts))))
    rows = cut(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("_row", F.monotonically_increasing_id()))
    counted = _scan(rows, "_row", context.broadcast(WindowSet([], window))).select("_row", "n_words")
    united = _united(rows, parts)
    parts.close()
    found = rows.select("_row", "doc_id").join(counted, "_row").join(united, "_row", "left")
    return found.select("doc_id", "n_words", F.coalesce("hits", F.array().cast("array<bigint>")).alias("hits"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def digest(found: DataFrame) -> DataFrame:
    return found.select(
        F.col("doc_id"),
        "n_words",
        F.size("hits").cast("long").alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"),
        (F.size("hits") > 0).alias("contaminated"),
    )


def remove_contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, limit: int = SET_BYTES) -> DataFrame:
    """The documents without the hit spans; those of which over REMOVE_SHARE of the words are hit are removed.

    Where a cut brings the words around it together as a window, that is cut as well, until none is left.
    """
    names = docs.columns
    parts = Parts(benchmark, window, limit)
    docs = packed(docs)
    if parts.count == 1:
        windows = next(iter(parts))
        return unpacked(_clean(docs, docs.sparkSession.sparkContext.broadcast(windows)), names) if windows.groups else docs.select(*_columns(names))
    now = cut(docs.withColumns({"_row": F.monotonically_increasing_id(), "_words": F.lit(None).cast("long"), "_gone": F.lit(0).cast("long")}))
    done = []
    while True:
        hits = _united(now, parts)
        if hits.isEmpty():
            done.append(now)
            break
        done.append(now.join(hits, "_row", "left_anti"))
        now = cut(_cut_out(now.join(hits.select("_row", "hits"), "_row"), now.schema))
    parts.close()
    every = reduce(DataFrame.unionByName, done)
    return unpacked(every.where(F.col("_gone") <= REMOVE_SHARE * F.coalesce("_words", F.lit(0))), names)


def _columns(names: list[str]):
    return [F.col("text") if c == "text" else F.col("rest").getField(c).alias(c) for c in names]


def _without(words: Words, hit: np.ndarray, first: int, last: int) -> str:
    """The text of the document with the words first to last - 1, without the words that are hit."""
    d = int(np.searchsorted(words.first, first, side="right")) - 1
    at, end = int(words.offsets[d]), int(words.offsets[d + 1])
    edge = np.diff(np.concatenate([[0], hit[first:last].astype(np.int8), [0]]))
    raw, kept = words.raw, []
    for a, b in zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist(), strict=True):
        kept.append(raw[at : words.starts[first + a]].tobytes())
        at = int(words.ends[first + b - 1])
    kept.append(raw[at:end].tobytes())
    return b"".join(kept).decode()


def _cut_out(docs: DataFrame, schema) -> DataFrame:
    """Documents with a column hits: the words that are hit cut out and counted."""

    def run(batches):
        for batch in batches:
            for some in slices(batch, "text"):
                words = Words(some.column("text"))
                lists = some.column("hits")
                size = lists.value_lengths().to_numpy()
                hit = np.zeros(len(words.starts), bool)
                hit[lists.flatten().to_numpy() + np.repeat(words.first[:-1], size)] = True
                texts = [_without(words, hit, int(a), int(b)) for a, b in zip(words.first[:-1], words.first[1:], strict=True)]
                columns = {n: some.column(n) for n in schema.names}
                columns["text"] = pa.array(texts, some.schema.field("text").type)
                columns["_words"] = pa.array([b if a is None else a for a, b in zip(columns["_words"].to_pylist(), np.diff(words.first).tolist(), strict=True)], pa.int64())
                columns["_gone"] = pa.array(columns["_gone"].to_numpy() + size)
                yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    return docs.mapInArrow(run, schema)


def _clean(docs: DataFrame, held) -> DataFrame:
    """The same for a benchmark in one part: all rounds of a document in one go."""

    def clean(text: str) -> tuple[str, int]:
        gone = 0
        while True:
            words = Words(pa.array([text]))
            hit, _ = held.value.scan(words)
            if not hit.any():
                return text, gone
            gone += int(hit.sum())
            text = _without(words, hit, 0, len(hit))

    def run(batches):
        for batch in batches:
            for some in slices(batch, "text"):
                words = Words(some.column("text"))
                hit, _ = held.value.scan(words)
                total = np.diff(words.first)
                keep = np.ones(some.num_rows, bool)
                texts = None
                for d in np.unique(np.searchsorted(words.first, np.flatnonzero(hit), side="right") - 1).tolist():
                    texts = some.column("text").to_pylist() if texts is None else texts
                    texts[d], gone = clean(texts[d])
                    keep[d] = gone <= REMOVE_SHARE * total[d]
                columns = {n: some.column(n) for n in some.schema.names}
                if texts is not None:
                    columns["text"] = pa.array(texts, some.schema.field("text").type)
                out = pa.RecordBatch.from_arrays(list(columns.values()), list(columns))
                yield out if keep.all() else out.filter(pa.array(keep))

    return docs.mapInArrow(run, docs.schema)


def query(spark, sf_dir: str) -> DataFrame:
    """All documents against all of benchmark."""
    return digest(contamination(documents(spark, sf_dir), table(spark, sf_dir, "benchmark")))


_SPLIT = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
ORACLE_SQL = rf"""
WITH b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_SPLIT} AS w FROM benchmark),
b2 AS (SELECT item, w, least(len(w), 10) AS k FROM b WHERE len(w) > 0),
b3 AS (SELECT item, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM b2),
bw AS (SELECT DISTINCT item, k, array_to_string(w[i:i + k - 1], ' ') AS win FROM b3),
d AS (SELECT doc_id, {_SPLIT} AS w FROM documents),
d2 AS (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, (SELECT DISTINCT k FROM bw)),
dw AS (SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS win FROM d2),
m AS (SELECT doc_id, item, dw.k AS k, i FROM dw JOIN bw ON dw.k = bw.k AND dw.win = bw.win),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM (SELECT DISTINCT doc_id, k, i FROM m)) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM m) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit ON d.doc_id = hit.doc_id LEFT JOIN it ON d.doc_id = it.doc_id
"""
