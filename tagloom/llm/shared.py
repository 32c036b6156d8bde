"""Helpers that the operators share: reading tables, cutting lineage, and word arrays over Arrow buffers."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.arrow import spread


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where it is unset, one is made on this machine, which only a driver that is its own executor may use.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("on a cluster, spark.checkpoint.dir must name a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="tagloom-checkpoints-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def _path(spark: SparkSession, where: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(where)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back, so that a lost executor costs no recomputation.

    The files go when the session's JVM ends, or earlier through :func:`release`.
    """
    spark = df.sparkSession
    where = f"{shared_dir(spark).rstrip('/')}/tagloom-{uuid.uuid4().hex}"
    df.write.parquet(where)
    path, fs = _path(spark, where)
    fs.deleteOnExit(path)
    back = spark.read.schema(df.schema).parquet(where)
    back._tagloom_path = where
    return back


def release(df: DataFrame) -> None:
    """Delete a table made by :func:`cut` that no later DataFrame reads."""
    where = getattr(df, "_tagloom_path", None)
    if where:
        path, fs = _path(df.sparkSession, where)
        fs.delete(path, True)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table ``documents``, dealt over all cores if it has fewer splits than cores; a large one is left as it is split."""
    return spread(table(spark, sf_dir, "documents"))


def packed(docs: DataFrame) -> DataFrame:
    """``text``, and all other columns in a struct ``rest``, so that names an operator uses cannot clash with theirs."""
    others = [F.col(f"`{c}`") for c in docs.columns if c != "text"]
    return docs.select(F.struct(*(others or [F.lit(None).cast("long").alias("doc_id")])).alias("rest"), "text")


def unpacked(df: DataFrame, names: list[str]) -> DataFrame:
    """The columns of these names again."""
    return df.select(*[F.col("text") if c == "text" else F.col("rest").getField(c).alias(c) for c in names])


def text_or_empty(column: str = "text"):
    return F.coalesce(F.col(column), F.lit(""))


# --- words over the bytes of an Arrow column -------------------------------------------------------------------------

_MULT = np.uint64(0x9E3779B97F4A7C15 | 1)
_POWERS = np.ones(1, np.uint64)


def _powers(n: int) -> np.ndarray:
    global _POWERS
    if len(_POWERS) < n:
        with np.errstate(over="ignore"):
            _POWERS = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(max(n, 1 << 16) - 1, _MULT)]), dtype=np.uint64)
    return _POWERS


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, so that every bit of a hash depends on all of the input."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> np.uint64(30))
        x = x * np.uint64(0xBF58476D1CE4E5B9)
        x = x ^ (x >> np.uint64(27))
        x = x * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


#: Bytes of text that numpy handles at once.
BLOCK = 1 << 21


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit polynomial hashes of the byte spans, in blocks of about BLOCK bytes whatever the length of the texts.

    Equal bytes have equal hashes; callers that need certainty compare the bytes as well. Spans are ascending and
    disjoint.
    """
    out = np.empty(len(starts), np.uint64)
    at = 0
    with np.errstate(over="ignore"):
        while at < len(starts):
            lo = int(starts[at])
            to = max(at + 1, int(np.searchsorted(ends, lo + BLOCK, side="right")))
            hi = int(ends[to - 1])
            lengths = ends[at:to] - starts[at:to]
            if hi - lo > 2 * BLOCK:  # one span of its own
                out[at:to] = _long_hash(data[lo:hi])
                at = to
                continue
            # reduceat over data * M^(place in the span)
            within = np.arange(lo, hi)
            s, e = starts[at:to] - lo, ends[at:to] - lo
            cover = np.zeros(hi - lo + 1, np.int32)
            np.add.at(cover, s, 1) if len(s) < 64 else cover.__setitem__(s, 1)
            owner = np.cumsum(cover[:-1], dtype=np.int32) - 1
            place = within - (s[owner] + lo)
            body = (data[lo:hi].astype(np.uint64) + np.uint64(1)) * _powers(int(place.max(initial=0)) + 1)[place]
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(body, dtype=np.uint64)])
            out[at:to] = mix((sums[e] - sums[s]) ^ (lengths.astype(np.uint64) << np.uint64(40)))
            at = to
    return out


def _long_hash(body: np.ndarray) -> np.uint64:
    total, n = np.uint64(0), len(body)
    powers = _powers(BLOCK)
    step = np.uint64(1)
    leap = powers[BLOCK - 1] * _MULT
    for i in range(0, n, BLOCK):
        part = body[i : i + BLOCK].astype(np.uint64) + np.uint64(1)
        total = total + step * np.sum(part * powers[: len(part)], dtype=np.uint64)
        step = step * leap
    return mix(np.array([total ^ (np.uint64(n) << np.uint64(40))], np.uint64))[0]


class HashIndex:
    """Places of 64-bit keys in the order they were added: open addressing over arrays."""

    def __init__(self, bits: int = 16):
        self.bits, self.keys = bits, np.zeros(0, np.uint64)
        self.table = np.full(1 << bits, -1, np.int32)

    def _spot(self, keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((keys * _MULT) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The place of each key, or -1."""
        out = np.full(len(keys), -1, np.int64)
        if not len(self.keys) or not len(keys):
            return out
        left, spot, wanted, last = None, self._spot(keys), keys, (1 << self.bits) - 1
        while True:
            at = self.table[spot]
            same = (self.keys[at] == wanted) & (at >= 0)
            if left is None:
                out[same] = at[same]
            else:
                out[left[same]] = at[same]
            on = np.flatnonzero((at >= 0) & ~same)
            if not len(on):
                return out
            left = on if left is None else left[on]
            wanted, spot = wanted[on], (spot[on] + 1) & last

    def add(self, keys: np.ndarray) -> None:
        """Add distinct keys that are not yet in."""
        start = len(self.keys)
        self.keys = np.concatenate([self.keys, keys])
        if 3 * len(self.keys) > 1 << self.bits:
            while 3 * len(self.keys) > 1 << self.bits:
                self.bits += 1
            self.table = np.full(1 << self.bits, -1, np.int32)
            start = 0
        new = np.arange(start, len(self.keys), dtype=np.int32)
        spot, last = self._spot(self.keys[start:]), (1 << self.bits) - 1
        while len(new):
            free = np.flatnonzero(self.table[spot] < 0)
            self.table[spot[free]] = new[free]
            on = self.table[spot] != new
            new, spot = new[on], (spot[on] + 1) & last


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column (null: empty), and len + 1 offsets into them."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null("").cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    body = column.buffers()[2]
    data = np.frombuffer(body, np.uint8) if body is not None and body.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]] if len(offsets) else data, offsets - offsets[0] if len(offsets) else np.zeros(1, np.int64)


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return _LOWER[data]


def runs(member: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of member bytes that do not cross document ends: starts, ends, and the first run of each document."""
    n = len(member)
    if not n:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offsets), np.int64)
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    before = np.empty(n, bool)
    before[0], before[1:] = False, member[:-1]
    starts = np.flatnonzero(member & (~before | edge[:-1]))
    after = np.empty(n, bool)
    after[-1], after[:-1] = False, member[1:]
    ends = np.flatnonzero(member & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)
