"""Token ids in a binary format of patched frame-of-reference blocks.

A file row (a *segment*) holds whole documents of some 64 Ki ids: a header, the documents' lengths, a block index and the
blocks. Each block of 128 ids stores its minimum, the differences packed at the width that holds nine in ten of them, and
for the others an exception list (place, high bits). Layout, little-endian::

    "PFR1" n_docs n_ids n_blocks | n_docs x u32 length | n_blocks x (u32 start, u32 minimum, u8 width, u8 exceptions) | body

The container is Parquet, so that Spark's committer makes files whole or absent when executors are lost, and any store
that Spark writes to will do. Documents are in ascending doc_id order within a part and parts are in order; documents
with equal ids are ordered by the hash of their text.

Texts are encoded as the library does by default: an added token such as ``<|endoftext|>`` inside a text is one id. A document
that holds one is encoded whole, all others by segment. With ``added=False`` such a token is text like any other.

Defined cases: a null text is empty and has the end id alone; null ids come first; repeated rows are encoded once each;
an empty table gives an empty file; other columns are ignored.
"""

from __future__ import annotations

import zlib
from functools import partial
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .segments import SegmentEncoder, slices
from .shared import cut, text_or_empty

BLOCK_IDS, KEEP = 128, 115  # the 116th smallest width of 128 holds nine in ten
SEGMENT_IDS = 1 << 16
MAGIC = b"PFR1"
FILE_SCHEMA = "part int, segment int, n_ids long, doc_ids array<bigint>, payload binary"


def _bit_length(x: np.ndarray) -> np.ndarray:
    return np.frexp(x.astype(np.float64))[1].astype(np.uint8)


def pack(ids: np.ndarray, lengths: np.ndarray) -> bytes:
    """One segment: ids of consecutive documents with these lengths."""
    n = len(ids)
    blocks = -(-n // BLOCK_IDS)
    padded = np.concatenate([ids.astype(np.uint32), np.full(blocks * BLOCK_IDS - n, ids[-1] if n else 0, np.uint32)]).reshape(blocks, BLOCK_IDS)
    low = padded.min(axis=1) if blocks else np.zeros(0, np.uint32)
    delta = padded - low[:, None]
    bits = _bit_length(delta)
    width = np.partition(bits, KEEP, axis=1)[:, KEEP].astype(np.int64) if blocks else np.zeros(0, np.int64)
    high = bits > width[:, None]
    odd = high.sum(axis=1)
    size = BLOCK_IDS // 8 * width + 5 * odd
    starts = np.cumsum(size) - size
    body = np.zeros(int(size.sum()), np.uint8)
    for w in np.unique(width):
        if w == 0:
            continue
        rows = np.flatnonzero(width == w)
        plain = np.unpackbits(np.ascontiguousarray(delta[rows]).view(np.uint8).reshape(len(rows), BLOCK_IDS, 4), axis=2, bitorder="little")[:, :, :w]
        packed = np.packbits(plain.reshape(len(rows), -1), axis=1, bitorder="little")
        body[starts[rows][:, None] + np.arange(packed.shape[1])] = packed
    row, place = np.nonzero(high)
    if len(row):
        rank = np.arange(len(row)) - np.repeat(np.cumsum(odd) - odd, odd)
        at = starts[row] + BLOCK_IDS // 8 * width[row]
        body[at + rank] = place
        over = (delta[row, place].astype(np.uint64) >> width[row].astype(np.uint64)).astype("<u4")
        body[(at + odd[row] + 4 * rank)[:, None] + np.arange(4)] = over.view(np.uint8).reshape(-1, 4)
    head = np.array([len(lengths), n, blocks], "<u4").tobytes()
    return b"".join([MAGIC, head, lengths.astype("<u4").tobytes(), starts.astype("<u4").tobytes(), low.astype("<u4").tobytes(), width.astype(np.uint8).tobytes(), odd.astype(np.uint8).tobytes(), body.tobytes()])


def unpack(payload: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The ids of a segment and its documents' lengths."""
    if payload[:4] != MAGIC:
        raise ValueError("not a segment of token ids")
    docs, n, blocks = np.frombuffer(payload, "<u4", 3, 4).tolist()
    at = 16
    lengths = np.frombuffer(payload, "<u4", docs, at)
    starts = np.frombuffer(payload, "<u4", blocks, at := at + 4 * docs).astype(np.int64)
    low = np.frombuffer(payload, "<u4", blocks, at := at + 4 * blocks)
    width = np.frombuffer(payload, np.uint8, blocks, at := at + 4 * blocks).astype(np.int64)
    odd = np.frombuffer(payload, np.uint8, blocks, at := at + blocks).astype(np.int64)
    body = np.frombuffer(payload, np.uint8, offset=at + blocks) if len(payload) > at + blocks else np.zeros(0, np.uint8)
    delta = np.zeros((blocks, BLOCK_IDS), np.uint32)
    for w in np.unique(width):
        if w == 0:
            continue
        rows = np.flatnonzero(width == w)
        packed = body[starts[rows][:, None] + np.arange(BLOCK_IDS // 8 * w)]
        plain = np.zeros((len(rows), BLOCK_IDS, 32), np.uint8)
        plain[:, :, :w] = np.unpackbits(packed, axis=1, bitorder="little").reshape(len(rows), BLOCK_IDS, w)
        delta[rows] = np.packbits(plain, axis=2, bitorder="little").view("<u4")[:, :, 0]
    if odd.any():
        row = np.repeat(np.arange(blocks), odd)
        rank = np.arange(len(row)) - np.repeat(np.cumsum(odd) - odd, odd)
        base = starts[row] + BLOCK_IDS // 8 * width[row]
        over = np.ascontiguousarray(body[(base + odd[row] + 4 * rank)[:, None] + np.arange(4)]).view("<u4")[:, 0].astype(np.uint64)
        delta[row, body[base + rank]] |= (over << width[row].astype(np.uint64)).astype(np.uint32)
    return (delta + low[:, None]).reshape(-1)[:n], lengths


_encoders: dict[str, SegmentEncoder] = {}


def encoder(tokenizer_file: str) -> SegmentEncoder:
    """Byte-level BPE of the tokenizers library: its pattern ends a token before a space that stands between two
    characters that are not white space, and between an ASCII letter and punctuation other than the apostrophe."""
    if tokenizer_file not in _encoders:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        own = Tokenizer.from_file(tokenizer_file)
        own.encode_special_tokens = True
        batch = getattr(own, "encode_batch_fast", own.encode_batch)

        def encode_new(segments: list[str], _first: list[bool]) -> tuple[np.ndarray, np.ndarray]:
            parts, sizes = [], []
            for at in range(0, len(segments), 4096):
                lists = [x.ids for x in batch(segments[at : at + 4096], add_special_tokens=False)]
                sizes += map(len, lists)
                parts.append(np.fromiter(chain.from_iterable(lists), "<u4"))
            return np.concatenate(parts), np.array(sizes, np.int64)

        _encoders[tokenizer_file] = SegmentEncoder(encode_new, punctuation=True)
    return _encoders[tokenizer_file]


_added: dict[str, tuple] = {}


def encode_with_added(tokenizer_file: str, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All ids of a column of texts, and len + 1 offsets, where added tokens inside a text are recognised."""
    if tokenizer_file not in _added:
        encoder(tokenizer_file)  # sets the environment
        from tokenizers import Tokenizer

        library = Tokenizer.from_file(tokenizer_file)
        _added[tokenizer_file] = library, [t.content for t in library.get_added_tokens_decoder().values()]
    library, tokens = _added[tokenizer_file]
    holds = np.zeros(len(column), bool)
    for token in tokens:
        holds |= pc.match_substring(column, token).to_numpy(zero_copy_only=False)
    if not holds.any():
        return encoder(tokenizer_file)(column)
    ids, offsets = encoder(tokenizer_file)(pc.if_else(pa.array(holds), pa.scalar("", column.type), column))
    whole = {i: np.array(library.encode(column[i].as_py(), add_special_tokens=False).ids, "<u4") for i in np.flatnonzero(holds).tolist()}
    parts, sizes, at = [], np.diff(offsets), 0
    for i, own in whole.items():
        parts += [ids[at : offsets[i]], own]
        sizes[i], at = len(own), offsets[i]
    return np.concatenate([*parts, ids[at:]]), np.concatenate([np.zeros(1, np.int64), np.cumsum(sizes)])


def with_end(ids: np.ndarray, offsets: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """The ids with the end id after each document, and the documents' lengths."""
    lengths = np.diff(offsets) + 1
    out = np.full(len(ids) + len(lengths), end_id, "<u4")
    keep = np.ones(len(out), bool)
    keep[np.cumsum(lengths) - 1] = False
    out[keep] = ids
    return out, lengths


def write_token_files(docs: DataFrame, tokenizer_file: str, end_id: int, added: bool = False) -> DataFrame:
    """Encode (doc_id, text) in ascending doc_id order and write the segments; returns the written table.

    added: whether added tokens inside a text are recognised, as the library does by default.
    """

    def encode(batches):
        part, segment = TaskContext.get().partitionId(), 0
        own = partial(encode_with_added, tokenizer_file) if added else encoder(tokenizer_file)
        waiting: list[tuple[np.ndarray, np.ndarray, list]] = []

        def flush():
            nonlocal segment, waiting
            ids, lengths = np.concatenate([x[0] for x in waiting]), np.concatenate([x[1] for x in waiting])
            doc_ids = [d for x in waiting for d in x[2]]
            waiting = []
            bounds = np.cumsum(lengths)
            cuts = [0]
            while cuts[-1] < len(lengths):
                done = int(bounds[cuts[-1] - 1]) if cuts[-1] else 0
                cuts.append(max(cuts[-1] + 1, int(np.searchsorted(bounds, done + SEGMENT_IDS, side="right"))))
            rows = []
            for a, b in zip(cuts, cuts[1:], strict=False):
                lo, hi = int(bounds[a - 1]) if a else 0, int(bounds[b - 1])
                rows.append((part, segment, hi - lo, doc_ids[a:b], pack(ids[lo:hi], lengths[a:b])))
                segment += 1
            types = [pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.binary()]
            names = ["part", "segment", "n_ids", "doc_ids", "payload"]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

        held = 0
        for batch in batches:
            for some in slices(batch, "text"):
                ids, lengths = with_end(*own(some.column("text")), end_id)
                waiting.append((ids, lengths, some.column("doc_id").to_pylist()))
                held += len(ids)
                if held >= 8 * SEGMENT_IDS:
                    yield flush()
                    held = 0
        if waiting:
            yield flush()

    text = text_or_empty()
    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("tie"))
    ordered = ordered.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie").select("doc_id", "text")
    return cut(ordered.mapInArrow(encode, FILE_SCHEMA))


def read_token_files(files: DataFrame) -> DataFrame:
    """From the files: part, segment, doc_id, place in the segment, n_tokens and the checksum of each document's ids."""

    def decode(batches):
        for batch in batches:
            rows = {k: [] for k in ("part", "segment", "doc_id", "inside", "n_tokens", "ids_crc32")}
            for part, segment, doc_ids, payload in zip(*(batch.column(k).to_pylist() for k in ("part", "segment", "doc_ids", "payload")), strict=True):
                ids, lengths = unpack(payload)
                raw = memoryview(np.ascontiguousarray(ids, "<u4")).cast("B")
                ends = np.cumsum(lengths, dtype=np.int64).tolist()
                sizes = lengths.tolist()
                rows["part"] += [part] * len(sizes)
                rows["segment"] += [segment] * len(sizes)
                rows["doc_id"] += doc_ids
                rows["inside"] += [e - s for e, s in zip(ends, sizes, strict=True)]
                rows["n_tokens"] += sizes
                rows["ids_crc32"] += [zlib.crc32(raw[4 * (e - s) : 4 * e]) for e, s in zip(ends, sizes, strict=True)]
            types = [pa.int32(), pa.int32()] + [pa.int64()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(rows.values(), types, strict=True)], list(rows))

    return files.mapInArrow(decode, "part int, segment int, doc_id long, inside long, n_tokens long, ids_crc32 long")


def token_index(files: DataFrame) -> DataFrame:
    """Rows (doc_id, start, n_tokens, ids_crc32) read back from the files."""
    parts = files.groupBy("part").agg(F.sum("n_ids").alias("n"))
    parts = parts.select("part", (F.sum("n").over(W.orderBy("part")) - F.col("n")).alias("part_start"))
    segments = files.select("part", "segment", (F.sum("n_ids").over(W.partitionBy("part").orderBy("segment")) - F.col("n_ids")).alias("segment_start"))
    starts = segments.join(parts, "part")
    return read_token_files(files).join(starts, ["part", "segment"]).select(
        "doc_id", (F.col("part_start") + F.col("segment_start") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32"
    )


def query(spark, sf_dir: str) -> DataFrame:
    """All documents through byte_bpe_50k.json with end id 2."""
    import public_tokenizers

    files = write_token_files(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"), 2, added=True)
    return token_index(files)
