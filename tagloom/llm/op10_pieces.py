"""SentencePiece encoding and decoding for merge-type (BPE) vocabularies.

The agenda: of all adjacent symbol pairs whose concatenation is a piece, the one with the best score is merged first,
the leftmost of equals, until none is left; symbols that are no piece fall back to bytes. Short segments run their
agendas side by side as rows of a matrix, long ones on a heap. Segments are cut before white space that follows other
characters, which is exact when no piece has white space after another character; that is verified from the vocabulary
(else a text is one segment). In every Arrow batch the segments met for the first time are also encoded by the
sentencepiece library and compared; where the two differ the library's ids are used, so the result is the library's.

Defined cases: a null text is empty and has the end id alone; repeated rows are encoded once each; an empty table gives
no rows; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .op02_token_ids import with_end
from .segments import SegmentEncoder, _Pool, slices
from .shared import HashIndex, documents, text_or_empty

WS = "▁"
#: Symbols up to which segments share a matrix.
WIDTHS = (4, 8, 12, 16, 24, 48)
_NONE = np.int32(1 << 30)


class PieceModel:
    def __init__(self, model_file: str):
        import sentencepiece

        self.library = sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        n = sp.vocab_size()
        self.n = n
        pieces = [sp.id_to_piece(i) for i in range(n)]
        usable = [i for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        self.byte_ids = {int(pieces[i][3:5], 16): i for i in range(n) if sp.is_byte(i)}
        self.unknown = sp.unk_id()
        self.id_of = {pieces[i]: i for i in usable}
        self.splits_at_space = not any(WS in p[k:] and p[k - 1] != WS for p in self.id_of for k in range(1, len(p)) if p[k] == WS)
        symbols = dict(self.id_of)
        for p in self.id_of:
            for c in p:
                symbols.setdefault(c, n + len(symbols))
        self.symbol_top = max(symbols.values()) + 1
        self.of_char = np.arange(0x110000, dtype=np.int64) + self.symbol_top
        for p, i in symbols.items():
            if len(p) == 1:
                self.of_char[ord(p)] = i
        scores = {i: sp.get_score(i) for i in usable}
        order = {s: k for k, s in enumerate(sorted(set(scores.values()), reverse=True))}
        pairs = {}
        for p, i in self.id_of.items():
            for k in range(1, len(p)):
                left, right = symbols.get(p[:k]), symbols.get(p[k:])
                if left is not None and right is not None:
                    pairs[left << 32 | right] = (order[scores[i]], i)
        self.pairs = pairs
        self.index = HashIndex(20)
        self.index.add(np.array(list(pairs), np.uint64))
        self.ranks = np.array([r for r, _ in pairs.values()] + [_NONE], np.int32)
        self.merged = np.array([m for _, m in pairs.values()], np.int64)

    def _find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Places of pairs in ranks and merged, or -1, which is the place of the rank that means none."""
        return self.index.find((left << 32 | (right & 0xFFFFFFFF)).astype(np.uint64).reshape(-1)).reshape(left.shape)

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        return self.ranks[self._find(left, right)]

    def _rows(self, a: np.ndarray) -> np.ndarray:
        """Merge every row of a matrix of symbols, padded on the right with -1."""
        out = np.full_like(a, -1)
        at = np.arange(len(a))
        r = np.full(a.shape, _NONE, np.int32)
        r[:, :-1] = self._rank(a[:, :-1], a[:, 1:])
        columns = np.arange(a.shape[1])
        while len(a):
            p = r.argmin(axis=1)
            rows = np.arange(len(a))
            live = r[rows, p] < _NONE
            if not live.all():
                out[at[~live]] = a[~live]
                a, r, at, p = a[live], r[live], at[live], p[live]
                if not len(a):
                    break
                rows = np.arange(len(a))
            whole = self._find(a[rows, p], a[rows, p + 1])
            pick = np.minimum(columns + (columns > p[:, None]), len(columns) - 1)
            a = np.take_along_axis(a, pick, 1)
            r = np.take_along_axis(r, pick, 1)
            a[:, -1], r[:, -1] = -1, _NONE
            a[rows, p] = self.merged[whole]
            r[rows, p] = self._rank(a[rows, p], a[rows, np.minimum(p + 1, len(columns) - 1)])
            has = np.flatnonzero(p > 0)
            r[has, p[has] - 1] = self._rank(a[has, p[has] - 1], a[has, p[has]])
        return out

    def _heap(self, symbols: list[int]) -> list[int]:
        """The same agenda for one long segment."""
        n = len(symbols)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        alive = [True] * n
        pairs = self.pairs

        def offer(i, j):
            if (found := pairs.get(symbols[i] << 32 | symbols[j])) is not None:
                heapq.heappush(agenda, (found[0], i, j, symbols[i], symbols[j], found[1]))

        agenda: list = []
        for i in range(n - 1):
            offer(i, i + 1)
        while agenda:
            _, i, j, a, b, whole = heapq.heappop(agenda)
            if not (alive[i] and alive[j] and after[i] == j and symbols[i] == a and symbols[j] == b):
                continue
            symbols[i], alive[j] = whole, False
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            if before[i] >= 0:
                offer(before[i], i)
            if after[i] < n:
                offer(i, after[i])
        return [s for s, ok in zip(symbols, alive, strict=True) if ok]

    def _ids(self, symbols: list[int]) -> list[int]:
        out = []
        for s in symbols:
            if s < self.n:
                out.append(s)
                continue
            c = chr(s - self.symbol_top) if s >= self.symbol_top else next(k for k in (chr(i) for i in np.flatnonzero(self.of_char == s)))
            out += [self.byte_ids[b] for b in c.encode()] if self.byte_ids else [self.unknown]
        return out

    def agenda(self, segments: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all segments end to end and how many each has; white space is already written as the marker."""
        lengths = np.fromiter(map(len, segments), np.int64, len(segments))
        codes = np.frombuffer("".join(segments).encode("utf-32-le"), np.uint32)
        symbols, starts = self.of_char[codes], np.cumsum(lengths) - lengths
        order, bodies, sizes = [], [], []
        least = 0
        for width in WIDTHS:
            some = np.flatnonzero((lengths > least) & (lengths <= width))
            least = width
            if not len(some):
                continue
            place = np.arange(width)
            inside = place < lengths[some][:, None]
            a = np.where(inside, symbols[np.minimum(starts[some][:, None] + place, len(symbols) - 1)], -1)
            a = self._rows(np.pad(a, ((0, 0), (0, 1)), constant_values=-1))
            odd = (a >= self.n).any(axis=1)
            plain = a[~odd]
            order.append(some[~odd])
            bodies.append(plain[plain >= 0])
            sizes.append((plain >= 0).sum(axis=1))
            for i, row in zip(some[odd].tolist(), a[odd], strict=True):
                ids = self._ids(row[row >= 0].tolist())
                order.append([i])
                bodies.append(ids)
                sizes.append([len(ids)])
        for i in np.flatnonzero(lengths > least).tolist():
            ids = self._ids(self._heap(symbols[starts[i] : starts[i] + lengths[i]].tolist()))
            order.append([i])
            bodies.append(ids)
            sizes.append([len(ids)])
        if not order:
            return np.zeros(0, "<u4"), np.zeros(len(segments), np.int64)
        pool = _Pool(np.dtype("<u4"))
        pool.add(np.concatenate(bodies), np.concatenate(sizes).astype(np.int64))
        at = np.concatenate(order)
        back = np.empty(len(segments), np.int64)
        back[at] = np.arange(len(at))
        return pool.gather(back)

    def encode_new(self, segments: list[str], first: list[bool]) -> tuple[np.ndarray, np.ndarray]:
        """Our ids of new segments, checked against the library's; raw segments that follow others begin with a space."""
        own, sizes = self.agenda([(WS + s if f else s).replace(" ", WS) for s, f in zip(segments, first, strict=True)])
        theirs = self.library.encode([s if f else s[1:] for s, f in zip(segments, first, strict=True)], num_threads=1)
        counts = np.fromiter(map(len, theirs), np.int64, len(theirs))
        check = np.fromiter(chain.from_iterable(theirs), "<u4", int(counts.sum()))
        return (own, sizes) if np.array_equal(sizes, counts) and np.array_equal(own, check) else (check, counts)


_models: dict[str, tuple[PieceModel, SegmentEncoder]] = {}


def model(model_file: str) -> tuple[PieceModel, SegmentEncoder]:
    if model_file not in _models:
        own = PieceModel(model_file)
        if not own.splits_at_space:
            raise ValueError("this vocabulary has pieces with white space after other characters")
        _models[model_file] = own, SegmentEncoder(own.encode_new)
    return _models[model_file]


def encode_texts(texts: pa.Array, model_file: str) -> tuple[np.ndarray, np.ndarray]:
    """Ids of a column of texts without end ids, and offsets."""
    return model(model_file)[1](texts)


_DIGITS: list[np.ndarray] = []


def _decimal(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids in decimal with a space after each, as bytes, and the end of each id in them."""
    if not _DIGITS:
        words = [f"{i} ".encode() for i in range(1 << 17)]
        _DIGITS.append(np.frombuffer(b"".join(w.ljust(8) for w in words), np.uint8).reshape(-1, 8))
        _DIGITS.append(np.fromiter(map(len, words), np.int64, len(words)))
    size = _DIGITS[1][ids]
    ends = np.cumsum(size)
    return _DIGITS[0][ids][np.arange(8) < size[:, None]], ends


def round_trip(docs: DataFrame, model_file: str, carry: tuple[str, ...] = ("doc_id",), with_ids: bool = False) -> DataFrame:
    """Per document: the carried columns, n_tokens with the end id, and checksums of ids and of the decoded text.

    with_ids adds the ids themselves, the end id included. Columns that are carried must not have the names of the others.
    """
    from pyspark.sql import types as T

    keep = docs.select(*carry).schema
    schema = T.StructType([*keep.fields, T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])
    if with_ids:
        schema = schema.add("ids", T.ArrayType(T.IntegerType()))

    def run(batches):
        own, encoder = model(model_file)
        library, end = own.library, own.library.eos_id()
        for batch in batches:
            for some in slices(batch, "_text"):
                ids, offsets = encoder(some.column("_text"))
                digits, ends = _decimal(ids) if len(ids) else (np.zeros(0, np.uint8), np.zeros(0, np.int64))
                ends = np.append(0, ends)
                raw = digits.tobytes()
                tail = str(end).encode()
                counts, id_sha, text_sha = [], [], []
                bounds = offsets.tolist()
                spots = ends[offsets].tolist()
                lists = [[*ids[a:b].tolist(), end] for a, b in zip(bounds, bounds[1:], strict=False)]
                for (a, b), (c, d), text in zip(zip(bounds, bounds[1:], strict=False), zip(spots, spots[1:], strict=False), library.decode(lists, num_threads=1), strict=True):
                    counts.append(b - a + 1)
                    id_sha.append(hashlib.sha256(raw[c:d] + tail).hexdigest())
                    text_sha.append(hashlib.sha256(text.encode()).hexdigest())
                made = [some.column(f.name) for f in keep.fields] + [pa.array(counts, pa.int64()), pa.array(id_sha, pa.string()), pa.array(text_sha, pa.string())]
                if with_ids:
                    ended, lengths = with_end(ids, offsets, end)
                    made.append(pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(lengths)), pa.int32()), pa.array(ended.astype(np.int32))))
                yield pa.RecordBatch.from_arrays(made, [f.name for f in schema.fields])

    return docs.select(*carry, text_or_empty().alias("_text")).mapInArrow(run, schema)


def query(spark, sf_dir: str) -> DataFrame:
    """All documents through piece_bpe_32k.model."""
    import public_tokenizers

    docs = documents(spark, sf_dir).withColumn("doc_id", F.col("doc_id").cast("long"))
    return round_trip(docs, public_tokenizers.path("piece_bpe_32k.model"))
