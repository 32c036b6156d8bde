"""Encoding whole texts through a per-worker cache of their segments.

A text is cut before single spaces between two characters that are surely no white space (and, if asked, between an
ASCII letter and ASCII punctuation). A tokenizer for which such cuts never lie inside a token gives the same ids for
the pieces as for the whole; the caller says so. Each distinct segment of a block is then encoded once, and ids are
gathered by index, so that the cost follows the number of distinct segments rather than the length of the texts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

from .shared import BLOCK, HashIndex, span_hashes, utf8

_SPACE = 32
_NEXT = np.zeros(256, bool)
_NEXT[33:127] = True
_NEXT[0xC3:0xE1] = True
_NEXT[0xE4:0xF5] = True
_PLAIN = np.zeros(256, bool)
_PLAIN[33:127] = True
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
_PUNCT = np.zeros(256, bool)
_PUNCT[33:48] = _PUNCT[58:65] = _PUNCT[91:97] = _PUNCT[123:127] = True
_PUNCT[39] = False
#: Segments and bytes of segments that a worker keeps before it starts afresh.
KEPT, KEPT_BYTES = 1_200_000, 1 << 25


def slices(batch: pa.RecordBatch, column: str, size: int = BLOCK) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows of about ``size`` bytes of text, one row at least."""
    _, offsets = utf8(batch.column(column))
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + size, side="right")) - 1)
        yield batch.slice(at, to - at)
        at = to


def segment_starts(data: np.ndarray, offsets: np.ndarray, punctuation: bool) -> np.ndarray:
    """Ascending byte offsets at which segments begin; each document that is not empty begins one."""
    n = len(data)
    begins = np.zeros(n + 1, bool)
    if n > 3:
        at = np.flatnonzero(data[1:-1] == _SPACE) + 1
        b1 = data[at - 1]
        b2, b3 = data[np.maximum(at - 2, 0)], data[np.maximum(at - 3, 0)]
        middle = (b2 >= 0x80) & (b2 < 0xC0)
        wide = (b1 >= 0x80) & ~(b2 == 0xC2) & ~(middle & (b3 >= 0xE1) & (b3 <= 0xE3))
        last = np.zeros(n + 1, bool)
        last[offsets] = True
        begins[at[_NEXT[data[at + 1]] & (_PLAIN[b1] | wide) & ~last[at + 1]]] = True
        if punctuation:
            begins[1:n] |= _LETTER[data[:-1]] & _PUNCT[data[1:]]
    begins[offsets[:-1]] = True
    begins[n] = False
    return np.flatnonzero(begins)


class _Pool:
    """Values of varying length, end to end in one growing array."""

    def __init__(self, dtype):
        self.body, self.n = np.zeros(1 << 12, dtype), 0
        self.starts, self.sizes = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, body: np.ndarray, sizes: np.ndarray) -> None:
        if self.n + len(body) > len(self.body):
            self.body = np.concatenate([self.body[: self.n], np.zeros(self.n + 2 * len(body), self.body.dtype)])
        self.body[self.n : self.n + len(body)] = body
        self.starts = np.concatenate([self.starts, self.n + np.cumsum(sizes) - sizes])
        self.sizes = np.concatenate([self.sizes, sizes])
        self.n += len(body)

    def gather(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The values at these places, end to end, and their sizes."""
        sizes = self.sizes[which]
        total = np.cumsum(sizes)
        index = np.arange(int(total[-1]) if len(total) else 0) + np.repeat(self.starts[which] - (total - sizes), sizes)
        return self.body[index], sizes


class SegmentEncoder:
    """encode_new: (segments, whether each begins its document) -> (all ids end to end, how many each has)."""

    def __init__(self, encode_new: Callable[[list[str], list[bool]], tuple[np.ndarray, np.ndarray]], punctuation: bool = False):
        self.encode_new, self.punctuation = encode_new, punctuation
        self._forget()

    def _forget(self) -> None:
        self.index, self.slots = HashIndex(18), np.zeros(0, np.int64)
        self.segments, self.flags, self.ids = _Pool(np.uint8), np.zeros(0, bool), _Pool(np.dtype("<u4"))

    def _known(self, data, starts, ends, first, hashes) -> np.ndarray:
        """The slot of each segment, or -1; a slot counts only if the bytes and the flag are the same."""
        out = np.full(len(hashes), -1, np.int64)
        at = self.index.find(hashes)
        hit = np.flatnonzero(at >= 0)
        lengths, slot = ends[hit] - starts[hit], self.slots[at[hit]]
        fits = (self.segments.sizes[slot] == lengths) & (self.flags[slot] == first[hit])
        hit, slot, lengths = hit[fits], slot[fits], lengths[fits]
        if not len(hit):
            return out
        kept, _ = self.segments.gather(slot)
        total = np.cumsum(lengths)
        index = np.arange(int(total[-1])) + np.repeat(starts[hit] - (total - lengths), lengths)
        wrong = data[index] != kept
        if wrong.any():
            bad = np.unique(np.searchsorted(total, np.flatnonzero(wrong), side="right"))
            slot[bad] = -1
        out[hit] = slot
        return out

    def _learn(self, data, starts, ends, first, hashes) -> np.ndarray:
        """Encode segments that are not known; returns the slot of each."""
        body = data.tobytes()
        seen: dict = {}
        which = [seen.setdefault((body[s:e], f), len(seen)) for s, e, f in zip(starts.tolist(), ends.tolist(), first.tolist(), strict=True)]
        slots = np.array(which, np.int64)
        _, picked = np.unique(slots, return_index=True)
        base = len(self.ids.sizes)
        keys = list(seen)
        ids, sizes = self.encode_new([k.decode() for k, _ in keys], [f for _, f in keys])
        self.ids.add(ids, sizes)
        self.segments.add(np.frombuffer(b"".join(k for k, _ in keys), np.uint8), np.fromiter((len(k) for k, _ in keys), np.int64, len(keys)))
        self.flags = np.concatenate([self.flags, first[picked]])
        fresh, at = np.unique(hashes[picked], return_index=True)  # of two segments with one hash, one is found again
        unseen = self.index.find(fresh) < 0
        self.index.add(fresh[unseen])
        self.slots = np.concatenate([self.slots, base + at[unseen]])
        return base + slots

    def _block(self, data, starts, ends, first) -> tuple[np.ndarray, np.ndarray]:
        """Ids of adjacent segments, and how many each has."""
        base = starts[0]
        data, starts, ends = data[base : ends[-1]], starts - base, ends - base
        if len(self.flags) > KEPT or self.segments.n > KEPT_BYTES:
            self._forget()
        hashes = span_hashes(data, starts, ends) ^ (first.astype(np.uint64) * np.uint64(0x5DEECE66D1234567))
        slots = self._known(data, starts, ends, first, hashes)
        new = np.flatnonzero(slots < 0)
        if len(new):
            slots[new] = self._learn(data, starts[new], ends[new], first[new], hashes[new])
        return self.ids.gather(slots)

    def __call__(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a column of texts, and len + 1 offsets of its documents into them."""
        data, offsets = utf8(column)
        starts = segment_starts(data, offsets, self.punctuation)
        if not len(starts):
            return np.zeros(0, "<u4"), np.zeros(len(offsets), np.int64)
        ends = np.append(starts[1:], len(data))
        first = np.zeros(len(data) + 1, bool)
        first[offsets] = True
        first = first[starts]
        ids, counts, at = [], [], 0
        while at < len(starts):
            to = max(at + 1, int(np.searchsorted(ends, starts[at] + BLOCK, side="right")))
            a, b = self._block(data, starts[at:to], ends[at:to], first[at:to])
            ids.append(a)
            counts.append(b)
            at = to
        before = np.concatenate([np.zeros(1, np.int64), np.cumsum(np.concatenate(counts))])
        return np.concatenate(ids), before[np.searchsorted(starts, offsets)]
