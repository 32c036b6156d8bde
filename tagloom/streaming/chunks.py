"""Documents that arrive in chunks: batch assembly, and its Structured Streaming twin.

A chunk is a row (keys, seq, bytes, is_last). A document is complete when its last chunk and all before it are there; a
chunk that comes again (a retry, with the same bytes) counts once. The encoding is sniffed over the first 16,384 bytes, and
the text is the same however it was cut. Batch and stream give the same rows, but for documents that never complete: the
stream waits for them, until its timeout; the batch leaves them out, or gives what there is of them.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from itertools import count, takewhile

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..core import encoding
from ..core.budgets import UNLIMITED, BudgetExceededError, Budgets
from ..functions import html as H
from ..operators import parse as P
from ..operators.arrow import budget_error, generate

OUTPUT = "text string, encoding string, source string, bytes_read bigint, max_buffered bigint, code string, budget string, limit bigint, actual bigint"


def _ordered(chunks: DataFrame, keys: list[str], incomplete: bool) -> DataFrame:
    """keys, _chunks: the bytes of each document's chunks in order, each seq once."""
    sorted_rows = F.sort_array(F.collect_list(F.struct("seq", "bytes")))
    whole = chunks.groupBy(*keys).agg(sorted_rows.alias("_rows"), F.max(F.when(F.col("is_last"), F.col("seq"))).alias("_last"))
    once = F.filter("_rows", lambda c, i: (i == 0) | (F.get(F.col("_rows"), i - 1)["seq"] != c["seq"]))
    whole = whole.select(*keys, "_last", once.alias("_rows"))
    if not incomplete:
        whole = whole.where(F.size("_rows") == F.col("_last") + 1)
    return whole.select(*keys, F.transform("_rows", lambda c: c["bytes"]).alias("_chunks"))


def assemble(chunks: DataFrame, keys: list[str], transport: str | None = None, budgets: Budgets = UNLIMITED, mode: str = "PERMISSIVE", incomplete: bool = False) -> DataFrame:
    """keys, text, encoding, source, bytes_read, max_buffered, budget_error of documents in batch.

    Documents that lack chunks are left out, or with ``incomplete`` made of the chunks that are there, as a stream does on its
    timeout.
    """
    whole = _ordered(chunks, keys, incomplete)
    return whole.select(*keys, H.decode_chunks("_chunks", transport, budgets, mode).alias("_d")).select(*keys, "_d.*")


def parse_stream_nodes(chunks: DataFrame, keys: list[str], spans: bool = False, columns: list[str] | None = None, **options) -> DataFrame:
    """Node table of documents in chunks; what :func:`operators.parse.parse_nodes` gives for their bytes."""
    return P.parse_nodes(assemble(chunks, keys, **options), keys, "text", spans=spans, columns=columns)


def parse_stream_trace(chunks: DataFrame, keys: list[str], budgets: Budgets = UNLIMITED, transport: str | None = None) -> DataFrame:
    """Trace of documents in chunks: the document's, then how it was decoded, read and buffered."""
    from .. import schemas
    from ..core.document import parse
    from ..core.encoding import decode_chunks

    whole = _ordered(chunks, keys, False)

    def trace(parts):
        try:
            text, name, source, read, buffered = decode_chunks([bytes(p) for p in parts], transport, budgets)
            events = parse(text, trace=True, budgets=budgets).trace
            events.push("decode", source="sniff", encoding=name, sniffSource=source)
            events.push("stream", bytesRead=read)
            events.budget("maxBufferedBytes", buffered)
        except BudgetExceededError:
            return ()
        return map(P.trace_row, events.events)

    return generate(whole, [F.col("_chunks")], keys, schemas.TRACE, trace)


def tokenize_stream(chunks: DataFrame, keys: list[str], **options) -> DataFrame:
    """Token table of documents in chunks."""
    return P.tokenize_html(assemble(chunks, keys, **options), keys, "text")


def assemble_stream(chunks: DataFrame, keys: list[str], transport: str | None = None, budgets: Budgets = UNLIMITED, timeout: str | None = None) -> DataFrame:
    """The same from a stream of chunks, out of order if need be; a document is put out once, when it is complete.

    The state of a document is its chunks so far; maxInputBytes bounds all of them, maxBufferedBytes and maxTimeMs those that
    join the beginning. A breach puts out a row with budget_error at once; what is kept of the document then is a flag, so
    that its later chunks are ignored, until its state times out. With ``timeout``
    (as "10 minutes") a document of which nothing has come for so long goes, and its incomplete text is put out.
    """
    kept = chunks.select(*keys).schema.fields
    out = T.StructType([*kept, *T._parse_datatype_string(OUTPUT).fields])
    columns = [f.name for f in out.fields]
    wait = int(pd.Timedelta(timeout).total_seconds() * 1000) if timeout else None

    def decoded(key: tuple, parts: list[bytes]) -> pd.DataFrame:
        try:
            row = (*encoding.decode_chunks(parts, transport, budgets), None, None, None, None)
        except BudgetExceededError as e:
            row = (None, None, None, None, None, *budget_error(e))
        return pd.DataFrame([(*key, *row)], columns=columns)

    def over(parts: dict[int, bytes]) -> bool:
        """Whether what has come so far breaks a budget already: in all, or in the chunks that join the beginning."""
        try:
            budgets.enforce("maxInputBytes", sum(map(len, parts.values())))
            encoding.within_budgets([parts[s] for s in takewhile(parts.__contains__, count())], budgets)
        except BudgetExceededError:
            return True
        return False

    def run(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        parts, last, done = pickle.loads(state.get[0]) if state.exists else ({}, None, False)
        if state.hasTimedOut:
            state.remove()
            if parts and not done:
                yield decoded(key, [parts[s] for s in sorted(parts)])
            return
        for frame in frames:
            for seq, body, ended in zip(frame["seq"], frame["bytes"], frame["is_last"], strict=True):
                if not done:
                    parts.setdefault(int(seq), bytes(body))
                    last = int(seq) if ended else last
        complete = last is not None and len(parts) == last + 1
        if not done and (complete or over(parts)):
            yield decoded(key, [parts[s] for s in sorted(parts)])
            parts, done = {}, True
            if complete and wait is None:
                state.remove()
                return
        state.update((pickle.dumps((parts, last, done)),))
        if wait is not None:
            state.setTimeoutDuration(wait)

    found = chunks.groupBy(*keys).applyInPandasWithState(run, out, "buffer binary", "append", "ProcessingTimeTimeout" if wait is not None else "NoTimeout")
    error = F.when(F.col("code").isNotNull(), F.struct("code", "budget", "limit", "actual"))
    return found.select(*keys, "text", "encoding", "source", "bytes_read", "max_buffered", error.alias("budget_error"))
