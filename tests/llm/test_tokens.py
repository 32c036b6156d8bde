import hashlib
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

P = pytest.importorskip("public_tokenizers")

from tagloom.llm import op02_token_ids, op10_pieces  # noqa: E402

PIECES = P.path("piece_bpe_32k.model")
BYTES = P.path("byte_bpe_50k.json")
ODD = [
    "", " ", "a", "  a  b ", "Hello, world!  it's\n\n\tfine ", "naïve café — 日本語 text 中文", "😀😀 emoji🇩🇪", "a\xa0b c　d", "x" * 5000, "ab " * 4000, "<|endoftext|> </s> <unk> <0x41>",
    "▁▁ already ▁marked", "\x00\x01 control \x7f", "don't can’t I'LL we’ve", "1234567890 3.14 1,000", "​zero‍width", "é combining ﬁ ligature Å", "tab\tsep\r\nline", "ＦＵＬＬ width ½ ²", "﻿bom", "ǅ ß İ", "a" * 300 + " " + "é" * 300, " lead", "trail ", "\n", "，。！", "¿Qué?", "¨ ´ ` ˜",
]


def sentencepiece_rows(texts):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    out = []
    for t in texts:
        ids = [*sp.encode(t or ""), sp.eos_id()]
        out.append((len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(sp.decode(ids).encode()).hexdigest()))
    return out


def random_texts(seed, n):
    rng = random.Random(seed)
    alphabet = list("abcdefghij  \n.,'!?-") + ["é", "ß", "日", "😀", "▁", "\xa0", "é", "ção", "ing", "the", " the", "2024"]
    return ["".join(rng.choice(alphabet) for _ in range(rng.randrange(120))) for _ in range(n)]


def test_pieces_equal_the_library(spark):
    texts = [None, *ODD, *random_texts(1, 300), *ODD, "long words " * 30_000 + "é" * 2000]
    docs = spark.createDataFrame([(i, t, i) for i, t in enumerate(texts)], "doc_id long, text string, n_tokens long").repartition(3)
    found = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in op10_pieces.round_trip(docs, PIECES).collect()}
    assert found == dict(enumerate(sentencepiece_rows(texts)))
    ids = op10_pieces.round_trip(docs, PIECES, with_ids=True).collect()
    assert all(len(r.ids) == r.n_tokens and r.ids[-1] == 2 for r in ids)
    assert op10_pieces.round_trip(docs.where("false"), PIECES).count() == 0


def test_own_agenda_is_right_without_help():
    own = op10_pieces.PieceModel(PIECES)
    texts = [t for t in random_texts(2, 300) if t and "  " not in t and not {"\n", "\u00a0", "\u2581"} & set(t)]
    assert len(texts) > 5
    ids, sizes = own.agenda(["\u2581" + t.replace(" ", "\u2581") for t in texts])
    at = 0
    for text, n in zip(texts, sizes.tolist(), strict=True):
        assert ids[at : at + n].tolist() == own.library.encode(text)
        at += n


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(max_size=80), min_size=1, max_size=6))
def test_any_text_encodes_as_the_libraries_do(texts):
    import pyarrow as pa
    import sentencepiece
    from tokenizers import Tokenizer

    texts = [t.encode("utf-8", "ignore").decode() for t in texts]
    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    ids, offsets = op10_pieces.encode_texts(pa.array(texts), PIECES)
    assert [ids[a:b].tolist() for a, b in zip(offsets, offsets[1:], strict=False)] == [sp.encode(t) for t in texts]
    library = Tokenizer.from_file(BYTES)
    library.encode_special_tokens = True
    ids, offsets = op02_token_ids.encoder(BYTES)(pa.array(texts))
    assert [ids[a:b].tolist() for a, b in zip(offsets, offsets[1:], strict=False)] == [library.encode(t, add_special_tokens=False).ids for t in texts]


def test_token_files(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(BYTES)
    library.encode_special_tokens = True
    texts = [None, *ODD, *random_texts(3, 200), "words and words " * 20_000]
    rows = [(i * 7 % 1000, t, i) for i, t in enumerate(texts)] + [(None, "null id", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, start long").repartition(4)
    found = sorted(op02_token_ids.token_index(op02_token_ids.write_token_files(docs, BYTES, 2)).collect(), key=lambda r: r.start)
    at = 0
    for (doc_id, text, _), r in zip(sorted(rows, key=lambda r: (r[0] is not None, r[0])), found, strict=True):
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 2]
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (doc_id, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    assert op02_token_ids.token_index(op02_token_ids.write_token_files(docs.where("false"), BYTES, 2)).count() == 0
    twice = spark.createDataFrame([(1, "same"), (1, "same"), (1, "other")], "doc_id long, text string")
    assert op02_token_ids.token_index(op02_token_ids.write_token_files(twice, BYTES, 2)).count() == 3


def test_query_recognises_added_tokens(spark, tmp_path):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(BYTES)
    texts = [None, *ODD, "one <|endoftext|> two", "a<|endoftext|>b", "<|endoftext|><|endoftext|>", "x  <|endoftext|>  y", "<|endoftext|", *random_texts(5, 50)]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2).write.parquet(str(tmp_path / "documents.parquet"))
    at = 0
    for r, text in zip(sorted(op02_token_ids.query(spark, str(tmp_path)).collect(), key=lambda r: r.doc_id), texts, strict=True):
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 2]
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.one_of(st.integers(0, 50), st.integers(0, 2**32 - 1)), max_size=400), max_size=6))
def test_blocks_round_trip(docs):
    ids = np.array([i for d in docs for i in d], np.uint32)
    lengths = np.array([len(d) for d in docs], np.int64)
    back, sizes = op02_token_ids.unpack(op02_token_ids.pack(ids, lengths))
    assert back.tolist() == ids.tolist()
    assert sizes.tolist() == lengths.tolist()


def test_blocks_are_small():
    rng = np.random.default_rng(1)
    ids = rng.integers(100, 160, 128 * 50).astype(np.uint32)
    ids[::100] = 49_000  # outliers go to exception lists
    assert len(op02_token_ids.pack(ids, np.array([len(ids)]))) < 1.5 * len(ids)
    with pytest.raises(ValueError, match="not a segment"):
        op02_token_ids.unpack(b"xxxx")
