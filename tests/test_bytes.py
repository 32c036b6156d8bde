"""Encodings: labels, sniffing, decoding, chunks."""

import random

import pytest

from tagloom.core import encoding as E
from tagloom.core.budgets import BudgetExceededError, Budgets


@pytest.mark.parametrize(
    ("data", "transport", "expected"),
    [
        (b'<meta charset="latin-1"><p>x', None, ("windows-1252", "meta")),
        (b'<meta charset="unicode"><p>x', None, ("utf-8", "meta")),
        (b'<meta charset="utf-16le"><p>x', None, ("utf-8", "meta")),
        (b'<!-- comment <meta charset="windows-1252"><meta charset="utf-8">', None, ("windows-1252", "default")),
        (b'<!-- c --><meta charset="utf-8">', None, ("utf-8", "meta")),
        (b'\xef\xbb\xbf<meta charset="windows-1252">', "iso-8859-1", ("utf-8", "bom")),
        (b"\xfe\xff\0x", None, ("utf-16be", "bom")),
        (b"\xff\xfex\0", None, ("utf-16le", "bom")),
        (b"<meta charset=utf-8>", "koi8-r", ("koi8-r", "transport")),
        (b"<meta charset=utf-8>", "nonsense", ("utf-8", "meta")),
        (b"<meta http-equiv=Content-Type content='text/html; charset=\"Shift_JIS\"'>", None, ("shift_jis", "meta")),
        (b"<meta content='text/html; charset=gbk'>", None, ("windows-1252", "default")),
        (b"<a title='>'><meta charset=big5>", None, ("big5", "meta")),
        (b"<a title='<meta charset=big5>", None, ("windows-1252", "default")),
        (b"<metax charset=big5><meta/charset=euc-kr>", None, ("euc-kr", "meta")),
        (b"<meta charset=nonsense><meta charset=ibm866>", None, ("ibm866", "meta")),
        (b" " * 16_384 + b"<meta charset=utf-8>", None, ("windows-1252", "default")),
        (b"", None, ("windows-1252", "default")),
    ],
)
def test_sniff(data, transport, expected):
    assert E.sniff(data, transport) == expected


def test_labels():
    assert E.canonical(' "UTF8" ') == "utf-8"
    assert E.canonical("ascii") == E.canonical("l1") == E.canonical("cp1252") == "windows-1252"
    assert E.canonical("latin5") == E.canonical("iso-8859-9") == "windows-1254"
    assert E.canonical("iso-ir-101") == "iso-8859-2"
    assert E.canonical("utf-7") is None
    assert E.canonical("") is None
    assert E.canonical("utf-16", declared=False) == "utf-16le"
    for name in set(E.LABELS.values()) - {"x-user-defined"}:
        assert isinstance(b"abcd".decode(E.CODECS[name]), str), name


def test_decode():
    assert E.decode(b"\x80\x81\xe9", "windows-1252") == "€\x81\xe9"
    assert E.decode(b"a\xff", "utf-8") == "a�"
    assert E.decode(b"\xef\xbb\xbfx", "utf-8") == "x"
    assert E.decode(b"\xff\xfex\0", "utf-16le") == "x"
    assert E.decode(b"A\x80\xff", "x-user-defined") == "A"
    assert E.decode(b"\xd2", "windows-1253") == "�"
    assert E.decode("ж".encode("koi8-r"), "koi8-r") == "ж"
    assert E.decode_html(b"<meta charset=windows-1252><p>\xe9") == ("<meta charset=windows-1252><p>é", "windows-1252", "meta")


def test_chunking_does_not_matter():
    rng = random.Random(3)
    for data in ("<meta charset=utf-8>é😀".encode() * 2000, b"<meta charset=windows-1252>\xe9", b""):
        whole = E.decode_html(data)
        for _ in range(5):
            cuts = sorted(rng.randrange(len(data) + 1) for _ in range(rng.randrange(8)))
            parts = [data[a:b] for a, b in zip([0, *cuts], [*cuts, len(data)], strict=True)]
            assert E.decode_chunks(parts)[:3] == whole
    assert E.decode_chunks([])[:3] == ("", "windows-1252", "default")


def test_stream_budgets():
    with pytest.raises(BudgetExceededError) as caught:
        E.decode_chunks([b"a"] * 40, budgets=Budgets(maxBufferedBytes=16))
    assert caught.value.payload == {"code": "BUDGET_EXCEEDED", "budget": "maxBufferedBytes", "limit": 16, "actual": 17}
    with pytest.raises(BudgetExceededError) as caught:
        E.decode_chunks([b"a" * 4] * 3, budgets=Budgets(maxInputBytes=6, maxBufferedBytes=64))
    assert caught.value.payload["actual"] == 8
    assert E.decode_chunks([b"a" * 20_000, b"b" * 5], budgets=Budgets(maxBufferedBytes=20_000))[3:] == (20_005, 20_000)
