"""Which encoding bytes of HTML are in, and decoding them."""

from __future__ import annotations

import codecs
import re
import time

from . import utf16

PRESCAN_BYTES = 16_384
DEFAULT = "windows-1252"

#: Labels of encodings that no rule below makes. Name, codec that decodes it, labels.
_NAMED = {
    "utf-8": ("utf-8", "utf-8 utf8 unicode-1-1-utf-8 unicode11utf8 unicode20utf8 x-unicode20utf8"),
    "utf-16le": ("utf-16-le", "utf-16 utf-16le csunicode iso-10646-ucs-2 ucs-2 unicode unicodefeff"),
    "utf-16be": ("utf-16-be", "utf-16be unicodefffe"),
    "ibm866": ("cp866", "866 cp866 csibm866 ibm866"),
    "koi8-r": ("koi8-r", "cskoi8r koi koi8 koi8-r koi8_r"),
    "koi8-u": ("koi8-u", "koi8-ru koi8-u"),
    "macintosh": ("mac-roman", "csmacintosh mac macintosh x-mac-roman"),
    "x-mac-cyrillic": ("mac-cyrillic", "x-mac-cyrillic x-mac-ukrainian"),
    "windows-874": ("cp874", "dos-874 iso-8859-11 iso8859-11 iso885911 tis-620 windows-874"),
    "gbk": ("gb18030", "chinese csgb2312 csiso58gb231280 gb2312 gb_2312 gb_2312-80 gbk iso-ir-58 x-gbk"),
    "gb18030": ("gb18030", "gb18030"),
    "big5": ("big5hkscs", "big5 big5-hkscs cn-big5 csbig5 x-x-big5"),
    "euc-jp": ("euc-jp", "cseucpkdfmtjapanese euc-jp x-euc-jp"),
    "iso-2022-jp": ("iso2022_jp", "csiso2022jp iso-2022-jp"),
    "shift_jis": ("cp932", "csshiftjis ms932 ms_kanji shift-jis shift_jis sjis windows-31j x-sjis"),
    "euc-kr": ("cp949", "cseuckr csksc56011987 euc-kr iso-ir-149 korean ks_c_5601-1987 ks_c_5601-1989 ksc5601 ksc_5601 windows-949"),
    "x-user-defined": ("", "x-user-defined"),
    "windows-1252": ("cp1252", "ansi_x3.4-1968 ascii iso_8859-1:1987 us-ascii latin-1"),
    "windows-1254": ("cp1254", "iso_8859-9:1989"),
    "iso-8859-2": ("iso8859-2", "iso_8859-2:1987"),
    "iso-8859-3": ("iso8859-3", "iso_8859-3:1988"),
    "iso-8859-4": ("iso8859-4", "iso_8859-4:1988"),
    "iso-8859-5": ("iso8859-5", "cyrillic csisolatincyrillic iso_8859-5:1988"),
    "iso-8859-6": ("iso8859-6", "arabic asmo-708 csiso88596e csiso88596i csisolatinarabic ecma-114 iso-8859-6-e iso-8859-6-i iso_8859-6:1987"),
    "iso-8859-7": ("iso8859-7", "csisolatingreek ecma-118 elot_928 greek greek8 iso_8859-7:1987 sun_eu_greek"),
    "iso-8859-8": ("iso8859-8", "csiso88598e csisolatinhebrew hebrew iso-8859-8-e iso_8859-8:1988 visual"),
    "iso-8859-8-i": ("iso8859-8", "csiso88598i iso-8859-8-i logical"),
    "iso-8859-15": ("iso8859-15", "csisolatin9 l9"),
}
#: ISO 8859 parts that are known by number, their "latin" numbers, and the registry numbers of some.
_PARTS = {1: 1, 2: 2, 3: 3, 4: 4, 5: None, 6: None, 7: None, 8: None, 9: 5, 10: 6, 13: None, 14: None, 15: None, 16: None}
_REGISTRY = {1: 100, 2: 101, 3: 109, 4: 110, 5: 144, 6: 127, 7: 126, 8: 138, 9: 148, 10: 157}
_AS_WINDOWS = {1: "windows-1252", 9: "windows-1254"}


def _labels() -> tuple[dict[str, str], dict[str, str]]:
    """Label to name, and name to codec."""
    names: dict[str, str] = {}
    codec: dict[str, str] = {}
    for part, latin in _PARTS.items():
        name = _AS_WINDOWS.get(part, f"iso-8859-{part}")
        made = [f"iso-8859-{part}", f"iso8859-{part}", f"iso8859{part}"]
        made += [f"iso_8859-{part}"] if part in (*range(1, 10), 15) else []
        made += [f"latin{latin}", f"l{latin}", f"csisolatin{latin}"] if latin else []
        made += [f"iso-ir-{_REGISTRY[part]}"] if part in _REGISTRY else []
        if part == 16:
            made = ["iso-8859-16"]
        names.update(dict.fromkeys(made, name))
        codec.setdefault(name, f"iso8859-{part}")
    for page in range(1250, 1259):
        names.update(dict.fromkeys((f"windows-{page}", f"cp{page}", f"x-cp{page}"), f"windows-{page}"))
        codec[f"windows-{page}"] = f"cp{page}"
    for name, (how, labels) in _NAMED.items():
        names.update(dict.fromkeys(labels.split(), name))
        codec[name] = how
    return names, codec


LABELS, CODECS = _labels()


def _gap(error: UnicodeDecodeError) -> tuple[str, int]:
    """A byte that a single-byte table leaves open: a C1 control stays one, others are unknown."""
    byte = error.object[error.start]
    return (chr(byte) if 0x80 <= byte < 0xA0 else "�"), error.start + 1


codecs.register_error("tagloom-gap", _gap)


def _bom(data: bytes) -> str | None:
    if data.startswith(b"\xef\xbb\xbf"):
        return "utf-8"
    return {b"\xfe\xff": "utf-16be", b"\xff\xfe": "utf-16le"}.get(data[:2])


def _unquoted(value: str) -> str:
    value = value.strip(utf16.JS_SPACE)
    if value and value[0] in "\"'" and value[-1] == value[0]:
        return value[1:-1].strip(utf16.JS_SPACE)
    return value


def canonical(label: str, declared: bool = True) -> str | None:
    """The name of the encoding a label means. A declaration (by transport or meta) of UTF-16 means UTF-8."""
    label = _unquoted(label).lower().strip(utf16.JS_SPACE)
    if declared and label.startswith("utf-16"):
        return "utf-8"
    name = LABELS.get(label)
    return "utf-8" if declared and name in ("utf-16le", "utf-16be") else name


_COMMENT = re.compile(r"<!--.*?(?:-->|\Z)", re.S)
_TAG = re.compile(r"<(?:[^\"'>]|\"[^\"]*\"|'[^']*')*>")
_META = re.compile(r"<meta(?=[\t\n\f\r />])", re.I)
_ATTRIBUTE = re.compile(r"[\t\n\f\r /]*([^\t\n\f\r />=]+)[\t\n\f\r ]*(?:=[\t\n\f\r ]*(?:\"([^\"]*)\"|'([^']*)'|([\"'])|([^\t\n\f\r >]*)))?")
_CONTENT = re.compile(rf"charset[{utf16.JS_SPACE}]*=[{utf16.JS_SPACE}]*(\"[^\"]*\"|'[^']*'|[^{utf16.JS_SPACE};\"'>]+)", re.I)


def _meta_attributes(tag: str) -> dict[str, str]:
    body, at, found = tag[5:-1], 0, {}
    while at < len(body):
        m = _ATTRIBUTE.match(body, at)
        if not m:
            break
        if m.group(4):  # a quote that never closes
            return {}
        found[m.group(1).lower()] = next((v for v in (m.group(2), m.group(3), m.group(5)) if v is not None), "")
        at = m.end()
    return found


def _tags(scan: str):
    """Stretches from < to > outside quotes; an unclosed one ends the scan."""
    at = 0
    while (at := scan.find("<", at)) >= 0:
        m = _TAG.match(scan, at)
        if not m:
            return
        yield m.group()
        at = m.end()


def _meta_charset(data: bytes) -> str | None:
    scan = _COMMENT.sub("", data.decode("latin-1"))
    for tag in _tags(scan):
        if not _META.match(tag):
            continue
        attributes = _meta_attributes(tag)
        if attributes.get("charset") and (name := canonical(attributes["charset"])):
            return name
        if attributes.get("http-equiv", "").lower() == "content-type" and attributes.get("content"):
            m = _CONTENT.search(attributes["content"])
            if m and (name := canonical(m.group(1))):
                return name
    return None


def sniff(data: bytes, transport: str | None = None, prescan: int = PRESCAN_BYTES, default: str = DEFAULT) -> tuple[str, str]:
    """(encoding, source): byte order mark, then transport label, then meta prescan, then the default."""
    if name := _bom(data):
        return name, "bom"
    if transport and (name := canonical(transport)):
        return name, "transport"
    if name := _meta_charset(data[:prescan]):
        return name, "meta"
    return canonical(default, declared=False) or DEFAULT, "default"


_MULTIBYTE = {"utf-8", "utf-16le", "utf-16be", "gbk", "gb18030", "big5", "euc-jp", "iso-2022-jp", "shift_jis", "euc-kr"}


def decode(data: bytes, encoding: str) -> str:
    """Bytes as text; a byte order mark of the encoding goes, what cannot be decoded becomes U+FFFD."""
    if encoding == "x-user-defined":
        return "".join(chr(b) if b < 0x80 else chr(0xF700 + b) for b in data)
    mark = {"utf-8": b"\xef\xbb\xbf", "utf-16le": b"\xff\xfe", "utf-16be": b"\xfe\xff"}.get(encoding)
    if mark and data.startswith(mark):
        data = data[len(mark) :]
    return data.decode(CODECS[encoding], "replace" if encoding in _MULTIBYTE else "tagloom-gap")


def decode_html(data: bytes, transport: str | None = None) -> tuple[str, str, str]:
    """(text, encoding, source)."""
    encoding, source = sniff(data, transport)
    return decode(data, encoding), encoding, source


def within_budgets(chunks: list[bytes], budgets=None, began: float | None = None) -> tuple[int, int]:
    """(bytes, most bytes buffered) of chunks in order; budgets are kept chunk by chunk, and nothing behind a breach is looked
    at. Bytes are held until the encoding is settled, once PRESCAN_BYTES have come; began is a time.monotonic()."""
    total = pending = buffered = 0
    settled = False
    for chunk in chunks:
        total += len(chunk)
        pending = len(chunk) if settled else pending + len(chunk)
        buffered = max(buffered, pending)
        settled = settled or pending >= PRESCAN_BYTES
        if budgets is not None:
            budgets.enforce("maxInputBytes", total)
            budgets.enforce("maxBufferedBytes", pending)
            _in_time(budgets, began)
    return total, buffered


def _in_time(budgets, began: float | None) -> None:
    if budgets.maxTimeMs is not None and began is not None:
        budgets.enforce("maxTimeMs", int((time.monotonic() - began) * 1000))


def decode_chunks(chunks: list[bytes], transport: str | None = None, budgets=None) -> tuple[str, str, str, int, int]:
    """(text, encoding, source, bytes, most bytes buffered) of a document that came in chunks; the time is looked at after
    each chunk and once all is decoded."""
    began = time.monotonic()
    total, buffered = within_budgets(chunks, budgets, began)
    text, encoding, source = decode_html(b"".join(chunks), transport)
    if budgets is not None:
        _in_time(budgets, began)
    return text, encoding, source, total, buffered
