"""Character references of HTML text and attribute values."""

from __future__ import annotations

import re
from html.entities import html5

#: Names that count without their semicolon, longest first when matching.
_BARE = {name for name in html5 if not name.endswith(";")}
_BARE_MAX = max(map(len, _BARE))
_NAME = re.compile(r"[A-Za-z0-9]+;?")
_HEX, _DEC = re.compile(r"[0-9A-Fa-f]+"), re.compile(r"[0-9]+")


def _c1(code: int) -> str:
    try:
        return bytes([code]).decode("cp1252")
    except UnicodeDecodeError:
        return chr(code)


#: Numeric references to C1 controls mean windows-1252 characters.
_C1 = {code: _c1(code) for code in range(0x80, 0xA0)}


def is_noncharacter(code: int) -> bool:
    return 0xFDD0 <= code <= 0xFDEF or code & 0xFFFE == 0xFFFE


def _number(code: int) -> tuple[str, str | None]:
    if code == 0:
        return "�", "null-character-reference"
    if code > 0x10FFFF:
        return "�", "character-reference-outside-unicode-range"
    if 0xD800 <= code <= 0xDFFF:
        return "�", "surrogate-character-reference"
    if is_noncharacter(code):
        return chr(code), "noncharacter-character-reference"
    if code == 0x0D or (code < 0x20 and code not in (0x09, 0x0A, 0x0C)) or 0x7F <= code <= 0x9F:
        return _C1.get(code, chr(code)), "control-character-reference"
    return chr(code), None


def reference(text: str, at: int, in_attribute: bool, end: int, error) -> tuple[str, int]:
    """What the ampersand at ``at`` stands for, and where to go on. ``error(code, place)`` is told of mistakes."""
    nxt = text[at + 1] if at + 1 < end else ""
    if nxt == "#":
        x = text[at + 2 : at + 3] in ("x", "X") and at + 2 < end
        m = (_HEX if x else _DEC).match(text, at + 2 + x, end)
        if not m:
            error("absence-of-digits-in-numeric-character-reference", at + 2 + x)
            return text[at : at + 2 + x], at + 2 + x
        digits = m.group().lstrip("0")
        code = int(digits or "0", 16 if x else 10) if len(digits) < 10 else 0x110000
        stop = m.end()
        if stop < end and text[stop] == ";":
            stop += 1
        else:
            error("missing-semicolon-after-character-reference", stop)
        char, wrong = _number(code)
        if wrong:
            error(wrong, stop)
        return char, stop
    m = _NAME.match(text, at + 1, end)
    if not m:
        return "&", at + 1
    name = m.group()
    if name.endswith(";") and name in html5:
        return html5[name], m.end()
    for size in range(min(len(name), _BARE_MAX), 1, -1):
        if name[:size] in _BARE:
            stop = at + 1 + size
            after = text[stop] if stop < end else ""
            if in_attribute and (after == "=" or (after.isascii() and after.isalnum())):
                return text[at:stop], stop
            if after != ";":
                error("missing-semicolon-after-character-reference", stop)
            return html5[name[:size]], stop
    if name.endswith(";"):
        error("unknown-named-character-reference", m.end() - 1)
        return text[at : m.end() - 1], m.end() - 1
    return text[at : m.end()], m.end()


def decode(text: str, in_attribute: bool = False) -> str:
    """``text`` with its references replaced."""
    if "&" not in text:
        return text
    parts, at, end = [], 0, len(text)
    while True:
        amp = text.find("&", at)
        if amp < 0:
            parts.append(text[at:])
            return "".join(parts)
        parts.append(text[at:amp])
        value, at = reference(text, amp, in_attribute, end, lambda *_: None)
        parts.append(value)
