"""Offsets and lengths in UTF-16 code units, in which the engine's spans, budgets and sizes are counted."""

from __future__ import annotations

import re
from bisect import bisect_left

_ASTRAL = re.compile("[\U00010000-\U0010ffff]")
#: White space as ECMAScript's trim() and \s have it.
JS_SPACE = "\t\n\v\f\r \xa0                　﻿"


def length(text: str) -> int:
    return len(text) if text.isascii() else len(text) + len(_ASTRAL.findall(text))


class Units:
    """A text addressed by UTF-16 code units."""

    def __init__(self, text: str):
        self.text = text
        self.raw = text.encode("utf-16-le", "surrogatepass") if not text.isascii() and _ASTRAL.search(text) else None
        self.size = len(text) if self.raw is None else len(self.raw) // 2

    def slice(self, start: int, end: int) -> str:
        if self.raw is None:
            return self.text[start:end]
        return self.raw[2 * start : 2 * end].decode("utf-16-le", "replace")

    def at(self, place: int) -> str:
        return self.slice(place, place + 1) if 0 <= place < self.size else ""


def head(text: str, size: int) -> str:
    """The first ``size`` code units; half of a surrogate pair becomes U+FFFD."""
    return Units(text).slice(0, size)


class Offsets:
    """Maps places in newline-normalised text to UTF-16 offsets in the original."""

    def __init__(self, original: str):
        self.places: list[int] = []
        if original.isascii() and "\r\n" not in original:
            return
        removed = 0
        for m in re.finditer("\r\n|[\U00010000-\U0010ffff]", original):
            # from the next character on, offsets are one larger
            self.places.append(m.start() - removed + 1)
            removed += m.group()[0] == "\r"

    def __call__(self, place: int | None) -> int | None:
        if place is None or not self.places:
            return place
        return place + bisect_left(self.places, place + 1)
