"""HTML tokenizer: scans runs with regular expressions and drives a sink.

The sink has ``characters(text, start, end)``, ``start_tag(tag)``, ``end_tag(tag)``, ``comment(data, start, end)``,
``doctype(name, public, system, quirks, start, end)``, ``in_foreign()`` and ``error(code, start, end)``. Offsets are places
in the text after newlines have been normalised. A sink that builds a tree sets :attr:`Tokenizer.state` from ``start_tag``.
"""

from __future__ import annotations

import re

from .charrefs import reference

DATA, RCDATA, RAWTEXT, SCRIPT, PLAINTEXT, CDATA = "data", "rcdata", "rawtext", "script", "plaintext", "cdata"

_SPACES = re.compile(r"[\t\n\f ]*")
_TAG_NAME = re.compile(r"[^\t\n\f />]+")
_ATTR_NAME = re.compile(r"[^\t\n\f />=]*")
_UNQUOTED = re.compile(r"[^\t\n\f >]*")
#: A whole tag without anything that needs care: the common case.
_PLAIN_TAG = re.compile(
    r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[\t\n\f ]+[a-zA-Z][a-zA-Z0-9:_-]*=(?:\"[^\"&\0]*\"|'[^'&\0]*'))*)[\t\n\f ]*(/?)>"
)
_PLAIN_ATTR = re.compile(r"([a-zA-Z][a-zA-Z0-9:_-]*)=(?:\"([^\"]*)\"|'([^']*)')")
_TEXT = re.compile(r"[^<&]+")
_COMMENT_END = re.compile(r"--!?>")
_DOCTYPE = re.compile(r"doctype", re.I)
_NONCHARACTERS = "\\ufdd0-\\ufdef" + "".join(f"\\U{plane:04x}fffe-\\U{plane:04x}ffff" for plane in range(17))
_BAD_INPUT = re.compile(rf"[\x01-\x08\x0b\x0e-\x1f\x7f-\x9f\ud800-\udfff{_NONCHARACTERS}]")
_UPPER = {c: c + 32 for c in range(65, 91)}


def lower(text: str) -> str:
    """A-Z lower-cased, nothing else."""
    return text.lower() if text.isascii() else text.translate(_UPPER)


def normalise_newlines(text: str) -> str:
    return text.replace("\r\n", "\n").replace("\r", "\n") if "\r" in text else text


class Tag:
    __slots__ = ("name", "attrs", "self_closing", "start", "end", "spans", "acknowledged")

    def __init__(self, name, attrs, self_closing, start, end, spans=None):
        self.name, self.attrs, self.self_closing, self.start, self.end, self.spans = name, attrs, self_closing, start, end, spans
        self.acknowledged = False


class Tokenizer:
    def __init__(self, text: str, sink, state: str = DATA, last_start_tag: str = "", spans: bool = False):
        self.text, self.sink, self.state, self.last, self.spans = text, sink, state, last_start_tag, spans
        self.at, self.size = 0, len(text)

    def input_errors(self) -> None:
        """Characters that should not be in the input at all."""
        if _BAD_INPUT.search(self.text):
            for m in _BAD_INPUT.finditer(self.text):
                code = ord(m.group())
                kind = "surrogate-in-input-stream" if 0xD800 <= code < 0xE000 else "control-character-in-input-stream" if code < 0xA0 else "noncharacter-in-input-stream"
                self.sink.error(kind, m.start(), m.start() + 1)

    def run(self) -> None:
        text, size, characters = self.text, self.size, self.sink.characters
        plain_tag, plain_text = _PLAIN_TAG.match, _TEXT.match
        while (at := self.at) < size:
            if self.state is not DATA:
                self._raw()
                continue
            c = text[at]
            if c == "<":
                m = plain_tag(text, at)
                if not (m and self._plain(m)):
                    self._markup(at)
            elif c == "&":
                value, self.at = reference(text, at, False, size, self._error)
                characters(value, at, self.at)
            else:
                self.at = end = plain_text(text, at).end()
                characters(text[at:end], at, end)

    def _error(self, code: str, place: int) -> None:
        self.sink.error(code, place, place)

    def _plain(self, m: re.Match) -> bool:
        close, name, body, slash = m.groups()
        name = name.lower()
        attrs, spans = {}, None
        if body:
            if close:
                return False
            for a in _PLAIN_ATTR.finditer(self.text, m.start(3), m.end(3)):
                key, quoted, single = a.groups()
                key = key.lower()
                if key in attrs:
                    return False
                attrs[key] = single if quoted is None else quoted
                if self.spans:
                    spans = spans or {}
                    spans[key] = a.span()
        if close:
            if slash:
                return False
            self.at = m.end()
            self.sink.end_tag(Tag(name, attrs, False, m.start(), m.end()))
            return True
        self.at = m.end()
        self.last = name
        self.sink.start_tag(Tag(name, attrs, bool(slash), m.start(), m.end(), spans))
        return True

    # --- text-only states ---------------------------------------------------------------------------------------------

    def _end_tag(self, at: int) -> int:
        """Where the appropriate end tag begins, or -1."""
        if not self.last:
            return -1
        m = re.compile(rf"</{re.escape(self.last)}(?=[\t\n\f />])", re.I | re.A).search(self.text, at)
        return m.start() if m else -1

    def _script_end(self, at: int) -> int:
        """The end tag of a script, minding <!-- <script> </script> -->."""
        text, name = self.text, re.escape(self.last)
        plain = re.compile(rf"(<!--)|(</{name}(?=[\t\n\f />]))", re.I | re.A)
        escaped = re.compile(rf"(-->)|(</{name}(?=[\t\n\f />]))|(<script[\t\n\f />])", re.I | re.A)
        double = re.compile(r"(-->)|(</script[\t\n\f />])", re.I | re.A)
        while True:
            m = plain.search(text, at)
            if not m:
                return -1
            if m.group(2):
                return m.start()
            at = m.start() + 2
            inside = escaped
            while True:
                m = inside.search(text, at)
                if not m:
                    self.sink.error("eof-in-script-html-comment-like-text", self.size, self.size)
                    return -1
                at = m.end()
                if m.group(1):
                    break
                if inside is double:
                    inside = escaped
                elif m.group(2):
                    return m.start()
                else:
                    inside = double

    def _raw(self) -> None:
        text, at, state = self.text, self.at, self.state
        if state is CDATA:
            stop = text.find("]]>", at)
            end = self.size if stop < 0 else stop
            if end > at:
                self.sink.characters(text[at:end], at, end)
            if stop < 0:
                self.sink.error("eof-in-cdata", self.size, self.size)
            self.at, self.state = (self.size if stop < 0 else stop + 3), DATA
            return
        end = -1 if state is PLAINTEXT else self._script_end(at) if state is SCRIPT else self._end_tag(at)
        stop = self.size if end < 0 else end
        if state is RCDATA:
            while at < stop:
                amp = text.find("&", at, stop)
                to = stop if amp < 0 else amp
                if to > at:
                    self.sink.characters(self._no_null(text[at:to], at), at, to)
                if amp < 0:
                    break
                value, at = reference(text, amp, False, stop, self._error)
                self.sink.characters(value, amp, at)
        elif stop > at:
            self.sink.characters(self._no_null(text[at:stop], at), at, stop)
        self.at = stop
        if end >= 0:
            self.state = DATA
            self._tag(end, True)

    def _no_null(self, value: str, at: int) -> str:
        if "\0" in value:
            for m in re.finditer("\0", value):
                self.sink.error("unexpected-null-character", at + m.start(), at + m.start() + 1)
            return value.replace("\0", "�")
        return value

    # --- markup -------------------------------------------------------------------------------------------------------

    def _markup(self, at: int) -> None:
        text, sink = self.text, self.sink
        c = text[at + 1 : at + 2]
        if c.isascii() and c.isalpha():
            self._tag(at, False)
        elif c == "/":
            d = text[at + 2 : at + 3]
            if d.isascii() and d.isalpha():
                self._tag(at, True)
            elif d == ">":
                sink.error("missing-end-tag-name", at + 2, at + 2)
                self.at = at + 3
            elif not d:
                sink.error("eof-before-tag-name", at + 2, at + 2)
                self.at = at + 2
                sink.characters("</", at, at + 2)
            else:
                sink.error("invalid-first-character-of-tag-name", at + 2, at + 2)
                self._bogus(at, at + 2)
        elif c == "!":
            if text.startswith("--", at + 2):
                self._comment(at)
            elif _DOCTYPE.match(text, at + 2):
                self._doctype(at)
            elif text.startswith("[CDATA[", at + 2):
                if sink.in_foreign():
                    self.at, self.state = at + 9, CDATA
                    if self.at >= self.size:
                        self._raw()
                else:
                    sink.error("cdata-in-html-content", at + 9, at + 9)
                    self._bogus(at, at + 2)
            else:
                sink.error("incorrectly-opened-comment", at + 2, at + 2)
                self._bogus(at, at + 2)
        elif c == "?":
            sink.error("unexpected-question-mark-instead-of-tag-name", at + 1, at + 1)
            self._bogus(at, at + 1)
        else:
            sink.error("invalid-first-character-of-tag-name" if c else "eof-before-tag-name", at + 1, at + 1)
            self.at = at + 1
            sink.characters("<", at, at + 1)

    def _bogus(self, start: int, at: int) -> None:
        stop = self.text.find(">", at)
        end = self.size if stop < 0 else stop
        self.at = end if stop < 0 else end + 1
        self.sink.comment(self._no_null(self.text[at:end], at), start, self.at)

    def _comment(self, start: int) -> None:
        text, at = self.text, start + 4
        if text.startswith(">", at) or text.startswith("->", at):
            self.sink.error("abrupt-closing-of-empty-comment", at, at)
            self.at = text.index(">", at) + 1
            self.sink.comment("", start, self.at)
            return
        m = _COMMENT_END.search(text, at)
        if m:
            data, self.at = text[at : m.start()], m.end()
            if m.end() - m.start() == 4:
                self.sink.error("incorrectly-closed-comment", m.end() - 1, m.end() - 1)
        else:
            data, self.at = re.sub(r"(?:--!|--?)\Z", "", text[at:]), self.size
            self.sink.error("eof-in-comment", self.size, self.size)
        if "<!--" in data:
            self.sink.error("nested-comment", at + data.index("<!--") + 4, at + data.index("<!--") + 4)
        self.sink.comment(self._no_null(data, at), start, self.at)

    def _spaces(self, at: int) -> int:
        return _SPACES.match(self.text, at).end()

    def _doctype(self, start: int) -> None:
        text, size, sink = self.text, self.size, self.sink
        name: str | None = None
        ids: dict[str, str | None] = {"public": None, "system": None}
        quirks = False

        def done(at: int, bad: bool = False) -> None:
            self.at = at
            sink.doctype(name, ids["public"], ids["system"], quirks or bad, start, at)

        def eof() -> None:
            sink.error("eof-in-doctype", size, size)
            done(size, True)

        def bogus(at: int, code: str, bad: bool) -> None:
            sink.error(code, at, at)
            stop = text.find(">", at)
            done(size if stop < 0 else stop + 1, bad)

        at = start + 9
        if at >= size:
            return eof()
        if text[at] not in "\t\n\f >":
            sink.error("missing-whitespace-before-doctype-name", at, at)
        at = self._spaces(at)
        if at >= size:
            return eof()
        if text[at] == ">":
            sink.error("missing-doctype-name", at, at)
            return done(at + 1, True)
        m = re.compile(r"[^\t\n\f >]+").match(text, at)
        name, at = lower(self._no_null(m.group(), at)), self._spaces(m.end())
        if at >= size:
            return eof()
        if text[at] == ">":
            return done(at + 1)
        word = text[at : at + 6].lower()
        if word not in ids:
            return bogus(at, "invalid-character-sequence-after-doctype-name", True)
        at += 6
        for kind in ("public", "system") if word == "public" else ("system",):
            spaced = self._spaces(at)
            first = kind == word
            c = text[spaced] if spaced < size else ""
            if not c:
                return eof()
            if c in "\"'":
                if spaced == at:
                    sink.error(f"missing-whitespace-after-doctype-{kind}-keyword" if first else "missing-whitespace-between-doctype-public-and-system-identifiers", at, at)
                stop = re.compile(f"[{c}>]").search(text, spaced + 1)
                ids[kind] = self._no_null(text[spaced + 1 : stop.start() if stop else size], spaced + 1)
                if not stop:
                    return eof()
                if stop.group() == ">":
                    sink.error(f"abrupt-doctype-{kind}-identifier", stop.start(), stop.start())
                    return done(stop.end(), True)
                at = stop.end()
            elif c == ">":
                if first:
                    sink.error(f"missing-doctype-{kind}-identifier", spaced, spaced)
                return done(spaced + 1, first)
            else:
                return bogus(spaced, f"missing-quote-before-doctype-{kind}-identifier", True)
        at = self._spaces(at)
        if at >= size:
            return eof()
        if text[at] == ">":
            return done(at + 1)
        return bogus(at, "unexpected-character-after-doctype-system-identifier", False)

    def _tag(self, start: int, close: bool) -> None:
        text, size, sink = self.text, self.size, self.sink
        m = _TAG_NAME.match(text, start + 1 + close)
        name, at = lower(self._no_null(m.group(), m.start())), m.end()
        attrs: dict[str, str] = {}
        spans: dict[str, tuple[int, int]] = {}
        slash = False
        while True:
            at = self._spaces(at)
            c = text[at] if at < size else ""
            if not c:
                sink.error("eof-in-tag", size, size)
                self.at = size
                return
            if c == ">":
                at += 1
                break
            if c == "/":
                at += 1
                if at < size and text[at] == ">":
                    slash, at = True, at + 1
                    break
                if at < size:
                    sink.error("unexpected-solidus-in-tag", at, at)
                continue
            begin = at
            if c == "=":
                sink.error("unexpected-equals-sign-before-attribute-name", at, at)
            at = _ATTR_NAME.match(text, at + 1).end()
            raw = text[begin:at]
            if '"' in raw or "'" in raw or "<" in raw:
                sink.error("unexpected-character-in-attribute-name", begin, begin)
            key, value, end = lower(self._no_null(raw, begin)), "", at
            at = self._spaces(at)
            if at < size and text[at] == "=":
                at = self._spaces(at + 1)
                c = text[at] if at < size else ""
                if c and c in "\"'":
                    stop = text.find(c, at + 1)
                    if stop < 0:
                        sink.error("eof-in-tag", size, size)
                        self.at = size
                        return
                    value = self._value(at + 1, stop)
                    at = end = stop + 1
                    if at < size and text[at] not in "\t\n\f />":
                        sink.error("missing-whitespace-between-attributes", at, at)
                elif c == ">":
                    sink.error("missing-attribute-value", at, at)
                    end = at
                elif c:
                    stop = _UNQUOTED.match(text, at).end()
                    if set(text[at:stop]) & set("\"'<=`"):
                        sink.error("unexpected-character-in-unquoted-attribute-value", at, at)
                    value = self._value(at, stop)
                    at = end = stop
            if key in attrs:
                sink.error("duplicate-attribute", end, end)
            else:
                attrs[key] = value
                spans[key] = begin, end
        self.at = at
        if close:
            if attrs:
                sink.error("end-tag-with-attributes", start, at)
            if slash:
                sink.error("end-tag-with-trailing-solidus", start, at)
            sink.end_tag(Tag(name, attrs, slash, start, at))
        else:
            self.last = name
            sink.start_tag(Tag(name, attrs, slash, start, at, spans if self.spans else None))

    def _value(self, at: int, stop: int) -> str:
        parts = []
        while True:
            amp = self.text.find("&", at, stop)
            parts.append(self._no_null(self.text[at : stop if amp < 0 else amp], at))
            if amp < 0:
                return "".join(parts) if len(parts) > 1 else parts[0]
            value, at = reference(self.text, amp, True, stop, self._error)
            parts.append(value)
