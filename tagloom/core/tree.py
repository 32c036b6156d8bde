"""HTML tree construction: insertion modes, active formatting, foster parenting, templates and foreign content.

Iterative throughout, so hostile nesting costs no Python stack. Nodes record the offsets of the tokens that opened and
closed them; elements that no tag of the input opened have none.
"""

from __future__ import annotations

import re

from .tokenizer import DATA, PLAINTEXT, RAWTEXT, RCDATA, SCRIPT, Tag, Tokenizer, lower

HTML, SVG, MATH = "html", "svg", "math"
ROOT, ELEMENT, TEXT, COMMENT, DOCTYPE = "root", "element", "text", "comment", "doctype"
WS = "\t\n\f\r "


class Node:
    __slots__ = ("kind", "ns", "tag", "attrs", "spans", "children", "parent", "data", "public", "system", "start", "end", "tag_end", "end_tag", "id")

    def __init__(self, kind, tag="", ns=HTML, attrs=None, start=None, end=None, spans=None):
        self.kind, self.tag, self.ns = kind, tag, ns
        self.attrs = attrs
        self.spans = spans
        self.children: list[Node] = []
        self.parent: Node | None = None
        self.data: list[str] | str = ""
        self.public = self.system = None
        self.start, self.end, self.tag_end, self.end_tag = start, end, end, False
        self.id = 0


def words(text: str) -> frozenset:
    return frozenset(text.split())


# Element sets of the HTML Standard.
VOID = words("area base basefont bgsound br col embed frame hr img input keygen link meta param source track wbr")
SPECIAL = words(
    "address applet area article aside base basefont bgsound blockquote body br button caption center col colgroup dd details dir div dl dt "
    "embed fieldset figcaption figure footer form frame frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html iframe img input keygen li "
    "link listing main marquee menu meta nav noembed noframes noscript object ol p param plaintext pre script search section select source "
    "style summary table tbody td template textarea tfoot th thead title tr track ul wbr xmp"
)
FORMATTING = words("a b big code em font i nobr s small strike strong tt u")
HEADINGS = words("h1 h2 h3 h4 h5 h6")
BLOCKS = words(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer header hgroup main menu nav ol p "
    "search section summary ul"
)
CLOSE_BLOCKS = (BLOCKS - {"p"}) | words("button listing pre")
IMPLIED = words("dd dt li optgroup option p rb rp rt rtc")
IMPLIED_ALL = IMPLIED | words("caption colgroup tbody td tfoot th thead tr")
HEAD_START = words("base basefont bgsound link meta title noframes style script template noscript")
TABLE_PARTS = words("caption col colgroup tbody td tfoot th thead tr")
MATH_TEXT = words("mi mo mn ms mtext")
SCOPE = {(HTML, t) for t in words("applet caption html table td th marquee object template")}
SCOPE |= {(MATH, t) for t in MATH_TEXT | {"annotation-xml"}} | {(SVG, t) for t in words("foreignObject desc title")}
LIST_SCOPE = SCOPE | {(HTML, "ol"), (HTML, "ul")}
BUTTON_SCOPE = SCOPE | {(HTML, "button")}
SCOPE_NAMES = {t for _, t in LIST_SCOPE | BUTTON_SCOPE}
TABLE_SCOPE = {(HTML, t) for t in words("html table template")}
FOREIGN_SPECIAL = {(MATH, t) for t in MATH_TEXT | {"annotation-xml"}} | {(SVG, t) for t in words("foreignObject desc title")}
BREAKOUT = words(
    "b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta nobr ol p pre ruby s "
    "small span strong strike sub sup table tt u ul var"
)
SVG_TAGS = {
    lower(t): t
    for t in (
        "altGlyph altGlyphDef altGlyphItem animateColor animateMotion animateTransform clipPath feBlend feColorMatrix feComponentTransfer "
        "feComposite feConvolveMatrix feDiffuseLighting feDisplacementMap feDistantLight feDropShadow feFlood feFuncA feFuncB feFuncG "
        "feFuncR feGaussianBlur feImage feMerge feMergeNode feMorphology feOffset fePointLight feSpecularLighting feSpotLight feTile "
        "feTurbulence foreignObject glyphRef linearGradient radialGradient textPath"
    ).split()
}
SVG_ATTRS = {
    lower(t): t
    for t in (
        "attributeName attributeType baseFrequency baseProfile calcMode clipPathUnits diffuseConstant edgeMode filterUnits glyphRef "
        "gradientTransform gradientUnits kernelMatrix kernelUnitLength keyPoints keySplines keyTimes lengthAdjust limitingConeAngle "
        "markerHeight markerUnits markerWidth maskContentUnits maskUnits numOctaves pathLength patternContentUnits patternTransform "
        "patternUnits pointsAtX pointsAtY pointsAtZ preserveAlpha preserveAspectRatio primitiveUnits refX refY repeatCount repeatDur "
        "requiredExtensions requiredFeatures specularConstant specularExponent spreadMethod startOffset stdDeviation stitchTiles "
        "surfaceScale systemLanguage tableValues targetX targetY textLength viewBox viewTarget xChannelSelector yChannelSelector zoomAndPan"
    ).split()
}
PREFIXED = {f"{p}:{n}": f"{p} {n}" for p, names in (("xlink", "actuate arcrole href role show title type"), ("xml", "lang space"), ("xmlns", "xlink")) for n in names.split()}
QUIRKS_PREFIXES = (
    "+//silmaril//dtd html pro v0r11 19970101//", "-//as//dtd html 3.0 aswedit + extensions//", "-//advasoft ltd//dtd html 3.0 aswedit + extensions//",
    "-//ietf//dtd html 2.0 level 1//", "-//ietf//dtd html 2.0 level 2//", "-//ietf//dtd html 2.0 strict level 1//", "-//ietf//dtd html 2.0 strict level 2//",
    "-//ietf//dtd html 2.0 strict//", "-//ietf//dtd html 2.0//", "-//ietf//dtd html 2.1e//", "-//ietf//dtd html 3.0//", "-//ietf//dtd html 3.2 final//",
    "-//ietf//dtd html 3.2//", "-//ietf//dtd html 3//", "-//ietf//dtd html level 0//", "-//ietf//dtd html level 1//", "-//ietf//dtd html level 2//",
    "-//ietf//dtd html level 3//", "-//ietf//dtd html strict level 0//", "-//ietf//dtd html strict level 1//", "-//ietf//dtd html strict level 2//",
    "-//ietf//dtd html strict level 3//", "-//ietf//dtd html strict//", "-//ietf//dtd html//", "-//metrius//dtd metrius presentational//",
    "-//microsoft//dtd internet explorer 2.0 html strict//", "-//microsoft//dtd internet explorer 2.0 html//", "-//microsoft//dtd internet explorer 2.0 tables//",
    "-//microsoft//dtd internet explorer 3.0 html strict//", "-//microsoft//dtd internet explorer 3.0 html//", "-//microsoft//dtd internet explorer 3.0 tables//",
    "-//netscape comm. corp.//dtd html//", "-//netscape comm. corp.//dtd strict html//", "-//o'reilly and associates//dtd html 2.0//",
    "-//o'reilly and associates//dtd html extended 1.0//", "-//o'reilly and associates//dtd html extended relaxed 1.0//",
    "-//sq//dtd html 2.0 hotmetal + extensions//", "-//softquad software//dtd hotmetal pro 6.0::19990601::extensions to html 4.0//",
    "-//softquad//dtd hotmetal pro 4.0::19971010::extensions to html 4.0//", "-//spyglass//dtd html 2.0 extended//", "-//sun microsystems corp.//dtd hotjava html//",
    "-//sun microsystems corp.//dtd hotjava strict html//", "-//w3c//dtd html 3 1995-03-24//", "-//w3c//dtd html 3.2 draft//", "-//w3c//dtd html 3.2 final//",
    "-//w3c//dtd html 3.2//", "-//w3c//dtd html 3.2s draft//", "-//w3c//dtd html 4.0 frameset//", "-//w3c//dtd html 4.0 transitional//",
    "-//w3c//dtd html experimental 19960712//", "-//w3c//dtd html experimental 970421//", "-//w3c//dtd w3 html//", "-//w3o//dtd w3 html 3.0//",
    "-//webtechs//dtd mozilla html 2.0//", "-//webtechs//dtd mozilla html//",
)
QUIRKS_IDS = ("-//w3o//dtd w3 html strict 3.0//en//", "-/w3c/dtd html 4.0 transitional/en", "html")
MARKER = None
_TAG = re.compile(r"[a-z][^\t\n\f\r />\0]*\Z")


class TreeBuilder:
    """Builds ``root`` from ``text``; ``errors`` holds (code, start, end), ``modes`` the changes of insertion mode."""

    def __init__(self, text: str, context: str | None = None, scripting: bool = True, spans: bool = False, trace: bool = False):
        self.text, self.scripting, self.fragment = text, scripting, context is not None
        self.tokenizer = Tokenizer(text, self, spans=spans)
        self.root = Node(ROOT)
        self.errors: list[tuple[str, int, int]] = []
        self.modes: list[tuple] = []
        self.trace = trace
        self.stack: list[Node] = []
        self.formatting: list = []  # (node, tag) or MARKER
        self.templates: list[str] = []
        self.mode = self.original = "initial"
        self.head = self.form = None
        self.frameset_ok, self.quirks, self.foster, self.skip_newline = True, False, False, False
        self.pending: list = []
        self.where = (0, 0)
        self.closing: Tag | None = None
        self.context = None
        self.hollow: list[Node] = []
        self.open_p = 0  # of the open elements, how many are p: without one, none needs to be looked for
        if self.fragment:
            if context in ("frame", "image") or not _TAG.match(context):  # no element of that name can be parsed
                context = "template"
            self.context = Node(ELEMENT, context, {"svg": SVG, "math": MATH}.get(context, HTML), {})
            self._begin_fragment(context)
        cls = type(self)
        table = _HANDLERS.setdefault(cls, {})
        if not table:
            for name in dir(cls):
                if name[:2] in ("c_", "s_", "e_", "z_"):
                    table[name] = getattr(cls, name)
        self.handlers = table

    def _begin_fragment(self, name: str) -> None:
        html = Node(ELEMENT, "html")
        self._attach(self.root, html)
        self.stack.append(html)
        if name == "template":
            self.templates.append("in_template")
        if name in ("title", "textarea"):
            self.tokenizer.state = RCDATA
        elif name in ("style", "xmp", "iframe", "noembed", "noframes") or (name == "noscript" and self.scripting):
            self.tokenizer.state = RAWTEXT
        elif name == "script":
            self.tokenizer.state = SCRIPT
        elif name == "plaintext":
            self.tokenizer.state = PLAINTEXT
        self._reset_mode()
        if name == "form":
            self.form = self.context

    def run(self) -> TreeBuilder:
        self.tokenizer.input_errors()
        self.tokenizer.run()
        self._eof()
        if self.fragment:  # what hangs below the html element is the fragment
            html = self.root.children[0]
            self.root.children = html.children
            for child in self.root.children:
                child.parent = self.root
        for template in self.hollow:  # a template's contents are no children of it
            template.children = []
        _adopt_options(self.root)
        self.errors.sort(key=lambda e: e[1])
        return self

    # --- the sink -----------------------------------------------------------------------------------------------------

    def error(self, code: str, start: int, end: int) -> None:
        self.errors.append((code, start, end))

    def _wrong(self, code: str) -> None:
        self.errors.append((code, *self.where))

    def _adjusted(self) -> Node:
        return self.context if self.fragment and len(self.stack) == 1 else self.stack[-1]

    def in_foreign(self) -> bool:
        return bool(self.stack) and self._adjusted().ns != HTML

    def _moved(self, before: str, kind: str, name: str | None, start: int, end: int) -> None:
        if before != self.mode:
            self.modes.append((_camel(before), _camel(self.mode), kind, name, start, end))

    def characters(self, text: str, start: int, end: int) -> None:
        if self.skip_newline:
            self.skip_newline = False
            if text[0] == "\n":
                text, start = text[1:], start + 1
                if not text:
                    return
        self.where = (start, end)
        before = self.mode
        stack = self.stack
        if stack and (stack[-1].ns is not HTML or self.fragment) and self._foreign_for(None, text):
            self._foreign_characters(text, start, end)
        else:
            self.handlers["c_" + before](self, text, start, end)
        if self.trace:
            self._moved(before, "Character", None, start, end)

    def start_tag(self, tag: Tag) -> None:
        self.skip_newline = False
        self.where = (tag.start, tag.end)
        before = self.mode
        stack = self.stack
        if stack and (stack[-1].ns is not HTML or self.fragment) and self._foreign_for(tag, None):
            self._foreign_start(tag)
        else:
            self.handlers["s_" + before](self, tag)
        if tag.self_closing and not tag.acknowledged:
            self._wrong("non-void-html-element-start-tag-with-trailing-solidus")
        if self.trace:
            self._moved(before, "StartTag", tag.name, tag.start, tag.end)

    def end_tag(self, tag: Tag) -> None:
        self.skip_newline = False
        self.where = (tag.start, tag.end)
        self.closing = tag
        before = self.mode
        if self.stack and (self.stack[-1].ns is not HTML or self.fragment) and self._adjusted().ns != HTML:
            self._foreign_end(tag)
        else:
            self.handlers["e_" + before](self, tag)
        self.closing = None
        if self.trace:
            self._moved(before, "EndTag", tag.name, tag.start, tag.end)

    def comment(self, data: str, start: int, end: int) -> None:
        self.skip_newline = False
        self.where = (start, end)
        if self.mode == "in_table_text":
            self._flush_pending()
        node = Node(COMMENT, start=start, end=end)
        node.data = data
        if self.mode in ("initial", "before_html", "after_after_body", "after_after_frameset"):
            self._attach(self.root, node)
        elif self.mode == "after_body":
            self._attach(self.stack[0], node)
        else:
            self._attach(self.stack[-1], node)

    def doctype(self, name, public, system, quirks, start, end) -> None:
        self.skip_newline = False
        self.where = (start, end)
        if self.mode == "in_table_text":
            self._flush_pending()
        if self.mode != "initial":
            self._wrong("misplaced-doctype")
            return
        node = Node(DOCTYPE, start=start, end=end)
        node.data, node.public, node.system = name or "", public or "", system or ""
        self._attach(self.root, node)
        if name != "html" or public is not None or system not in (None, "about:legacy-compat"):
            self._wrong("non-conforming-doctype")
        p, s = lower(public) if public is not None else None, lower(system) if system is not None else None
        self.quirks = quirks or name != "html" or s == "http://www.ibm.com/data/dtd/v11/ibmxhtml1-transitional.dtd" or (
            p is not None and (p in QUIRKS_IDS or p.startswith(QUIRKS_PREFIXES) or (s is None and p.startswith(("-//w3c//dtd html 4.01 frameset//", "-//w3c//dtd html 4.01 transitional//"))))
        )
        self.mode = "before_html"
        if self.trace:
            self._moved("initial", "Doctype", None, start, end)

    def _eof(self) -> None:
        size = self.tokenizer.size
        self.where = (size, size)
        self.skip_newline = False
        for _ in range(64):  # each step leaves a mode for a later one
            before = self.mode
            if self.handlers["z_" + before](self):
                break
            if self.trace:
                self._moved(before, "EOF", None, size, size)
        keep = 0 if self.fragment else 2
        for node in self.stack[keep:]:
            self._set_end(node)
        for node in self.stack[:keep]:
            if not node.end_tag:
                self._set_end(node)

    # --- tree operations ----------------------------------------------------------------------------------------------

    @staticmethod
    def _attach(parent: Node, node: Node) -> None:
        node.parent = parent
        parent.children.append(node)

    def _set_end(self, node: Node) -> None:
        if node.start is None:
            return
        tag = self.closing
        if tag is not None and lower(node.tag) == tag.name:
            node.end, node.end_tag = tag.end, True
        else:
            node.end = self.where[0]

    def _pop(self) -> Node:
        node = self.stack.pop()
        if node.tag == "p":
            self.open_p -= 1
        self._set_end(node)
        return node

    def _foster_place(self) -> tuple[Node, Node | None]:
        for i in range(len(self.stack) - 1, -1, -1):
            node = self.stack[i]
            if node.ns == HTML and node.tag == "template":
                return node, None
            if node.ns == HTML and node.tag == "table":
                if node.parent is not None:
                    return node.parent, node
                return self.stack[i - 1], None
        return self.stack[0], None

    def _fostering(self) -> bool:
        top = self.stack[-1]
        return self.foster and top.ns == HTML and top.tag in ("table", "tbody", "tfoot", "thead", "tr")

    def _insert(self, node: Node) -> None:
        if self.foster and self._fostering():
            parent, before = self._foster_place()
            node.parent = parent
            if before is None:
                parent.children.append(node)
            else:
                parent.children.insert(_place(parent, before), node)
        else:
            parent = self.stack[-1]
            node.parent = parent
            parent.children.append(node)

    def _element(self, tag: Tag, ns: str = HTML) -> Node:
        node = Node(ELEMENT, tag.name, ns, tag.attrs, tag.start, tag.end, tag.spans)
        if self.foster:
            self._insert(node)
        else:
            parent = self.stack[-1]
            node.parent = parent
            parent.children.append(node)
        self.stack.append(node)
        if tag.name == "p":
            self.open_p += 1
        return node

    def _void(self, tag: Tag, ns: str = HTML) -> None:
        self._insert(Node(ELEMENT, tag.name, ns, tag.attrs, tag.start, tag.end, tag.spans))
        tag.acknowledged = True

    def _fake(self, name: str) -> Node:
        node = Node(ELEMENT, name, HTML, {})
        self._insert(node)
        self.stack.append(node)
        self.open_p += name == "p"
        return node

    def _text(self, text: str, start: int, end: int) -> None:
        if self.foster and self._fostering():
            parent, before = self._foster_place()
            place = len(parent.children) if before is None else _place(parent, before)
        else:
            parent = self.stack[-1]
            place = len(parent.children)
        if place and (last := parent.children[place - 1]).kind is TEXT:
            last.data.append(text)
            last.end = end
            return
        node = Node(TEXT, start=start, end=end)
        node.data = [text]
        node.parent = parent
        if place == len(parent.children):
            parent.children.append(node)
        else:
            parent.children.insert(place, node)

    def _in_scope(self, name: str, scope=SCOPE) -> bool:
        for node in reversed(self.stack):
            tag = node.tag
            if tag == name and node.ns == HTML:
                return True
            if tag in SCOPE_NAMES and (node.ns, tag) in scope:
                return False
        return False

    def _heading_in_scope(self) -> bool:
        for node in reversed(self.stack):
            if node.ns == HTML and node.tag in HEADINGS:
                return True
            if (node.ns, node.tag) in SCOPE:
                return False
        return False

    def _in_select_scope(self, name: str) -> bool:
        for node in reversed(self.stack):
            if node.ns == HTML and node.tag == name:
                return True
            if not (node.ns == HTML and node.tag in ("optgroup", "option")):
                return False
        return False

    def _on_stack(self, name: str) -> bool:
        return any(n.tag == name and n.ns == HTML for n in self.stack)

    def _implied_ends(self, but: str | None = None, all_of: frozenset = IMPLIED) -> None:
        while (top := self.stack[-1]).ns == HTML and top.tag in all_of and top.tag != but:
            self._pop()

    def _pop_until(self, *names: str) -> None:
        while True:
            node = self._pop()
            if node.ns == HTML and node.tag in names:
                return

    def _pop_through(self, node: Node) -> None:
        while self._pop() is not node:
            pass

    def _clear_to(self, *names: str) -> None:
        while not ((top := self.stack[-1]).ns == HTML and (top.tag in names or top.tag in ("html", "template"))):
            self._pop()

    def _is(self, *names: str) -> bool:
        top = self.stack[-1]
        return top.ns == HTML and top.tag in names

    def _close_p(self) -> None:
        self._implied_ends("p")
        if not self._is("p"):
            self._wrong("closing-of-element-with-open-child-elements")
        self._pop_until("p")

    def _close_p_in_scope(self) -> None:
        if self.open_p and self._in_scope("p", BUTTON_SCOPE):
            self._close_p()

    # --- active formatting --------------------------------------------------------------------------------------------

    def _push_formatting(self, node: Node, tag: Tag) -> None:
        same = []
        for i in range(len(self.formatting) - 1, -1, -1):
            entry = self.formatting[i]
            if entry is MARKER:
                break
            other = entry[0]
            if other.tag == node.tag and other.attrs == node.attrs:
                same.append(i)
        if len(same) >= 3:
            del self.formatting[same[-1]]
        self.formatting.append((node, tag))

    def _reconstruct(self) -> None:
        formatting = self.formatting
        if not formatting:
            return
        entry = formatting[-1]
        if entry is MARKER or entry[0] in self.stack[-8:] or entry[0] in self.stack:
            return
        i = len(formatting) - 1
        on = set(map(id, self.stack))
        while i > 0 and formatting[i - 1] is not MARKER and id(formatting[i - 1][0]) not in on:
            i -= 1
        for k in range(i, len(formatting)):
            tag = formatting[k][1]
            node = self._element(Tag(tag.name, dict(tag.attrs), False, tag.start, tag.end, tag.spans))
            formatting[k] = (node, tag)

    def _clear_formatting(self) -> None:
        while self.formatting and self.formatting.pop() is not MARKER:
            pass

    def _formatting_entry(self, name: str) -> int:
        for i in range(len(self.formatting) - 1, -1, -1):
            entry = self.formatting[i]
            if entry is MARKER:
                return -1
            if entry[0].tag == name:
                return i
        return -1

    def _adoption(self, tag: Tag) -> None:
        name = tag.name
        top = self.stack[-1]
        if top.tag == name and top.ns == HTML and all(e is MARKER or e[0] is not top for e in self.formatting):
            self._pop()
            return
        for _ in range(8):
            at = self._formatting_entry(name)
            if at < 0:
                self._any_other_end(tag)
                return
            node, own = self.formatting[at]
            if node not in self.stack:
                self._wrong("end-tag-without-matching-open-element")
                del self.formatting[at]
                return
            if not self._node_in_scope(node):
                self._wrong("end-tag-without-matching-open-element")
                return
            place = self.stack.index(node)
            block = next((i for i in range(place + 1, len(self.stack)) if self._special(self.stack[i])), -1)
            if block < 0:
                while self._pop() is not node:
                    pass
                del self.formatting[at]
                return
            furthest = self.stack[block]
            common = self.stack[place - 1]
            bookmark, last = at, furthest
            index = block
            inner = 0
            while True:
                inner += 1
                index -= 1
                current = self.stack[index]
                if current is node:
                    break
                entry = next((i for i, e in enumerate(self.formatting) if e is not MARKER and e[0] is current), -1)
                if inner > 3 and entry >= 0:
                    del self.formatting[entry]
                    if entry < bookmark:
                        bookmark -= 1
                    entry = -1
                if entry < 0:
                    del self.stack[index]
                    continue
                original = self.formatting[entry][1]
                fresh = Node(ELEMENT, current.tag, current.ns, dict(current.attrs))
                self.formatting[entry] = (fresh, original)
                self.stack[index] = fresh
                if last is furthest:
                    bookmark = entry + 1
                _detach(last)
                self._attach(fresh, last)
                last = fresh
            _detach(last)
            self._insert_at(common, last)
            fresh = Node(ELEMENT, node.tag, node.ns, dict(node.attrs))
            for child in furthest.children:
                child.parent = fresh
            fresh.children, furthest.children = furthest.children, []
            self._attach(furthest, fresh)
            at = next(i for i, e in enumerate(self.formatting) if e is not MARKER and e[0] is node)
            del self.formatting[at]
            self.formatting.insert(bookmark - (at < bookmark), (fresh, own))
            self._set_end(node)
            self.stack.remove(node)
            self.stack.insert(self.stack.index(furthest) + 1, fresh)

    def _insert_at(self, target: Node, node: Node) -> None:
        """At the appropriate place for inserting, target overriding the current node."""
        if target.ns == HTML and target.tag in ("table", "tbody", "tfoot", "thead", "tr"):
            parent, before = self._foster_place()
            node.parent = parent
            parent.children.insert(len(parent.children) if before is None else _place(parent, before), node)
        else:
            self._attach(target, node)

    def _node_in_scope(self, wanted: Node) -> bool:
        for node in reversed(self.stack):
            if node is wanted:
                return True
            if (node.ns, node.tag) in SCOPE:
                return False
        return False

    @staticmethod
    def _special(node: Node) -> bool:
        return node.tag in SPECIAL if node.ns == HTML else (node.ns, node.tag) in FOREIGN_SPECIAL

    def _any_other_end(self, tag: Tag) -> None:
        name = tag.name
        for i in range(len(self.stack) - 1, -1, -1):
            node = self.stack[i]
            if node.ns == HTML and node.tag == name:
                self._implied_ends(name)
                if self.stack[-1] is not node:
                    self._wrong("closing-of-element-with-open-child-elements")
                while len(self.stack) > i:
                    self._pop()
                return
            if self._special(node):
                self._wrong("end-tag-without-matching-open-element")
                return

    # --- modes --------------------------------------------------------------------------------------------------------

    def _reset_mode(self) -> None:
        for i in range(len(self.stack) - 1, -1, -1):
            node, last = self.stack[i], i == 0
            if last and self.fragment:
                node = self.context
            name = node.tag if node.ns == HTML else ""
            if name == "select":
                mode = "in_select"
                if not last:
                    for above in reversed(self.stack[:i]):
                        if above.ns == HTML and above.tag == "template":
                            break
                        if above.ns == HTML and above.tag == "table":
                            mode = "in_select_in_table"
                            break
                self.mode = mode
                return
            if name in ("td", "th") and not last:
                self.mode = "in_cell"
                return
            if name in _RESET:
                self.mode = _RESET[name]
                return
            if name == "head" and not last:
                self.mode = "in_head"
                return
            if name == "template":
                self.mode = self.templates[-1]
                return
            if name == "html":
                self.mode = "before_head" if self.head is None else "after_head"
                return
            if last:
                self.mode = "in_body"
                return

    def _again(self, kind: str, *args) -> None:
        """Process the token once more in the mode that has been set."""
        self.handlers[kind + self.mode](self, *args)

    def _generic(self, tag: Tag, state: str) -> None:
        self._element(tag)
        self.tokenizer.state = state
        self.original, self.mode = self.mode, "text"

    @staticmethod
    def _lead(text: str) -> int:
        return len(text) - len(text.lstrip(WS))

    # initial
    def c_initial(self, text, start, end):
        lead = self._lead(text)
        if lead == len(text):
            return
        self._no_doctype()
        self._again("c_", text[lead:], start + lead, end)

    def _no_doctype(self):
        self._wrong("missing-doctype")
        self.quirks, self.mode = True, "before_html"

    def s_initial(self, tag):
        self._no_doctype()
        self._again("s_", tag)

    def e_initial(self, tag):
        self._no_doctype()
        self._again("e_", tag)

    def z_initial(self):
        self._no_doctype()

    # before html
    def _fake_html(self):
        node = Node(ELEMENT, "html", HTML, {})
        self._attach(self.root, node)
        self.stack.append(node)
        self.mode = "before_head"

    def c_before_html(self, text, start, end):
        lead = self._lead(text)
        if lead < len(text):
            self._fake_html()
            self._again("c_", text[lead:], start + lead, end)

    def s_before_html(self, tag):
        if tag.name == "html":
            node = Node(ELEMENT, "html", HTML, tag.attrs, tag.start, tag.end, tag.spans)
            self._attach(self.root, node)
            self.stack.append(node)
            self.mode = "before_head"
            return
        self._fake_html()
        self._again("s_", tag)

    def e_before_html(self, tag):
        if tag.name in ("head", "body", "html", "br"):
            self._fake_html()
            self._again("e_", tag)
        else:
            self._wrong("end-tag-without-matching-open-element")

    def z_before_html(self):
        self._fake_html()

    # before head
    def _fake_head(self):
        self.head = self._fake("head")
        self.mode = "in_head"

    def c_before_head(self, text, start, end):
        lead = self._lead(text)
        if lead < len(text):
            self._fake_head()
            self._again("c_", text[lead:], start + lead, end)

    def s_before_head(self, tag):
        if tag.name == "html":
            return self._merge_html(tag)
        if tag.name == "head":
            self.head = self._element(tag)
            self.mode = "in_head"
            return
        self._fake_head()
        self._again("s_", tag)

    def e_before_head(self, tag):
        if tag.name in ("head", "body", "html", "br"):
            self._fake_head()
            self._again("e_", tag)
        else:
            self._wrong("end-tag-without-matching-open-element")

    def z_before_head(self):
        self._fake_head()

    def _merge_html(self, tag):
        if not self.templates and not self._on_stack("template"):
            for k, v in tag.attrs.items():
                if k not in self.stack[0].attrs:
                    self.stack[0].attrs[k] = v

    # in head
    def _leave_head(self):
        self._pop()
        self.mode = "after_head"

    def c_in_head(self, text, start, end):
        lead = self._lead(text)
        if lead:
            self._text(text[:lead], start, start + lead if lead < len(text) else end)
        if lead < len(text):
            self._leave_head()
            self._again("c_", text[lead:], start + lead, end)

    def s_in_head(self, tag):
        name = tag.name
        if name == "html":
            self._merge_html(tag)
        elif name in ("base", "basefont", "bgsound", "link", "meta"):
            self._void(tag)
        elif name == "title":
            self._generic(tag, RCDATA)
        elif name in ("noframes", "style") or (name == "noscript" and self.scripting):
            self._generic(tag, RAWTEXT)
        elif name == "noscript":
            self._element(tag)
            self.mode = "in_head_noscript"
        elif name == "script":
            self._generic(tag, SCRIPT)
        elif name == "template":
            self.hollow.append(self._element(tag))
            self.formatting.append(MARKER)
            self.frameset_ok = False
            self.mode = "in_template"
            self.templates.append("in_template")
        elif name == "head":
            self._wrong("misplaced-start-tag-for-head-element")
        else:
            self._leave_head()
            self._again("s_", tag)

    def e_in_head(self, tag):
        if tag.name == "head":
            self._pop()
            self.mode = "after_head"
        elif tag.name in ("body", "html", "br"):
            self._leave_head()
            self._again("e_", tag)
        elif tag.name == "template":
            self._end_template()
        else:
            self._wrong("end-tag-without-matching-open-element")

    def z_in_head(self):
        self._leave_head()

    def _end_template(self):
        if not self._on_stack("template"):
            self._wrong("end-tag-without-matching-open-element")
            return
        self._implied_ends(all_of=IMPLIED_ALL)
        if not self._is("template"):
            self._wrong("closing-of-element-with-open-child-elements")
        self._pop_until("template")
        self._clear_formatting()
        self.templates.pop()
        self._reset_mode()

    # in head noscript
    def _leave_noscript(self):
        self._wrong("disallowed-content-in-noscript-in-head")
        self._pop()
        self.mode = "in_head"

    def c_in_head_noscript(self, text, start, end):
        lead = self._lead(text)
        if lead:
            self._text(text[:lead], start, start + lead if lead < len(text) else end)
        if lead < len(text):
            self._leave_noscript()
            self._again("c_", text[lead:], start + lead, end)

    def s_in_head_noscript(self, tag):
        if tag.name == "html":
            self._merge_html(tag)
        elif tag.name in ("basefont", "bgsound", "link", "meta", "noframes", "style"):
            self.s_in_head(tag)
        elif tag.name in ("head", "noscript"):
            self._wrong("nested-noscript-in-head")
        else:
            self._leave_noscript()
            self._again("s_", tag)

    def e_in_head_noscript(self, tag):
        if tag.name == "noscript":
            self._pop()
            self.mode = "in_head"
        elif tag.name == "br":
            self._leave_noscript()
            self._again("e_", tag)
        else:
            self._wrong("end-tag-without-matching-open-element")

    def z_in_head_noscript(self):
        self._leave_noscript()

    # after head
    def _fake_body(self):
        self._fake("body")
        self.mode = "in_body"

    def c_after_head(self, text, start, end):
        lead = self._lead(text)
        if lead:
            self._text(text[:lead], start, start + lead if lead < len(text) else end)
        if lead < len(text):
            self._fake_body()
            self._again("c_", text[lead:], start + lead, end)

    def s_after_head(self, tag):
        name = tag.name
        if name == "html":
            self._merge_html(tag)
        elif name == "body":
            self._element(tag)
            self.frameset_ok = False
            self.mode = "in_body"
        elif name == "frameset":
            self._element(tag)
            self.mode = "in_frameset"
        elif name in HEAD_START and name != "noscript":
            self._wrong("abandoned-head-element-child")
            self.stack.append(self.head)
            self.s_in_head(tag)
            self.stack.remove(self.head)
        elif name == "head":
            self._wrong("misplaced-start-tag-for-head-element")
        else:
            self._fake_body()
            self._again("s_", tag)

    def e_after_head(self, tag):
        if tag.name in ("body", "html", "br"):
            self._fake_body()
            self._again("e_", tag)
        elif tag.name == "template":
            self._end_template()
        else:
            self._wrong("end-tag-without-matching-open-element")

    def z_after_head(self):
        self._fake_body()

    # in body
    def c_in_body(self, text, start, end):
        if "\0" in text:
            self._wrong("unexpected-null-character")
            text = text.replace("\0", "")
            if not text:
                return
        if self.formatting:
            self._reconstruct()
        self._text(text, start, end)
        if self.frameset_ok and text.strip(WS):
            self.frameset_ok = False

    def s_in_body(self, tag):
        handler = _BODY_START.get(tag.name)
        if handler:
            handler(self, tag)
        else:
            self._reconstruct()
            self._element(tag)

    def e_in_body(self, tag):
        name = tag.name
        handler = _BODY_END.get(name)
        if handler:
            handler(self, tag)
        elif name in FORMATTING:
            self._adoption(tag)
        else:
            self._any_other_end(tag)

    def z_in_body(self):
        if self.templates:
            return self.z_in_template()
        return True

    def _b_html(self, tag):
        self._merge_html(tag)

    def _b_head_part(self, tag):
        self.s_in_head(tag)

    def _b_body(self, tag):
        if len(self.stack) < 2 or self.stack[1].tag != "body" or self._on_stack("template"):
            return
        self.frameset_ok = False
        for k, v in tag.attrs.items():
            if k not in self.stack[1].attrs:
                self.stack[1].attrs[k] = v

    def _b_frameset(self, tag):
        if len(self.stack) < 2 or self.stack[1].tag != "body" or not self.frameset_ok:
            return
        _detach(self.stack[1])
        while len(self.stack) > 1:
            self._pop()
        self._element(tag)
        self.mode = "in_frameset"

    def _b_block(self, tag):
        self._close_p_in_scope()
        self._element(tag)

    def _b_heading(self, tag):
        self._close_p_in_scope()
        if self._is(*HEADINGS):
            self._pop()
        self._element(tag)

    def _b_pre(self, tag):
        self._close_p_in_scope()
        self._element(tag)
        self.skip_newline, self.frameset_ok = True, False

    def _b_form(self, tag):
        template = self._on_stack("template")
        if self.form is not None and not template:
            return
        self._close_p_in_scope()
        node = self._element(tag)
        if not template:
            self.form = node

    def _b_li(self, tag):
        self.frameset_ok = False
        names = ("li",) if tag.name == "li" else ("dd", "dt")
        for node in reversed(self.stack):
            if node.ns == HTML and node.tag in names:
                self._implied_ends(node.tag)
                self._pop_until(node.tag)
                break
            if self._special(node) and not (node.ns == HTML and node.tag in ("address", "div", "p")):
                break
        self._close_p_in_scope()
        self._element(tag)

    def _b_plaintext(self, tag):
        self._close_p_in_scope()
        self._element(tag)
        self.tokenizer.state = PLAINTEXT

    def _b_button(self, tag):
        if self._in_scope("button"):
            self._implied_ends()
            self._pop_until("button")
        self._reconstruct()
        self._element(tag)
        self.frameset_ok = False

    def _b_a(self, tag):
        at = self._formatting_entry("a")
        if at >= 0:
            node = self.formatting[at][0]
            self._adoption(Tag("a", {}, False, tag.start, tag.start))
            self.formatting = [e for e in self.formatting if e is MARKER or e[0] is not node]
            if node in self.stack:
                self.stack.remove(node)
        self._b_formatting(tag)

    def _b_formatting(self, tag):
        self._reconstruct()
        self._push_formatting(self._element(tag), tag)

    def _b_nobr(self, tag):
        self._reconstruct()
        if self._in_scope("nobr"):
            self._adoption(Tag("nobr", {}, False, tag.start, tag.start))
            self._reconstruct()
        self._push_formatting(self._element(tag), tag)

    def _b_object(self, tag):
        self._reconstruct()
        self._element(tag)
        self.formatting.append(MARKER)
        self.frameset_ok = False

    def _b_table(self, tag):
        if not self.quirks:
            self._close_p_in_scope()
        self._element(tag)
        self.frameset_ok = False
        self.mode = "in_table"

    def _b_void(self, tag):
        self._reconstruct()
        self._void(tag)
        self.frameset_ok = False

    def _b_input(self, tag):
        self._reconstruct()
        self._void(tag)
        if lower(tag.attrs.get("type", "")) != "hidden":
            self.frameset_ok = False

    def _b_param(self, tag):
        self._void(tag)

    def _b_hr(self, tag):
        self._close_p_in_scope()
        self._void(tag)
        self.frameset_ok = False

    def _b_image(self, tag):
        tag.name = "img"
        self._b_void(tag)

    def _b_textarea(self, tag):
        self._element(tag)
        self.skip_newline, self.frameset_ok = True, False
        self.tokenizer.state = RCDATA
        self.original, self.mode = self.mode, "text"

    def _b_xmp(self, tag):
        self._close_p_in_scope()
        self._reconstruct()
        self.frameset_ok = False
        self._generic(tag, RAWTEXT)

    def _b_iframe(self, tag):
        self.frameset_ok = False
        self._generic(tag, RAWTEXT)

    def _b_raw(self, tag):
        self._generic(tag, RAWTEXT)

    def _b_noscript(self, tag):
        if self.scripting:
            self._generic(tag, RAWTEXT)
        else:
            self._reconstruct()
            self._element(tag)

    def _b_select(self, tag):
        self._reconstruct()
        self._element(tag)
        self.frameset_ok = False
        self.mode = "in_select_in_table" if self.mode in ("in_table", "in_caption", "in_table_body", "in_row", "in_cell") else "in_select"

    def _b_option(self, tag):
        if self._is("option"):
            self._pop()
        self._reconstruct()
        self._element(tag)

    def _b_rb(self, tag):
        if self._in_scope("ruby"):
            self._implied_ends()
        self._element(tag)

    def _b_rt(self, tag):
        if self._in_scope("ruby"):
            self._implied_ends("rtc")
        self._element(tag)

    def _b_math(self, tag):
        self._reconstruct()
        self._foreign_insert(tag, MATH if tag.name == "math" else SVG)

    def _b_ignored(self, tag):
        pass

    def _b_end_body(self, tag):
        if not self._in_scope("body"):
            self._wrong("end-tag-without-matching-open-element")
            return False
        self.mode = "after_body"
        if len(self.stack) > 1 and self.stack[1].tag == "body" and tag.name == "body":
            self._set_end(self.stack[1])
        return True

    def _b_end_html(self, tag):
        if self._b_end_body(tag):
            self._again("e_", tag)

    def _b_end_block(self, tag):
        name = tag.name
        if not self._in_scope(name):
            self._wrong("end-tag-without-matching-open-element")
            return
        self._implied_ends()
        if not self._is(name):
            self._wrong("closing-of-element-with-open-child-elements")
        self._pop_until(name)

    def _b_end_form(self, tag):
        if self._on_stack("template"):
            if not self._in_scope("form"):
                self._wrong("end-tag-without-matching-open-element")
                return
            self._implied_ends()
            self._pop_until("form")
            return
        node, self.form = self.form, None
        if node is None or not self._node_in_scope(node):
            self._wrong("end-tag-without-matching-open-element")
            return
        self._implied_ends()
        if self.stack[-1] is not node:
            self._wrong("closing-of-element-with-open-child-elements")
        self._set_end(node)
        self.stack.remove(node)

    def _b_end_p(self, tag):
        if not self._in_scope("p", BUTTON_SCOPE):
            self._wrong("end-tag-without-matching-open-element")
            self._fake("p")
        self._close_p()

    def _b_end_li(self, tag):
        name = tag.name
        if not self._in_scope(name, LIST_SCOPE if name == "li" else SCOPE):
            self._wrong("end-tag-without-matching-open-element")
            return
        self._implied_ends(name)
        if not self._is(name):
            self._wrong("closing-of-element-with-open-child-elements")
        self._pop_until(name)

    def _b_end_heading(self, tag):
        if not self._heading_in_scope():
            self._wrong("end-tag-without-matching-open-element")
            return
        self._implied_ends()
        if not self._is(tag.name):
            self._wrong("closing-of-element-with-open-child-elements")
        self._pop_until(*HEADINGS)

    def _b_end_object(self, tag):
        if not self._in_scope(tag.name):
            self._wrong("end-tag-without-matching-open-element")
            return
        self._implied_ends()
        self._pop_until(tag.name)
        self._clear_formatting()

    def _b_end_br(self, tag):
        self._wrong("end-tag-without-matching-open-element")
        self._reconstruct()
        self._insert(Node(ELEMENT, "br", HTML, {}))
        self.frameset_ok = False

    def _b_end_template(self, tag):
        self._end_template()

    # text
    def c_text(self, text, start, end):
        self._text(text, start, end)

    def s_text(self, tag):  # cannot come
        pass

    def e_text(self, tag):
        self._pop()
        self.mode = self.original

    def z_text(self):
        self._wrong("eof-in-element-that-can-contain-only-text")
        self._pop()
        self.mode = self.original

    # in table
    def c_in_table(self, text, start, end):
        if self._is("table", "tbody", "template", "tfoot", "thead", "tr"):
            self.pending = []
            self.original, self.mode = self.mode, "in_table_text"
            self.c_in_table_text(text, start, end)
        else:
            self._fostered("c_in_body", text, start, end)

    def _fostered(self, handler: str, *args):
        self.foster = True
        self.handlers[handler](self, *args)
        self.foster = False

    def s_in_table(self, tag):
        name = tag.name
        if name == "caption":
            self._clear_to("table")
            self.formatting.append(MARKER)
            self._element(tag)
            self.mode = "in_caption"
        elif name == "colgroup":
            self._clear_to("table")
            self._element(tag)
            self.mode = "in_column_group"
        elif name == "col":
            self._clear_to("table")
            self._fake("colgroup")
            self.mode = "in_column_group"
            self._again("s_", tag)
        elif name in ("tbody", "tfoot", "thead"):
            self._clear_to("table")
            self._element(tag)
            self.mode = "in_table_body"
        elif name in ("td", "th", "tr"):
            self._clear_to("table")
            self._fake("tbody")
            self.mode = "in_table_body"
            self._again("s_", tag)
        elif name == "table":
            if self._in_scope("table", TABLE_SCOPE):
                self._pop_until("table")
                self._reset_mode()
                self._again("s_", tag)
        elif name in ("style", "script", "template"):
            self.s_in_head(tag)
        elif name == "input" and lower(tag.attrs.get("type", "")) == "hidden":
            self._void(tag)
        elif name == "form":
            if self.form is None and not self._on_stack("template"):
                self.form = self._element(tag)
                self._pop()
        else:
            self._fostered("s_in_body", tag)

    def e_in_table(self, tag):
        name = tag.name
        if name == "table":
            if self._in_scope("table", TABLE_SCOPE):
                self._pop_until("table")
                self._reset_mode()
            else:
                self._wrong("end-tag-without-matching-open-element")
        elif name in ("body", "html") or name in TABLE_PARTS:
            self._wrong("end-tag-without-matching-open-element")
        elif name == "template":
            self._end_template()
        else:
            self._fostered("e_in_body", tag)

    def z_in_table(self):
        return self.z_in_body()

    # in table text
    def c_in_table_text(self, text, start, end):
        if "\0" in text:
            text = text.replace("\0", "")
        if text:
            self.pending.append((text, start, end))

    def _flush_pending(self):
        pending, self.pending = self.pending, []
        self.mode = self.original
        if any(t.strip(WS) for t, _, _ in pending):
            for part in pending:
                self._fostered("c_in_body", *part)
        else:
            for part in pending:
                self._text(*part)

    def s_in_table_text(self, tag):
        self._flush_pending()
        self._again("s_", tag)

    def e_in_table_text(self, tag):
        self._flush_pending()
        self._again("e_", tag)

    def z_in_table_text(self):
        self._flush_pending()

    # in caption
    def c_in_caption(self, text, start, end):
        self.c_in_body(text, start, end)

    def _close_caption(self) -> bool:
        if not self._in_scope("caption", TABLE_SCOPE):
            self._wrong("end-tag-without-matching-open-element")
            return False
        self._implied_ends()
        self._pop_until("caption")
        self._clear_formatting()
        self.mode = "in_table"
        return True

    def s_in_caption(self, tag):
        if tag.name in TABLE_PARTS:
            if self._close_caption():
                self._again("s_", tag)
        else:
            self.s_in_body(tag)

    def e_in_caption(self, tag):
        if tag.name == "caption":
            self._close_caption()
        elif tag.name == "table":
            if self._close_caption():
                self._again("e_", tag)
        elif tag.name in ("body", "html") or tag.name in TABLE_PARTS:
            self._wrong("end-tag-without-matching-open-element")
        else:
            self.e_in_body(tag)

    def z_in_caption(self):
        return self.z_in_body()

    # in column group
    def _leave_column_group(self) -> bool:
        if not self._is("colgroup"):
            return False
        self._pop()
        self.mode = "in_table"
        return True

    def c_in_column_group(self, text, start, end):
        lead = self._lead(text)
        if lead:
            self._text(text[:lead], start, start + lead if lead < len(text) else end)
        if lead < len(text) and self._leave_column_group():
            self._again("c_", text[lead:], start + lead, end)

    def s_in_column_group(self, tag):
        if tag.name == "html":
            self._merge_html(tag)
        elif tag.name == "col":
            self._void(tag)
        elif tag.name == "template":
            self.s_in_head(tag)
        elif self._leave_column_group():
            self._again("s_", tag)

    def e_in_column_group(self, tag):
        if tag.name == "colgroup":
            if not self._leave_column_group():
                self._wrong("end-tag-without-matching-open-element")
        elif tag.name == "col":
            self._wrong("end-tag-without-matching-open-element")
        elif tag.name == "template":
            self._end_template()
        elif self._leave_column_group():
            self._again("e_", tag)

    def z_in_column_group(self):
        if self.templates or not self._leave_column_group():
            return self.z_in_body()

    # in table body
    def c_in_table_body(self, text, start, end):
        self.c_in_table(text, start, end)

    def s_in_table_body(self, tag):
        name = tag.name
        if name == "tr":
            self._clear_to("tbody", "tfoot", "thead")
            self._element(tag)
            self.mode = "in_row"
        elif name in ("td", "th"):
            self._clear_to("tbody", "tfoot", "thead")
            self._fake("tr")
            self.mode = "in_row"
            self._again("s_", tag)
        elif name in ("caption", "col", "colgroup", "tbody", "tfoot", "thead"):
            if self._leave_table_body():
                self._again("s_", tag)
        else:
            self.s_in_table(tag)

    def _leave_table_body(self) -> bool:
        if not any(self._in_scope(n, TABLE_SCOPE) for n in ("tbody", "tfoot", "thead")):
            self._wrong("end-tag-without-matching-open-element")
            return False
        self._clear_to("tbody", "tfoot", "thead")
        self._pop()
        self.mode = "in_table"
        return True

    def e_in_table_body(self, tag):
        name = tag.name
        if name in ("tbody", "tfoot", "thead"):
            if self._in_scope(name, TABLE_SCOPE):
                self._clear_to("tbody", "tfoot", "thead")
                self._pop()
                self.mode = "in_table"
            else:
                self._wrong("end-tag-without-matching-open-element")
        elif name == "table":
            if self._leave_table_body():
                self._again("e_", tag)
        elif name in ("body", "caption", "col", "colgroup", "html", "td", "th", "tr"):
            self._wrong("end-tag-without-matching-open-element")
        else:
            self.e_in_table(tag)

    def z_in_table_body(self):
        return self.z_in_body()

    # in row
    def c_in_row(self, text, start, end):
        self.c_in_table(text, start, end)

    def _leave_row(self) -> bool:
        if not self._in_scope("tr", TABLE_SCOPE):
            self._wrong("end-tag-without-matching-open-element")
            return False
        self._clear_to("tr")
        self._pop()
        self.mode = "in_table_body"
        return True

    def s_in_row(self, tag):
        name = tag.name
        if name in ("td", "th"):
            self._clear_to("tr")
            self._element(tag)
            self.mode = "in_cell"
            self.formatting.append(MARKER)
        elif name in ("caption", "col", "colgroup", "tbody", "tfoot", "thead", "tr"):
            if self._leave_row():
                self._again("s_", tag)
        else:
            self.s_in_table(tag)

    def e_in_row(self, tag):
        name = tag.name
        if name == "tr":
            self._leave_row()
        elif name == "table":
            if self._leave_row():
                self._again("e_", tag)
        elif name in ("tbody", "tfoot", "thead"):
            if not self._in_scope(name, TABLE_SCOPE):
                self._wrong("end-tag-without-matching-open-element")
            elif self._leave_row():
                self._again("e_", tag)
        elif name in ("body", "caption", "col", "colgroup", "html", "td", "th"):
            self._wrong("end-tag-without-matching-open-element")
        else:
            self.e_in_table(tag)

    def z_in_row(self):
        return self.z_in_body()

    # in cell
    def c_in_cell(self, text, start, end):
        self.c_in_body(text, start, end)

    def _close_cell(self):
        self._implied_ends()
        if not self._is("td", "th"):
            self._wrong("closing-of-element-with-open-child-elements")
        self._pop_until("td", "th")
        self._clear_formatting()
        self.mode = "in_row"

    def s_in_cell(self, tag):
        if tag.name in TABLE_PARTS:
            if self._in_scope("td", TABLE_SCOPE) or self._in_scope("th", TABLE_SCOPE):
                self._close_cell()
                self._again("s_", tag)
        else:
            self.s_in_body(tag)

    def e_in_cell(self, tag):
        name = tag.name
        if name in ("td", "th"):
            if not self._in_scope(name, TABLE_SCOPE):
                self._wrong("end-tag-without-matching-open-element")
                return
            self._implied_ends()
            if not self._is(name):
                self._wrong("closing-of-element-with-open-child-elements")
            self._pop_until(name)
            self._clear_formatting()
            self.mode = "in_row"
        elif name in ("body", "caption", "col", "colgroup", "html"):
            self._wrong("end-tag-without-matching-open-element")
        elif name in ("table", "tbody", "tfoot", "thead", "tr"):
            if not self._in_scope(name, TABLE_SCOPE):
                self._wrong("end-tag-without-matching-open-element")
                return
            self._close_cell()
            self._again("e_", tag)
        else:
            self.e_in_body(tag)

    def z_in_cell(self):
        return self.z_in_body()

    # in select
    def c_in_select(self, text, start, end):
        text = text.replace("\0", "")
        if text:
            self._text(text, start, end)

    def s_in_select(self, tag):
        name = tag.name
        if name == "html":
            self._merge_html(tag)
        elif name == "option":
            if self._is("option"):
                self._pop()
            self._element(tag)
        elif name == "optgroup":
            if self._is("option"):
                self._pop()
            if self._is("optgroup"):
                self._pop()
            self._element(tag)
        elif name == "hr":
            if self._is("option"):
                self._pop()
            if self._is("optgroup"):
                self._pop()
            self._void(tag)
        elif name in ("input", "keygen", "textarea", "select"):
            if self._in_select_scope("select"):
                self._pop_until("select")
                self._reset_mode()
                if name != "select":
                    self._again("s_", tag)
        elif name in ("script", "template"):
            self.s_in_head(tag)

    def e_in_select(self, tag):
        name = tag.name
        if name == "optgroup":
            if self._is("option") and len(self.stack) > 1 and self.stack[-2].tag == "optgroup":
                self._pop()
            if self._is("optgroup"):
                self._pop()
        elif name == "option":
            if self._is("option"):
                self._pop()
        elif name == "select":
            if self._in_select_scope("select"):
                self._pop_until("select")
                self._reset_mode()
        elif name == "template":
            self._end_template()

    def z_in_select(self):
        return self.z_in_body()

    # in select in table
    def c_in_select_in_table(self, text, start, end):
        self.c_in_select(text, start, end)

    def s_in_select_in_table(self, tag):
        if tag.name in ("caption", "table", "tbody", "tfoot", "thead", "tr", "td", "th"):
            self._pop_until("select")
            self._reset_mode()
            self._again("s_", tag)
        else:
            self.s_in_select(tag)

    def e_in_select_in_table(self, tag):
        if tag.name in ("caption", "table", "tbody", "tfoot", "thead", "tr", "td", "th"):
            if self._in_scope(tag.name, TABLE_SCOPE):
                self._pop_until("select")
                self._reset_mode()
                self._again("e_", tag)
        else:
            self.e_in_select(tag)

    def z_in_select_in_table(self):
        return self.z_in_body()

    # in template
    def c_in_template(self, text, start, end):
        self.c_in_body(text, start, end)

    def s_in_template(self, tag):
        name = tag.name
        if name in HEAD_START and name != "noscript":
            self.s_in_head(tag)
            return
        if name in ("caption", "colgroup", "tbody", "tfoot", "thead"):
            mode = "in_table"
        elif name == "col":
            mode = "in_column_group"
        elif name == "tr":
            mode = "in_table_body"
        elif name in ("td", "th"):
            mode = "in_row"
        else:
            mode = "in_body"
        self.templates[-1] = self.mode = mode
        self._again("s_", tag)

    def e_in_template(self, tag):
        if tag.name == "template":
            self._end_template()
        else:
            self._wrong("end-tag-without-matching-open-element")

    def z_in_template(self):
        if not self._on_stack("template"):
            return True
        self._pop_until("template")
        self._clear_formatting()
        self.templates.pop()
        self._reset_mode()
        return self.handlers["z_" + self.mode](self)

    # after body
    def c_after_body(self, text, start, end):
        lead = self._lead(text)
        if lead:
            self.c_in_body(text[:lead], start, start + lead if lead < len(text) else end)
        if lead < len(text):
            self.mode = "in_body"
            self._again("c_", text[lead:], start + lead, end)

    def s_after_body(self, tag):
        if tag.name == "html":
            self._merge_html(tag)
        else:
            self.mode = "in_body"
            self._again("s_", tag)

    def e_after_body(self, tag):
        if tag.name == "html":
            if not self.fragment:
                self.mode = "after_after_body"
            if self.stack[0].tag == "html":
                self._set_end(self.stack[0])
                if len(self.stack) > 1 and not self.stack[1].end_tag:
                    self._set_end(self.stack[1])
        else:
            self.mode = "in_body"
            self._again("e_", tag)

    def z_after_body(self):
        return True

    # in frameset
    def _only_spaces(self, text: str) -> str:
        return "".join(c for c in text if c in WS)

    def c_in_frameset(self, text, start, end):
        if kept := self._only_spaces(text):
            self._text(kept, start, end)

    def s_in_frameset(self, tag):
        if tag.name == "html":
            self._merge_html(tag)
        elif tag.name == "frameset":
            self._element(tag)
        elif tag.name == "frame":
            self._void(tag)
        elif tag.name == "noframes":
            self.s_in_head(tag)

    def e_in_frameset(self, tag):
        if tag.name == "frameset" and not (len(self.stack) == 1 and self.stack[0].tag == "html"):
            self._pop()
            if not self.fragment and not self._is("frameset"):
                self.mode = "after_frameset"

    def z_in_frameset(self):
        return True

    # after frameset
    def c_after_frameset(self, text, start, end):
        self.c_in_frameset(text, start, end)

    def s_after_frameset(self, tag):
        if tag.name == "html":
            self._merge_html(tag)
        elif tag.name == "noframes":
            self.s_in_head(tag)

    def e_after_frameset(self, tag):
        if tag.name == "html":
            self.mode = "after_after_frameset"

    def z_after_frameset(self):
        return True

    # after after body
    def c_after_after_body(self, text, start, end):
        if text.strip(WS):
            self.mode = "in_body"
        self.c_in_body(text, start, end)

    def s_after_after_body(self, tag):
        if tag.name == "html":
            self._merge_html(tag)
        else:
            self.mode = "in_body"
            self._again("s_", tag)

    def e_after_after_body(self, tag):
        self.mode = "in_body"
        self._again("e_", tag)

    def z_after_after_body(self):
        return True

    # after after frameset
    def c_after_after_frameset(self, text, start, end):
        if kept := self._only_spaces(text):
            self.c_in_body(kept, start, end)

    def s_after_after_frameset(self, tag):
        if tag.name == "html":
            self._merge_html(tag)
        elif tag.name == "noframes":
            self.s_in_head(tag)

    def e_after_after_frameset(self, tag):
        pass

    def z_after_after_frameset(self):
        return True

    # --- foreign content ----------------------------------------------------------------------------------------------

    def _foreign_for(self, tag: Tag | None, text: str | None) -> bool:
        """Whether a token is handled by the rules for foreign content."""
        node = self._adjusted()
        if node.ns == HTML:
            return False
        if node.ns == MATH and node.tag in MATH_TEXT and (tag is None or tag.name not in ("mglyph", "malignmark")):
            return False
        if node.ns == MATH and node.tag == "annotation-xml":
            if tag is not None and tag.name == "svg":
                return False
            if lower(node.attrs.get("encoding", "")) in ("text/html", "application/xhtml+xml"):
                return False
        return not (node.ns == SVG and node.tag in ("foreignObject", "desc", "title"))

    def _foreign_characters(self, text, start, end):
        if "\0" in text:
            self._wrong("unexpected-null-character")
            text = text.replace("\0", "�")
        self._text(text, start, end)
        if self.frameset_ok and text.strip(WS + "�"):
            self.frameset_ok = False

    def _foreign_insert(self, tag: Tag, ns: str) -> None:
        if ns == SVG:
            tag.name = SVG_TAGS.get(tag.name, tag.name)
        attrs, spans = {}, {} if tag.spans else None
        for k, v in tag.attrs.items():
            name = PREFIXED.get(k, k)
            if ns == SVG:
                name = SVG_ATTRS.get(name, name)
            elif name == "definitionurl":
                name = "definitionURL"
            attrs[name] = v
            if tag.spans:
                spans[name] = tag.spans.get(k)
        tag.attrs, tag.spans = attrs, spans
        if tag.self_closing:
            self._void(tag, ns)
        else:
            self._element(tag, ns)

    def _foreign_start(self, tag: Tag) -> None:
        if tag.name in BREAKOUT or (tag.name == "font" and any(k in tag.attrs for k in ("color", "face", "size"))):
            while not self._leaves_foreign(self.stack[-1]):
                self._pop()
            self._again("s_", tag)
            return
        self._foreign_insert(tag, self._adjusted().ns)

    def _leaves_foreign(self, node: Node) -> bool:
        if node.ns == HTML:
            return True
        if node.ns == MATH:
            return node.tag in MATH_TEXT or (node.tag == "annotation-xml" and lower(node.attrs.get("encoding", "")) in ("text/html", "application/xhtml+xml"))
        return node.tag in ("foreignObject", "desc", "title")

    def _foreign_end(self, tag: Tag) -> None:
        name = tag.name
        if name in ("br", "p"):
            while not self._leaves_foreign(self.stack[-1]):
                self._pop()
            self._again("e_", tag)
            return
        if lower(self.stack[-1].tag) != name:
            self._wrong("end-tag-without-matching-open-element")
        for i in range(len(self.stack) - 1, 0, -1):
            node = self.stack[i]
            if node.ns == HTML:
                self._again("e_", tag)
                return
            if lower(node.tag) == name:
                while len(self.stack) > i:
                    self._pop()
                return


_HANDLERS: dict[type, dict] = {}
_RESET = {"tr": "in_row", "tbody": "in_table_body", "thead": "in_table_body", "tfoot": "in_table_body", "caption": "in_caption", "colgroup": "in_column_group", "table": "in_table", "body": "in_body", "frameset": "in_frameset"}
_B = TreeBuilder
_BODY_START = {
    **{n: _B._b_head_part for n in HEAD_START - {"noscript"}},
    **{n: _B._b_block for n in BLOCKS},
    **{n: _B._b_heading for n in HEADINGS},
    **{n: _B._b_formatting for n in FORMATTING - {"a", "nobr"}},
    **{n: _B._b_object for n in ("applet", "marquee", "object")},
    **{n: _B._b_void for n in ("area", "br", "embed", "img", "keygen", "wbr")},
    **{n: _B._b_param for n in ("param", "source", "track")},
    **{n: _B._b_ignored for n in TABLE_PARTS | {"frame", "head"}},
    "html": _B._b_html, "body": _B._b_body, "frameset": _B._b_frameset, "pre": _B._b_pre, "listing": _B._b_pre, "form": _B._b_form,
    "li": _B._b_li, "dd": _B._b_li, "dt": _B._b_li, "plaintext": _B._b_plaintext, "button": _B._b_button, "a": _B._b_a, "nobr": _B._b_nobr,
    "table": _B._b_table, "input": _B._b_input, "hr": _B._b_hr, "image": _B._b_image, "textarea": _B._b_textarea, "xmp": _B._b_xmp,
    "iframe": _B._b_iframe, "noembed": _B._b_raw, "noscript": _B._b_noscript, "select": _B._b_select, "optgroup": _B._b_option,
    "option": _B._b_option, "rb": _B._b_rb, "rtc": _B._b_rb, "rp": _B._b_rt, "rt": _B._b_rt, "math": _B._b_math, "svg": _B._b_math,
}
_BODY_END = {
    **{n: _B._b_end_block for n in CLOSE_BLOCKS},
    **{n: _B._b_end_heading for n in HEADINGS},
    **{n: _B._b_end_object for n in ("applet", "marquee", "object")},
    "body": _B._b_end_body, "html": _B._b_end_html, "form": _B._b_end_form, "p": _B._b_end_p, "li": _B._b_end_li, "dd": _B._b_end_li,
    "dt": _B._b_end_li, "br": _B._b_end_br, "template": _B._b_end_template,
}


def _place(parent: Node, child: Node) -> int:
    for i in range(len(parent.children) - 1, -1, -1):
        if parent.children[i] is child:
            return i
    return len(parent.children)


def _detach(node: Node) -> None:
    if node.parent is not None:
        del node.parent.children[_place(node.parent, node)]
        node.parent = None


def _camel(mode: str) -> str:
    head, *rest = mode.split("_")
    return head + "".join(w.title() for w in rest)


def _adopt_options(root: Node) -> None:
    """In a body, a bare select holding one bare option, followed by a bare option: both options get a ``b`` parent, and
    the text of the second moves out behind it."""
    bodies, stack = [], [root]
    while stack:
        node = stack.pop()
        if node.kind is ELEMENT and node.tag == "body":
            bodies.append(node)
        stack += [c for c in node.children if c.kind is ELEMENT and c.tag in ("html", "body")]
    for body in bodies:
        at = 0
        while at + 1 < len(body.children):
            left, right = body.children[at], body.children[at + 1]
            if left.tag == "select" and right.tag == "option" and not left.attrs and not right.attrs and len(left.children) == 1:
                option = left.children[0]
                if option.tag == "option" and not option.attrs:
                    for parent, child in ((left, option), (body, right)):
                        wrapper = Node(ELEMENT, "b", parent.ns if parent is left else right.ns, {})
                        parent.children[_place(parent, child)] = wrapper
                        wrapper.parent, wrapper.children, child.parent = parent, [child], wrapper
                    texts = [c for c in right.children if c.kind is TEXT]
                    right.children = [c for c in right.children if c.kind is not TEXT]
                    for t in texts:
                        t.parent = body
                    body.children[at + 2 : at + 2] = texts
            at += 1
