"""Text of HTML pages as laid out (operator 4).

A tree builder with implied tags (omitted end tags, implied table rows, content
that does not belong into a table moved before it) makes a tree; the renderer
emits all text that a reader would see: block elements on lines of their own
with their spacing, list items with bullets or numbers, indented by depth,
preformatted text as it is, and table cells aligned in columns (row and column
spans included; tables wider than `table_width` list their cells with bars).

Not visible: head, scripts, styles, templates, noscript and embedded content,
the hidden attribute, display:none and visibility:hidden (inline, or by a style
sheet's rule for a tag, class or id that holds for every screen and that no other
rule may override), hidden inputs, and closed details but for their summary.
Visible inside visibility:hidden: what sets visibility:visible.

Pages are independent: one pass, no shuffle.  Cases: null, empty or textless
page: the empty text.  Null page_id: kept null.  Repeated rows: each rendered.
Very long or deep pages: whole; elements nested deeper than 150 are taken as
siblings.  Broken markup never fails.  Empty table: empty result.  Extra columns
are ignored.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from dataclasses import dataclass
from unicodedata import east_asian_width

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Params:
    table_width: int = 160
    deepest: int = 150


VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript".split())
HIDDEN = frozenset("head script style template noscript iframe noembed noframes object svg math canvas audio video datalist title meta link base param rp".split())
HEAD_ONLY = frozenset("base link meta title style script noscript template".split())
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
CLOSES_P = frozenset("""address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form
header hgroup hr main menu nav ol p pre section summary table ul li dd dt h1 h2 h3 h4 h5 h6""".split())
#: Block elements and the blank lines around them.
BLOCK = {t: 0 for t in "html body address article aside center details dialog div dd dt fieldset figcaption footer form header hgroup main nav section summary li legend option optgroup caption".split()}
BLOCK |= {t: 1 for t in "blockquote dl figure hr menu dir ol p pre table ul h1 h2 h3 h4 h5 h6".split()}
SCOPE = frozenset("table td th caption template object html button".split())
CELLS, ROWS, GROUPS = frozenset(("td", "th")), frozenset(("tr",)), frozenset(("thead", "tbody", "tfoot"))
IN_TABLE = frozenset(("table", "thead", "tbody", "tfoot", "tr"))
BETWEEN = IN_TABLE | {"colgroup"}
#: What a start tag ends, and where looking for it stops.
ENDS = {"li": (("li",), ("ul", "ol", "menu", "dir")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)),
        "option": (("option",), ("select", "datalist")), "optgroup": (("option", "optgroup"), ("select",)), "a": (("a",), ("td", "th", "li", "div")), "button": (("button",), ())}
_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|[^<]+|<""", re.S)
_ATTR = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
_CSS_DROP = re.compile(r"""/\*.*?(?:\*/|\Z)|<!--|-->|"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*'""", re.S)
_CSS_SHOWS = re.compile(r"(?:^|;)\s*(display|visibility)\s*:\s*([a-z-]+)[^;]*", re.I)
_CSS_ESCAPE = re.compile(r"\\(?:([0-9a-fA-F]{1,6})\s?|(.))", re.S)
_CSS_PART = re.compile(r"([.#]?)((?:[\w-]|[^\x00-\x7f])+)")
#: Selectors for generated content, and those of a page at rest that match nothing.
_CSS_NOT_BOX = re.compile(r"::|:(?:before|after|first-line|first-letter)\b", re.I)
_CSS_TOUCHED = re.compile(r":(?:hover|active|focus|focus-within|focus-visible|target)\b", re.I)
_SPACE = re.compile(r"[ \t\n\r\f]+")


class Node:
    __slots__ = ("kids", "raw", "tag", "_attrs")

    def __init__(self, tag: str, raw: str = ""):
        self.tag, self.raw, self.kids, self._attrs = tag, raw, [], None

    @property
    def attrs(self) -> dict[str, str]:
        if self._attrs is None:
            self._attrs = {}
            for m in _ATTR.finditer(self.raw):
                self._attrs.setdefault(m[1].lower(), entities.unescape(next((g for g in m.groups()[1:] if g is not None), "")))
        return self._attrs

    def number(self, name: str, default: int, least: int, most: int) -> int:
        m = re.match(r"\s*([+-]?\d{1,9})", self.attrs.get(name, "")) if name in self.raw.lower() else None
        return min(most, max(least, int(m[1]))) if m else default


# ---------------------------------------------------------------- tree


class Builder:
    def __init__(self, p: Params):
        self.p = p
        self.root = Node("html")
        self.stack = [self.root]
        self.css: list[tuple[int, str]] = []  # whether its media hold, style sheet

    def _pop_to(self, i: int) -> None:
        del self.stack[max(1, i):]

    def _find(self, tags, stop) -> int:
        """Place of the innermost open element of these tags, not beyond one of `stop`; 0: none."""
        for i in range(len(self.stack) - 1, 0, -1):
            tag = self.stack[i].tag
            if tag in tags:
                return i
            if tag in stop:
                return 0
        return 0

    def _append(self, node) -> None:
        top = self.stack[-1]
        if top.tag == "colgroup" and (node.strip() if isinstance(node, str) else node.tag not in ("col", "template")):
            self._pop_to(len(self.stack) - 1)  # anything else ends the column group
            top = self.stack[-1]
        if top.tag in IN_TABLE and not (isinstance(node, str) and not node.strip()) and (isinstance(node, str) or node.tag not in IN_TABLE | CELLS | {"caption", "colgroup", "col", "script", "style", "template"}):
            i = next((i for i in range(len(self.stack) - 1, 0, -1) if self.stack[i].tag == "table"), 0)
            if i:  # not allowed in a table: goes before it
                kids = self.stack[i - 1].kids
                kids.insert(max(0, len(kids) - 1), node)
                return
        top.kids.append(node)

    def text(self, s: str) -> None:
        if s.strip() and self.stack[-1].tag == "head":
            self._pop_to(len(self.stack) - 1)
        self._append(s)

    def start(self, tag: str, raw: str) -> None:
        if tag in ("html", "body"):
            if tag == "body":
                self._pop_to(1)
            if not self.root.raw or tag == "body":
                self.root.raw += " " + raw
                self.root._attrs = None
            return
        if self.stack[-1].tag == "head" and tag not in HEAD_ONLY:
            self._pop_to(len(self.stack) - 1)
        if tag in CLOSES_P and (i := self._find(("p",), SCOPE)):
            self._pop_to(i)
        if tag in ENDS and (i := self._find(ENDS[tag][0], (*ENDS[tag][1], "table", "td", "th"))):
            self._pop_to(i)
        if tag in HEADINGS and self.stack[-1].tag in HEADINGS:
            self._pop_to(len(self.stack) - 1)
        if tag == "table" and self.stack[-1].tag in BETWEEN and (i := self._find(("table",), ("template",))):
            self._pop_to(i)  # a table between the cells of another ends that one
        if tag in CELLS or tag in ROWS or tag in GROUPS or tag in ("caption", "colgroup", "col"):
            t = self._find(("table",), ("template",))
            if not t:
                return  # outside of a table such a tag means nothing
            inner = {"td": ROWS, "th": ROWS, "tr": GROUPS}.get(tag, frozenset())
            while len(self.stack) - 1 > t and self.stack[-1].tag not in inner:
                if tag in CELLS and self.stack[-1].tag in GROUPS:
                    break
                self.stack.pop()
            if tag in CELLS and self.stack[-1].tag not in ROWS:  # a cell without a row
                row = Node("tr")
                self.stack[-1].kids.append(row)
                self.stack.append(row)
        node = Node(tag, raw)
        self._append(node)
        if tag not in VOID and not (raw.endswith("/") and tag in ("svg", "path")) and len(self.stack) <= self.p.deepest:
            self.stack.append(node)

    def end(self, tag: str) -> None:
        if tag == "br":
            self._append(Node("br"))
            return
        stop = () if tag in IN_TABLE or tag in CELLS else ("td", "th", "caption", "template")
        tags = HEADINGS if tag in HEADINGS else (tag,)
        if i := self._find(tags, stop if tag not in ("td", "th") else ("table",)):
            self._pop_to(i)
        elif tag == "p":
            self._append(Node("p"))

    def _style(self, a: dict[str, str], sheet: str) -> None:
        if a.get("type", "").strip().lower() in ("", "text/css") and not self._find(("template",), ()):
            self.css.append((media_holds(a.get("media", "")), sheet))

    def build(self, page: str) -> Node:
        pos, n = 0, len(page)
        while pos < n:
            m = _TOKEN.match(page, pos)
            pos = m.end()
            tag = m[2] or m[5]
            if tag is None:
                s = m.group()
                if not (s.startswith("<!") or s.startswith("<?")):
                    self.text(entities.unescape(s) if "&" in s else s)
                continue
            tag = tag.lower()
            if m[1] or m[4]:
                self.end(tag)
                continue
            self.start(tag, m[3] if m[2] else m[6])
            if tag == "plaintext":
                self.text(page[pos:])
                break
            if tag in RAW:
                close = re.compile(rf"</{tag}(?=[\s/>]|\Z)", re.I).search(page, pos)
                stop = close.start() if close else n
                body = page[pos:stop]
                if tag == "style":
                    self._style(Node(tag, m[3] if m[2] else m[6]).attrs, body)
                elif tag in ("textarea", "xmp", "title"):
                    self.stack[-1].kids.append(entities.unescape(body) if tag != "xmp" else body)
                if self.stack[-1].tag == tag:
                    self.stack.pop()
                gt = page.find(">", stop) if close else n
                pos = n if gt < 0 else min(n, gt + 1)
        return self.root


# ---------------------------------------------------------------- style sheets

NEVER, MAYBE, SURE = 0, 1, 2


def media_holds(queries: str) -> int:
    """Whether a media query list holds for a screen; MAYBE: it asks for more than the medium."""
    best = NEVER
    for q in queries.lower().split(","):
        m = re.fullmatch(r"\s*(not\s+|only\s+)?([a-z]+)?\s*(.*?)\s*", q, re.S)
        screen = m[2] in (None, "all", "screen") if m else True
        if not m or m[3] or (m[1] or "").strip() == "not" and m[2] is None or m[2] in ("not", "only"):
            holds = MAYBE if screen or m[1] else NEVER
        else:
            holds = SURE if screen != ((m[1] or "").strip() == "not") else NEVER
        best = max(best, holds)
    return best


def declared(block: str) -> dict[str, tuple[bool, bool | None]]:
    """Of a rule's display and visibility: (important, shown); shown None: as around it."""
    out: dict[str, tuple[bool, bool | None]] = {}
    for m in _CSS_SHOWS.finditer(block):
        prop, value, important = m[1].lower(), m[2].lower(), bool(re.search(r"!\s*important", m[0], re.I))
        if prop in out and out[prop][0] > important:
            continue
        shown = value not in ("none", "hidden", "collapse")
        out[prop] = (important, None if prop == "visibility" and value in ("inherit", "unset", "revert") else shown)
    return out


class Styles:
    """What style sheets say on display and visibility.

    Hiding rules count where they surely apply: one tag, class or id, for all
    media or the screen.  Showing rules count where they may apply: their last
    compound matches, in any at-rule that can hold for a screen.  Of those that
    match an element the cascade decides: importance, specificity, order."""

    def __init__(self, sheets: list[tuple[int, str]]):
        self.by_key: dict[str, list[tuple]] = {}
        self.known: dict[tuple, dict[str, tuple]] = {}
        self.order, hides = 0, False
        for media, sheet in sheets:
            for selectors, block, holds, order in self._rules(sheet, media):
                if "display" not in block.lower() and "visibility" not in block.lower():
                    continue
                for prop, (important, shown) in declared(block).items():
                    for s in re.split(r",(?![^(]*\))", selectors):
                        if found := self._selector(s, holds, shown is False):
                            key, parts, weight = found
                            hides |= shown is False
                            self.by_key.setdefault(key, []).append((prop, parts, (important, 0, *weight, order), shown))
        if not hides:
            self.by_key = {}

    def _rules(self, sheet: str, media: int) -> list[tuple[str, str, int, int]]:
        """(selectors, declarations, whether the at-rules around it hold, order) of all rules, nested ones too."""
        if "display" not in sheet.lower() and "visibility" not in sheet.lower():
            return []
        sheet = _CSS_DROP.sub(lambda m: "''" if m[0][0] in "\"'" else " ", sheet)
        sheet = _CSS_ESCAPE.sub(lambda m: chr(0xF0000 + min(int(m[1], 16) if m[1] else ord(m[2]), 0xFFFD)), sheet)
        out, at = [], 0
        open_: list[tuple[str, int, int, list[str]]] = []
        for m in re.finditer(r"[{};]|\Z", sheet):
            text, at = sheet[at : m.start()].strip(), m.end()
            if m[0] == "{":
                around, holds = open_[-1][:2] if open_ else ("", media)
                self.order += 1
                if text.startswith("@"):
                    name, _, rest = text[1:].replace("(", " (", 1).partition(" ")
                    kind = name.lower()
                    if kind == "media":
                        holds = min(holds, media_holds(rest))
                    else:
                        holds = min(holds, MAYBE if kind in ("supports", "layer", "container", "scope") else NEVER)
                    open_.append((around, holds, self.order, []))
                else:
                    inner = ",".join(s.replace("&", around) if "&" in s else f"{around} {s}" for s in text.split(",")) if around and "," not in around else text
                    open_.append((inner, min(holds, MAYBE) if around else holds, self.order, []))
            elif open_:
                open_[-1][3].append(text)
                if m[0] != ";":
                    for sel, holds, order, texts in [open_.pop()] if m[0] == "}" else open_:
                        if sel and holds:
                            out.append((sel, ";".join(texts), holds, order))
        return out

    @staticmethod
    def _selector(s: str, holds: int, hides: bool) -> tuple[str, frozenset[str], tuple[int, int, int]] | None:
        """(a key of the last compound, all its keys, specificity); None: does not count."""
        s = s.strip()
        if hides and (holds < SURE or not _CSS_PART.fullmatch(s)) or _CSS_NOT_BOX.search(s):
            return None
        flat, n = s, 0
        while (k := re.subn(r":not\([^()]*\)|\([^()]*\)|\[[^\]]*\]", lambda m: "" if m[0][0] == "(" else ":x", flat))[1]:
            flat = k[0]
        if _CSS_TOUCHED.search(flat):
            return None
        flat, n = re.subn(r":[\w-]+", "", flat)
        name = lambda m: m[1] + "".join(chr(ord(c) - 0xF0000) if c >= "\U000F0000" else c for c in (m[2] if m[1] else m[2].lower()))
        every = [m[1] for m in _CSS_PART.finditer(flat)]
        last = re.split(r"[\s>+~]+", flat.rstrip())[-1] if not re.search(r"[\s>+~]$", s) else ""
        parts = frozenset(map(name, _CSS_PART.finditer(last)))
        weight = (every.count("#"), every.count(".") + n, every.count(""))
        return min(parts, key=lambda x: ("#.".find(x[0]) % 3, x), default="*"), parts, weight

    def of(self, node: Node) -> dict[str, tuple[tuple, bool | None]]:
        """For display and visibility: (weight, shown) of the rule that wins, inline style included."""
        a = node.attrs if node.raw else {}
        out: dict[str, tuple[tuple, bool | None]] = {}
        if self.by_key:
            which = (node.tag, a.get("id"), a.get("class"))
            if which not in self.known:
                keys = {node.tag, *("." + c for c in (which[2] or "").split())} | ({"#" + which[1]} if which[1] else set())
                won: dict[str, tuple[tuple, bool | None]] = {}
                for key in (*keys, "*"):
                    for prop, parts, weight, shown in self.by_key.get(key, ()):
                        if parts <= keys and (prop not in won or weight > won[prop][0]):
                            won[prop] = (weight, shown)
                self.known[which] = won
            out = self.known[which]
        if style := a.get("style"):
            for prop, (important, shown) in declared(_CSS_DROP.sub(" ", style)).items():
                if prop not in out or (important, 1) > out[prop][0][:2]:
                    out = out | {prop: ((important, 1), shown)}
        return out


# ---------------------------------------------------------------- rendering


def width(s: str) -> int:
    """Columns a string takes."""
    return len(s) if s.isascii() else len(s) + sum(east_asian_width(c) in "WF" for c in s)


class Flow:
    """Lines of a block: runs of white space are one space, blank lines between blocks do not add up."""

    def __init__(self):
        self.lines: list[str] = []
        self.now: list[str] = []
        self.space = False
        self.gap = 0

    def text(self, s: str) -> None:
        if not s:
            return
        if s[0] in " \t\n\r\f":
            self.space = True
        words = _SPACE.split(s.strip(" \t\n\r\f"))
        if words == [""]:
            return
        if self.now and self.space:
            self.now.append(" ")
        self.now.append(" ".join(words))
        self.space = s[-1] in " \t\n\r\f"

    def end_line(self) -> None:
        if self.now:
            self._take(["".join(self.now)])
            self.now = []
        self.space = False

    def line_break(self) -> None:
        if self.now:
            self.end_line()
        elif self.lines:
            self.gap = max(self.gap, 1)

    def block(self, blank: int) -> None:
        self.end_line()
        if self.lines:
            self.gap = max(self.gap, blank)

    def _take(self, lines: list[str]) -> None:
        self.lines += [""] * self.gap + lines
        self.gap = 0

    def add(self, lines: list[str]) -> None:
        self.end_line()
        if lines:
            self._take(lines)


def _roman(n: int) -> str:
    out = ""
    for v, s in ((1000, "m"), (900, "cm"), (500, "d"), (400, "cd"), (100, "c"), (90, "xc"), (50, "l"), (40, "xl"), (10, "x"), (9, "ix"), (5, "v"), (4, "iv"), (1, "i")):
        out += s * (n // v)
        n %= v
    return out


def _marker(kind: str, n: int) -> str:
    if kind in ("i", "I") and 0 < n < 4000:
        s = _roman(n)
    elif kind in ("a", "A") and n > 0:
        s = ""
        while n:
            n, r = divmod(n - 1, 26)
            s = chr(97 + r) + s
    else:
        return f"{n}. "
    return (s.upper() if kind.isupper() else s) + ". "


class Renderer:
    def __init__(self, styles: Styles, p: Params):
        self.styles, self.p, self.depth = styles, p, 0

    def _shown(self, node: Node, visible: bool) -> tuple[bool, bool]:
        """(is it laid out, is its text visible)."""
        if node.tag in HIDDEN:
            return False, False
        if node.raw:
            a = node.attrs
            if "hidden" in a or (node.tag == "input" and a.get("type", "").lower() == "hidden"):
                return False, False
        if node.raw or self.styles.by_key:
            said = self.styles.of(node)
            if "display" in said and said["display"][1] is False:
                return False, False
            if "visibility" in said and said["visibility"][1] is not None:
                visible = said["visibility"][1]
        return True, visible

    def children(self, node: Node, flow: Flow, visible: bool) -> None:
        for kid in node.kids:
            if isinstance(kid, str):
                if visible:
                    flow.text(kid)
            else:
                self.element(kid, flow, visible)

    def inside(self, node: Node, visible: bool) -> list[str]:
        """Lines of a node's content by itself."""
        flow = Flow()
        self.children(node, flow, visible)
        flow.end_line()
        return flow.lines

    def alone(self, node: Node, visible: bool) -> list[str]:
        """Lines of an element by itself."""
        flow = Flow()
        self.element(node, flow, visible)
        flow.end_line()
        return flow.lines

    def element(self, node: Node, flow: Flow, visible: bool) -> None:
        laid, visible = self._shown(node, visible)
        if not laid:
            return
        tag = node.tag
        if tag == "br":
            flow.line_break()
        elif tag == "input":
            if visible and node.attrs.get("type", "text").lower() in ("submit", "button", "reset", "text", ""):
                flow.text(" " + node.attrs.get("value", "") + " ")
        elif tag in ("ul", "ol", "menu", "dir"):
            self.list(node, flow, visible)
        elif tag == "table":
            flow.block(1)
            flow.add(self.table(node, visible))
            flow.block(1)
        elif tag in ("pre", "textarea", "xmp", "listing", "plaintext"):
            flow.block(1)
            text = self.verbatim(node, visible)
            flow.add([x.rstrip() for x in text.removeprefix("\n").rstrip().split("\n")] if text.strip() else [])
            flow.block(1)
        elif tag == "details" and "open" not in node.attrs:
            flow.block(0)
            for kid in node.kids:
                if isinstance(kid, Node) and kid.tag == "summary":
                    self.element(kid, flow, visible)
            flow.block(0)
        elif tag in ("blockquote", "dd"):
            flow.block(BLOCK[tag])
            flow.add(["  " + x if x else x for x in self.inside(node, visible)])
            flow.block(BLOCK[tag])
        elif tag == "hr":
            flow.block(1)
        elif tag in BLOCK:
            flow.block(BLOCK[tag])
            self.children(node, flow, visible)
            flow.block(BLOCK[tag])
        else:
            self.children(node, flow, visible)

    def verbatim(self, node: Node, visible: bool) -> str:
        out = []
        for kid in node.kids:
            if isinstance(kid, str):
                out.append(kid if visible else "")
            elif kid.tag == "br":
                out.append("\n")
            else:
                laid, seen = self._shown(kid, visible)
                if laid:
                    out.append(self.verbatim(kid, seen))
        return "".join(out)

    def list(self, node: Node, flow: Flow, visible: bool) -> None:
        out: list[str] = []
        self.depth += 1
        ordered = node.tag == "ol"
        items = sum(isinstance(k, Node) and k.tag == "li" for k in node.kids)
        back = ordered and "reversed" in node.attrs
        n = node.number("start", items if back else 1, -10**6, 10**6) if ordered else 0
        kind = node.attrs.get("type", "1") if ordered and node.raw else "1"
        for kid in node.kids:
            if isinstance(kid, str):
                if visible and kid.strip():
                    out.append(_SPACE.sub(" ", kid.strip()))
                continue
            laid, seen = self._shown(kid, visible)
            if not laid:
                continue
            if kid.tag != "li":
                f = Flow()
                self.element(kid, f, visible)
                f.end_line()
                out += ["  " + x if x else x for x in f.lines]
                continue
            n = kid.number("value", n, -10**6, 10**6) if ordered else n
            mark = _marker(kind, n) if ordered else "- "
            n += -1 if back else 1
            lines = self.inside(kid, seen)
            if lines:
                out.append(mark + lines[0])
                out += [" " * len(mark) + x if x else x for x in lines[1:]]
        self.depth -= 1
        blank = 0 if self.depth else 1  # lists in lists stand without blank lines
        flow.block(blank)
        flow.add(out)
        flow.block(blank)

    def table(self, node: Node, visible: bool) -> list[str]:
        above: list[str] = []
        rows: list[tuple[Node, bool]] = []

        def gather(n: Node, seen: bool) -> None:
            for kid in n.kids:
                if isinstance(kid, Node):
                    laid, s = self._shown(kid, seen)
                    if not laid:
                        continue
                    if kid.tag == "tr":
                        rows.append((kid, s))
                    elif kid.tag in GROUPS:
                        gather(kid, s)
                    elif kid.tag not in ("col", "colgroup"):
                        above.extend(self.inside(kid, s) if kid.tag == "caption" else self.alone(kid, seen))

        gather(node, visible)
        grid: list[list[tuple[int, int, list[str]]]] = []  # per row: (column, span, lines)
        held: dict[int, int] = {}  # column -> rows it is still taken by a cell above
        for row, seen in rows:
            line, col = [], 0
            fresh: dict[int, int] = {}
            for cell in row.kids:
                if not isinstance(cell, Node):
                    continue
                if cell.tag not in CELLS:  # as deep as elements nest, what belongs nowhere stands above
                    above.extend(self.alone(cell, seen))
                    continue
                laid, s = self._shown(cell, seen)
                if not laid:
                    continue
                while held.get(col):
                    col += 1
                span, down = cell.number("colspan", 1, 1, 1000), cell.number("rowspan", 1, 1, len(rows))
                line.append((col, span, self.inside(cell, s)))
                if down > 1:
                    fresh |= {c: down for c in range(col, col + span)}
                col += span
            held = {c: k - 1 for c, k in (held | fresh).items() if k > 1}
            grid.append(line)
        wide: dict[int, int] = {}
        for line in grid:
            for col, span, lines in line:
                if span == 1:
                    wide[col] = max(wide.get(col, 0), max(map(width, lines), default=0))
        used = [c for c in sorted({c for line in grid for c, _, lines in line if lines})]
        if not used:
            return above
        for c in used:
            wide.setdefault(c, 0)
        for line in grid:  # a cell over several columns widens the last of them
            for col, span, lines in line:
                cols = [c for c in used if col <= c < col + span] or [col]
                if span > 1 and lines:
                    wide.setdefault(cols[-1], 0)
                    lack = max(map(width, lines)) - sum(wide.get(c, 0) for c in cols) - 2 * (len(cols) - 1)
                    wide[cols[-1]] += max(0, lack)
        offset, at = {}, 0
        for c in sorted(set(used) | {c for c in wide if wide[c]}):
            offset[c] = at
            at += wide[c] + 2
        out = list(above)
        if at - 2 > self.p.table_width:  # too wide to align: cells with bars, cells of several lines one under the other
            for line in grid:
                cells = [lines for _, _, lines in line if lines]
                if all(len(x) == 1 for x in cells):
                    if cells:
                        out.append(" | ".join(x[0] for x in cells))
                else:
                    for x in cells:
                        out += x
            return out
        for line in grid:
            for k in range(max((len(lines) for _, _, lines in line), default=0)):
                s, have = [], 0
                for col, _, lines in line:
                    if k < len(lines) and lines[k]:
                        pad = offset.get(col, have) - have
                        s.append(" " * max(0, pad) + lines[k])
                        have += max(0, pad) + width(lines[k])
                out.append("".join(s).rstrip())
        return out


def render(page: str | None, p: Params = Params()) -> str:
    """All visible text of a page, laid out."""
    if not page:
        return ""
    b = Builder(p)
    root = b.build(page)
    r = Renderer(Styles(b.css), p)
    flow = Flow()
    r.element(root, flow, True)
    flow.end_line()
    return "\n".join(x.rstrip() for x in flow.lines)


def extract(pages: DataFrame, p: Params = Params()) -> DataFrame:
    """For each row of pages (page_id, html): page_id, text, n_lines."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            texts = [render(x if isinstance(x, str) else None, p) for x in pdf["html"]]
            yield pd.DataFrame({"page_id": pdf["page_id"], "text": texts, "n_lines": [t.count("\n") + 1 if t else 0 for t in texts]})

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("html").cast("string").alias("html"))
    return rows.mapInPandas(run, "page_id long, text string, n_lines long")
