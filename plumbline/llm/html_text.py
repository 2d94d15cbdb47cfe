"""Visible text of markup with its layout.

A tree builder repairs the tag soup (void elements, implied end tags, ignored
stray end tags) and sends balanced start, end and text events to a renderer
without recursion. The renderer leaves out what a browser does not show, keeps
blank lines between blocks, indents lists under their markers, keeps
preformatted text, and aligns table cells by column.
"""

from __future__ import annotations

import html
import re

from pyspark.sql import DataFrame

from plumbline.llm._common import map_text, pick, texts

#: Kinds of elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript".split())
HIDDEN = frozenset("script style head title template noscript noembed noframes iframe object audio video canvas datalist".split())
HIDDEN_IN = {"desc": "svg", "metadata": "svg", "defs": "svg", "annotation": "math", "annotation-xml": "math"}
APART = frozenset("option optgroup text".split())
#: What may stand in a head; anything else closes it.
IN_HEAD = frozenset("base basefont bgsound link meta title noscript noframes style script template".split())
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl table blockquote pre figure fieldset hr".split())
BLOCK = SPACED | frozenset("address article aside body caption center dd details dialog div dt figcaption footer form header hgroup html legend li main menu nav section summary tbody td tfoot th thead tr".split())
#: A start tag closes these open elements, up to the given borders.
CLOSES = {
    "li": ("li", "ul ol menu"),
    "dt": ("dt dd", "dl"),
    "dd": ("dt dd", "dl"),
    "tr": ("tr td th caption", "table"),
    "td": ("td th caption", "tr table"),
    "th": ("td th caption", "tr table"),
    "tbody": ("tbody thead tfoot tr td th caption", "table"),
    "thead": ("tbody thead tfoot tr td th caption", "table"),
    "tfoot": ("tbody thead tfoot tr td th caption", "table"),
    "option": ("option", "select"),
    "body": ("head", "html"),
}
_CLOSES = {k: (frozenset(a.split()), frozenset(b.split())) for k, (a, b) in CLOSES.items()}
_SCOPE = frozenset("table td th caption html".split())
_TAG = re.compile(r"<(?:!--|(/?)([A-Za-z][^\s/>]*)|([!?/]))")
_ATTR = re.compile(r"[\s/]*+([^\s/>=][^\s/>=]*+)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>]*+)))?")
_SPACE = re.compile(r"[ \t\n\f\r]+")
_UNSEEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*(?:hidden|collapse)", re.I)


def tokens(text: str):
    """('start', name, attributes), ('end', name, None) and ('text', data, None)."""
    at, n, low = 0, len(text), None
    while at < n:
        m = _TAG.search(text, at)
        if not m:
            yield "text", text[at:], None
            return
        if m.start() > at:
            yield "text", text[at : m.start()], None
        at = m.end()
        if m[2] is None:  # a comment, a declaration or a stray '</'
            stop = text.find("-->", max(m.start() + 2, at - 2)) if m[3] is None else text.find(">", at)
            at = n if stop < 0 else stop + (3 if m[3] is None else 1)
            continue
        name, attributes = m[2].lower(), {}
        while (a := _ATTR.match(text, at)) and a[1]:
            attributes.setdefault(a[1].lower(), a[2] or a[3] or a[4] or "")
            at = a.end()
        stop = text.find(">", at)
        at = n if stop < 0 else stop + 1
        if m[1]:
            yield "end", name, None
            continue
        yield "start", name, attributes
        if name in RAW:
            low = low if low is not None else text.lower()
            stop = low.find(f"</{name}", at)
            stop = n if stop < 0 else stop
            if stop > at:
                yield "text", text[at:stop], None
            at = stop


def events(text: str):
    """Balanced events: every start has its end, in order of nesting."""
    stack: list[str] = []
    count: dict[str, int] = {}

    def close(i: int):
        while len(stack) > i:
            name = stack.pop()
            count[name] -= 1
            yield "end", name, None

    def find(names: frozenset, border: frozenset) -> int:
        """The outermost open element among names above the nearest border; -1: none."""
        if not any(count.get(x) for x in names):
            return -1
        found = -1
        for i in range(len(stack) - 1, -1, -1):
            if stack[i] in border:
                break
            if stack[i] in names:
                found = i
        return found

    begun = False  # a head can come no more
    for kind, name, attributes in tokens(text):
        if stack[-1:] == ["head"] and (_SPACE.sub("", name) if kind == "text" else kind == "start" and name not in IN_HEAD and name not in ("html", "head")):
            yield from close(len(stack) - 1)
        if kind == "text":
            begun = begun or bool(_SPACE.sub("", name))
            yield kind, name, None
        elif kind == "start":
            if name in ("html", "body") and count.get(name) or name == "head" and begun:
                continue
            begun = begun or name != "html"
            if name in _CLOSES and (i := find(*_CLOSES[name])) >= 0:
                yield from close(i)
            if name in BLOCK and count.get("p") and (i := find(frozenset(["p"]), _SCOPE)) >= 0:
                yield from close(i)
            yield kind, name, attributes
            if name in VOID:
                yield "end", name, None
            else:
                stack.append(name)
                count[name] = count.get(name, 0) + 1
        elif name == "br":
            yield "start", "br", {}
            yield "end", "br", None
        elif count.get(name):
            border = frozenset() if name in ("table", "html", "body") else frozenset(["table"]) if name in ("tr", "td", "th", "caption", "tbody", "thead", "tfoot") else frozenset(["td", "th", "caption"])
            for i in range(len(stack) - 1, -1, -1):
                if stack[i] == name:
                    yield from close(i)
                    break
                if stack[i] in border:
                    break
    yield from close(0)


class _Flow:
    """Lines of text under construction."""

    def __init__(self):
        self.lines: list[str] = []
        self.line: list[str] = []
        self.space = False
        self.gap = 0
        self.indent: list[str] = []
        self.marker: str | None = None

    def _begin(self) -> None:
        if not self.line:
            if self.gap and self.lines:
                self.lines.append("")
            self.gap = 0
            lead = "".join(self.indent)
            if self.marker is not None:
                lead = "".join(self.indent[:-1]) + self.marker
                self.marker = None
            self.line.append(lead)
            self.space = False

    def text(self, data: str) -> None:
        words = _SPACE.sub(" ", data)
        if words[:1] == " ":
            self.space = self.space or len(self.line) > 1
            words = words[1:]
        tail = words[-1:] == " "
        words = words[:-1] if tail else words
        if words:
            self._begin()
            if self.space and len(self.line) > 1:
                self.line.append(" ")
            self.line.append(words)
            self.space = tail
        elif tail:
            self.space = self.space or len(self.line) > 1

    def pre(self, data: str) -> None:
        for i, part in enumerate(data.split("\n")):
            if i:
                self.newline()
            if part:
                self._begin()
                self.line.append(part)

    def newline(self) -> None:
        """End the line, an empty one too."""
        if not self.line:
            self._begin()
        self.lines.append("".join(self.line).rstrip())
        self.line, self.space = [], False

    def block(self, gap: int) -> None:
        if self.line:
            self.newline()
        self.gap = max(self.gap, gap)

    def done(self) -> list[str]:
        if self.line:
            self.newline()
        lines = self.lines
        while lines and not lines[-1]:
            lines.pop()
        while lines and not lines[0]:
            lines = lines[1:]
        return lines


class _Table:
    def __init__(self):
        self.rows: list[list[tuple[list[str], int, int]]] = []

    def layout(self) -> list[str]:
        """Cells as lines, aligned by column; spans take the width of what they cover."""
        grid: list[list[tuple[int, int, list[str]]]] = []
        taken: dict[int, int] = {}  # columns that a cell above still covers, and for how many rows
        for row in self.rows:
            at, placed, later = 0, [], {c: k - 1 for c, k in taken.items() if k > 1}
            for lines, across, down in row:
                while taken.get(at, 0) > 0:
                    at += 1
                placed.append((at, across, lines))
                if down > 1:
                    later.update((c, down - 1) for c in range(at, at + across))
                at += across
            grid.append(placed)
            taken = later
        width: dict[int, int] = {}
        for placed in grid:
            for at, across, lines in placed:
                if across == 1:
                    width[at] = max(width.get(at, 0), max(map(len, lines), default=0))
        out = []
        for placed in grid:
            for i in range(max((len(x[2]) for x in placed), default=0)):
                line, end = "", 0
                for at, across, lines in placed:
                    start = sum(width.get(c, 0) + 2 for c in range(at)) if at else 0
                    line = line.ljust(max(start, end)) + (lines[i] if i < len(lines) else "")
                    end = len(line) + 2
                out.append(line.rstrip())
        return out


def render(text: str) -> str:
    """All visible text of a document, '' if there is none."""
    flows, tables, lists = [_Flow()], [], []
    hidden, pre, opened = 0, 0, []  # opened: what each start has pushed
    for kind, name, attributes in events(text):
        flow = flows[-1]
        if kind == "text":
            if not hidden:
                data = html.unescape(name) if "&" in name else name
                flow.pre(data) if pre else flow.text(data)
            continue
        if kind == "start":
            unseen = name in HIDDEN or (name in HIDDEN_IN and any(x[0] == HIDDEN_IN[name] for x in opened)) or "hidden" in attributes or (name == "dialog" and "open" not in attributes) or ("style" in attributes and bool(_UNSEEN.search(attributes["style"])))
            inside = bool(opened) and opened[-1] == ("details", True) and name != "summary"
            opened.append((name, name == "details" and "open" not in attributes))
            if hidden or unseen or inside:
                hidden += 1
            elif name == "br":
                flow.newline()
            elif name == "table":
                flow.block(1)
                tables.append(_Table())
            elif name == "tr" and tables:
                tables[-1].rows.append([])
            elif name in ("td", "th") and tables:
                if not tables[-1].rows:
                    tables[-1].rows.append([])
                tables[-1].rows[-1].append(([], _span(attributes, "colspan"), _span(attributes, "rowspan")))
                flows.append(_Flow())
            elif name in ("ul", "ol", "menu"):
                flow.block(0 if lists else 1)
                lists.append([name == "ol", _span(attributes, "start", 0) if "start" in attributes else 1])
            elif name == "li":
                flow.block(0)
                marker = "- "
                if lists and lists[-1][0]:
                    marker = f"{lists[-1][1]}. "
                    lists[-1][1] += 1
                flow.indent.append(" " * len(marker))
                flow.marker = marker
            elif name in BLOCK:
                flow.block(int(name in SPACED))
                if name in ("dd", "blockquote"):
                    flow.indent.append("  ")
                pre += name == "pre"
            elif name in APART:
                flow.text(" ")
            elif name == "img" and attributes.get("alt"):
                flow.text(html.unescape(attributes["alt"]))
            continue
        opened.pop()
        if hidden:
            hidden -= 1
        elif name == "table":
            table = tables.pop()
            flow.block(1)
            for line in table.layout():
                flow._begin()
                flow.line.append(line)
                flow.newline()
            flow.block(1)
        elif name in ("td", "th") and tables and len(flows) > 1:
            lines = flows.pop().done()
            tables[-1].rows[-1][-1][0].extend(lines)
        elif name in ("ul", "ol", "menu"):
            lists.pop()
            flow.block(0 if lists else 1)
        elif name == "li":
            flow.block(0)
            flow.indent and flow.indent.pop()
            flow.marker = None
        elif name in BLOCK and name != "tr":
            flow.block(int(name in SPACED))
            if name in ("dd", "blockquote") and flow.indent:
                flow.indent.pop()
            pre -= name == "pre"
        elif name in APART:
            flow.text(" ")
    return "\n".join(flows[0].done())


def _span(attributes: dict[str, str], name: str, least: int = 1) -> int:
    """A span as browsers read it: digits, at least 1 and at most 1000."""
    m = re.match(r"\s*(\d{1,9})", attributes.get(name, ""))
    return min(1000, max(least, int(m[1]))) if m else 1


def extract_pages(df: DataFrame, row_id: str = "page_id", markup: str = "html") -> DataFrame:
    """Visible text of every whole page, without a shuffle.

    Returns page_id, text and n_chars. Null or empty markup gives ''. Text
    without a tag is a line. Repeated rows are rendered each, other columns are
    ignored, an empty table gives an empty table. Rules of style sheets are not
    applied; of styles only an element's own display and visibility count.
    """

    def make():
        def work(part):
            out = [render(t) if t else "" for t in texts(part, "html")]
            return {"page_id": part.column(0), "text": out, "n_chars": [len(t) for t in out]}

        return work

    return map_text(pick(df, page_id=row_id, html=markup), "html", "page_id long, text string, n_chars long", make)
