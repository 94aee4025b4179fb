"""HTML to text by building the tree and laying it out.

Tags open and close elements as browsers imply it (paragraphs, list items, table parts,
options), elements that are not shown are left out, and the rest is written as blocks:
paragraphs and headings apart by a blank line, list items with markers and indentation,
table cells padded to the columns they stand in, preformatted text as it is.
No step recurses, so nesting may be as deep as the page makes it.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plaint.llm.common import small_batches

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
#: Never shown.
UNSEEN = frozenset("head script style template noscript title meta link iframe noembed noframes object audio video canvas datalist".split())
#: Start tags that an open head takes; any other, and text other than white space, closes it.
IN_HEAD = frozenset("html head base link meta title noscript noframes style script template".split())
#: In a drawing the first are text that is shown, the second are not shown; the third end it.
DRAWN = frozenset("text foreignobject".split())
UNDRAWN = frozenset("defs desc metadata symbol clippath mask pattern marker".split())
UNDRAWING = frozenset("b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta nobr ol p pre ruby s small span strong strike sub sup table tt u ul var".split())

#: Apart by a blank line, and by a line break.
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl table blockquote pre figure hr fieldset".split())
BROKEN = frozenset("address article aside body center dd details dialog dir div dt figcaption footer form header hgroup html legend li main menu nav option search section summary tr caption".split())
BLOCK = (SPACED | BROKEN) - {"option", "tr", "caption"}
#: What an opening tag closes, and where the search for it stops.
_SCOPE = frozenset("table td th caption html button object".split())
#: An item is not closed through one of these.
_AROUND = _SCOPE | (BLOCK - {"address", "div", "p"})
IMPLIED: dict[str, tuple[frozenset[str], frozenset[str]]] = {
    **{t: (frozenset({"p"}), _SCOPE) for t in BLOCK - {"body", "html", "li", "dd", "dt", "legend", "summary", "figcaption"}},
    "li": (frozenset({"li", "p"}), _AROUND - {"li"}),
    "dt": (frozenset({"dt", "dd", "p"}), _AROUND - {"dt", "dd"}),
    "dd": (frozenset({"dt", "dd", "p"}), _AROUND - {"dt", "dd"}),
    "option": (frozenset({"option"}), frozenset({"select", "datalist", "optgroup"})),
    "optgroup": (frozenset({"option", "optgroup"}), frozenset({"select"})),
    "td": (frozenset({"td", "th", "p"}), frozenset({"table", "tr"})),
    "th": (frozenset({"td", "th", "p"}), frozenset({"table", "tr"})),
    "tr": (frozenset({"tr", "td", "th", "caption", "p"}), frozenset({"table", "thead", "tbody", "tfoot"})),
    **{t: (frozenset({"thead", "tbody", "tfoot", "tr", "td", "th", "caption", "p"}), frozenset({"table"})) for t in ("thead", "tbody", "tfoot")},
    "body": (frozenset({"head"}), frozenset()),
}
_OPEN = re.compile(r"<(?:!--|[!?]|(/?)([a-zA-Z][^\s/>]*))")
_TAG_END = re.compile(r"""[^>"']*+(?:"[^"]*+"[^>"']*+|'[^']*+'[^>"']*+)*+>""")
_ATTRIBUTE = re.compile(r"""([^\s=/"'<>]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_USED = re.compile(r"hidden|style|span|start|value|open", re.I)
_CLASSED = re.compile(_USED.pattern + "|class|id", re.I)
_COMMENT_END = re.compile(r"--!?>")
_STYLE = re.compile(r"<style(?:\s[^>]*+)?>(.*?)(?:</style|\Z)", re.I | re.S)
#: Comments and at-rules, whose conditions are not judged.
_NO_RULE = re.compile(r"/\*.*?(?:\*/|\Z)|@[^{};]*+(?:;|\{(?:[^{}]*+\{[^{}]*+\})*+[^{}]*+\})", re.S)
_RULE = re.compile(r"([^{}]++)\{([^{}]*+)\}")
_SELECTOR = re.compile(r"(\*|[a-zA-Z][\w-]*)?((?:[.#][\w-]+)*)")
_SEEING = re.compile(r"(?:^|[;\s])(display|visibility)\s*:\s*([a-z-]+)\s*(!\s*important)?", re.I)
#: Widest indentation, last column that cells are aligned to, and tables inside one another that are laid out in columns.
DEEPEST, WIDEST, MOST_TABLES = 64, 500, 16
_SPACES = re.compile(r"[ \t\n\r\f]+")


class Node:
    __slots__ = ("tag", "attributes", "children")

    def __init__(self, tag: str, attributes: dict[str, str] | None = None):
        self.tag, self.attributes, self.children = tag, attributes or {}, []


def _attributes(text: str, used: re.Pattern = _USED) -> dict[str, str] | None:
    if not used.search(text):
        return None
    return {k.lower(): unescape(v[1:-1] if v[:1] in "\"'" else v) for k, v in _ATTRIBUTE.findall(text)}


def _tokens(page: str) -> Iterator[tuple[str, str, str]]:
    """(kind, name or text, attributes): kinds are text, open, close."""
    at, n = 0, len(page)
    no_quoted_tag_after = n + 1  # from here on a quote is left open, so quotes count no more
    while at < n:
        m = _OPEN.search(page, at)
        if m is None:
            yield "text", page[at:], ""
            return
        if m.start() > at:
            yield "text", page[at : m.start()], ""
        if m.group(2) is None:
            if m.group() == "<!--":
                close = _COMMENT_END.search(page, m.end() - 2 if page.startswith((">", "->"), m.end()) else m.end())
                at = close.end() if close else n
            elif page.startswith("<![CDATA[", m.start()):
                end = page.find("]]>", m.end())
                yield "text", page[m.start() + 9 : n if end < 0 else end].replace("&", "&amp;"), ""
                at = n if end < 0 else end + 3
            else:
                end = page.find(">", m.end())
                at = n if end < 0 else end + 1
            continue
        done = _TAG_END.match(page, m.end()) if m.end() < no_quoted_tag_after else None
        if done:
            end = done.end() - 1
        else:
            no_quoted_tag_after = min(no_quoted_tag_after, m.end())
            end = page.find(">", m.end())
            if end < 0:
                return  # a tag that the page ends in shows nothing
        name = m.group(2).lower()
        yield ("close" if m.group(1) else "open"), name, page[m.end() : end]
        at = end + 1
        if not m.group(1) and name in RAW:
            close = re.compile(f"</{name}(?=[\\s/>])", re.I).search(page, at)
            yield "text", page[at : close.start() if close else n], ""
            at = close.start() if close else n


def rules(page: str) -> dict[str, list[tuple[str, frozenset[str], frozenset[str], str, str, tuple]]]:
    """(tag, classes, id, property, value, precedence) of rules in the page's style elements that show or hide, by one name each asks for.

    Selectors are a tag, classes and ids of one element; others and at-rules are not applied.
    """
    out: dict[str, list] = {}
    count = 0
    for sheet in _STYLE.findall(page) if "<style" in page.lower() else ():
        for selectors, body in _RULE.findall(_NO_RULE.sub(" ", sheet)):
            settings = _SEEING.findall(body)
            for selector in selectors.split(",") if settings else ():
                m = _SELECTOR.fullmatch(selector.strip())
                if not m or not m.group():
                    continue
                names = re.findall(r"[.#][\w-]+", m.group(2))
                classes, ids = (frozenset(x[1:] for x in names if x[0] == c) for c in ".#")
                tag = "" if m.group(1) in (None, "*") else m.group(1).lower()
                for name, value, important in settings:
                    weight = (bool(important), False, len(ids), len(classes), bool(tag), count)
                    out.setdefault(names[-1] if names else tag, []).append((tag, classes, ids, name.lower(), value.lower(), weight))
                    count += 1
    return out


def _seen(node: Node, sheet: dict | None) -> tuple[str | None, str | None]:
    """The values of display and visibility that hold for an element, None if nothing sets them."""
    a = node.attributes
    found: dict[str, tuple] = {}
    if a.get("style"):
        for name, value, important in _SEEING.findall(a["style"]):
            found[name.lower()] = max(found.get(name.lower(), ((),)), ((bool(important), True), value.lower()))
    if sheet:
        own = frozenset(a.get("class", "").split())
        asked = ("", node.tag, "#" + a.get("id", ""), *("." + x for x in own))
        for tag, classes, ids, name, value, weight in (rule for key in asked for rule in sheet.get(key, ())):
            if (not tag or tag == node.tag) and classes <= own and ids <= {a.get("id")}:
                found[name] = max(found.get(name, ((),)), (weight, value))
    return tuple(found[name][1] if name in found else None for name in ("display", "visibility"))


def parse(page: str, classed: bool = False) -> Node:
    """The element tree of a page; ``classed``: with classes and ids."""
    root = Node("#root")
    stack = [root]
    open_count: dict[str, int] = {}

    def pop() -> None:
        open_count[stack.pop().tag] -= 1

    for kind, name, rest in _tokens(page):
        if stack[-1].tag == "head":
            if kind == "text" and name.strip(" \t\n\r\f") or kind == "open" and name not in IN_HEAD or kind == "close" and name == "br":
                pop()
            elif kind == "open" and name in ("html", "head"):
                continue
        if kind == "open" and name in UNDRAWING and open_count.get("svg"):
            if next(x.tag for x in reversed(stack) if x.tag in ("svg", "foreignobject")) == "svg":
                while stack[-1].tag != "svg":
                    pop()
                pop()
        if kind == "text":
            stack[-1].children.append(name)
        elif kind == "open":
            closes, scope = IMPLIED.get(name, (frozenset(), frozenset()))
            if any(open_count.get(t) for t in closes):
                deepest = None
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i].tag in closes:
                        deepest = i
                    elif stack[i].tag in scope or (stack[i].tag in BLOCK and "p" in closes and closes == {"p"}):
                        break
                if deepest is not None:
                    while len(stack) > deepest:
                        pop()
            node = Node(name, _attributes(rest, _CLASSED if classed else _USED))
            stack[-1].children.append(node)
            if name not in VOID and not (rest.endswith("/") and (name in ("svg", "path") or open_count.get("svg") and not open_count.get("foreignobject"))):
                stack.append(node)
                open_count[name] = open_count.get(name, 0) + 1
        elif name == "br":
            stack[-1].children.append(Node("br"))
        elif open_count.get(name):
            if name not in ("table", "body", "html") and any(open_count.get(t) for t in ("td", "th")):
                # a cell keeps end tags of what is open around it from closing it
                for node in reversed(stack):
                    if node.tag == name:
                        break
                    if node.tag in ("td", "th") and name not in ("tr", "tbody", "thead", "tfoot"):
                        name = ""
                        break
                if not name:
                    continue
            while stack[-1].tag != name:
                pop()
            pop()
    return root


def shown(node: Node, parent: Node, display: str | None = None) -> bool:
    a = node.attributes
    if node.tag in UNSEEN or display == "none" or ("hidden" in a and display is None):
        return False
    if node.tag == "dialog":
        return "open" in a
    return not (parent.tag == "details" and "open" not in parent.attributes and node.tag != "summary")


class Flow:
    """Lines of text under construction."""

    def __init__(self):
        self.lines: list[str] = []
        self.parts: list[str] = []
        self.blank, self.space, self.marker, self.indent = 0, False, "", ""

    def end_line(self) -> None:
        if self.parts:
            self.lines.append("".join(self.parts).rstrip())
            self.parts = []
        self.space = False

    def apart(self, blank: int) -> None:
        self.end_line()
        if self.lines:
            self.blank = max(self.blank, blank)

    def _begin(self) -> None:
        if not self.parts:
            self.lines.extend([""] * self.blank)
            self.blank = 0
            self.parts.append(self.marker or self.indent)
            self.marker = ""

    def text(self, text: str) -> None:
        words = [w for w in _SPACES.split(text) if w]
        if not words:
            self.space = self.space or bool(text)
            return
        before = (self.space or text[0] in " \t\n\r\f") and bool(self.parts)
        self._begin()
        self.parts.append(" " * before + " ".join(words))
        self.space = text[-1] in " \t\n\r\f"

    def verbatim(self, text: str) -> None:
        for i, line in enumerate(text.replace("\r\n", "\n").split("\n")):
            if i:
                self._begin()
                self.lines.append("".join(self.parts).rstrip())
                self.parts = []
            if line:
                self._begin()
                self.parts.append(line.expandtabs(8))

    def rows(self, lines: list[str]) -> None:
        for line in lines:
            self._begin()
            self.parts.append(line)
            self.end_line()

    def break_line(self) -> None:
        if not self.parts:
            self._begin()
        self.lines.append("".join(self.parts).rstrip())
        self.parts, self.space = [], False


def _number(value: str | None, default: int) -> int:
    m = re.match(r"\s*([0-9]{1,9})", value or "")
    return int(m.group(1)) if m else default


def _grid(rows: list[list[tuple[list[str], int, int]] | None]) -> list[str]:
    """Cells (lines, colspan, rowspan) padded to their columns; None ends a row group, and spans with it.

    A spanning cell pushes the columns behind it.  Columns start within WIDEST; cells beyond
    it follow one another, so a page's text stays in proportion to the page.
    """
    placed: list[list[tuple[int, list[str]]]] = []
    needs: list[tuple[int, int, int]] = []  # column, column behind, width
    taken: list[tuple[int, int, int]] = []  # columns from, to, rows before
    for r, row in enumerate(rows):
        if row is None:
            taken = []
            continue
        taken = sorted(span for span in taken if span[2] > r)
        column, passed, line, below = 0, 0, [], []
        for lines, across, down in row:
            while passed < len(taken) and taken[passed][0] <= column:
                column = max(column, taken[passed][1])
                passed += 1
            line.append((column, lines))
            needs.append((column, column + across, max(map(len, lines), default=0)))
            if down != 1:
                below.append((column, column + across, r + down if down else len(rows)))
            column += across
        placed.append(line)
        taken += below
    columns = sorted({c for c, _, _ in needs})
    behind: dict[int, list[tuple[int, int]]] = {}
    for column, after, width in needs:
        k = bisect_left(columns, after)
        if k < len(columns):
            behind.setdefault(columns[k], []).append((column, width))
    start: dict[int, int] = {}
    at = -2
    for c in columns:
        at = max([at + 2, *(start[before] + width + 2 for before, width in behind.get(c, ()) if start[before] + width + 2 <= WIDEST)])
        start[c] = at
    out = []
    for line in placed:
        for k in range(max((len(lines) for _, lines in line), default=0)):
            parts, size = [], 0
            for column, lines in line:
                if k < len(lines) and lines[k]:
                    if column:
                        gap = start[column] - size if size <= start[column] <= WIDEST else 2 if size else 0
                        parts.append(" " * gap)
                        size += gap
                    parts.append(lines[k])
                    size += len(lines[k])
            text = "".join(parts)
            if text.strip():
                out.append(text.rstrip())
    return out


def render(root: Node, sheet: dict | None = None) -> str:
    """The visible text of a tree; ``sheet``: the page's rules."""
    flow = Flow()
    flows: list[Flow] = []
    tables: list[list] = []
    hidden: list[tuple[Node, bool]] = []  # elements that set visibility, and whether they hide
    outside: list[str] = []  # indentation around each open item
    lists: list[list] = []
    quiet = 0  # depth of pre
    drawings: list[bool] = []  # inside a drawing: whether text is not shown here
    stack: list[tuple[object, object, bool]] = [(c, root, False) for c in reversed(root.children)]
    while stack:
        node, parent, leaving = stack.pop()
        if isinstance(node, str):
            if parent.tag == "details" and "open" not in parent.attributes:
                continue
            if drawings and drawings[-1] or hidden and hidden[-1][1]:
                continue
            if tables and parent.tag in ("table", "thead", "tbody", "tfoot", "tr") and not node.strip():
                continue
            (flow.verbatim if quiet else flow.text)(unescape(node))
            continue
        tag = node.tag
        if not leaving:
            display, visibility = _seen(node, sheet) if node.attributes or sheet else (None, None)
            if not shown(node, parent, display) or (drawings and drawings[-1] and tag in UNDRAWN):
                continue
            if tag == "svg":
                drawings.append(True)
            elif drawings and tag in DRAWN:
                drawings.append(False)
                flow.apart(0)
            if tag == "br":
                if not (hidden and hidden[-1][1]):
                    flow.break_line()
                continue
            if tag in VOID and tag != "hr":
                continue
            if visibility in ("visible", "hidden", "collapse"):
                hidden.append((node, visibility != "visible"))
            if tag in SPACED:
                flow.apart(0 if tag in ("ul", "ol") and lists else 1)
            elif tag in BROKEN:
                flow.apart(0)
            if tag == "pre":
                quiet += 1
            elif tag in ("ul", "ol"):
                lists.append([_number(node.attributes.get("start"), 1) if tag == "ol" else None, flow.indent])
            elif tag == "li":
                kind = lists[-1] if lists else [None, flow.indent]
                if kind[0] is None:
                    mark = "- "
                else:
                    kind[0] = _number(node.attributes.get("value"), kind[0])
                    mark = f"{kind[0]}. "
                    kind[0] += 1
                outside.append(flow.indent)
                around = kind[1] if parent.tag in ("ul", "ol") else flow.indent
                flow.marker = around + mark
                flow.indent = (around + " " * len(mark))[:DEEPEST]
            elif tag in ("blockquote", "dd"):
                outside.append(flow.indent)
                flow.indent = (flow.indent + "  ")[:DEEPEST]
            elif tag == "table":
                tables.append([])
            elif tag == "tr" and tables:
                tables[-1].append([])
            elif tag in ("td", "th") and tables:
                if len(tables) > MOST_TABLES:
                    flow.apart(0)
                else:
                    if not tables[-1] or tables[-1][-1] is None:
                        tables[-1].append([])
                    flows.append(flow)
                    flow = Flow()
            stack.append((node, parent, True))
            stack.extend((c, node, False) for c in reversed(node.children))
            continue
        if tag == "svg":
            drawings.pop()
        elif drawings and tag in DRAWN:
            drawings.pop()
            flow.apart(0)
        if hidden and hidden[-1][0] is node:
            hidden.pop()
        if tag in ("thead", "tbody", "tfoot") and tables:
            tables[-1].append(None)
        if tag in ("td", "th") and len(tables) > MOST_TABLES:
            flow.apart(0)
            continue
        if tag in ("td", "th") and tables:
            flow.end_line()
            lines, flow = flow.lines, flows.pop()
            tables[-1][-1].append((lines, max(1, min(_number(node.attributes.get("colspan"), 1), 1000)), _number(node.attributes.get("rowspan"), 1)))
            continue
        if tag == "table":
            flow.apart(1)
            flow.rows(_grid(tables.pop()))
        if tag in SPACED:
            flow.apart(0 if tag in ("ul", "ol") and len(lists) > 1 else 1)
        elif tag in BROKEN:
            flow.apart(0)
        if tag == "pre":
            quiet -= 1
        elif tag in ("ul", "ol"):
            flow.indent = lists.pop()[1]
        elif tag == "li":
            flow.marker, flow.indent = "", outside.pop()
        elif tag in ("blockquote", "dd"):
            flow.indent = outside.pop()
    flow.end_line()
    return "\n".join(flow.lines)


def to_text(page: str) -> str:
    sheet = rules(page)
    return render(parse(page, bool(sheet)), sheet)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [to_text(page or "") for page in batch.column("html").to_pylist()]
        yield pa.record_batch([batch.column("page_id"), pa.array([len(t) for t in texts], pa.int64()), pa.array([t.count("\n") + 1 if t else 0 for t in texts], pa.int64()),
                               pa.array(texts, pa.string())], names=["page_id", "n_chars", "n_lines", "text"])


def extract(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(page_id, n_chars, n_lines, text) of each row of ``pages``; null and empty pages have an empty text.

    Repeated rows have equal results; a null id stays null.  Pages may be nested to any depth: indentation
    ends at DEEPEST columns, alignment at WIDEST, and tables in more than MOST_TABLES others are blocks.
    """
    out = small_batches(pages).select(F.col(id_col).alias("page_id"), F.col(html_col).alias("html"))
    return out.mapInArrow(_extract, f"page_id {out.schema['page_id'].dataType.simpleString()}, n_chars long, n_lines long, text string")
