"""Layout-aware text of HTML pages.

A tokenizer and a tree builder with implied tags make a tree; a renderer writes all
visible text: blocks on lines of their own (paragraph-like ones set off by a blank
line), list items with bullets or numbers and indentation, preformatted text as it is,
and table cells padded into aligned columns, spanned rows left blank.  Elements that browsers
do not show (head, scripts, styles, templates, closed details, elements hidden by an attribute,
an inline style or the page's style sheets) give no text.  Styles (``css.py``) also override the
attribute ``hidden``, make elements blocks or inline, and keep white space; what is visible
again inside an invisible element is shown.

Scale: a map without a shuffle, one page at a time, without recursion, so that neither
deep nesting nor long pages break it.

Defined cases: null and empty html give an empty text; very long pages are rendered whole;
markup that never ends is dropped as browsers do; of equal style rules the last counts; an
empty table gives an empty result; repeated rows give repeated results; extra columns are ignored.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from motifmill.llm import common, css

MAX_DEPTH = 512
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
HIDDEN = frozenset("head title script style template noscript iframe noembed noframes object audio video canvas datalist".split())
# Elements of svg and math that are not shown where they stand.
HIDDEN_FOREIGN = frozenset("desc metadata defs symbol clippath mask marker pattern annotation annotation-xml".split())
NO_VALUE = frozenset("hidden checkbox radio file image color range password".split())
#: Elements whose text keeps its white space.
KEPT = frozenset("pre xmp plaintext".split())
_BLOCK_DISPLAY = frozenset("block flex grid table list-item flow-root".split())
_INLINE_DISPLAY = frozenset("inline inline-block inline-flex inline-grid inline-table contents".split())
_WHITE = {"pre": "pre", "pre-wrap": "pre", "break-spaces": "pre", "pre-line": "lines", "normal": "", "nowrap": ""}
PARAGRAPHS = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl table pre xmp plaintext blockquote figure fieldset".split())
BLOCKS = PARAGRAPHS | frozenset(
    "html body div section article header footer main nav aside form address hgroup details summary li dt dd figcaption legend hr center dir menu tr td th thead tbody tfoot caption".split()
)
# An opening tag of the first kind ends open elements of the second, up to a limit of the third.
_CELLS, _ROWS, _TABLE = {"td", "th"}, {"tr"}, {"table"}
IMPLIED: dict[str, tuple[frozenset, frozenset]] = {
    "li": (frozenset({"li"}), frozenset({"ul", "ol", "menu", "dir", "table", "td", "th"})),
    "dt": (frozenset({"dt", "dd"}), frozenset({"dl", "table", "td", "th"})),
    "dd": (frozenset({"dt", "dd"}), frozenset({"dl", "table", "td", "th"})),
    "option": (frozenset({"option"}), frozenset({"select"})),
    "optgroup": (frozenset({"option", "optgroup"}), frozenset({"select"})),
    "td": (frozenset(_CELLS), frozenset({"table", "tr"})),
    "th": (frozenset(_CELLS), frozenset({"table", "tr"})),
    "tr": (frozenset(_CELLS | _ROWS), frozenset({"table"})),
    "thead": (frozenset(_CELLS | _ROWS | {"thead", "tbody", "tfoot", "caption", "colgroup"}), frozenset({"table"})),
    "tbody": (frozenset(_CELLS | _ROWS | {"thead", "tbody", "tfoot", "caption", "colgroup"}), frozenset({"table"})),
    "tfoot": (frozenset(_CELLS | _ROWS | {"thead", "tbody", "tfoot", "caption", "colgroup"}), frozenset({"table"})),
    "body": (frozenset({"head"}), frozenset()),
}
_SCOPE = frozenset({"table", "td", "th", "caption", "button", "object", "template", "html"})
_CLOSES_P = (PARAGRAPHS | frozenset("div section article header footer main nav aside form address hr center details li dt dd".split())) - {"table"}

# A quote opens a quoted value only directly after "=" (and white space); elsewhere it is an ordinary character.
_NAME, _EQUALS, _UNQUOTED = r"[^ \t\n\r\f/>][^ \t\n\r\f/>=]*+", r"[ \t\n\r\f]*+=[ \t\n\r\f]*+", r"[^ \t\n\r\f>\"'][^ \t\n\r\f>]*+"
_ATTRS = rf"(?:[ \t\n\r\f/]++|{_NAME}(?:{_EQUALS}(?:\"[^\"]*+\"|'[^']*+'|{_UNQUOTED}|(?=>))|(?![ \t\n\r\f]*+=)))*+"
_MARKUP = re.compile(r"<(?:!--(?:>|->|(?P<comment>.*?)(?:--!?>|\Z))|(?P<bang>[!?][^>]*(?:>|\Z))|/(?P<close>[a-zA-Z][^\s/>]*)[^>]*(?:>|\Z)|(?P<open>[a-zA-Z][^\s/>]*)(?P<attrs>" + _ATTRS + r")(?P<end>>)?)", re.S)
_ATTR = re.compile(rf"({_NAME})(?:{_EQUALS}(?:\"([^\"]*+)\"|'([^']*+)'|({_UNQUOTED})|\Z))?")
_SPACES = re.compile(r"[ \t\n\r\f]+")


class Node:
    __slots__ = ("tag", "attrs", "children", "hidden")

    def __init__(self, tag: str, attrs: dict[str, str] | None = None, hidden: bool = False):
        self.tag, self.attrs, self.children, self.hidden = tag, attrs or {}, [], hidden


def _attributes(text: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for name, a, b, c in _ATTR.findall(text):
        out.setdefault(name.lower(), html.unescape(a or b or c))
    return out


def _ends_itself(text: str) -> bool:
    """Whether attributes end with a slash of their own, not one of an unquoted value."""
    if not text.endswith("/"):
        return False
    end = 0
    for m in _ATTR.finditer(text):
        end = m.end()
    return end < len(text)


def _is_hidden(tag: str, attrs: dict[str, str]) -> bool:
    return tag in HIDDEN


def _not_displayed(node: Node) -> bool:
    """Elements that are not shown unless a style displays them."""
    return "hidden" in node.attrs or (node.tag == "dialog" and "open" not in node.attrs)


def parse(page: str) -> Node:
    """The tree of a page; text nodes are plain strings with character references resolved."""
    root = Node("#root")
    sheets: list[str] = []
    stack = [root]
    opened: Counter = Counter()  # open elements by tag
    at, size = 0, len(page)

    def push(node: Node) -> None:
        if len(stack) < MAX_DEPTH:  # as browsers do, deeper elements become siblings
            stack.append(node)
            opened[node.tag] += 1

    def cut(k: int) -> None:
        for n in stack[k:]:
            opened[n.tag] -= 1
        del stack[k:]

    def text(chars: str) -> None:
        if chars:
            stack[-1].children.append(html.unescape(chars) if "&" in chars else chars)

    def close(kinds: frozenset, limit: frozenset) -> None:
        """Ends the innermost open element of these kinds inside the limit, again and again."""
        while any(opened[x] for x in kinds):
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag in kinds:
                    cut(k)
                    break
                if stack[k].tag in limit:
                    return
            else:
                return

    while at < size:
        start = page.find("<", at)
        if start < 0:
            text(page[at:])
            break
        m = _MARKUP.match(page, start)
        if m is None:  # a lone "<"
            text(page[at : start + 1])
            at = start + 1
            continue
        text(page[at:start])
        at = m.end()
        if (tag := m["close"]) is not None:
            tag = tag.lower()
            if tag == "p" and not opened["p"]:
                stack[-1].children.append(Node("p"))
                continue
            for k in range(len(stack) - 1, 0, -1) if opened[tag] else ():
                if stack[k].tag == tag:
                    cut(k)
                    break
                if stack[k].tag in ("table", "td", "th") and tag not in ("table", "tr", "tbody", "thead", "tfoot", "td", "th", "body", "html"):
                    break
            continue
        if (tag := m["open"]) is None:
            if page.startswith("<![CDATA[", start) and (opened["svg"] or opened["math"]) and not opened["foreignobject"]:
                end = page.find("]]>", start)
                stack[-1].children.append(page[start + 9 : end if end >= 0 else size])
                at = end + 3 if end >= 0 else size
            continue
        if m["end"] is None:  # the page ends inside the tag
            break
        tag, attrs = tag.lower(), _attributes(m["attrs"]) if m["attrs"].strip(" /") else {}
        if tag in ("html", "body") and opened[tag]:
            continue
        if tag in _CLOSES_P:
            close(frozenset({"p"}), _SCOPE)
        if tag in IMPLIED:
            close(*IMPLIED[tag])
        if tag in ("td", "th") and stack[-1].tag in ("table", "tbody", "thead", "tfoot"):
            row = Node("tr")
            stack[-1].children.append(row)
            push(row)
        foreign = (opened["svg"] or opened["math"]) and not opened["foreignobject"]
        node = Node(tag, attrs, _is_hidden(tag, attrs) or bool(foreign and tag in HIDDEN_FOREIGN))
        stack[-1].children.append(node)
        if tag in VOID or ((foreign or tag in ("svg", "math")) and _ends_itself(m["attrs"])):
            continue
        if tag in RAW:
            stop = re.compile(rf"</{tag}(?=[\s/>])[^>]*>", re.I).search(page, at)
            inner = page[at : stop.start() if stop else size]
            if tag == "textarea":
                node.children.append(html.unescape(inner))
            elif tag == "xmp":
                node.children.append(inner)
            elif tag == "style" and not opened["noscript"] and not opened["template"] and css.applies(attrs.get("media", "")) and attrs.get("type", "text/css").strip().lower() in ("", "text/css"):
                sheets.append(inner)
            at = stop.end() if stop else size
            continue
        push(node)
        if tag == "plaintext":  # nothing ends it
            node.children.append(page[at:])
            break
    root.attrs["sheets"] = sheets
    return root


class _Writer:
    """Lines of one flow of text; collapses white space and counts blank lines wanted."""

    def __init__(self) -> None:
        self.lines: list[str] = []
        self.now: list[str] = []
        self.space = False
        self.blank = False
        self.prefix: list[str] = []
        self.first = ""

    def inline(self, text: str) -> None:
        if not text:
            return
        flat = _SPACES.sub(" ", text)
        if flat[0] == " " and self.now:
            self.space = True
        body = flat.strip(" ")
        if body:
            if self.space and self.now:
                self.now.append(" ")
            self.now.append(body)
            self.space = flat[-1] == " "

    def end_line(self, keep_empty: bool = False) -> None:
        if self.now or keep_empty:
            self._put("".join(self.now))
        self.now, self.space = [], False

    def paragraph(self) -> None:
        self.end_line()
        self.blank = True

    def _put(self, line: str) -> None:
        if self.blank and self.lines and self.lines[-1] != "":
            self.lines.append("")
        self.blank = False
        indent = "".join(self.prefix)
        if self.first:
            indent, self.first = indent[: len(indent) - len(self.first)] + self.first, ""
        self.lines.append((indent + line).rstrip())

    def raw(self, lines: list[str]) -> None:
        self.end_line()
        for line in lines:
            self._put(line)

    def text(self) -> str:
        self.end_line()
        return "\n".join(self.lines).strip("\n")


def _width(text: str) -> int:
    """Columns of a line: wide characters take two, combining ones none."""
    return len(text) if text.isascii() else sum(0 if unicodedata.combining(c) else 2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in text)


def _layout(rows: list[list[tuple[str, int, int]]]) -> list[str]:
    """Cells (text, columns spanned, rows spanned) as lines with aligned columns."""
    widths: dict[int, int] = {}
    taken: dict[int, int] = {}  # columns that cells above still span, and for how many rows
    placed = []
    for row in rows:
        k, own, now = 0, [(c, [""], 1) for c in taken], {}
        for cell, span, down in row:
            while k in taken:
                k += 1
            lines = cell.split("\n")
            own.append((k, lines, span))
            for c in range(k, k + span):
                widths.setdefault(c, 0)
                now[c] = max(down, taken.get(c, 0))
            if span == 1:
                widths[k] = max(widths[k], *map(_width, lines))
            k += span
        placed.append(sorted(own, key=lambda x: x[0]))
        taken = {c: n - 1 for c, n in (taken | now).items() if n > 1}
    out = []
    for own in placed:
        for line in range(max((len(x[1]) for x in own), default=0)):
            parts = []
            for k, lines, span in own:
                width = sum(widths[c] for c in range(k, k + span)) + 3 * (span - 1)
                cell = lines[line] if line < len(lines) else ""
                parts.append(cell + " " * (width - _width(cell)))
            while parts and not parts[-1].strip():
                parts.pop()
            out.append(" | ".join(parts).rstrip(" "))
    return out


def _span(node: Node, name: str, most: int) -> int:
    value = node.attrs.get(name, "1")
    return min(most, max(1, int(value))) if value.isascii() and value.isdigit() and len(value) < 6 else 1


def render(root: Node) -> str:
    writers = [_Writer()]
    tables: list[list[list[tuple[str, int, int]]]] = []
    styles = css.Styles(root.attrs.pop("sheets", []))
    visible = [True]
    path: list[Node] = []  # elements around the place
    white, flows = [""], [""]  # how white space is kept, and whether a style made the element a block or inline
    lists: list[list] = []
    todo: list = [(root, False)]
    while todo:
        node, leaving = todo.pop()
        w = writers[-1]
        if isinstance(node, str):
            if not visible[-1]:
                continue
            if white[-1] == "lines":
                first, *rest = node.split("\n")
                w.inline(first)
                for line in rest:
                    w.end_line(keep_empty=True)
                    w.inline(line)
            elif white[-1]:
                first, *rest = node.split("\n")
                w.now.append(first)
                for line in rest:
                    w.end_line(keep_empty=True)
                    w.now.append(line)
            else:
                w.inline(node)
            continue
        tag = node.tag
        if leaving:
            visible.pop()
            white.pop()
            path.pop()
            flow = flows.pop()
            if tag in ("td", "th") and tables:
                cell = writers.pop().text()
                if not tables[-1]:
                    tables[-1].append([])
                tables[-1][-1].append((cell, _span(node, "colspan", 100), _span(node, "rowspan", 65534)))
            elif tag == "table":
                rows = tables.pop()
                w.raw(_layout([r for r in rows if r]))
                w.blank = True
            elif tag == "li":
                w.end_line()
                w.prefix.pop()
                w.first = ""
            elif tag in ("dd", "blockquote"):
                w.end_line()
                w.prefix.pop()
                if tag == "blockquote":
                    w.blank = True
            elif tag in ("ul", "ol", "menu", "dir"):
                w.end_line()
                lists.pop()
                w.blank = not lists
            elif flow == "inline":
                pass
            elif tag in PARAGRAPHS:
                w.paragraph()
            elif tag in BLOCKS or flow:
                w.end_line()
            elif tag == "text":
                w.inline(" ")
            continue
        if node.hidden:
            continue
        style = styles.of(node, path) if styles.rules or "style" in node.attrs else {}
        display, own = style.get("display"), style.get("visibility")
        if display == "none" or (_not_displayed(node) and display in (None, "revert")):
            continue
        flow = "block" if display in _BLOCK_DISPLAY else "inline" if display in _INLINE_DISPLAY else ""
        seen = visible[-1] if own in (None, "inherit") else own not in ("hidden", "collapse")
        if tag == "br":
            w.end_line(keep_empty=True)
            continue
        if tag == "hr":
            w.paragraph()
            w.raw(["---"] if seen else [])
            w.blank = True
            continue
        if tag == "input":
            if seen and node.attrs.get("type", "text").lower() not in NO_VALUE:
                w.inline(f" {node.attrs.get('value', '')} ")
            continue
        if tag in ("td", "th") and tables:
            writers.append(_Writer())
        elif tag == "tr" and tables:
            tables[-1].append([])
        elif tag == "table":
            w.paragraph()
            tables.append([])
        elif tag == "li":
            w.end_line()
            if lists and lists[-1][0] == "ol":
                value = node.attrs.get("value", "")
                lists[-1][1] = int(value) if value.isascii() and value.isdigit() and len(value) < 10 else lists[-1][1] + 1
                mark = f"{lists[-1][1]}. "
            else:
                mark = "- "
            w.prefix.append(" " * len(mark))
            w.first = mark
        elif tag in ("ul", "ol", "menu", "dir"):
            w.end_line()
            if not lists:
                w.blank = True
            start = node.attrs.get("start", "1")
            lists.append([tag, (int(start) if start.isascii() and start.isdigit() and len(start) < 10 else 1) - 1])
        elif tag in ("dd", "blockquote"):
            w.paragraph() if tag == "blockquote" else w.end_line()
            w.prefix.append("  ")
        elif flow == "inline":
            pass
        elif tag in PARAGRAPHS:
            w.paragraph()
        elif tag in BLOCKS or flow:
            w.end_line()
        elif tag == "option":
            w.end_line()
        elif tag == "text":  # of svg, placed on its own
            w.inline(" ")
        todo.append((node, True))
        visible.append(seen)
        white.append(_WHITE.get(style.get("white-space", ""), "pre" if tag in KEPT else white[-1]))
        flows.append(flow)
        path.append(node)
        children = node.children
        if tag == "details" and "open" not in node.attrs:
            children = [c for c in children if isinstance(c, Node) and c.tag == "summary"][:1]
        todo.extend((c, False) for c in reversed(children))
    return writers[0].text()


def html_text(page: str) -> str:
    return render(parse(page))


def extract(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", keep: tuple[str, ...] = ()) -> DataFrame:
    """The visible text of each page."""

    def worker():
        return lambda pages: [pa.array([html_text(p.decode("utf-8", "replace")) for p in pages], pa.string())]

    return common.map_texts(pages, worker, "page_text string", id_col, html_col, keep)


def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(common.table(spark, sf_dir, "pages"), keep=("url",))
