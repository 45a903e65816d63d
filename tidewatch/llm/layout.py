"""Layout-aware rendering of HTML: a tree builder with implied tags, and a renderer that emits all visible text.

The builder follows the usual rules: void elements, raw text of scripts and styles, paragraphs closed by blocks, list items, cells,
rows, sections, options and terms closed by their like, rows implied for cells, the end of the head and the body implied by the first content,
self-closing tags of SVG and MathML, both left at an HTML block, end tags without a start ignored. The renderer
leaves out what a browser does not show (head, scripts, styles, templates, noscript, frames, players, canvas, data lists, definitions and descriptions of
SVG, annotations of MathML, values of inputs that are masked or no text, ``hidden``, ``display:none``, ``visibility:hidden``), shows the fallback of
objects as nothing is loaded, collapses white space outside
``pre``, parts blocks by line breaks and paragraphs by blank lines, marks list items by ``-`` or their number with two spaces
per level, and sets the cells of a table in columns.

Defined results: null and empty pages give the empty text; bytes that are no markup are text; any nesting depth is allowed
(the walk keeps its own stack); repeated rows are rendered each; other columns are not read.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
HIDDEN = frozenset("head script style template noscript title meta link base iframe noembed noframes audio video canvas datalist param source track col colgroup area".split())
#: Left out inside SVG or MathML only.
HIDDEN_FOREIGN = frozenset("desc metadata defs symbol clippath mask marker pattern annotation annotation-xml".split())
#: Inputs whose value is not shown as text.
HIDDEN_INPUTS = frozenset("hidden password checkbox radio range color file image".split())
#: Start tags that leave an open head open; any other ends it.
METADATA = frozenset("html head base basefont bgsound link meta title style script noscript noframes template".split())
#: Start tags that end SVG and MathML, unless one of the elements that hold HTML is open.
ENDS_FOREIGN = frozenset("b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta nobr ol p pre ruby s small span strong strike sub sup table tt u ul var".split())
HOLDS_HTML = frozenset("foreignobject desc annotation-xml mi mo mn ms mtext".split())
#: Elements of SVG and MathML that are set apart by a space.
APART = frozenset("text mi mo mn ms mtext".split())
#: Blocks with a blank line around them.
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl blockquote pre table figure fieldset hr menu".split())
BLOCKS = SPACED | frozenset("address article aside body center details dialog dd div dt figcaption footer form header hgroup html legend li main nav optgroup option section summary tr td th tbody thead tfoot caption".split())
#: A start tag of these ends an open paragraph.
ENDS_PARAGRAPH = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section summary table ul li dd dt".split())
#: Start tag -> (elements that it ends, elements at which the search stops).
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "tr": ({"tr", "caption", "colgroup"}, {"table", "tbody", "thead", "tfoot"}), "tbody": ({"tbody", "thead", "tfoot", "caption", "colgroup"}, {"table"}), "thead": ({"tbody", "thead", "tfoot", "caption", "colgroup"}, {"table"}),
    "tfoot": ({"tbody", "thead", "tfoot", "caption", "colgroup"}, {"table"}), "option": ({"option"}, {"select", "optgroup", "datalist"}), "optgroup": ({"optgroup", "option"}, {"select"}), "body": ({"head"}, {"html"}),
}
#: Columns are padded up to this width; longer cells run on.
CELL_WIDTH = 40
_TAG = re.compile(r"</?([a-zA-Z][^\s/>]*)")
_ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
_UNSEEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_SPACES = re.compile(r"[ \t\n\r\f]+")
_QUOTE_OR_END = re.compile("[>\"']")


class Node:
    __slots__ = ("tag", "attributes", "children")

    def __init__(self, tag: str, attributes: dict[str, str]):
        self.tag, self.attributes, self.children = tag, attributes, []


def tokens(page: str) -> Iterator[tuple[str, str, str]]:
    """``(kind, name or text, attributes)`` with kinds text, raw, start and end."""
    at, n, foreign = 0, len(page), 0
    while at < n:
        mark = page.find("<", at)
        if mark < 0:
            mark = n
        if mark > at:
            yield "text", page[at:mark], ""
            at = mark
            continue
        tag = _TAG.match(page, at)
        if page.startswith("<!--", at):
            end = page.find("-->", at + 4)
            at = n if end < 0 else end + 3
        elif page.startswith(("<!", "<?"), at):
            end = page.find(">", at)
            at = n if end < 0 else end + 1
        elif tag is None:
            yield "text", "<", ""
            at += 1
        else:
            name, closing = tag[1].lower(), page[at + 1] == "/"
            end = _tag_end(page, tag.end())
            attributes = page[tag.end():end]
            at = min(end + 1, n)
            if closing:
                if name in ("svg", "math"):
                    foreign = max(0, foreign - 1)
                yield "end", name, ""
                continue
            yield "start", name, attributes
            if name in ("svg", "math") and not attributes.endswith("/"):
                foreign += 1
            if name in RAW and not (foreign and attributes.endswith("/")):
                stop = re.compile(f"</{re.escape(name)}(?=[\\s/>])", re.I).search(page, at)
                upto = stop.start() if stop else n
                if upto > at:
                    yield "raw", page[at:upto], ""
                at = upto


def _tag_end(page: str, at: int) -> int:
    """Where the tag ends: the first ``>`` outside quotes, or any if a quote is never closed."""
    first = page.find(">", at)
    if first < 0:
        return len(page)
    while (m := _QUOTE_OR_END.search(page, at)) is not None:
        if m[0] == ">":
            return m.start()
        close = page.find(m[0], m.end())
        if close < 0:
            return first
        at = close + 1
    return first


def _attributes(text: str) -> dict[str, str]:
    found: dict[str, str] = {}
    for m in _ATTRIBUTE.finditer(text):
        found.setdefault(m[1].lower(), html.unescape(next((v for v in m.groups()[1:] if v is not None), "")))
    return found


def build(page: str) -> Node:
    """The element tree of a page."""
    root = Node("#root", {})
    stack, open_ = [root], {}

    def push(tag: str, attributes: dict[str, str]) -> None:
        node = Node(tag, attributes)
        stack[-1].children.append(node)
        if tag not in VOID:
            stack.append(node)
            open_[tag] = open_.get(tag, 0) + 1

    def pop_to(k: int) -> None:
        while len(stack) > k:
            open_[stack.pop().tag] -= 1

    def end_of(tags, stops) -> None:
        if not any(open_.get(t) for t in tags):
            return
        for k in range(len(stack) - 1, 0, -1):
            if stack[k].tag in tags:
                pop_to(k)
                return
            if stack[k].tag in stops:
                return

    def body() -> None:
        pop_to(len(stack) - 1)
        push("body", {})

    for kind, value, rest in tokens(page):
        if kind == "text":
            text = html.unescape(value) if "&" in value else value
            if stack[-1].tag == "head" and text.strip(" \t\n\r\f"):
                body()
            stack[-1].children.append(text)
        elif kind == "raw":
            stack[-1].children.append(html.unescape(value) if stack[-1].tag in ("title", "textarea") else value)
        elif kind == "start":
            if open_.get("head"):
                if value == "head":
                    continue
                if stack[-1].tag == "head" and value not in METADATA and value != "body":
                    body()
            foreign = open_.get("svg") or open_.get("math")
            if foreign and value in ENDS_FOREIGN and not any(open_.get(t) for t in HOLDS_HTML):
                pop_to(next(k for k, node in enumerate(stack) if node.tag in ("svg", "math")))
                foreign = False
            if value in ENDS_PARAGRAPH:
                end_of({"p"}, {"td", "th", "table", "button", "object", "caption"})
            if value in ENDS:
                end_of(*ENDS[value])
            if value in ("td", "th") and open_.get("table") and stack[-1].tag in ("table", "tbody", "thead", "tfoot"):
                push("tr", {})
            attributes = _attributes(rest) if rest.strip(" /\t\n\r\f") else {}
            if foreign and value in HIDDEN_FOREIGN:
                attributes["hidden"] = ""
            push(value, attributes)
            if rest.endswith("/") and (foreign or value in ("svg", "math")) and value not in VOID:
                pop_to(len(stack) - 1)
        elif value == "br":
            if stack[-1].tag == "head":
                body()
            push("br", {})
        elif open_.get(value):
            stops = {"table"} if value in ("p", "li", "div", "span", "a", "b", "i") else set()
            end_of({value}, stops - {value})
    return root


def hidden(node: Node) -> bool:
    a = node.attributes
    if node.tag in HIDDEN or (a and "hidden" in a) or (node.tag == "input" and a.get("type", "").strip().lower() in HIDDEN_INPUTS):
        return True
    return bool(a and "style" in a and _UNSEEN.search(a["style"]))


class Page:
    """Lines of text with collapsed white space and pending line breaks."""

    def __init__(self):
        self.lines, self.line, self.breaks, self.space, self.prefix, self.indent = [], [], 0, False, "", 0

    def block(self, blank: bool) -> None:
        if self.line:
            self.lines.append("".join(self.line))
            self.line = []
            self.breaks = 0
        if self.lines:
            self.breaks = max(self.breaks, 1 if blank else 0)
        self.space = False

    def force(self) -> None:
        self.lines.append("".join(self.line))
        self.line, self.space, self.breaks = [], False, 0

    def _open(self) -> None:
        if not self.line:
            self.lines += [""] * self.breaks
            self.breaks = 0
            self.line.append("  " * self.indent + self.prefix)
            self.prefix = ""

    def write(self, text: str) -> None:
        inner = _SPACES.sub(" ", text)
        if inner == " " or not inner:
            self.space = self.space or bool(inner)
            return
        lead, tail = inner[0] == " ", inner[-1] == " "
        started = bool(self.line)
        self._open()
        if started and (self.space or lead):
            self.line.append(" ")
        self.line.append(inner.strip(" "))
        self.space = tail

    def verbatim(self, text: str) -> None:
        for k, part in enumerate(text.replace("\r\n", "\n").split("\n")):
            if k:
                self._open()
                self.force()
            if part:
                self._open()
                self.line.append(part)

    def text(self) -> str:
        self.block(False)
        return "\n".join(x.rstrip() for x in self.lines).strip("\n")


def _column_set(rows: list[list[tuple[str, int]]]) -> list[str]:
    """Lines of a table: cells of a column start at the same place."""
    grid = []
    for row in rows:
        cells: list[list[str]] = []
        for text, span in row:
            cells.append(text.split("\n"))
            cells += [[""]] * (span - 1)
        grid.append(cells)
    columns = max(map(len, grid), default=0)
    width = [min(CELL_WIDTH, max((len(x) for cells in grid if k < len(cells) for x in cells[k]), default=0)) for k in range(columns)]
    out = []
    for cells in grid:
        for h in range(max(map(len, cells), default=0)):
            out.append("  ".join((cells[k][h] if h < len(cells[k]) else "").ljust(width[k]) for k in range(len(cells))).rstrip())
    return out


def render(page: str) -> str:
    """The visible text of a page."""
    pages, tables, lists = [Page()], [], []
    todo: list[tuple[str, object, bool]] = [("node", c, False) for c in reversed(build(page).children)]
    while todo:
        step, node, pre = todo.pop()
        out = pages[-1]
        if step == "end":
            _close(node, pages, tables, lists)
            continue
        if isinstance(node, str):
            out.verbatim(node) if pre else out.write(node)
            continue
        if hidden(node):
            continue
        tag = node.tag
        if tag == "br":
            out._open()
            out.force()
            continue
        if tag == "input":
            out.write(f" {node.attributes.get('value', '')} ")
            continue
        if tag in APART:
            out.write(" ")
        elif tag == "table":
            out.block(True)
            tables.append([])
        elif tag == "tr" and tables:
            tables[-1].append([])
        elif tag in ("td", "th") and tables:
            if not tables[-1]:
                tables[-1].append([])
            pages.append(Page())
        elif tag in BLOCKS and not (tables and tag in ("tbody", "thead", "tfoot")):
            out.block(tag in SPACED and not (tag in ("ul", "ol", "menu") and lists))
            if tag in ("ul", "ol", "menu"):
                start = node.attributes.get("start", "1")
                lists.append([tag, int(start) if re.fullmatch(r"-?[0-9]{1,9}", start) else 1])
                out.indent = len(lists) - 1
            elif tag == "li":
                ordered = bool(lists) and lists[-1][0] == "ol"
                out.prefix = f"{lists[-1][1]}. " if ordered else "- "
                if ordered:
                    lists[-1][1] += 1
        todo.append(("end", node, pre))
        todo.extend(("node", c, pre or tag in ("pre", "textarea")) for c in reversed(node.children))
    return pages[0].text()


def _close(node: Node, pages: list[Page], tables: list, lists: list) -> None:
    tag, out = node.tag, pages[-1]
    if tag in APART:
        out.write(" ")
    elif tag == "table":
        for line in _column_set([r for r in tables.pop() if r]):
            if line:
                out._open()
                out.line.append(line)
            out.block(False)
        out.block(True)
    elif tag in ("td", "th") and tables:
        span = node.attributes.get("colspan", "1")
        tables[-1][-1].append((pages.pop().text(), min(int(span), 1000) if re.fullmatch("[1-9][0-9]{0,3}", span) else 1))
    elif tag == "tr" and tables or tables and tag in ("tbody", "thead", "tfoot"):
        pass
    elif tag in BLOCKS:
        if tag in ("ul", "ol", "menu") and lists:
            lists.pop()
            out.indent = max(0, len(lists) - 1)
        if tag == "li":
            out.block(False)
            out.prefix = ""
        else:
            out.block(tag in SPACED and not (tag in ("ul", "ol", "menu") and lists))


def visible_text(pages: DataFrame, *, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """``id_col, text`` of every row of ``pages``."""
    schema = pa.schema([("id", pa.int64()), ("text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [render(p) if p else "" for p in batch.column("html").to_pylist()]
            yield pa.record_batch([batch.column("id").cast(pa.int64()), pa.array(texts, pa.string())], schema=schema)

    return pages.select(F.col(id_col).alias("id"), F.col(html_col).alias("html")).mapInArrow(run, "id long, text string").withColumnRenamed("id", id_col)
