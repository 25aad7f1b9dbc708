"""Layout-aware rendering of HTML: a tree builder with implied tags, and a renderer of what is visible.

The builder closes elements that a later tag ends by implication (a paragraph by a block, a list item by the next one, cells, rows and
parts of tables by their successors), ignores end tags of elements that are not open, and reads scripts, styles and titles as raw text. The renderer leaves out
what no reader sees, collapses white space as a browser does, sets blocks apart, marks list items, and aligns the cells of a table's
rows in columns. It walks the tree with a stack of its own, so depth is no limit.
"""

from __future__ import annotations

import html as entities
import re
import unicodedata
from bisect import bisect_right

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricetrail.llm.rows import map_batches

# Fixed values of the HTML standard: element names by behaviour.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes plaintext".split())
HIDDEN = frozenset("head script style template noscript iframe audio video canvas datalist noembed noframes title annotation annotation-xml".split())
#: What of a drawing is text, and what of it is only there to be referred to or to describe.
DRAWN, UNDRAWN = frozenset(("text", "foreignobject")), frozenset("defs symbol desc metadata clippath mask pattern marker".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6"
    " header hgroup hr html legend li listing main menu nav ol optgroup option p plaintext pre search section summary ul xmp".split())  # fmt: skip
#: Blocks with an empty line before and after them.
APART = frozenset("blockquote dl fieldset figure h1 h2 h3 h4 h5 h6 hr menu ol p pre table ul".split())
#: Start tags that end an open paragraph.
ENDS_P = (BLOCK | {"table"}) - {"body", "html", "legend", "optgroup", "option", "frameset", "dir"}
#: Open elements that a start tag closes, and the elements beyond which it does not look.
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select", "datalist"}), "optgroup": ({"option", "optgroup"}, {"select"}),
    "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "tr": ({"tr", "td", "th", "caption", "colgroup"}, {"table"}),
    **{part: ({"tbody", "thead", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}) for part in ("tbody", "thead", "tfoot")},
    "body": ({"head"}, {"html"}),
    "rt": ({"rt", "rp"}, {"ruby"}), "rp": ({"rt", "rp"}, {"ruby"}),
}
#: Elements that an end tag or an implied end does not reach through.
SCOPE = frozenset("html table td th caption button template".split())
_ROWS = frozenset("table tbody thead tfoot tr".split())
#: Levels of indent that a line shows. Deeper blocks keep their text and their marks and are indented like this level, so a page's rendering grows with the page.
DEEPEST = 32

_TOKEN = re.compile(r"<!--(?:>|->|.*?(?:--!?>|\Z))|<[!?][^>]*(?:>|\Z)|</([a-zA-Z][^\s/>]*)[^>]*(?:>|\Z)|<([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"([^\s=\"'/>][^\s=/>]*)(?:\s*=\s*(?:\"([^\"]*)\"?|'([^']*)'?|([^\s>]+)))?")
_UNSEEN = re.compile(r"(?:^|;)\s*display\s*:\s*none", re.I)
_VISIBILITY = re.compile(r"(?:^|;)\s*visibility\s*:\s*(hidden|collapse|visible|initial)", re.I)
_SPACE = re.compile("[ \t\n\r\f]+")


class Node:
    __slots__ = ("name", "attributes", "children")

    def __init__(self, name: str, attributes: dict[str, str] | None = None):
        self.name, self.attributes, self.children = name, attributes or {}, []


def _attributes(text: str) -> dict[str, str]:
    found: dict[str, str] = {}
    for name, *values in _ATTRIBUTE.findall(text):
        found.setdefault(name.lower(), entities.unescape("".join(values)))
    return found


def build(source: str) -> Node:
    """The tree of a page. Text is unescaped; nothing in the source makes this fail."""
    root = Node("html")
    stack, at = [root], 0

    opened: dict[str, list[int]] = {}  # where the open elements of a name stand on the stack, so that no search walks it

    def push(node: Node) -> None:
        stack[-1].children.append(node)
        opened.setdefault(node.name, []).append(len(stack))
        stack.append(node)

    def cut(k: int) -> None:
        for node in stack[k:]:
            opened[node.name].pop()
        del stack[k:]

    def innermost(names) -> int:
        return max((opened[n][-1] for n in names if opened.get(n)), default=0)

    def close(names, stops) -> None:
        """Close the open elements of these names above the innermost stop."""
        if any(opened.get(n) for n in names):
            stop = innermost(stops - names)
            above = [places[k] for places in (opened.get(n, ()) for n in names) if (k := bisect_right(places, stop)) < len(places)]
            if above:
                cut(min(above))

    def close_end(name: str) -> None:
        """What an end tag does: close the innermost open element of that name, unless a table or a cell stands between."""
        if opened.get(name):
            k = opened[name][-1]
            if name in SCOPE or name in _ROWS or innermost(SCOPE) < k:
                cut(k)

    def text(piece: str) -> None:
        if piece:
            stack[-1].children.append(entities.unescape(piece))

    while (match := _TOKEN.search(source, at)) is not None:
        text(source[at : match.start()])
        at = match.end()
        end, start, rest = match.groups()
        if end:
            end = end.lower()
            if end == "p" and not opened.get("p"):
                stack[-1].children.append(Node("p"))
            elif end == "br":
                stack[-1].children.append(Node("br"))
            else:
                close_end(end)
        elif start:
            name, found = start.lower(), _attributes(rest) if rest else {}
            if name == "html":
                root.attributes = found | root.attributes
                continue
            if name in IMPLIED:
                close(*IMPLIED[name])
            if name in ENDS_P:
                close({"p"}, SCOPE)
            if name in ("td", "th") and stack[-1].name in _ROWS - {"tr"}:
                push(Node("tr"))
            node = Node(name, found)
            if name not in RAW and name not in VOID:
                push(node)
                continue
            stack[-1].children.append(node)
            if name in RAW:
                stop = re.compile(rf"</{name}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I).search(source, at) if name != "plaintext" else None
                raw = source[at : stop.start()] if stop else source[at:]
                node.children.append(entities.unescape(raw) if name in ("title", "textarea") else raw)
                at = stop.end() if stop else len(source)
    text(source[at:])
    return root


def visible(node: Node) -> bool:
    """Whether a reader sees the element: by its name, ``hidden``, aria-hidden, an input's type, or an inline ``display``; see ``settle`` for ``visibility``."""
    a = node.attributes
    if node.name in HIDDEN or "hidden" in a and a["hidden"].lower() != "until-found" or a.get("aria-hidden", "").lower() == "true":
        return False
    if node.name == "dialog" and "open" not in a or node.name == "input" and a.get("type", "").lower() == "hidden":
        return False
    return not ("style" in a and _UNSEEN.search(a["style"]))


def settle(root: Node) -> None:
    """Hand ``visibility`` down the tree: what inherits hidden loses its text, and what holds nothing that is shown again becomes hidden as a whole."""
    order, stack = [], [(root, False)]
    while stack:
        node, unseen = stack.pop()
        if own := _VISIBILITY.findall(node.attributes.get("style", "")):
            unseen = own[-1].lower() in ("hidden", "collapse")
        order.append((node, unseen))
        stack.extend((c, unseen) for c in node.children if isinstance(c, Node))
    for node, unseen in reversed(order):
        if unseen:
            node.children = [c for c in node.children if isinstance(c, Node) and visible(c)]
            if not node.children:
                node.attributes = {"hidden": ""}


def drawn(svg: Node) -> list[Node]:
    """The texts of a drawing, in order."""
    found, stack = [], list(reversed(svg.children))
    while stack:
        child = stack.pop()
        if isinstance(child, str) or child.name in UNDRAWN or not visible(child):
            continue
        if child.name in DRAWN:
            found.append(child)
        else:
            stack.extend(reversed(child.children))
    return found


def _width(text: str) -> int:
    """Columns that a text takes: wide characters two, combining ones none."""
    return len(text) if text.isascii() else sum(0 if unicodedata.combining(c) else 1 + (unicodedata.east_asian_width(c) in "WF") for c in text)


class Page:
    """Lines as they are written: pending white space, pending empty lines, and the prefix of the block they stand in."""

    def __init__(self):
        self.lines: list[str] = []
        self.line, self.space, self.gap, self.mark = "", False, 0, ""
        self.indent: list[str] = []

    def write(self, text: str) -> None:
        lead, trail = text[:1] in " \t\n\r\f", text[-1:] in " \t\n\r\f"
        words = _SPACE.sub(" ", text).strip(" ")
        if not words:
            self.space = self.space or bool(text)
            return
        if self.line and (self.space or lead):
            self.line += " "
        self.line += words
        self.space = trail

    def exact(self, text: str) -> None:
        for k, part in enumerate(text.replace("\r\n", "\n").split("\n")):
            if k:
                self.end(keep=True)
            self.line += part

    def end(self, keep: bool = False) -> None:
        """End the line; ``keep`` an empty one."""
        if self.line or keep:
            if self.lines and self.gap:
                self.lines.append("")
            prefix = "".join(self.indent[:DEEPEST])
            if self.mark:
                room = len(self.mark) if len(self.indent) <= DEEPEST else 0
                prefix, self.mark = prefix[: len(prefix) - room] + self.mark, ""
            self.lines.append((prefix + self.line).rstrip(" "))
            self.line, self.gap = "", 0
        self.space = False

    def apart(self) -> None:
        self.end()
        self.gap = 1


def _cells(table: Node) -> tuple[list[Node], list[list[Node]]]:
    """Captions, and the cells of each row, of a table; anything else in it counts as a row of its own."""
    captions, rows, stack = [], [], list(reversed(table.children))
    while stack:
        child = stack.pop()
        if isinstance(child, str):
            if child.strip(" \t\n\r\f"):
                loose = Node("td")
                loose.children.append(child)
                rows.append([loose])
        elif not visible(child) or child.name in ("colgroup", "col"):
            continue
        elif child.name in ("tbody", "thead", "tfoot"):
            stack.extend(reversed(child.children))
        elif child.name == "caption":
            captions.append(child)
        elif child.name == "tr":
            cells = []
            for c in child.children:
                if isinstance(c, str):
                    if c.strip(" \t\n\r\f"):
                        loose = Node("td")
                        loose.children.append(c)
                        cells.append(loose)
                elif visible(c):
                    cells.append(c)
            rows.append(cells)
        else:
            rows.append([child])
    return captions, rows


def _span(cell: Node, name: str = "colspan") -> int:
    value = cell.attributes.get(name, "1").strip()
    return min(max(int(value), 1), 1000) if value.isdecimal() and len(value) < 6 else 1


def _placed(rows: list[list[tuple[list[str], int, int]]]) -> list[list[tuple[list[str], int]]]:
    """Rows of (lines, columns, rows it spans) with empty cells where a cell of an earlier row reaches down."""
    reaching: dict[int, tuple[int, int]] = {}  # column: rows still to come, columns
    out = []
    for row in rows:
        placed, at, below = [], 0, {}
        for lines, span, down in row:
            while at in reaching:
                placed.append(([], reaching[at][1]))
                at += reaching[at][1]
            placed.append((lines, span))
            if down > 1:
                below[at] = (down - 1, span)
            at += span
        reaching = {c: (left - 1, span) for c, (left, span) in reaching.items() if left > 1} | below
        out.append(placed)
    return out


def table_lines(rows: list[list[tuple[list[str], int]]]) -> list[str]:
    """Aligned lines of rows of (cell's lines, columns it spans). Cells are set apart by two spaces; spans take the room that is there."""
    widths: dict[int, int] = {}
    for row in rows:
        at = 0
        for lines, span in row:
            if span == 1:
                widths[at] = max(widths.get(at, 0), max(map(_width, lines), default=0))
            at += span
    out = []
    for row in rows:
        for k in range(max((len(lines) for lines, _ in row), default=0)):
            line, at, edge = "", 0, 0
            for lines, span in row:
                if k < len(lines) and lines[k]:
                    line += " " * max(edge - _width(line), 2 if line else 0) + lines[k]
                edge += sum(widths[c] + 2 for c in range(at, at + span) if widths.get(c))
                at += span
            out.append(line.rstrip(" "))
    return out


def render(source: str | None) -> str:
    """All visible text of a page, laid out. Null and empty pages give an empty text."""
    return rendered(build(source), source) if source else ""


def rendered(root: Node, source: str) -> str:
    """The text of a page's tree, which is used up."""
    if "visibility" in source.lower():
        settle(root)
    page = Page()
    #: a work list of steps: nodes to enter, and functions to call when their content is done
    work: list = [(root, False)]
    while work:
        item = work.pop()
        if callable(item):
            item()
            continue
        node, pre = item
        if isinstance(node, str):
            page.exact(node) if pre else page.write(node)
            continue
        if not visible(node):
            continue
        name = node.name
        if name == "br":
            page.end(keep=True)
        elif name == "img":
            if alt := node.attributes.get("alt", "").strip():
                page.write(f" {alt} ")
        elif name == "hr":
            page.apart()
        elif name == "input":
            if node.attributes.get("type", "").lower() in ("submit", "button", "reset"):
                page.write(" " + node.attributes.get("value", "") + " ")
        elif name == "table":
            _enter_table(node, page, work)
        elif name == "svg":
            for child in reversed(drawn(node)):
                work += [(" ", False), (child, False), (" ", False)]
        else:
            _enter(node, page, work, pre or name in ("pre", "listing", "xmp", "plaintext", "textarea"))
    page.end()
    return "\n".join(page.lines)


def _children(node: Node, pre: bool) -> list:
    return [(child, pre) for child in reversed(node.children)]


def _enter(node: Node, page: Page, work: list, pre: bool) -> None:
    name = node.name
    if name in ("td", "th"):  # outside a row
        page.write(" ")
    if name not in BLOCK:
        work.extend(_children(node, pre))
        return
    nested = name in ("ul", "ol", "menu") and bool(page.indent)
    page.apart() if name in APART and not nested else page.end()
    push = None
    if name == "li":
        mark = node.attributes.get("\0mark", "- ")
        page.mark, push = mark, " " * len(mark)
    elif name == "blockquote":
        push = "> "
    elif name == "dd":
        push = "    "
    elif name in ("ul", "ol", "menu"):
        value = node.attributes.get("start", "1").strip()
        number = int(value) if re.fullmatch("-?[0-9]{1,9}", value) else 1
        for child in node.children:
            if isinstance(child, Node) and child.name == "li" and visible(child):
                if re.fullmatch("-?[0-9]{1,9}", own := child.attributes.get("value", "").strip()):
                    number = int(own)
                child.attributes = child.attributes | {"\0mark": f"{number}. " if name == "ol" else "- "}
                number += 1
    elif name == "optgroup" and (label := node.attributes.get("label", "").strip()):
        page.write(label)
        page.end()
    if push is not None:
        page.indent.append(push)

    def leave() -> None:
        page.end()
        if push is not None:
            page.indent.pop()
            page.mark = ""
        if name in APART and not nested:
            page.gap = 1

    work.append(leave)
    work.extend(_children(node, pre))


def _enter_table(table: Node, page: Page, work: list) -> None:
    """Render each cell on a page of its own, then write the aligned lines."""
    captions, rows = _cells(table)
    done: list[list[tuple[list[str], int, int]]] = []
    page.apart()

    def finish() -> None:
        for line in table_lines(_placed(done)):
            page.line = line
            page.end(keep=not line and bool(page.lines))
        page.gap = 1

    # the outer page's state is put aside while cells are written, and restored by the steps below
    def begin(cell: Node):
        def step() -> None:
            kept.append((page.lines, page.line, page.space, page.gap, page.mark, page.indent))
            page.lines, page.line, page.space, page.gap, page.mark, page.indent = [], "", False, 0, "", []

        return step

    def end(row: list, cell: Node):
        def step() -> None:
            page.end()
            row.append((page.lines, _span(cell), _span(cell, "rowspan")))
            page.lines, page.line, page.space, page.gap, page.mark, page.indent = kept.pop()

        return step

    kept: list = []
    steps: list = []
    for caption in captions:
        steps += _in_order(caption)
        steps.append(page.end)
    for cells in rows:
        done.append(row := [])
        for cell in cells:
            steps += [begin(cell), *(_in_order(cell) if cell.name in ("td", "th") else [(cell, False)]), end(row, cell)]
    steps.append(finish)
    work.extend(reversed(steps))


def _in_order(node: Node) -> list:
    return [(child, False) for child in node.children]


def extracted(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """page_id, title, text, n_chars for every row of ``pages``: all visible text, laid out.

    Null and empty pages have an empty text; a page without title has a null one. Repeated rows are rendered each; other columns are never
    read; an empty table gives no rows.
    """

    def make():
        def step(batch: pa.RecordBatch) -> dict:
            sources = batch.column(1).to_pylist()
            titles, texts = [], []
            for source in sources:
                tree = build(source or "")
                titles.append(titled(tree))
                texts.append(rendered(tree, source) if source else "")
            return {"page_id": batch.column(0), "title": pa.array(titles, pa.string()), "text": texts,
                    "n_chars": pa.array(map(len, texts), pa.int64())}

        return step

    rows = pages.select(F.col(key).cast("long").alias("page_id"), F.col(html).cast("string").alias("html"))
    return map_batches(rows, make, "page_id long, title string, text string, n_chars long")


def title(source: str | None) -> str | None:
    return titled(build(source or ""))


def titled(root: Node) -> str | None:
    """The text of the first title element outside drawings, white space collapsed; comments and scripts hold none."""
    stack = [root]
    while stack:
        node = stack.pop()
        if node.name == "title":
            return _SPACE.sub(" ", "".join(c for c in node.children if isinstance(c, str))).strip(" ")
        if node.name != "svg":
            stack.extend(c for c in reversed(node.children) if isinstance(c, Node))
    return None
