"""HTML extraction by layout-aware rendering.

A tree builder reads tags in order, closes elements whose end tags HTML lets authors leave out, and drops
subtrees that aren't shown (head, scripts, styles, `hidden`, display: none, ...). A renderer walks the
tree and emits all visible text: blocks on lines of their own with a blank line where the default style
has a margin, lists with markers and indentation, table cells aligned in columns, preformatted text as
written. Pages are independent rows, so the job is one map without a shuffle.

Defined results: null or empty html gives empty text and zero counts; text without tags is one block;
unclosed and stray tags never fail; `<` that opens no tag is text; nested tables are laid out as blocks
inside their cell; repeated rows are rendered each; an empty table gives no rows; other columns ignored.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<![^>]*>|<\?[^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.DOTALL
)
ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?")
SPACES = re.compile(r"[ \t\n\r\f]+")

# HTML element classes.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript".split())
UNSEEN = frozenset(
    "head script style template noscript iframe noembed noframes title textarea select datalist object video audio canvas svg math".split()
)
MARGIN = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl table blockquote pre figure fieldset".split())
BLOCK = MARGIN | frozenset(
    "html body div section article aside header footer nav main address form details summary dialog hgroup li dt dd figcaption legend center menu tr caption thead tbody tfoot".split()
)
CLOSES_P = MARGIN | frozenset("div section article aside header footer nav main address form details dialog hr menu center".split())
# Which open elements a start tag ends, and where the search stops.
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "thead": ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}),
    "tbody": ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}),
    "option": ({"option"}, {"select"}),
    "body": ({"head"}, set()),
}
HIDDEN_STYLE = re.compile(r"display\s*:\s*none|visibility\s*:\s*(?:hidden|collapse)", re.IGNORECASE)


@dataclass
class Node:
    tag: str
    attributes: str = ""
    children: list = field(default_factory=list)

    def get(self, name: str) -> str | None:
        for key, value in ATTRIBUTE.findall(self.attributes):
            if key.lower() == name:
                return html.unescape(value.strip("\"'"))
        return None

    def shown(self) -> bool:
        if self.tag in UNSEEN:
            return False
        if not self.attributes:
            return True
        if self.get("hidden") is not None or (self.tag == "input"):
            return False
        return not HIDDEN_STYLE.search(self.get("style") or "")


def build(source: str) -> Node:
    """The element tree of a page; text children are strings."""
    root = Node("root")
    stack = [root]
    at, end = 0, len(source)
    for m in iter(lambda: TOKEN.search(source, at), None):
        if m.start() > at:
            stack[-1].children.append(html.unescape(source[at : m.start()]))
        at = m.end()
        if not m[2]:
            continue
        tag = m[2].lower()
        if m[1]:
            _close(stack, tag)
            continue
        if tag in CLOSES_P:
            _end_paragraph(stack)
        if tag in IMPLIED:
            ends, stops = IMPLIED[tag]
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag in stops:
                    break
                if stack[i].tag in ends:
                    del stack[i:]
        node = Node(tag, m[3])
        stack[-1].children.append(node)
        if tag in VOID:
            continue
        if tag in RAW:
            close = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>", re.IGNORECASE).search(source, at)
            at = close.end() if close else end
            continue
        stack.append(node)
    if at < end:
        stack[-1].children.append(html.unescape(source[at:]))
    return root


def _close(stack: list[Node], tag: str) -> None:
    for i in range(len(stack) - 1, 0, -1):
        if stack[i].tag == tag:
            del stack[i:]
            return
        if stack[i].tag in ("table", "td", "th") and tag not in ("table", "tr", "tbody", "thead", "tfoot", "td", "th", "body", "html"):
            return


def _end_paragraph(stack: list[Node]) -> None:
    for i in range(len(stack) - 1, 0, -1):
        if stack[i].tag == "p":
            del stack[i:]
            return
        if stack[i].tag in ("table", "td", "th", "li", "div", "body", "section", "article"):
            return


class Page:
    """Collects lines with block spacing."""

    def __init__(self):
        self.lines: list[str] = []
        self.line = ""
        self.gap = 0
        self.indent = ""
        self.marker = ""
        self.kept = False
        self.blocks = self.items = self.rows = 0

    def text(self, value: str, keep: bool = False) -> None:
        if keep:
            first, *rest = value.split("\n")
            self.line += first
            for part in rest:
                self.flush(True)
                self.line = part
            self.kept = True
            return
        value = SPACES.sub(" ", value)
        if not self.line or self.line.endswith(" "):
            value = value.lstrip(" ")
        self.line += value

    def flush(self, blank: bool = False) -> None:
        line = self.line if blank or self.kept else self.line.strip(" ")
        self.line, self.kept = "", False
        if not line and not blank:
            return
        if self.gap and self.lines:
            self.lines += [""] * self.gap
        self.gap = 0
        if self.marker:
            line = self.indent[: -len(self.marker)] + self.marker + line
            self.marker = ""
        else:
            line = self.indent + line if line else line
        self.lines.append(line.rstrip(" "))
        self.blocks += 1

    def space(self, margin: bool) -> None:
        self.flush()
        if margin and not self.marker:
            self.gap = 1


def draw(node: Node, page: Page, keep: bool = False) -> None:
    """Emit a node's visible text. Deep nesting is walked with an explicit stack of pending work."""
    work: list = [(node, keep)]
    while work:
        job = work.pop()
        if callable(job):
            job()
            continue
        node, keep = job
        if isinstance(node, str):
            page.text(node, keep)
            continue
        if not node.shown():
            continue
        tag = node.tag
        if tag == "br":
            page.flush(True)
        elif tag == "hr":
            page.space(True)
            page.line = "---"
            page.space(True)
        elif tag == "table":
            page.space(True)
            table(node, page)
            page.space(True)
        elif tag in BLOCK:
            nested = tag in ("ul", "ol") and bool(page.indent)
            page.space(tag in MARGIN and not nested)
            before, numbered = page.indent, {}
            if tag in ("ul", "ol", "menu"):
                start = node.get("start") if tag == "ol" else None
                count = int(start) if start and start.lstrip("-").isdigit() else 1
                for child in node.children:
                    if isinstance(child, Node) and child.tag == "li" and child.shown():
                        numbered[id(child)] = f"{count}. " if tag == "ol" else "- "
                        count += 1
            if tag in ("blockquote", "dd"):
                page.indent += "  "

            def leave(before=before, tag=tag, nested=nested) -> None:
                page.space(tag in MARGIN and not nested)
                page.indent, page.marker = before, ""

            work.append(leave)
            inner = keep or tag == "pre"
            for child in reversed(node.children):
                marker = numbered.get(id(child)) if not isinstance(child, str) else None
                if marker:
                    work.append(lambda before=page.indent: setattr(page, "indent", before))
                    work.append((child, inner))

                    def enter(marker=marker) -> None:
                        page.flush()
                        page.indent += " " * len(marker)
                        page.marker = marker
                        page.items += 1

                    work.append(enter)
                else:
                    work.append((child, inner))
        else:
            for child in reversed(node.children):
                work.append((child, keep))


def table(node: Node, page: Page) -> None:
    """Rows of cells padded to their column's width; captions and nested blocks keep one line per cell."""
    rows: list[list[str]] = []
    captions: list[Node] = []
    pending = list(reversed(node.children))
    while pending:
        child = pending.pop()
        if isinstance(child, str):
            if child.strip(" \t\r\n\f"):
                captions.append(Node("div", "", [child]))
        elif not child.shown():
            continue
        elif child.tag == "tr":
            cells: list[str] = []
            for cell in child.children:
                if isinstance(cell, Node) and cell.tag in ("td", "th"):
                    if not cell.shown():
                        continue
                    span = cell.get("colspan") or "1"
                    cells += [_flat(cell), *[""] * (min(int(span), 100) - 1 if span.isdigit() else 0)]
                elif not isinstance(cell, str) or cell.strip(" \t\r\n\f"):
                    cells.append(_flat(cell if isinstance(cell, Node) else Node("span", "", [cell])))
            rows.append(cells)
        elif child.tag in ("thead", "tbody", "tfoot"):
            pending += reversed(child.children)
        else:
            captions.append(child)
    for caption in captions:
        draw(caption, page)
        page.flush()
    width: list[int] = []
    for cells in rows:
        width += [0] * (len(cells) - len(width))
        for i, cell in enumerate(cells):
            width[i] = max(width[i], len(cell))
    for cells in rows:
        page.line = " | ".join(cell.ljust(width[i]) for i, cell in enumerate(cells))
        page.rows += bool(page.line.strip(" |"))
        if page.line.strip(" |"):
            page.flush()
        page.line = ""


def _flat(cell: Node) -> str:
    inner = Page()
    for child in cell.children:
        draw(child, inner)
    inner.flush()
    return " / ".join(line for line in (x.strip() for x in inner.lines) if line)


def render(source: str | None) -> tuple[str, int, int, int]:
    """(text, lines, list items, table rows) of a page."""
    page = Page()
    draw(build(source or ""), page)
    page.flush()
    return "\n".join(page.lines).strip("\n"), page.blocks, page.items, page.rows


def visible_text(pages: DataFrame) -> DataFrame:
    """page_id, text, n_chars, n_lines, n_items and n_rows for every row of pages."""
    kind = pages.schema["page_id"].dataType.simpleString()
    names = ["page_id", "text", "n_lines", "n_items", "n_rows"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 500):
                part = batch.slice(i, 500)
                out = list(zip(*[render(x) for x in part.column("html").to_pylist()], strict=True))
                kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([part.column("page_id"), *(pa.array(c, k) for c, k in zip(out, kinds, strict=True))], names=names)

    taken = pages.select("page_id", F.col("html").cast("string").alias("html"))
    out = taken.mapInArrow(run, f"page_id {kind}, text string, n_lines long, n_items long, n_rows long")
    return out.select("page_id", "text", F.length("text").cast("long").alias("n_chars"), "n_lines", "n_items", "n_rows")
