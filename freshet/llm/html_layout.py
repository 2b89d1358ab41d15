"""Visible text of web pages, laid out as a browser would: blocks, lists and aligned tables."""

from __future__ import annotations

import html
import re
import sys

from pyspark import cloudpickle
from pyspark.sql import DataFrame

from .common import session_of

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Element names of the HTML standard.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title xmp iframe noembed noframes".split())
UNSEEN = set("head script style template noscript title iframe noembed noframes object canvas svg math audio video datalist".split())
BLOCKS = set("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form "
             "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre section summary table ul".split())
SPACED = set("blockquote dl figure h1 h2 h3 h4 h5 h6 ol p pre table ul menu dir hr".split())
CLOSES_P = BLOCKS - {"body", "html", "dd", "dt", "li", "legend", "option"}
# An opening tag ends open elements of these names, up to the nearest of the borders.
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select", "datalist"}), "optgroup": ({"option", "optgroup"}, {"select"}),
    "tr": ({"tr", "td", "th", "caption"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "thead": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption"}, {"table"}),
    "tbody": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption"}, {"table"}),
    "body": ({"head"}, {"html"}),
}
BORDERS = {"table", "td", "th", "caption", "template", "button", "object"}
#: Elements nested deeper become siblings, as in browsers.
DEPTH = 200

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
INVISIBLE = re.compile(r"display\s*:\s*none|visibility\s*:\s*(?:hidden|collapse)", re.I)
SPACE = re.compile(r"[ \t\n\r\f]+")


class Node:
    __slots__ = ("tag", "children", "start", "span")

    def __init__(self, tag: str) -> None:
        self.tag, self.children, self.start, self.span = tag, [], 1, 1


def attributes(text: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for name, a, b, c in ATTRIBUTE.findall(text):
        out.setdefault(name.lower(), html.unescape(a or b or c))
    return out


def whole(value: str | None, default: int, most: int = 1000) -> int:
    return min(int(value), most) if value and value.isascii() and value.isdigit() and len(value) < 10 else default


def tree(page: str) -> Node:
    """The page's elements that can be seen, with implied tags added, and their text.

    Elements hidden by an attribute or an inline style stay out with all they hold.
    """
    root = Node("html")
    stack = [root]
    hidden = 0  # position in the stack of the outermost unseen element, 0 if none

    def close(names: set[str], borders: set[str]) -> None:
        nonlocal hidden
        for k in range(len(stack) - 1, 0, -1):
            if stack[k].tag in names:
                outermost = k
                while outermost > 1 and stack[outermost - 1].tag in names and stack[outermost - 1].tag not in borders:
                    outermost -= 1
                del stack[outermost:]
                if hidden >= len(stack):
                    hidden = 0
                return
            if stack[k].tag in borders:
                return

    at = 0
    match = TOKEN.search(page, at)
    while match:
        if match.start() > at and not hidden:
            stack[-1].children.append(html.unescape(page[at : match.start()]))
        at = match.end()
        slash, name, rest = match.groups()
        if name:
            name = name.lower()
            if slash:
                if name == "p" and not any(n.tag == "p" for n in stack):
                    stack[-1].children.append(Node("p"))
                elif name == "br":
                    stack[-1].children.append(Node("br"))
                else:
                    close({name}, BORDERS - {name} if name not in ("table", "tr", "tbody", "thead", "tfoot") else {"table"} - {name})
            else:
                if name in CLOSES_P:
                    close({"p"}, BORDERS)
                if name in IMPLIED:
                    names, borders = IMPLIED[name]
                    if name == "tr" or name in ("thead", "tbody", "tfoot"):
                        for _ in range(4):
                            close(names, borders)
                    else:
                        close(names, borders | BORDERS if name in ("li", "dt", "dd") else borders)
                if name in ("td", "th") and stack[-1].tag not in ("tr", "td", "th"):
                    if any(n.tag == "table" for n in stack) and not any(n.tag == "tr" for n in stack[max((k for k, n in enumerate(stack) if n.tag == "table"), default=0):]):
                        row = Node("tr")
                        stack[-1].children.append(row)
                        stack.append(row)
                node = Node(name)
                given = attributes(rest) if rest.strip(" /") else {}
                unseen = (name in UNSEEN or "hidden" in given or (name == "dialog" and "open" not in given)
                          or (name == "input") or bool(INVISIBLE.search(given.get("style", ""))))
                if name == "ol":
                    node.start = whole(given.get("start"), 1, 10**9)
                if name in ("td", "th"):
                    node.span = max(1, whole(given.get("colspan"), 1))
                if not hidden and not unseen:
                    if name == "img" and given.get("alt"):
                        stack[-1].children.append(given["alt"])
                    stack[-1].children.append(node)
                if name in RAW:
                    end = re.compile(rf"</{re.escape(name)}[\s/>]", re.I).search(page, at)
                    stop = end.start() if end else len(page)
                    if name in ("textarea", "xmp") and not hidden and not unseen:
                        node.children.append(html.unescape(page[at:stop]))
                    after = page.find(">", stop)
                    at = after + 1 if end and after >= 0 else len(page)
                elif name not in VOID and len(stack) < DEPTH:
                    stack.append(node)
                    if unseen and not hidden:
                        hidden = len(stack) - 1
        match = TOKEN.search(page, at)
    if at < len(page) and not hidden:
        stack[-1].children.append(html.unescape(page[at:]))
    return root


class Page:
    """Lines of text as they are laid out."""

    def __init__(self) -> None:
        self.lines: list[str] = []
        self.now = ""
        self.gap = False  # a space is due before the next word

    def words(self, text: str, pre: bool) -> None:
        if pre:
            head, *more = text.replace("\r\n", "\n").split("\n")
            self.now += head
            for line in more:
                self.lines.append(self.now.rstrip())
                self.now = line
            return
        text = text.replace("​", "").replace("­", "")
        plain = SPACE.sub(" ", text)
        if not plain:
            return
        if plain == " ":
            self.gap = True
            return
        if self.now and (self.gap or plain[0] == " "):
            self.now += " "
        self.now += plain.strip(" ")
        self.gap = plain[-1] == " "

    def line(self, force: bool = False) -> None:
        if self.now.strip() or force:
            self.lines.append(self.now.rstrip())
        self.now, self.gap = "", False

    def space(self) -> None:
        self.line()
        if self.lines and self.lines[-1]:
            self.lines.append("")


def rendered(children: list, page: Page, pre: bool, item: list) -> None:
    for child in children:
        if isinstance(child, str):
            page.words(child, pre)
            continue
        tag = child.tag
        if tag == "br":
            page.line(force=True)
        elif tag == "hr":
            page.space()
            page.lines.append("-" * 8)
            page.space()
        elif tag == "table":
            page.space()
            page.lines += table_lines(child)
            page.space()
        elif tag in ("ul", "ol", "menu", "dir"):
            nested = bool(item)
            page.line() if nested else page.space()
            item.append([tag, child.start])
            rendered(child.children, page, pre, item)
            item.pop()
            page.line() if nested else page.space()
        elif tag == "li":
            page.line()
            inner = Page()
            rendered(child.children, inner, pre, [*item[-1:]] if item else [["ul", 1]])
            inner.line()
            if item and item[-1][0] == "ol":
                mark = f"{item[-1][1]}. "
                item[-1][1] += 1
            else:
                mark = "- "
            lines = [x for x in inner.lines if x] or [""]
            page.lines += [(mark if k == 0 else " " * len(mark)) + x for k, x in enumerate(lines)]
        elif tag == "dd":
            page.line()
            inner = Page()
            rendered(child.children, inner, pre, [])
            inner.line()
            page.lines += ["  " + x if x else x for x in inner.lines]
        elif tag in BLOCKS or tag in ("tr", "caption"):
            page.space() if tag in SPACED else page.line()
            rendered(child.children, page, pre or tag == "pre", item)
            page.space() if tag in SPACED else page.line()
        elif tag in ("td", "th"):
            page.words(" ", False)
            rendered(child.children, page, pre, item)
            page.words(" ", False)
        else:
            rendered(child.children, page, pre or tag in ("textarea", "xmp"), item)


def table_lines(table: Node) -> list[str]:
    """Rows with cells padded to the width of their column; captions and loose text before."""
    before, rows, todo = Page(), [], [table]

    def walk(node: Node) -> None:
        for child in node.children:
            if isinstance(child, str):
                before.words(child, False)
            elif child.tag == "tr":
                row = []
                for cell in child.children:
                    if isinstance(cell, str):
                        if cell.strip():
                            row.append(SPACE.sub(" ", cell).strip())
                        continue
                    inner = Page()
                    rendered(cell.children if cell.tag in ("td", "th") else [cell], inner, False, [])
                    inner.line()
                    row.append(" ".join(x.strip() for x in inner.lines if x.strip()))
                    row += [""] * (cell.span - 1)
                rows.append(row)
            elif child.tag in ("thead", "tbody", "tfoot"):
                walk(child)
            else:
                rendered([child], before, False, [])

    walk(todo[0])
    before.line()
    widths: list[int] = []
    for row in rows:
        for k, cell in enumerate(row):
            if k == len(widths):
                widths.append(0)
            widths[k] = max(widths[k], len(cell) if len(cell) <= 60 else 0)
    lines = ["  ".join(cell.ljust(w) for cell, w in zip(row, widths)).rstrip() for row in rows]
    return [x for x in before.lines if x] + [x for x in lines if x]


def page_text(page: str | None) -> str | None:
    """All visible text of a page; blank lines separate paragraphs."""
    if page is None:
        return None
    out = Page()
    rendered(tree(page).children, out, False, [])
    out.line()
    lines: list[str] = []
    for line in out.lines:
        if line or (lines and lines[-1]):
            lines.append(line)
    while lines and not lines[-1]:
        lines.pop()
    return "\n".join(lines)


def extract_text(pages: DataFrame, html_col: str = "html", out: str = "text") -> DataFrame:
    """``pages`` with the visible text of each page appended as ``out``.

    A null page has a null text, an empty one an empty text. Malformed markup is read as
    browsers do: missing end tags are implied, unknown elements are inline. Elements
    nested deeper than 200 are read as siblings. All rows and columns are kept, repeated
    rows included; a column named like ``out`` is replaced.
    """
    session_of(pages)
    keep = [c for c in pages.columns if c != out]
    frame = pages.select(*keep)
    kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in frame.schema)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            texts = [page_text(p) for p in batch.column(html_col).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*keep, out])

    return frame.mapInArrow(run, f"{kind}, `{out}` string")

