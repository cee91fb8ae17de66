"""Visible text of web pages by a layout-aware renderer.

The tree builder supplies the end tags that pages leave out, and each element
is rendered when it closes, so depth costs no recursion. Blocks begin on lines
of their own, with blank lines around paragraphs, headings, lists and tables;
list items have marks and hang; table cells are padded to columns; text in
``pre`` keeps its white space. Elements that a browser doesn't show are left
out with all they hold. Every page is rendered in its own task; no shuffle.
"""

from __future__ import annotations

import re
from collections import Counter
from html.parser import HTMLParser

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from qualispark.llm.common import arrow_map

#: A cell wider than this isn't padded (its text is kept whole).
COLUMN = 60

# Element names of HTML by what a browser does with them.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
HIDDEN = frozenset("head title script style template datalist iframe object audio video canvas noembed noframes".split())
HEAD_ONLY = frozenset("title meta link script style base noscript template".split())
SPACED = frozenset(
    "p h1 h2 h3 h4 h5 h6 ul ol dl menu table pre blockquote figure fieldset hr form details".split()
)
BLOCK = SPACED | frozenset(
    "html body div section article main header footer nav aside address li dt dd figcaption legend "
    "summary center dialog option optgroup select caption hgroup search".split()
)
CELLS = frozenset(("td", "th"))
SECTIONS = frozenset(("thead", "tbody", "tfoot"))
#: Opening the key ends open elements of the first set, up to one of the second.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select", "datalist"}),
    "optgroup": ({"option", "optgroup"}, {"select"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tr": ({"td", "th", "tr", "caption"}, {"table"}),
    "tbody": ({"td", "th", "tr", "thead", "tbody", "tfoot", "caption"}, {"table"}),
    "thead": ({"td", "th", "tr", "thead", "tbody", "tfoot", "caption"}, {"table"}),
    "tfoot": ({"td", "th", "tr", "thead", "tbody", "tfoot", "caption"}, {"table"}),
}
#: An end tag doesn't reach out of these, other than for itself.
SCOPE = frozenset("table td th caption html".split())

_SPACE = re.compile(r"[ \t\n\r\f]+")
_NOT_SHOWN = re.compile(r"(?:^|;)\s*(?:display\s*:\s*none|visibility\s*:\s*(?:hidden|collapse))", re.I)


class _Element:
    """An open element and what it has rendered: lines, and text of the last line."""

    __slots__ = ("tag", "hidden", "pre", "lines", "text", "gap", "rows", "count", "span", "shown_only")

    def __init__(self, tag: str, hidden: bool, pre: bool):
        self.tag, self.hidden, self.pre = tag, hidden, pre
        self.lines: list[str] = []  # "" is a blank line between blocks
        self.text: list[str] = []
        self.gap = False  # a blank line is due before the next text
        self.rows: list[list[list[str]]] = []
        self.count, self.span, self.shown_only = 0, 1, None

    def flush(self) -> None:
        joined = "".join(self.text)
        self.text = []
        if self.pre:
            new = joined.split("\n") if joined else []
        else:
            new = [x for x in (_SPACE.sub(" ", part).strip(" ") for part in joined.split("\v")) if x]
        self.put(new)

    def put(self, new: list[str]) -> None:
        if new:
            if self.gap and self.lines:
                self.lines.append("")
            self.gap = False
            self.lines += new

    def block(self, new: list[str], spaced: bool) -> None:
        self.flush()
        if spaced and self.lines:
            self.gap = True
        self.put(new)
        if spaced and new:
            self.gap = True


def _aligned(rows: list[list[list[str]]]) -> list[str]:
    """Rows of cells of lines, columns padded to their widest cell up to ``COLUMN``."""
    widths: list[int] = []
    for row in rows:
        widths += [0] * (len(row) - len(widths))
        for i, cell in enumerate(row):
            widths[i] = max([widths[i], *(len(x) for x in cell if len(x) <= COLUMN)])
    out = []
    for row in rows:
        for n in range(max(map(len, row), default=0)):
            parts = [(cell[n] if n < len(cell) else "").ljust(widths[i]) for i, cell in enumerate(row)]
            out.append("  ".join(parts).rstrip(" "))
    return [x for x in out if x]


class _Renderer(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open = [_Element("#root", False, False)]
        self.among: Counter[str] = Counter()  # open elements by tag: most searches of the stack end here

    # tree builder

    def _find(self, tags, stop) -> int | None:
        if not any(self.among[t] for t in tags):
            return None
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag in tags:
                return i
            if self.open[i].tag in stop:
                return None
        return None

    def _close_to(self, i: int) -> None:
        while len(self.open) > i:
            self._close()

    def handle_starttag(self, tag, attrs):
        if tag in ("html", "body"):
            head = self._find({"head"}, ())
            if head:
                self._close_to(head)
            return
        if tag not in HEAD_ONLY and (head := self._find({"head"}, ())):
            self._close_to(head)
        if tag in CLOSES:
            ends, stop = CLOSES[tag]
            while (i := self._find(ends, stop)) is not None:
                self._close_to(i)
            if tag in CELLS and self.open[-1].tag != "tr":
                self._push("tr", {})
        elif tag in BLOCK and (i := self._find({"p"}, SCOPE | {"button", "object"})):
            self._close_to(i)
        elif tag in ("a", "button") and (i := self._find({tag}, SCOPE)):
            self._close_to(i)
        if tag[:1] == "h" and tag[1:] in tuple("123456") and self.open[-1].tag in ("h1", "h2", "h3", "h4", "h5", "h6"):
            self._close()
        if tag == "br":
            self.open[-1].text.append("\n" if self.open[-1].pre else "\v")
        elif tag == "hr":
            self.open[-1].block([], True)
        elif tag not in VOID:
            self._push(tag, dict(attrs))

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)  # browsers ignore the slash of other elements

    def handle_endtag(self, tag):
        if tag in ("html", "body"):
            return
        if tag in ("br", "p") and (tag == "br" or self._find({"p"}, SCOPE) is None):
            self.handle_starttag(tag, [])
            if tag == "p":
                self._close()
            return
        heading = {"h1", "h2", "h3", "h4", "h5", "h6"} if tag[:1] == "h" and tag[1:] in tuple("123456") else {tag}
        stop = () if tag in SCOPE else SCOPE
        if tag in CELLS | {"tr"} | SECTIONS | {"caption"}:
            stop = {"table"}
        if tag == "li":
            stop = SCOPE | {"ul", "ol", "menu"}
        if (i := self._find(heading, stop)) is not None:
            self._close_to(i)

    def handle_data(self, data):
        top = self.open[-1]
        if not top.hidden and top.tag not in ("table", "tr", "thead", "tbody", "tfoot"):
            top.text.append(data.replace("\v", " ") if not top.pre else data)
        elif not top.hidden and data.strip():
            self.open[self._outside_table()].text.append(data)

    def parse_marked_section(self, i, report=1):
        return self.parse_bogus_comment(i, 0)

    def _outside_table(self) -> int:
        """Text between cells belongs before the table."""
        i = self._find({"table"}, ())
        return (i or 1) - 1

    # layout

    def _push(self, tag: str, attrs: dict) -> None:
        up = self.open[-1]
        hidden = up.hidden or tag in HIDDEN or "hidden" in attrs or bool(_NOT_SHOWN.search(attrs.get("style") or ""))
        hidden = hidden or (tag == "dialog" and "open" not in attrs)
        hidden = hidden or (up.shown_only is not None and tag != up.shown_only)
        inline = tag not in BLOCK and tag not in CELLS and tag not in SECTIONS and tag != "tr"
        if inline and not hidden and tag not in ("textarea", "pre"):
            e = _Element(tag, hidden, up.pre)
            e.lines, e.text, e.gap = up.lines, up.text, up.gap  # an inline element writes to its block
            e.shown_only, e.rows = up.shown_only, up.rows
            e.span = 0
        else:
            e = _Element(tag, hidden, up.pre or tag in ("pre", "textarea"))
        if tag == "details" and "open" not in attrs:
            e.shown_only = "summary"
        if tag == "ol":
            start = attrs.get("start") or ""
            e.count = int(start) - 1 if re.fullmatch(r"-?[0-9]{1,9}", start) else 0
        if tag in CELLS:
            span = attrs.get("colspan") or ""
            e.span = min(int(span), 1000) if re.fullmatch(r"[0-9]{1,4}", span) and int(span) else 1
        self.open.append(e)
        self.among[self.open[-1].tag] += 1

    def _close(self) -> None:
        self.among[self.open[-1].tag] -= 1
        e, up = self.open.pop(), self.open[-1]
        if e.hidden:
            return
        if e.lines is up.lines or e.span == 0:  # inline
            up.lines, up.text, up.gap = e.lines, e.text, e.gap
            return
        if e.shown_only and not e.pre:
            e.text = []  # bare text of closed details isn't shown
        e.flush()
        if e.tag == "pre":
            while e.lines and not e.lines[-1].strip():
                e.lines.pop()
            while e.lines and not e.lines[0].strip():
                e.lines.pop(0)
        if e.tag in CELLS:
            row = self.open[self._find({"tr"}, {"table"}) or 0]
            row.rows.append([e.lines])
            row.rows += [[[]] for _ in range(e.span - 1)]
        elif e.tag == "tr":
            table = self.open[self._find({"table"}, ()) or 0]
            if table.tag == "table":
                table.rows.append([cell[0] for cell in e.rows])
            else:
                table.block(_aligned([[cell[0] for cell in e.rows]]), False)
        elif e.tag in SECTIONS:
            up.put(e.lines)
        elif e.tag == "table":
            up.block(e.lines + _aligned(e.rows), True)
        elif e.tag == "li" and e.lines:
            mark = "- "
            if up.tag == "ol":
                up.count += 1
                mark = f"{up.count}. "
            pad = " " * len(mark)
            up.block([(mark if i == 0 else pad if x else "") + x for i, x in enumerate(e.lines)], False)
        elif e.tag in ("dd", "blockquote"):
            up.block(["  " + x if x else "" for x in e.lines], e.tag == "blockquote")
        else:
            nested = e.tag in ("ul", "ol", "menu") and up.tag == "li"
            up.block(e.lines, e.tag in SPACED and not nested)

    def result(self) -> str:
        self._close_to(1)
        root = self.open[0]
        root.flush()
        return "\n".join(x.replace("\xa0", " ").rstrip() for x in root.lines)


def visible_text(html: str) -> str:
    """The text that a browser would show, laid out in lines."""
    page = _Renderer()
    page.feed(html)
    page.close()
    return page.result()


def extract(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """One row per page: page_id, text (laid out), n_chars, n_lines.

    A null or empty page has an empty text; null ids and repeated rows are
    rendered like any other; an empty table gives no rows; other columns are
    not read.
    """

    def rows(batches):
        for b in batches:
            for begin in range(0, b.num_rows, 64):
                part = b.slice(begin, 64)
                yield {"page_id": part.column(0), "text": [visible_text(x or "") for x in part.column(1).to_pylist()]}

    own = pages.select(F.col(f"`{id_col}`").cast("long").alias("page_id"), F.col(f"`{html_col}`").alias("html"))
    found = arrow_map(own, rows, "page_id long, text string")
    lines = F.filter(F.split("text", "\n"), lambda x: x != "")
    return found.select(
        "page_id", "text", F.length("text").cast("long").alias("n_chars"), F.size(lines).cast("long").alias("n_lines")
    )
