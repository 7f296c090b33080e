"""Web pages by a stack of open tags: one pass over the tags, with the ends that HTML leaves out."""

from __future__ import annotations

import re
from html import unescape

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.config import DEFAULT

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^"'>]|"[^"]*"|'[^']*')*)>|<[!?][^>]*>""", re.S)
#: Elements whose content is no text of the page; the content of these runs to their own end tag.
SILENT = {"script", "style", "noscript", "template", "title", "textarea", "iframe", "svg"}
HEADINGS = {f"h{i}": i for i in range(1, 7)}
TEXTS = {"p", "li", "pre", "code", "dt", "dd", "blockquote", "figcaption", *HEADINGS}
VOID = {"br", "hr", "img", "input", "meta", "link", "area", "base", "col", "embed", "source", "track", "wbr"}
#: Starts of these end an open paragraph.
ENDS_P = {"address", "article", "aside", "blockquote", "div", "dl", "dt", "dd", "fieldset", "figure", "figcaption", "footer", "form", "header", "hr", "main", "nav", "ol", "p", "pre", "section", "table", "ul", "li", *HEADINGS}
#: What a start tag ends, and how far up it looks.
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu", "td", "th"}),
    "dt": ({"dt", "dd"}, {"dl", "td", "th"}),
    "dd": ({"dt", "dd"}, {"dl", "td", "th"}),
    "tr": ({"tr", "td", "th", "caption"}, {"table"}),
    "td": ({"td", "th", "caption"}, {"table", "tr"}),
    "th": ({"td", "th", "caption"}, {"table", "tr"}),
    "tbody": ({"tr", "td", "th", "thead", "tbody", "tfoot", "caption"}, {"table"}),
    "thead": ({"tr", "td", "th", "thead", "tbody", "tfoot", "caption"}, {"table"}),
    "tfoot": ({"tr", "td", "th", "thead", "tbody", "tfoot", "caption"}, {"table"}),
    "option": ({"option"}, {"select", "td", "th"}),
}
#: An end tag does not look beyond these for its start.
WALLS = {"table", "td", "th", "caption", "html"}
BLOCK_ENDS = ENDS_P | TEXTS | {"td", "th", "tr", "body", "html", "caption", "thead", "tbody", "tfoot", "option", "select", "button", "br", "menu"}


class _Table:
    def __init__(self, number: int):
        self.number, self.rows = number, []


class Page:
    """What one pass finds: blocks (level, text) in order, tables of cells, and counts."""

    def __init__(self, html: str):
        self.blocks: list[tuple[int, str]] = []
        self.tables: list[_Table] = []
        self.images = self.words = 0
        # an entry: tag, text so far, the heading level or 0, the table of a table element
        self._stack: list[dict] = [{"tag": "html", "text": [], "table": None}]
        self._scan(html)
        while len(self._stack) > 1:
            self._pop()
        self._flush(self._stack[0])

    def _sink(self) -> dict:
        """The innermost element that collects text: a block, a cell, or what stands around."""
        return next(e for e in reversed(self._stack) if e["text"] is not None)

    def _flush(self, e: dict) -> None:
        """What an element has collected becomes a block."""
        text = " ".join(unescape("".join(e["text"])).split())
        e["text"] = []
        if text:
            self.words += len(text.split())
            if e["tag"] in HEADINGS:
                self.blocks.append((HEADINGS[e["tag"]], text))
            elif e["tag"] not in ("td", "th"):
                if len(text) > DEFAULT.html_least_chars:
                    self.blocks.append((0, text))
            else:
                self._cell(e, text)
        elif e["tag"] in ("td", "th"):
            self._cell(e, "")

    def _cell(self, e: dict, text: str) -> None:
        if e["row"] is not None:
            e["row"].append(text)

    def _push(self, tag: str) -> None:
        e = {"tag": tag, "text": None, "table": None}
        if tag in ("td", "th"):
            table = next((x["table"] for x in reversed(self._stack) if x["table"] is not None), None)
            if table is not None and not table.rows:
                table.rows.append([])
            e |= {"text": [], "row": table.rows[-1] if table is not None else None}
        elif tag in TEXTS:
            around = self._sink()
            # code within running text stays in it; text of a cell belongs to the cell
            if not (tag == "code" and around["tag"] in TEXTS) and not self._in_cell():
                self._flush(around)  # what came before stands before
                e["text"] = []
        elif tag == "table":
            around = self._sink()
            if around["tag"] not in ("td", "th"):
                self._flush(around)
            e["table"] = _Table(len(self.tables))
            self.tables.append(e["table"])
        elif tag == "tr":
            table = next((x["table"] for x in reversed(self._stack) if x["table"] is not None), None)
            if table is not None:
                table.rows.append([])
        self._stack.append(e)

    def _in_cell(self) -> bool:
        for e in reversed(self._stack):
            if e["tag"] in ("td", "th"):
                return True
            if e["tag"] == "table":
                return False
        return False

    def _pop(self) -> None:
        e = self._stack.pop()
        if e["text"] is not None:
            self._flush(e)

    def _close(self, tags: set[str], walls: set[str]) -> None:
        """End all open elements down to the outermost of some kinds before a wall."""
        last = None
        for i in range(len(self._stack) - 1, 0, -1):
            if self._stack[i]["tag"] in walls:
                break
            if self._stack[i]["tag"] in tags:
                last = i
        while last is not None and len(self._stack) > last:
            self._pop()

    def _start(self, tag: str) -> None:
        if tag in IMPLIED:
            self._close(*IMPLIED[tag])
        if tag in ENDS_P:
            self._close({"p"}, WALLS | {"button", "li", "dd", "dt"} - {tag} if tag in ("li", "dd", "dt") else WALLS | {"button"})
        if tag in HEADINGS and self._stack[-1]["tag"] in HEADINGS:
            self._pop()
        if tag in BLOCK_ENDS:
            self._sink()["text"].append(" ")
        if tag == "img":
            self.images += 1
        if tag not in VOID:
            self._push(tag)

    def _end(self, tag: str) -> None:
        for i in range(len(self._stack) - 1, 0, -1):
            own = self._stack[i]["tag"]
            if own == tag or tag in HEADINGS and own in HEADINGS:
                while len(self._stack) > i:
                    self._pop()
                break
            if own in WALLS and tag != "table" and not (own in ("td", "th", "caption") and tag in ("tr", "tbody", "thead", "tfoot", "table")):
                break
        if tag in BLOCK_ENDS:
            self._sink()["text"].append(" ")
        if tag in ("div", "section", "article", "body", "header", "footer", "nav", "main", "aside") and not self._in_cell():
            self._flush(self._sink()) if self._sink()["tag"] not in TEXTS else None

    def _scan(self, html: str) -> None:
        at = 0
        while m := _TAG.search(html, at):
            if m.start() > at:
                self._sink()["text"].append(html[at : m.start()])
            at = m.end()
            if not m[2]:
                continue
            tag = m[2].lower()
            if m[1]:
                self._end(tag)
            elif tag in SILENT:
                end = re.compile(rf"</{re.escape(tag)}\b[^>]*>", re.I).search(html, at)
                at = end.end() if end else (len(html) if tag in ("script", "style") else at)
            else:
                self._start(tag)
        if at < len(html):
            self._sink()["text"].append(html[at:])


SCHEMA = "kind string, pos long, level int, text string, table_pos long, headers array<string>, rows array<array<string>>, images long, words long"


def pages(docs: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """(key, kind, ...): of each page its blocks (pos, level, text), its tables (table_pos, headers, rows) and one row of counts (images, words).

    Headings come first, then texts, as the data model has them. A text stands once, in the innermost element that holds it, and none is cut;
    a text of a cell is the cell's. Texts of at most 15 characters outside headings are left out. A null page has counts of 0.
    """
    names = [c.split()[0] for c in SCHEMA.split(", ")]

    def run(batches):
        for df in batches:
            rows = []
            for k, text in zip(df["key"], df["html"], strict=True):
                page = Page(text or "")
                ordered = [b for b in page.blocks if b[0]] + [b for b in page.blocks if not b[0]]
                rows += [(k, "block", i, level, t, None, None, None, None, None) for i, (level, t) in enumerate(ordered)]
                tables = [[r for r in t.rows if r] for t in page.tables]
                rows += [(k, "table", None, None, None, i, t[0], t[1:], None, None) for i, t in enumerate(t for t in tables if t)]
                rows.append((k, "page", None, None, None, None, None, None, page.images, page.words))
            yield pd.DataFrame(rows, columns=["key", *names], dtype=object)

    kind = dict(docs.dtypes)[key]
    found = docs.select(F.col(key).cast("string").alias("key"), F.col(html).alias("html")).mapInPandas(run, f"key string, {SCHEMA}")
    return found.select(F.col("key").cast(kind).alias(key), *names)
