"""The content of web pages as typed blocks: headings, paragraphs, lists, tables and code, each with the headings that it stands under."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Elements that hold no content, and words in class, id, role and aria-label that say so of others.
NOISE = {"script", "style", "noscript", "template", "svg", "head", "header", "footer", "nav", "aside", "dialog"}
HINTS = {
    "cookie", "cookies", "banner", "menu", "navbar", "nav", "header", "footer", "sidebar", "breadcrumbs", "breadcrumb", "advert", "promo", "share", "social",
    "modal", "popup", "overlay", "dialog", "search", "login", "signin", "signup", "register", "auth",
}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
#: What ends an open paragraph.
_ENDS_P = {"p", "div", "section", "article", "main", "table", "ul", "ol", "pre", "blockquote", "form", "h1", "h2", "h3", "h4", "h5", "h6"}
#: Open elements of the same list or table that are over when one begins, as their end tags may be left out.
_ENDS = {"li": ["li"], "tr": ["td", "th", "tr"], "td": ["td", "th"], "th": ["td", "th"]}
_MOST_SPAN = 1000


@dataclass
class Block:
    kind: str
    path: str
    body: str = ""
    level: int = 0
    rows: int = 0
    columns: int = 0


def grid(rows: list[list[tuple[str, int, int]]]) -> list[list[str]]:
    """Rows of cells (text, columns, rows) as a full grid: what spans several places stands in each of them, and short rows are filled up."""
    out: dict[tuple[int, int], str] = {}
    for r, cells in enumerate(rows):
        c = 0
        for text, across, down in cells:
            while (r, c) in out:
                c += 1
            for i in range(min(down, len(rows) - r)):
                for j in range(across):
                    out.setdefault((r + i, c + j), text)
            c += across
    width = max((c for _, c in out), default=-1) + 1
    return [[out.get((r, c), "") for c in range(width)] for r in range(len(rows))]


def table_text(cells: list[list[str]]) -> str:
    """A grid in markdown, its first row as the header."""
    line = lambda row: "| " + " | ".join(c.replace("|", "\\|") for c in row) + " |"
    return "\n".join([line(cells[0]), line(["---"] * len(cells[0])), *map(line, cells[1:])]) if cells else ""


class _Reader(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.blocks: list[Block] = []
        self.visible: list[str] = []
        self.removed = 0
        self.open: list[str] = []
        self.skipped_at: int | None = None  # depth of the open element that is no content
        self.headings: list[str] = []
        self.held: list[str] | None = None  # text of the block or cell that is open
        self.lists: list[list] = []  # ordered, number, for each open list
        self.items: list[str] = []
        self.rows: list[list[tuple[str, int, int]]] = []
        self.spans, self.language = (1, 1), ""
        self.forms: list[list] = []  # where a form's blocks begin, and whether it asks for a password

    def _says_noise(self, tag: str, attrs: dict[str, str]) -> bool:
        said = " ".join(attrs.get(a) or "" for a in ("class", "id", "role", "aria-label")).lower()
        return tag in NOISE or (tag not in ("html", "body", "main", "article") and any(w in HINTS for w in re.split("[^a-z]+", said)))

    def handle_starttag(self, tag: str, attrs: list) -> None:
        of = {k: v or "" for k, v in attrs}
        if tag in VOID:
            if tag == "br" and self.held is not None:
                self.held.append("\n")
            if tag == "input" and of.get("type", "").lower() == "password" and self.forms:
                self.forms[-1][1] = True
            return
        if self.skipped_at is None:
            if tag in _ENDS_P and "p" in self.open:
                self._close("p")
            self._end_same(tag)
            if self._says_noise(tag, of):
                self.removed += tag not in ("head", "script", "style")
                self.skipped_at = len(self.open)
            else:
                self._begin(tag, of)
        self.open.append(tag)

    def _end_same(self, tag: str) -> None:
        for kind in _ENDS.get(tag, ()):
            inside = next((i for i in range(len(self.open) - 1, -1, -1) if self.open[i] in ("ul", "ol", "table")), -1)
            if kind in self.open[inside + 1 :]:
                self._close(kind)

    def _begin(self, tag: str, of: dict[str, str]) -> None:
        in_table = "table" in self.open
        if tag == "form":
            self.forms.append([len(self.blocks), False])
        elif tag in ("td", "th") and self.open.count("table") == 1:
            number = lambda a: min(_MOST_SPAN, max(1, int(of[a]))) if of.get(a, "").isdigit() else 1
            self.spans, self.held = (number("colspan"), number("rowspan")), []
        elif tag == "tr" and self.open.count("table") == 1:
            self.rows.append([])
        elif in_table or "pre" in self.open:
            pass  # what stands in cells and code is their text
        elif tag == "table":
            self.rows = []
        elif tag in ("ul", "ol"):
            self._item()
            self.lists.append([tag == "ol", 0])
        elif tag == "li":
            self._item()
            if self.lists:
                self.lists[-1][1] += 1
            self.held = []
        elif tag == "pre":
            self.held = []
            self.language = next((c[9:] for c in of.get("class", "").split() if c.startswith("language-")), "")
        elif (tag == "p" and not self.lists) or re.fullmatch("h[1-6]", tag):
            self.held = []

    def _item(self) -> None:
        """Ends the text of a list's item, before what may be a list inside it."""
        text, self.held = self._text(), None
        if text and self.lists:
            ordered, number = self.lists[-1]
            self.items.append("  " * (len(self.lists) - 1) + (f"{number}. " if ordered else "- ") + text)

    def _text(self) -> str:
        lines = (re.sub(r"[^\S\n]+", " ", s).strip() for s in "".join(self.held or []).split("\n"))
        return "\n".join(s for s in lines if s)

    def handle_endtag(self, tag: str) -> None:
        if tag in self.open:
            self._close(tag)

    def _close(self, tag: str) -> None:
        """Ends the innermost open element of that name and whatever is open inside it."""
        while True:
            name = self.open.pop()
            if self.skipped_at is None:
                self._end(name)
            elif len(self.open) <= self.skipped_at:
                self.skipped_at = None
            if name == tag:
                return

    def _add(self, kind: str, body: str, **more: int) -> None:
        if body:
            self.blocks.append(Block(kind, " / ".join(self.headings), body, **more))

    def _end(self, tag: str) -> None:
        in_table = "table" in self.open
        if tag == "form" and self.forms:
            start, asks = self.forms.pop()
            if asks:
                self.removed += 1
                del self.blocks[start:]
        elif tag in ("td", "th") and self.open.count("table") == 1 and self.held is not None:
            if self.rows:
                self.rows[-1].append((self._text().replace("\n", " "), *self.spans))
            self.held = None
        elif tag == "table" and not in_table:
            cells = grid([r for r in self.rows if r])
            self._add("table", table_text(cells), rows=len(cells), columns=len(cells[0]) if cells else 0)
            self.rows, self.held = [], None
        elif in_table or "pre" in self.open:
            pass
        elif tag == "li":
            self._item()
        elif tag in ("ul", "ol") and self.lists:
            self._item()
            ordered = self.lists.pop()[0]
            if not self.lists:
                self._add("ordered_list" if ordered else "list", "\n".join(self.items), rows=len(self.items))
                self.items = []
        elif tag == "pre":
            body, self.held = "".join(self.held or []).strip("\n").rstrip(), None
            self._add("code", f"```{self.language}\n{body}\n```" if body else "")
        elif re.fullmatch("h[1-6]", tag) and self.held is not None:
            text, level, self.held = self._text().replace("\n", " "), int(tag[1]), None
            if text:
                self.headings = [*self.headings[: level - 1], text]
            self._add("heading", text, level=level)
        elif tag == "p" and not self.lists and self.held is not None:
            text, self.held = self._text(), None
            self._add("paragraph", text)

    def handle_data(self, data: str) -> None:
        if self.skipped_at is None:
            if self.held is not None:
                self.held.append(data if "pre" in self.open else data.replace("\n", " "))
            if data.strip():
                self.visible.append(re.sub(r"\s+", " ", data).strip())

    def finished(self) -> list[Block]:
        self.close()
        while self.open:
            self._close(self.open[-1])
        return self.blocks or ([Block("visible_text", "", "\n".join(self.visible))] if self.visible else [])


def read_blocks(html: str) -> tuple[list[Block], int]:
    """The blocks of a page, and how many parts of it were left out as no content. A page without blocks is one block of its visible text; text
    outside of headings, paragraphs, lists, tables and code is no block otherwise."""
    reader = _Reader()
    reader.feed(html.replace("\0", ""))
    return reader.finished(), reader.removed


def html_blocks(pages: DataFrame, key: str, html: str) -> DataFrame:
    """(key, block, kind, level, section_path, body, n_rows, n_columns, removed) of the blocks of each page, in one scan. Kinds: heading, paragraph, list, ordered_list,
    table, code, visible_text. section_path has the headings above, a heading's its own too. Pages that are null or hold no text have no rows."""
    names = [key, "block", "kind", "level", "section_path", "body", "n_rows", "n_columns", "removed"]
    types = [pa.int32(), pa.string(), pa.int32(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kind, rows = batch.schema.field(key).type, []
            for k, h in zip(batch[key].to_pylist(), batch[html], strict=True):
                blocks, removed = read_blocks(h.as_py() or "")
                rows += ((k, n, b.kind, b.level, b.path, b.body, b.rows, b.columns, removed) for n, b in enumerate(blocks))
                if len(rows) > 2000:
                    yield out(rows, kind)
                    rows = []
            yield out(rows, kind)

    def out(rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate([kind, *types])], names)

    schema = f"{key} {pages.schema[key].dataType.simpleString()}, block int, kind string, level int, section_path string, body string, n_rows int, n_columns int, removed int"
    return pages.select(key, F.col(html).cast("string").alias(html)).mapInArrow(run, schema)


def documents(blocks: DataFrame, key: str) -> DataFrame:
    """(key, markdown, outline, n_words, and counts by kind) of each page from its blocks. outline: structs of level and section_path. A page's blocks are gathered, as one page is one row of text anyway."""
    mark = F.when(F.col("kind") == "heading", F.concat(F.repeat(F.lit("#"), F.col("level")), F.lit(" "), "body")).otherwise(F.col("body"))
    count = lambda *kinds: F.count(F.when(F.col("kind").isin(*kinds), 1))
    g = blocks.groupBy(key).agg(
        F.array_sort(F.collect_list(F.struct("block", mark.alias("text")))).alias("_b"), F.array_sort(F.collect_list(F.when(F.col("kind") == "heading", F.struct("block", "level", "section_path")))).alias("_o"),
        count("heading").alias("n_headings"), count("paragraph", "visible_text").alias("n_paragraphs"), count("list", "ordered_list").alias("n_lists"), count("table").alias("n_tables"), count("code").alias("n_code"),
    )
    markdown: Column = F.array_join("_b.text", "\n\n")
    outline = F.transform("_o", lambda o: F.struct(o["level"].alias("level"), o["section_path"].alias("section_path")))
    return g.select(key, markdown.alias("markdown"), outline.alias("outline"), F.size(F.filter(F.split(markdown, r"\s+"), lambda w: w != "")).alias("n_words"), "n_headings", "n_paragraphs", "n_lists", "n_tables", "n_code")
