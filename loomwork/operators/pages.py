"""Pages: links between them, and their text."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import url as U


def link_edges(pages: DataFrame) -> DataFrame:
    """(page_id, host, href): a row for each link of each page."""
    return pages.select("page_id", U.host(F.col("url")).alias("host"), F.explode(U.links(F.col("html"))).alias("href"))


def link_groups(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(a, b, relation): each neighbour of a as mutual, out or in. Edges are distinct."""
    both = edges.select(a, b, F.lit(1).alias("out"), F.lit(0).alias("in")).unionByName(edges.select(F.col(b).alias(a), F.col(a).alias(b), F.lit(0).alias("out"), F.lit(1).alias("in")))
    g = both.groupBy(a, b).agg(F.max("out").alias("out"), F.max("in").alias("in"))
    return g.select(a, b, F.when((F.col("out") == 1) & (F.col("in") == 1), "mutual").when(F.col("out") == 1, "out").otherwise("in").alias("relation"))


class _Markdown(HTMLParser):
    """Headings, paragraphs, lists and code as markdown; navigation, scripts and forms are left out."""

    SKIP = {"script", "style", "nav", "footer", "header", "aside", "form", "template", "noscript", "dialog"}
    BREAK = {"p", "div", "section", "article", "main", "table", "tr", "ul", "ol", "pre", "blockquote"}

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.title, self.in_title, self.skip, self.lists = "", False, 0, []
        self.counts = {"h": 0, "li": 0, "p": 0}

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in self.SKIP:
            self.skip += 1
        elif tag == "title":
            self.in_title = True
        elif not self.skip:
            if re.fullmatch("h[1-6]", tag):
                self.counts["h"] += 1
                self.out.append("\n\n" + "#" * int(tag[1]) + " ")
            elif tag in ("ul", "ol"):
                self.lists.append([tag, 0])
                self.out.append("\n")
            elif tag == "li":
                self.counts["li"] += 1
                kind = self.lists[-1] if self.lists else ["ul", 0]
                kind[1] += 1
                self.out.append("\n" + (f"{kind[1]}. " if kind[0] == "ol" else "- "))
            elif tag == "br":
                self.out.append("\n")
            elif tag in self.BREAK:
                self.counts["p"] += tag == "p"
                self.out.append("\n\n")

    def handle_endtag(self, tag: str) -> None:
        if tag in self.SKIP:
            self.skip = max(0, self.skip - 1)
        elif tag == "title":
            self.in_title = False
        elif tag in ("ul", "ol") and self.lists:
            self.lists.pop()
        elif not self.skip and (tag in self.BREAK or re.fullmatch("h[1-6]", tag)):
            self.out.append("\n\n")

    def handle_data(self, data: str) -> None:
        if self.in_title:
            self.title += data
        elif not self.skip:
            self.out.append(re.sub(r"\s+", " ", data))

    def text(self) -> str:
        lines = [s.strip() for s in "".join(self.out).split("\n")]
        return re.sub(r"\n{3,}", "\n\n", "\n".join(lines)).strip()


def extracted(pages: DataFrame, key: str, html: str) -> DataFrame:
    """(key, title, markdown, n_headings, n_lists, n_paragraphs) of each page; an unreadable or null page is empty."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for k, h in zip(batch[key], batch[html], strict=True):
                p = _Markdown()
                p.feed(h or "")
                p.close()
                rows.append((k, p.title.strip(), p.text(), p.counts["h"], p.counts["li"], p.counts["p"]))
            yield pd.DataFrame(rows, columns=[key, "title", "markdown", "n_headings", "n_lists", "n_paragraphs"])

    return pages.select(key, html).mapInPandas(run, f"{key} {pages.schema[key].dataType.simpleString()}, title string, markdown string, n_headings int, n_lists int, n_paragraphs int")
