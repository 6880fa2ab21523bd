"""Chunks of documents for retrieval. Sequential within a text, so small Python steps in tasks; texts are never gathered."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_SCHEMA = "chunk int, kind string, start int, end int, header string, n_tokens int, text string"
_TYPES = [pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.int32(), pa.string()]


def windows(words: list[str], sizes: list[int], most_tokens: int, most_chars: int, overlap: int) -> Iterator[tuple[int, int]]:
    """(start, end) of runs of words within both caps; each next one repeats up to overlap tokens, a quarter at most."""
    start = 0
    while start < len(words):
        end, tokens, chars = start, 0, -1
        while end < len(words) and (end == start or (tokens + sizes[end] <= most_tokens and chars + 1 + len(words[end]) <= most_chars)):
            tokens, chars, end = tokens + sizes[end], chars + 1 + len(words[end]), end + 1
        yield start, end
        if end >= len(words):
            return
        back, again = end, 0
        while back > start + 1 and again + sizes[back - 1] <= min(overlap, tokens // 4):
            back, again = back - 1, again + sizes[back - 1]
        start = back if most_chars > sum(map(len, words[back : end + 1])) + end - back else end


def blocks(text: str) -> Iterator[tuple[str, str, str]]:
    """(kind, header, text) of a markdown text: tables, and the text under each path of headings."""
    path: list[tuple[int, str]] = []
    lines: list[str] = []
    table: list[str] = []

    def flush() -> Iterator[tuple[str, str, str]]:
        header = " > ".join(t for _, t in path)
        if len(table) >= 2:
            yield "table", header, "\n".join(table)
        else:
            lines.extend(table)
        table.clear()
        body = "\n".join(lines).strip()
        if body:
            yield "text", header, body
        lines.clear()

    for line in text.split("\n"):
        heading = re.match(r"(#{1,6})[ \t]+(\S.*)$", line.strip())
        if heading:
            yield from flush()
            while path and path[-1][0] >= len(heading[1]):
                path.pop()
            path.append((len(heading[1]), heading[2].strip()))
        elif line.count("|") >= 2:
            if not table and lines:
                yield from flush()
            table.append(line)
        else:
            if table:
                yield from flush()
            lines.append(line)
    yield from flush()


def within(words: list[str], tokens: Callable[[str], int], most_tokens: int, most_chars: int) -> Iterator[str]:
    """words, those over a cap cut into the longest parts that are within both."""
    for word in words:
        while len(word) > most_chars or tokens(word) > most_tokens:
            # The longest fitting start, as tokens grow with length; one character at least.
            low, high = 1, min(len(word) - 1, most_chars)
            while low < high:
                half = (low + high + 1) // 2
                low, high = (half, high) if tokens(word[:half]) <= most_tokens else (low, half - 1)
            if len(word) == 1:
                break
            yield word[:low]
            word = word[low:]
        yield word


def chunks_of(text: str, tokens: Callable[[str], int], most_tokens: int, most_chars: int, overlap: int, structured: bool) -> Iterator[tuple]:
    n = 0
    for kind, header, body in blocks(text) if structured else [("text", "", text)]:
        words = list(within(body.split(), tokens, most_tokens, most_chars))
        sizes = [tokens(w) for w in words]
        if structured and kind == "text" and len(words) > 24:
            yield n, "section_summary" if header else "summary", 0, min(120, len(words)), header, sum(sizes[:120]), " ".join(words[:120])
            n += 1
        for start, end in windows(words, sizes, most_tokens, most_chars, overlap):
            yield n, kind, start, end, header, sum(sizes[start:end]), " ".join(words[start:end])
            n += 1


def _chunk(df: DataFrame, key: str, text: str, tokens: Callable[[str], int], structured: bool, most_tokens: int, most_chars: int, overlap: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, rows = [], []
            for k, t in zip(batch[key], batch[text], strict=True):
                for row in chunks_of(t.as_py() or "", tokens, most_tokens, most_chars, overlap, structured):
                    keys.append(k.as_py())
                    rows.append(row)
                if len(rows) > 2000:
                    yield _batch(batch.schema.field(key), keys, rows)
                    keys, rows = [], []
            yield _batch(batch.schema.field(key), keys, rows)

    return df.select(key, F.col(text).alias(text)).mapInArrow(run, f"{key} {df.schema[key].dataType.simpleString()}, {_SCHEMA}")


def _batch(field: pa.Field, keys: list, rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[]] * len(_TYPES)
    return pa.RecordBatch.from_arrays([pa.array(keys, field.type), *(pa.array(c, t) for c, t in zip(columns, _TYPES, strict=True))], [field.name, "chunk", "kind", "start", "end", "header", "n_tokens", "text"])


def one_token(word: str) -> int:
    return 1


def window_chunks(df: DataFrame, key: str, text: str, tokens: Callable[[str], int] = one_token, most_tokens: int = 3500, most_chars: int = 12_000, overlap: int = 400) -> DataFrame:
    """(key, chunk, kind, start, end, header, n_tokens, text): windows over a whole text; start and end count words. tokens: of a word.
    A word over a cap counts as several: the longest parts that fit."""
    return _chunk(df, key, text, tokens, False, most_tokens, most_chars, overlap)


def structured_chunks(df: DataFrame, key: str, text: str, tokens: Callable[[str], int] = one_token, most_tokens: int = 3500, most_chars: int = 12_000, overlap: int = 400) -> DataFrame:
    """As window_chunks, for each table and each text under a path of headings; longer texts have a summary chunk of 120 words too."""
    return _chunk(df, key, text, tokens, True, most_tokens, most_chars, overlap)
