"""Long blocks and tables cut into parts that fit: by paragraphs, sentences and words, and by rows under a repeated header."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PARAGRAPHS, SENTENCES = re.compile(r"\n\s*\n"), re.compile(r"(?<=[.!?。！？])\s+")
Span = tuple[int, int]


def _trimmed(text: str, start: int, end: int) -> Span:
    while start < end and text[start].isspace():
        start += 1
    while end > start and text[end - 1].isspace():
        end -= 1
    return start, end


def _between(gaps: re.Pattern, text: str, span: Span) -> Iterator[Span]:
    """What lies between the gaps of a span, without white space at its ends."""
    at = span[0]
    for gap in [*gaps.finditer(text, *span), None]:
        part = _trimmed(text, at, gap.start() if gap else span[1])
        if part[0] < part[1]:
            yield part
        at = gap.end() if gap else at


def _hard(text: str, span: Span, most: int) -> Iterator[Span]:
    """Cuts at the last space that keeps a part within most characters, or in mid-word where there is none."""
    start, end = span
    while end - start > most:
        space = text.rfind(" ", start + 1, start + most)
        cut = space if space > 0 else start + most
        yield _trimmed(text, start, cut)
        start = _trimmed(text, cut, end)[0]
    if start < end:
        yield start, end


def _packed(text: str, spans: Iterator[Span], most: int) -> Iterator[list[Span]]:
    """Spans in a row whose lengths, with a space between them, fit in most together; one that is too long is cut up by itself."""
    held: list[Span] = []
    size = -1
    for span in spans:
        n = span[1] - span[0]
        if held and size + 1 + n > most:
            yield held
            held, size = [], -1
        if n > most:
            yield from ([part] for part in _hard(text, span, most))
        else:
            held, size = [*held, span], size + 1 + n
    if held:
        yield held


def split_block(text: str, most: int) -> Iterator[list[Span]]:
    """Parts of a text of at most most characters, each as the spans it consists of, in order; all but white space is in one part.

    A text that fits is one part. Else each of its paragraphs is, and one that does not fit is cut into runs of sentences, and a
    sentence that does not fit at spaces.
    """
    whole = _trimmed(text, 0, len(text))
    if whole[0] == whole[1]:
        return
    if whole[1] - whole[0] <= most:
        yield [whole]
        return
    for paragraph in _between(PARAGRAPHS, text, whole):
        if paragraph[1] - paragraph[0] <= most:
            yield [paragraph]
        else:
            yield from _packed(text, _between(SENTENCES, text, paragraph), most)


def split_rows(table: str, most_tokens: int, tokens: Callable[[str], int]) -> Iterator[tuple[int, int, str]]:
    """(first row, rows, text) of parts of a table: two lines of header, then as many rows as fit in most_tokens with the header, one at least.

    Blank lines are no rows. A table without rows is one part, as it is.
    """
    lines = [line for line in table.splitlines() if line.strip()]
    head, rows = lines[:2], lines[2:]
    if not rows:
        yield 0, 0, table
        return
    room = most_tokens - tokens("\n".join(head))
    sizes = [tokens(row) for row in rows]
    first, used = 0, sizes[0]
    for i in range(1, len(rows) + 1):
        if i == len(rows) or used + sizes[i] > room:
            yield first, i - first, "\n".join([*head, *rows[first:i]])
            first, used = i, 0
        used += sizes[i] if i < len(rows) else 0


def _exploded(df: DataFrame, key: str, text: str, schema: str, types: list[pa.DataType], parts: Callable[[str], Iterator[tuple]]) -> DataFrame:
    """(key, *schema) of parts of each text, in one scan."""
    names = [key, *(c.split()[0] for c in schema.split(", "))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kind, rows = batch.schema.field(key).type, []
            for k, t in zip(batch[key].to_pylist(), batch[text], strict=True):
                rows += ((k, *part) for part in parts(t.as_py() or ""))
                if len(rows) > 2000:
                    yield out(rows, kind)
                    rows = []
            yield out(rows, kind)

    def out(rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate([kind, *types])], names)

    return df.select(key, F.col(text).cast("string").alias(text)).mapInArrow(run, f"{key} {df.schema[key].dataType.simpleString()}, {schema}")


def split_blocks(df: DataFrame, key: str, text: str, most_chars: int = 48_000) -> DataFrame:
    """(key, part, start, end, body) of the parts of each text (split_block). start and end are offsets in the text, from 0;
    body has the part's sentences with one space between them. Null and blank texts have no parts; key and text are read alone."""

    def parts(value: str) -> Iterator[tuple]:
        for n, spans in enumerate(split_block(value, most_chars)):
            yield n, spans[0][0], spans[-1][1], " ".join(value[a:b] for a, b in spans)

    return _exploded(df, key, text, "part int, start int, end int, body string", [pa.int32(), pa.int32(), pa.int32(), pa.string()], parts)


def split_tables(df: DataFrame, key: str, text: str, most_tokens: int = 3500, tokens: Callable[[str], int] = lambda s: len(s.split())) -> DataFrame:
    """(key, part, first_row, n_rows, body) of the parts of each table (split_rows); every row is in one part. Null texts are tables of nothing."""

    def parts(value: str) -> Iterator[tuple]:
        for n, (first, rows, body) in enumerate(split_rows(value, most_tokens, tokens)):
            yield n, first, rows, body

    return _exploded(df, key, text, "part int, first_row int, n_rows int, body string", [pa.int32(), pa.int32(), pa.int32(), pa.string()], parts)
