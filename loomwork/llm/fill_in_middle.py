"""Fill-in-the-middle documents, cut at line boundaries that an indexable skip list finds."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"


def line_widths(text: str) -> list[int]:
    """Code points of each line, its newline included; the last one may lack it. An empty text has no lines."""
    widths = [len(line) + 1 for line in text.split("\n")]
    widths[-1] -= 1
    return widths if widths[-1] else widths[:-1]


class SkipList:
    """Units in order, each of a width in code points, under express lanes.

    A lane is a list of towers; the link that leaves a tower carries how many units it passes (its unit width) and how many
    code points these have together. Lane 0 has a tower for each unit. About one tower in four, chosen by a hash of its number,
    also stands in the lane above, the first always, up to a lane of few towers. So a rank is found in steps in proportion to the
    logarithm of the number of units, and all lanes together take a third more room than the units.
    """

    def __init__(self, widths: list[int], least: int = 8):
        chars, units, towers = np.asarray(widths, np.int64), np.ones(len(widths), np.int64), np.arange(len(widths), dtype=np.uint64)
        self.lanes = [([1] * len(widths), widths, towers)]  # the last of the three: where each tower stands in the lane below
        while len(units) > least:
            height = len(self.lanes)
            # Two bits of a multiplicative hash of the tower's number decide, other ones for each lane.
            up = (towers * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - 2 * height)) & np.uint64(3) == 0
            up[0] = True
            below = np.flatnonzero(up)
            units, chars, towers = np.add.reduceat(units, below), np.add.reduceat(chars, below), towers[below]
            self.lanes.append((units.tolist(), chars.tolist(), below.tolist()))

    def offset(self, rank: int) -> int:
        """Code points before the unit of that rank: from the top lane, follow links while their unit widths fit in the rank, then go down."""
        left, passed, at = rank, 0, 0
        for units, chars, below in reversed(self.lanes):
            while left and at < len(units) and units[at] <= left:
                left -= units[at]
                passed += chars[at]
                at += 1
            if not left:
                return passed
            at = below[at]
        raise IndexError(rank)


def _draws(doc_id: int | None, seed: int) -> tuple[int, int, int, int]:
    """The first four 8-digit groups of the hexadecimal sha256 of seed:doc_id."""
    digits = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return tuple(int(digits[i : i + 8], 16) for i in range(0, 32, 8))


def transform(text: str, draws: tuple[int, int, int, int], rate: int, spm_rate: int) -> tuple[int, str, int | None, int | None, str]:
    """(n lines, form, prefix_chars, middle_chars, output) of a text."""
    widths = line_widths(text)
    n = len(widths)
    if not text or PREFIX in text or SUFFIX in text or MIDDLE in text or draws[2] % 100 >= rate:
        return n, "plain", None, None, text
    cuts = sorted((draws[0] % (n + 1), draws[1] % (n + 1)))
    lines = SkipList(widths)
    first, last = (lines.offset(rank) for rank in cuts)
    prefix, middle, suffix = text[:first], text[first:last], text[last:]
    if draws[3] % 100 < spm_rate:
        return n, "spm", first, last - first, f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
    return n, "psm", first, last - first, f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"


def fill_in_middle(docs: DataFrame, seed: int = 7, rate: int = 100, spm_rate: int = 50, batch_chars: int = 4 << 20) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output) of each row of docs (doc_id, text).

    n counts lines. The two cuts, the share of texts that are transformed (rate per cent) and the order (spm in spm_rate per
    cent of these, else psm) follow from a hash of seed and doc_id. Each row is transformed by itself, in one scan.

    A text stays plain, with null prefix_chars and middle_chars, if it is empty (null too) or holds a sentinel, as its output
    could not be told apart. A null doc_id is hashed as an empty string. Repeated rows are rows like others; no rows give no
    rows; other columns are not read, whatever their names.
    """
    names = ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, chars = [], 0
            for key, text in zip(batch["doc_id"].to_pylist(), batch["text"], strict=True):
                row = (key, *transform(text.as_py() or "", _draws(key, seed), rate, spm_rate))
                rows.append(row)
                chars += len(row[-1])
                if chars >= batch_chars:
                    yield out(rows)
                    rows, chars = [], 0
            yield out(rows)

    def out(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names)

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(run, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(output: Column, form: Column) -> Column:
    """The original text, from output and form alone: sentinels stand once each, as texts that hold one stay plain."""
    def between(after: str, before: str | None) -> Column:
        rest = F.substring_index(output, after, -1)
        return F.substring_index(rest, before, 1) if before else rest

    psm = F.concat(between(PREFIX, SUFFIX), between(MIDDLE, None), between(SUFFIX, MIDDLE))
    spm = F.concat(between(PREFIX, MIDDLE), between(MIDDLE, None), between(SUFFIX, PREFIX))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)
