"""Best-fit packing of tokenised documents into sequences of a fixed length."""

from __future__ import annotations

import re
import zlib
from array import array
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import written

_LATIN = "A-Za-zªµºÀ-ÖØ-öø-ɏ"


def _bytes_of_symbols() -> dict[str, int]:
    """The bytes that byte-level BPE writes as other characters: printable ones stand for themselves, the rest follow from 256."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class TextIds:
    """Token ids of texts, as little-endian 32-bit bytes.

    A byte-level BPE token's id is its merge rank, so tiktoken gives the same ids as the tokenizer, several times
    faster. Texts with special tokens, or with characters outside the Latin blocks (where the two libraries' classes
    of letters and spaces may differ), go through the tokenizer.
    """

    PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

    def __init__(self, tokenizer: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer)
        special = self.tokenizer.get_added_tokens_decoder()
        self.special = [t.content for t in special.values()]
        byte = _bytes_of_symbols()
        ranks = {bytes(byte[c] for c in token): i for token, i in self.tokenizer.get_vocab().items() if i not in special}
        self.encode = tiktoken.Encoding("own", pat_str=self.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.odd = re.compile(f"[^\\t\\n\\r\\x20-\\x7e{_LATIN}]").search

    def of(self, text: str) -> bytes:
        if self.odd(text) or any(s in text for s in self.special):
            return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
        return array("I", self.encode(text)).tobytes()


_PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"


def _cut(tokenizer: str, size: int, end: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of, tail = TextIds(tokenizer), end.to_bytes(4, "little")
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for doc, text in zip(batch["doc_id"], batch["text"], strict=True):
                ids = ids_of.of(text.as_py() or "") + tail
                total = len(ids) // 4
                at, piece, doc = 0, 0, doc.as_py()
                while at < total:
                    n = total - at if total <= size else (total - at) % size or size
                    for x, v in zip(out, (doc, piece, at, n, zlib.crc32(ids[4 * at : 4 * (at + n)])), strict=True):
                        x.append(v)
                    at, piece = at + n, piece + 1
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return cut


def cut_documents(docs: DataFrame, tokenizer: str, size: int = 1024, end: int = 2) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of each piece of docs (doc_id, text).

    A document is the ids of its whole text and the id end. One of over size ids is cut into pieces of size ids;
    the first piece takes what is left over. A null or empty text is one piece of one id. Repeated rows are
    documents of their own; null doc_ids stay. Columns besides doc_id and text are not read.
    """
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return base.mapInArrow(_cut(tokenizer, size, end), _PIECE)


def best_fit_counts(counts: dict[int, int], size: int) -> tuple[list[tuple[int, int, int, int, int]], list[tuple[int, int, int]]]:
    """Best fit, longest first, of counts[length] items of each length, without a row for each item.

    Gives moves (length, first item, n, first bin, place): n items of a length, from the given one on, go one each into
    so many bins, from the given one on, all filled up to place before; and runs of bins (first bin, n, fill). Items of a
    length and bins are numbered from 0. Work and output follow the number of lengths, not of items.
    """
    moves, n_bins = [], 0
    by_room: list[list[tuple[int, int]]] = [[] for _ in range(size + 1)]  # by room: runs (first bin, n)
    rooms = 0  # bit r: a bin with room r is open
    for length in sorted((k for k, n in counts.items() if n), reverse=True):
        item, left = 0, counts[length]
        while left:
            fits = rooms >> length
            if fits:
                room = length + (fits & -fits).bit_length() - 1
                first, n = by_room[room].pop()
                if n > left:
                    by_room[room].append((first + left, n - left))
                    n = left
                if not by_room[room]:
                    rooms ^= 1 << room
                filled = [(first, n, 1)]
            else:  # new bins of this length alone: as many items in each as fit, and one bin for the rest
                room, each = size, size // length
                filled = [(n_bins, left // each, each), (n_bins + left // each, min(1, left % each), left % each)]
                n_bins += -(-left // each)
            for first, n, times in filled:
                if not n:
                    continue
                for k in range(times):
                    moves.append((length, item, n, first, size - room + k * length))
                    item, left = item + n, left - n
                rest = room - times * length
                by_room[rest].append((first, n))
                if rest:
                    rooms |= 1 << rest
    return moves, [(first, n, size - room) for room, runs in enumerate(by_room) for first, n in runs]


def give_back(moves: list[tuple], runs: list[tuple], full: int, small: int) -> tuple[list[tuple], list[tuple]]:
    """moves and runs of best_fit_counts, but bins under full give back the items of at most small that they were filled
    with: these are bins of their own again. They came last, so what stays in a bin has no gaps."""
    runs = sorted(runs)
    starts, n_bins = [r[0] for r in runs], runs[-1][0] + runs[-1][1] if runs else 0
    fills, kept, singles = [r[2] for r in runs], [], []
    for length, item, n, first, place in moves:
        if length > small or not place:
            kept.append((length, item, n, first, place))
            continue
        i = bisect_right(starts, first) - 1
        while n:
            k = min(n, runs[i][0] + runs[i][1] - first)
            if runs[i][2] >= full:
                kept.append((length, item, k, first, place))
            else:
                kept.append((length, item, k, n_bins, 0))
                singles.append((n_bins, k, length))
                n_bins += k
                fills[i] -= length
            item, n, first, i = item + k, n - k, first + k, i + 1
    return kept, [(r[0], r[1], fill) for r, fill in zip(runs, fills, strict=True)] + singles


def _pack(size: int, slack: int):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A task's pieces with their bins: fill, and, if underfull, the bin's number among the task's ones of that fill."""
        task = TaskContext.get().partitionId()
        own = [b for b in batches if len(b)]
        if not own:
            return
        table = pa.Table.from_batches(own)
        length = table["length"].to_numpy()
        order = np.argsort(-length, kind="stable")
        ranked = length[order]
        edges = np.concatenate(([0], np.flatnonzero(np.diff(ranked)) + 1, [len(ranked)]))
        moves, runs = best_fit_counts({int(ranked[i]): int(j - i) for i, j in zip(edges[:-1], edges[1:], strict=True)}, size)
        moves, runs = give_back(moves, runs, size - slack, size // 2)
        start = {int(ranked[i]): int(i) for i in edges[:-1]}
        bins, places = np.empty(len(ranked), np.int64), np.empty(len(ranked), np.int64)
        for own, item, n, first, place in moves:
            at = order[start[own] + item : start[own] + item + n]
            bins[at], places[at] = np.arange(first, first + n), place
        n_bins = max(first + n for first, n, _ in runs)
        fill, number, seen = np.empty(n_bins, np.int64), np.empty(n_bins, np.int64), {}
        for first, n, full in runs:
            fill[first : first + n] = full
            number[first : first + n] = np.arange(seen.get(full, 0), seen.get(full, 0) + n)
            seen[full] = seen.get(full, 0) + n
        own = [pa.array(np.full(len(bins), task)), pa.array(bins), pa.array(fill[bins]), pa.array(number[bins]), pa.array(places)]
        out = pa.table([*table.columns, *own], [*table.schema.names, "task", "bin", "fill", "number", "offset"])
        yield from out.combine_chunks().to_batches(max_chunksize=50_000)

    return pack


_PLAN = "team long, unit long, fill long, first long, n long, bin long, place long, sealed boolean, new_fill long, new_number long"


def _merge(size: int, slack: int, last: bool):
    def merge(key: tuple, units: pd.DataFrame) -> pd.DataFrame:
        """Best fit of a team's underfull bins, from their numbers by unit and fill alone.

        A row says where n bins of a unit and fill, from number first on, go: into n bins of the team from bin on, at
        place. Those are sealed (in the last round all are), or are new_fill full and have numbers from new_number on.
        """
        units = units.sort_values(["fill", "unit"]).reset_index(drop=True)
        counts = units.groupby("fill")["n"].sum()
        moves, runs = best_fit_counts({int(k): int(n) for k, n in counts.items()}, size)
        if not last:
            moves, runs = give_back(moves, runs, size - slack, size // 2)
        # Items of a fill are numbered over the team's units in turn.
        units["at"] = units.groupby("fill")["n"].cumsum() - units["n"]
        numbered, seen = [], {}
        for first, n, fill in sorted(runs):
            numbered.append((first, n, fill, seen.get(fill, 0)))
            seen[fill] = seen.get(fill, 0) + n
        starts = np.array([r[0] for r in numbered])
        by_fill = {int(k): g for k, g in units.groupby("fill")}
        rows = []
        for own, item, n, first, place in moves:
            for u in by_fill[own].itertuples():
                lo, hi = max(item, u.at), min(item + n, u.at + u.n)
                at = lo
                while at < hi:  # cut where the bins' runs end
                    b = first + at - item
                    run = numbered[int(np.searchsorted(starts, b, "right")) - 1]
                    k = min(hi - at, run[0] + run[1] - b)
                    full = last or run[2] >= size - slack
                    rows.append((key[0], u.unit, own, at - u.at, k, b, place, full, run[2], run[3] + b - run[0]))
                    at += k
        return pd.DataFrame(rows, columns=[c.split()[0] for c in _PLAN.split(", ")])

    return merge


def pack(pieces: DataFrame, size: int = 1024, slack: int = 4, fan_in: int = 8) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset): pieces placed in sequences of at most size ids.

    Hierarchical residual packing: each task packs its own pieces best-fit, longest first. Bins with at most slack
    ids of room are final. The others become items: fan_in tasks make a team, whose bins are packed best-fit again, and
    so on over a tree of teams until one has seen all underfull bins; the bins of that last round are all final. An
    underfull bin gives back the items of at most half a sequence that it was filled with: as bins of their own they can
    make others nearly full further up.

    Which bins merge follows from how many a unit (a task, or a team of the round before) has of each fill: at most size
    numbers a unit. So a team sees fan_in * size numbers, never members; where a bin goes is told for runs of bins; and
    no piece moves: each finds its bin's place by a join with these runs, in one round after the other. Bins are kept
    as items to the end, so a sequence may have room that a cut through bins would use: under 1 % in the tests.

    offset is gapless from 0 in each sequence, sequence_id any number. Pieces with equal columns are placed one by one; no
    pieces give no rows; a length over size is refused by an error. Other columns are not read.
    """
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    one = F.when(F.col("length") > size, F.raise_error(F.lit("a piece is longer than a sequence"))).otherwise(F.col("length"))
    items = pieces.select(*(one.cast("long").alias(c) if c == "length" else c for c in columns))
    tasks = items.rdd.getNumPartitions()
    placed = written(items.mapInArrow(_pack(size, slack), f"{_PIECE}, task long, bin long, fill long, number long, offset long"), "packing-bins")
    number = lambda team, b, level: F.lit(level << 58) + team * (1 << 34) + b
    done = F.col("fill") >= size - slack
    settled = placed.where(done).select(*columns, number(F.col("task"), F.col("bin"), 0).alias("sequence_id"), "offset")
    open_bins = placed.where(~done)
    units = open_bins.groupBy(F.col("task").alias("unit"), "fill").agg(F.count_distinct("number").alias("n"))
    waiting = open_bins.withColumnRenamed("task", "unit").drop("bin")
    level, parts = 0, [settled]
    while True:
        level, n_units, tasks = level + 1, tasks, -(-tasks // fan_in)
        last = tasks <= 1
        teams = units.withColumn("team", F.floor(F.col("unit") / fan_in))
        plan = written(teams.groupBy("team").applyInPandas(_merge(size, slack, last), _PLAN), "packing-plan")
        runs = plan.select(F.col("unit").alias("of_unit"), F.col("fill").alias("of_fill"), "team", "first", "n", F.col("bin").alias("into"), "place", "sealed", "new_fill", "new_number")
        here = (F.col("unit") == F.col("of_unit")) & (F.col("fill") == F.col("of_fill")) & (F.col("number") >= F.col("first")) & (F.col("number") < F.col("first") + F.col("n"))
        # At most size rows a unit and what runs are cut into: small enough for all tasks where units are few.
        moved = waiting.join(F.broadcast(runs) if n_units <= 64 else runs, here)
        shift = F.col("number") - F.col("first")
        moved = moved.select(
            *columns, F.col("team").alias("unit"), F.col("new_fill").alias("fill"), (F.col("new_number") + shift).alias("number"),
            (F.col("offset") + F.col("place")).alias("offset"), (F.col("into") + shift).alias("bin"), "sealed",
        )
        if not last:
            moved = written(moved, "packing-moved")
        parts.append(moved.where("sealed").select(*columns, number(F.col("unit"), F.col("bin"), level).alias("sequence_id"), "offset"))
        if last:
            break
        waiting = moved.where("not sealed").drop("sealed", "bin")
        units = plan.where("not sealed").select(F.col("team").alias("unit"), F.col("new_fill").alias("fill"), "new_number", "n").distinct().groupBy("unit", "fill").agg(F.max(F.col("new_number") + F.col("n")).alias("n"))
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out


def best_fit_packing(docs: DataFrame, tokenizer: str, size: int = 1024, end: int = 2) -> DataFrame:
    """cut_documents, then pack."""
    return pack(written(cut_documents(docs, tokenizer, size, end), "packing-pieces"), size)
