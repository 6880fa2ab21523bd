"""Removal of passages that stood in the corpus before, by sliding spans of sentences."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import written
from .textbytes import fold, per_row, text_blocks, words

_STOP = np.zeros(256, bool)
_STOP[[33, 46, 63]] = True  # ! . ?


def sentences(offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sentences of a block of texts: their rows, first bytes, first words and words' ends, and the word hashes.

    A sentence ends with a word that ends in . ! or ?, or that a line feed follows, or that is its text's last. It reaches
    to the next one's first word; a text's first sentence starts with the text.
    """
    starts, ends, rows, hashes = words(offsets, data)
    if not len(starts):
        none = np.zeros(0, np.int64)
        return none, none, none, none, hashes
    feeds = np.concatenate(([0], np.cumsum(data == 10)))
    following = np.append(starts[1:], len(data))
    last = np.append(rows[1:] != rows[:-1], True)
    closes = _STOP[data[ends - 1]] | (feeds[following] > feeds[ends]) | last
    word_end = np.flatnonzero(closes) + 1
    word_start = np.concatenate(([0], word_end[:-1]))
    row = rows[word_start]
    first = starts[word_start]
    leads = np.append(True, row[1:] != row[:-1])
    first[leads] = offsets[row[leads]]
    return row, first, word_start, word_end, hashes


def spans(row: np.ndarray, word_start: np.ndarray, word_end: np.ndarray, hashes: np.ndarray, least: int, least_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first sentence, end, hash) of the shortest runs of at least least sentences and least_words words that start at
    each sentence, and of the shortest that end at it; none where the text ends or starts in between. Each run comes once."""
    n = len(row)
    i = np.arange(n)
    end = np.maximum(i + least, np.searchsorted(word_end, word_start + least_words) + 1)
    fits = end <= np.searchsorted(row, row, "right")
    start = np.minimum(i + 1 - least, np.searchsorted(word_start, word_end - least_words, "right") - 1)
    back = start >= np.searchsorted(row, row)
    # A run that is the shortest both from its start and to its end is left out here.
    back[back] = end[start[back]] != i[back] + 1
    first, last = np.concatenate((i[fits], start[back])), np.concatenate((end[fits], i[back] + 1))
    order = np.argsort(first, kind="stable")
    first, last = first[order], last[order]
    return first, last, fold(hashes, word_start[first], word_end[last - 1])


def _spans(least: int, least_words: int):
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each span of each text: its first place, and the others in more. A place is pos << 32 | n."""
        for batch in batches:
            for first, offsets, data in text_blocks(batch["text"], 1 << 20):
                row, _, word_start, word_end, hashes = sentences(offsets, data)
                if not len(row):
                    continue
                lead = per_row(row, len(offsets) - 1)
                i, end, h = spans(row, word_start, word_end, hashes, least, least_words)
                order = np.argsort(h, kind="stable")
                order = order[np.argsort(row[i[order]].astype(np.uint16), kind="stable")]
                i, end, h = i[order], end[order], h[order]
                new = np.ones(len(i), bool)
                new[1:] = (h[1:] != h[:-1]) | (row[i[1:]] != row[i[:-1]])
                heads = np.flatnonzero(new)
                place = (i - lead[row[i]]) << 32 | (end - i)
                others = np.diff(np.append(heads, len(i))) - 1
                more = pa.LargeListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(others)))), pa.array(place[~new])).cast(pa.list_(pa.int64()))
                at = pa.array(first + row[i[heads]])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(h[heads].view(np.int64)), batch["doc_id"].take(at), batch["text_key"].take(at), pa.array(place[heads]), pc.if_else(pa.array(others > 0), more, None)],
                    ["span", "doc_id", "text_key", "place", "more"],
                )

    return find


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts without the sentences of repeats (pos << 32 | n); a block at a time, so that memory stays small."""
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
    for batch in batches:
        names = [c for c in batch.schema.names if c not in ("text", "repeats")]
        for first, offsets, data in text_blocks(batch["text"], 1 << 20):
            out, n_sentences, n_removed, removed = [], [], [], []
            row, byte, _, _, _ = sentences(offsets, data)
            lead = per_row(row, len(offsets) - 1)
            for r in range(len(offsets) - 1):
                n = int(lead[r + 1] - lead[r])
                text = data[offsets[r] : offsets[r + 1]]
                drop = np.zeros(n, bool)
                for place in batch["repeats"][first + r].as_py() or []:
                    drop[place >> 32 : (place >> 32) + (place & 0xFFFFFFFF)] = True
                bounds = np.append(byte[lead[r] : lead[r + 1]] - offsets[r], len(text))
                pairs = np.flatnonzero(np.diff(np.concatenate(([0], drop.astype(np.int8), [0])))).reshape(-1, 2)
                if len(pairs):
                    keep = np.ones(len(text), bool)
                    for a, b in pairs:
                        keep[bounds[a] : bounds[b]] = False
                    text = text[keep]
                out.append(text.tobytes().decode())
                n_sentences.append(n)
                n_removed.append(int(drop.sum()))
                removed.append([{"start": int(a), "end": int(b)} for a, b in pairs])
            rest = [batch[c].slice(first, len(out)) for c in names]
            yield pa.RecordBatch.from_arrays([*rest, pa.array(out, pa.string()), pa.array(n_sentences, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(removed, kind)], [*names, "text", "n_sentences", "n_removed", "removed"])


def remove_repeats(docs: DataFrame, least: int = 2, least_words: int = 10) -> DataFrame:
    """docs (doc_id, text, ...) with the sentences gone that a repeated span covers, plus n_sentences, n_removed and
    removed (start, end): the runs of removed sentences, counted from 0.

    A span is any run of at least least sentences and least_words words. Spans are equal if their words are (A-Z
    lower-cased, whatever white space is between); they are compared by 64-bit hashes over the whole corpus. The first
    place of a span, by doc_id, text and position, stays; the sentences of all other places go, in the same text too.
    What is left of a text is unchanged, white space goes with the sentence before it. A sentence that repeats alone stays.

    Two spans for each sentence stand for all: the shortest that starts at it, and the shortest that ends at it. For
    let a longer run be repeated, with its first place elsewhere. Each of its sentences from which a shortest span still
    ends inside the run is covered by that one, which is repeated as well and comes first where the run does. The others
    lie after the start of the shortest span that ends with the run, or a span from them would fit; so that one covers them.

    A null text becomes an empty one; empty and white texts stay as they are. Rows alike in doc_id and text are one text
    to this operator: they get the same result. Null doc_ids come first. Other columns are passed on (named
    n_sentences, n_removed or removed they are replaced). No rows give no rows.

    A span that a text holds many times is one row of that text, and repeated rows are one text before their places
    are gathered. First places are found by a pre-aggregated minimum for each span, so a passage that a third of all
    documents share is one row a task there; the join that follows can be split.
    """
    names = [c for c in docs.columns if c not in ("n_sentences", "n_removed", "removed")]
    others = [c for c in names if c not in ("doc_id", "text")]
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    # What else a row holds travels as one struct, so that no name can clash.
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("text_key"), F.struct(F.lit(0).alias("none"), *(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(others))).alias("rest"))
    found = written(
        base.select("doc_id", "text", "text_key").mapInArrow(_spans(least, least_words), "span long, doc_id long, text_key long, place long, more array<long>"),
        "substring-spans",
    )
    at = F.struct("doc_id", "text_key", "place")
    firsts = found.groupBy("span").agg(F.min(at).alias("first"), F.max(at).alias("last"), F.max(F.col("more").isNotNull()).alias("again"))
    # Written, so that the join has an exchange on either side and Spark can split the partition of a frequent span.
    firsts = written(firsts.where("again or first <> last").select("span", F.col("first.doc_id").alias("first_doc"), F.col("first.text_key").alias("first_key")), "substring-firsts")
    in_first = F.col("doc_id").eqNullSafe(F.col("first_doc")) & (F.col("text_key") == F.col("first_key"))
    later = found.join(firsts, "span").where(~in_first | F.col("more").isNotNull())
    places = F.when(in_first, F.col("more")).otherwise(F.concat(F.array("place"), F.coalesce("more", F.array().cast("array<bigint>"))))
    # A set of lists: repeated rows bring the same ones.
    repeats = later.select("doc_id", "text_key", places.alias("places")).groupBy("doc_id", "text_key").agg(F.array_distinct(F.flatten(F.collect_set("places"))).alias("repeats"))
    repeats = repeats.withColumnsRenamed({"doc_id": "of_doc", "text_key": "of_text"})
    joined = base.join(repeats, F.col("doc_id").eqNullSafe(F.col("of_doc")) & (F.col("text_key") == F.col("of_text")), "left").select("doc_id", "rest", "text", "repeats")
    cut = joined.mapInArrow(_cut, f"doc_id long, rest {joined.schema['rest'].dataType.simpleString()}, text string, n_sentences long, n_removed long, removed array<struct<start:int,end:int>>")
    return cut.select(*(F.col(c) if c in ("doc_id", "text") else F.col(f"rest.c{others.index(c)}").alias(c) for c in names), "n_sentences", "n_removed", "removed")
