"""Resampling of documents by their importance for a target distribution, by hashed features of words and word runs.

Texts stay UTF-8 bytes. One table of 256 bytes lower-cases A-Z and blanks every other ASCII character but digits and
letters, so that translate() and split() yield the words. The checksum of a run of words is that of the run before its last
word, carried on over a space and the word, so no run is ever put together.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import repeat
from operator import mod

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .store import written

_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
_ROW_BITS = 33  # of monotonically_increasing_id; the bits above number the partition


def word_blocks(text: bytes, size: int = 1 << 20) -> Iterator[list[bytes]]:
    """The words of a text, in blocks of about size bytes, so that a very long text is never a list of all its words."""
    blank = text.translate(_TABLE)
    start = 0
    while start < len(blank):
        end = blank.find(b" ", start + size)
        end = len(blank) if end < 0 else end
        yield blank[start:end].split()
        start = end


def features(text: bytes, most_words: int, buckets: int, size: int = 1 << 20) -> Iterator[tuple[int, list[int]]]:
    """(new words, buckets of the runs of 1 to most_words words that end in them) of each block of a text."""
    carried: list[bytes] = []
    for fresh in word_blocks(text, size):
        words = carried + fresh
        crcs = list(map(zlib.crc32, words))
        found = crcs[len(carried) :]
        for k in range(2, most_words + 1):
            # crcs[i] stands for the run of k - 1 words from word i; one word more carries it on.
            crcs = list(map(zlib.crc32, map(b" ".__add__, words[k - 1 :]), crcs))
            found += crcs[max(0, len(carried) - k + 1) :]
        yield len(fresh), list(map(mod, found, repeat(buckets)))
        carried = words[-(most_words - 1) :] if most_words > 1 else []


def feature_counts(texts: DataFrame, most_words: int, buckets: int) -> DataFrame:
    """(bucket, n) over all of texts (text): each task counts its own texts and sends a row for each bucket at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            for text in batch["text"]:
                for _, found in features(text.as_py() or b"", most_words, buckets):
                    counts.update(found)
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.int64()), pa.array(list(counts.values()), pa.int64())], ["bucket", "n"])

    return _bytes(texts).mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(raw: dict[int, int], target: dict[int, int], buckets: int) -> list[int]:
    """For each bucket, floor(1000 ln) of its smoothed share in the target over that in the raw texts."""
    n, m = sum(raw.values()), sum(target.values())
    return [math.floor(1000 * math.log((target.get(b, 0) + 1) * (n + buckets) / ((raw.get(b, 0) + 1) * (m + buckets)))) for b in range(buckets)]


def _bytes(df: DataFrame) -> DataFrame:
    return df.withColumn("text", F.col("text").cast("string").cast("binary"))


def _noise(doc_id: int | None, seed: int) -> int:
    """A Gumbel variate of seed and doc_id in thousandths: the highest sums of log weight and noise are a weighted draw without replacement."""
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def scored(docs: DataFrame, gain: list[int], most_words: int, seed: int) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score) of each row of docs. gain has a number for each bucket, and goes to every task."""
    names, buckets = ["doc_id", "n_words", "n_features", "weight", "score"], len(gain)
    table = docs.sparkSession.sparkContext.broadcast(gain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain_of = table.value.__getitem__
        for batch in batches:
            rows = []
            for key, text in zip(batch["doc_id"].to_pylist(), batch["text"], strict=True):
                n_words = n_features = total = 0
                for words, found in features(text.as_py() or b"", most_words, buckets):
                    n_words, n_features, total = n_words + words, n_features + len(found), total + sum(map(gain_of, found))
                weight = total // n_features if n_features else 0
                rows.append((key, n_words, n_features, weight, weight + _noise(key, seed)))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(5)], names)

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return _bytes(docs).mapInArrow(run, ", ".join(f"{n} long" for n in names))


def importance_resample(docs: DataFrame, target: DataFrame, percent: int = 25, least_words: int = 20, most_words: int = 2, buckets: int = 10_000, seed: int = 7) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score, rank) of each row of docs (doc_id, text); target has (text).

    weight is the floored mean of the gains of a document's features, 0 without features. score adds noise to it by seed and
    doc_id. Of the N rows of at least least_words words, the floor(percent * N / 100) highest scores are drawn: rank is 1, 2, 3...
    for them, and null for all others. Ties go to the smaller doc_id, null doc_ids last.

    Texts are read twice, for the counts and for the scores; buckets numbers are all that passes the driver. Ranks come from
    one range partitioning of narrow rows: a row's place in its partition, after the rows of earlier partitions.
    Rows alike in score and doc_id are ranked in any order, and their number keeps them from making one partition large.
    Null texts are empty; an empty target leaves weights by the documents alone; no rows give no rows; other columns are not read.
    """
    raw, wanted = ({r["bucket"]: r["n"] for r in feature_counts(t.select("text"), most_words, buckets).collect()} for t in (docs, target))
    rows = scored(docs, gains(raw, wanted, buckets), most_words, seed)
    rows = written(rows.withColumn("_long", F.col("n_words") >= least_words).withColumn("_row", F.monotonically_increasing_id()), "importance-scores")

    order = [F.desc("_long"), F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("_row")]
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_row", F.monotonically_increasing_id())
    placed = written(placed.withColumn("_part", F.shiftright("_row", _ROW_BITS)), "importance-order")
    counts = placed.groupBy("_part").agg(F.count(F.when(F.col("_long"), 1)).alias("_n"))  # a row for each partition
    earlier, everything = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    counts = counts.select("_part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"), F.floor(F.sum("_n").over(everything) * percent / 100).alias("_drawn"))
    rank = F.col("_before") + F.col("_row").bitwiseAND((1 << _ROW_BITS) - 1) + 1
    drawn = placed.join(F.broadcast(counts), "_part").withColumn("rank", F.when(F.col("_long") & (rank <= F.col("_drawn")), rank))
    return drawn.select("doc_id", "n_words", "n_features", "weight", "score", "rank")
