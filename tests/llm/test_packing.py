"""Packing: the tree of teams against best fit over all pieces at once."""

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomwork.llm import packing

PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"


def brute_best_fit(lengths, size):
    """The fills of bins: longest first, each into the fullest bin that holds it."""
    rooms = []
    for n in sorted(lengths, reverse=True):
        fits = [i for i, r in enumerate(rooms) if r >= n]
        if fits:
            i = min(fits, key=rooms.__getitem__)
            rooms[i] -= n
        else:
            rooms.append(size - n)
    return [size - r for r in rooms]


def check(rows, lengths, size):
    """Every piece once, sequences gapless and not too long; gives their number."""
    assert Counter((r["doc_id"], r["length"]) for r in rows) == Counter(enumerate(lengths))
    sequences = {}
    for r in rows:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in sequences.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= size
    return len(sequences)


@pytest.mark.parametrize("seed", range(4))
def test_counts_pack_like_single_items(seed):
    rng = np.random.default_rng(seed)
    lengths = rng.integers(1, [30, 100, 60, 7][seed], 500).tolist()
    moves, runs = packing.best_fit_counts(Counter(lengths), 100)
    fills, items = Counter(), Counter()
    for length, first, n, into, place in moves:
        for i in range(n):
            assert fills[into + i] == place
            fills[into + i] += length
            items[length, first + i] += 1
    assert items == Counter((k, i) for k, n in Counter(lengths).items() for i in range(n))
    assert sorted(fills.values()) == sorted(brute_best_fit(lengths, 100)) == sorted(f for _, n, f in runs for _ in range(n))


def test_underfull_bins_give_back_small_items():
    lengths = [60] * 4 + [30] * 2 + [5] * 3 + [40]
    moves, runs = packing.give_back(*packing.best_fit_counts(Counter(lengths), 100), 100, 10)
    fills = Counter()
    for length, _, n, into, place in sorted(moves, key=lambda m: m[4]):
        for i in range(n):
            assert fills[into + i] == place
            fills[into + i] += length
    assert sorted(fills.values()) == sorted(f for _, n, f in runs for _ in range(n)) == [5, 60, 90, 100, 100]


@pytest.mark.parametrize("kind, tasks", [("mixed", 4), ("over half", 64), ("small and over half", 12), ("equal", 9), ("one", 1), ("full", 3)])
def test_tree_is_close_to_best_fit(spark, kind, tasks):
    rng = np.random.default_rng(1)
    n = 4000
    lengths = {"mixed": rng.integers(1, 1025, n), "over half": rng.integers(600, 607, n), "small and over half": np.where(rng.random(n) < 0.1, rng.integers(1, 5, n), 603), "equal": np.full(n, 341), "one": np.array([7]), "full": np.full(n, 1024)}[kind].tolist()
    pieces = spark.createDataFrame([(i, 0, 0, x, i) for i, x in enumerate(lengths)], PIECE).repartition(tasks)
    got = check(packing.pack(pieces).collect(), lengths, 1024)
    assert got <= 1.01 * len(brute_best_fit(lengths, 1024)) + 1


def test_no_task_gets_the_underfull_bins(spark):
    """Pieces of which no two fit together, and a few tiny ones: no task of the later rounds has over an eighth of them."""
    length = F.when(F.col("id") % 1000 == 0, 2).otherwise(600 + F.col("id") % 7)
    pieces = spark.range(0, 50_000, 1, 64).select(F.col("id").alias("doc_id"), F.lit(0).alias("piece"), F.lit(0).cast("long").alias("start"), length.alias("length"), F.lit(0).cast("long").alias("ids_crc32"))
    small = {"spark.sql.files.maxPartitionBytes": "64k", "spark.sql.files.openCostInBytes": "1k"}  # splits as small to this table as real ones to a real one
    before = {k: spark.conf.get(k) for k in small}
    try:
        for k, v in small.items():
            spark.conf.set(k, v)
        out = packing.pack(pieces)
        assert out.count() == 50_000 and out.select("sequence_id").distinct().count() <= 49_950 * 1.001
        assert max(r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect()) <= 50_000 / 8
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_clashing_columns_and_no_rows(spark):
    rows = [(1, 0, 0, 5, 1, 1, 2, 3), (1, 0, 0, 5, 1, 1, 2, 3), (None, 0, 0, 1024, 1, 1, 2, 3)]
    df = spark.createDataFrame(rows, PIECE + ", task long, fill long, members long")
    out = packing.pack(df).collect()
    assert sorted((r["doc_id"] or 0, r["offset"]) for r in out) == [(0, 0), (1, 0), (1, 5)]
    assert packing.pack(df.where("false")).count() == 0
    with pytest.raises(Exception, match="longer than a sequence"):
        packing.pack(spark.createDataFrame([(1, 0, 0, 1025, 1)], PIECE)).collect()
