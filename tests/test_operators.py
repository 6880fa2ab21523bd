"""Operators that spread a group's work, against plain versions on groups of ties and single rows."""

import math

import numpy as np
from pyspark.sql import functions as F

from loomwork.operators import analytics as A
from loomwork.operators import retrieval as R


def test_nearest_rank_matches_sorting(spark):
    rng = np.random.default_rng(3)
    groups = {"ties": [5.0] * 400 + [1.0] * 3, "one": [7.0], "spread": rng.normal(0, 1e6, 700).tolist(), "few": [2.0, 1.0], "tail": [0.0] * 300 + [1e12]}
    rows = [(g, v) for g, vs in groups.items() for v in vs] + [("ties", None), ("one", float("nan"))]
    got = {r["g"]: (r["p1"], r["p50"], r["p95"], r["p100"]) for r in A.nearest_rank(spark.createDataFrame(rows, "g string, v double"), ["g"], "v", [1, 50, 95, 100], buckets=16).collect()}
    rank = lambda vs, p: sorted(vs)[max(1, math.ceil(len(vs) * (p / 100))) - 1]
    assert got == {g: tuple(rank(vs, p) for p in (1, 50, 95, 100)) for g, vs in groups.items()}
    assert A.nearest_rank(spark.createDataFrame([], "g string, v double"), ["g"], "v", [50]).count() == 0


def test_peak_concurrency_matches_counting(spark):
    rng = np.random.default_rng(4)
    rows = [(f"g{i % 2}", int(s), int(s + d)) for i, (s, d) in enumerate(zip(rng.integers(0, 300, 200), rng.integers(0, 120, 200), strict=True))]
    got = {r["g"]: r["peak"] for r in A.peak_concurrency(spark.createDataFrame(rows, "g string, s long, e long"), ["g"], "s", "e", slice_width=10).collect()}
    assert got == {g: max(sum(s <= t <= e for h, s, e in rows if h == g) for t in range(500)) for g in ("g0", "g1")}


def test_bm25_reads_texts_once_a_scan(spark):
    docs = spark.createDataFrame([(1, "a b a"), (2, "c"), (3, None), (4, "b c c c")], "id long, t string")
    out = R.bm25(docs, "id", "t", ["a", "c", "a"])
    assert {r["id"] for r in out.collect()} == {1, 2, 4}
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") == 2  # the scan for statistics, and the one for hits


def test_postings_count_terms_by_field(spark):
    docs = spark.createDataFrame([(1, "a b a", "b"), (2, None, "b b")], "id long, head string, body string")
    got = {(r["id"], r["field"], r["term"]): (r["tf"], r["length"]) for r in R.postings(docs, "id", ["head", "body"]).collect()}
    assert got == {(1, "head", "a"): (2, 3), (1, "head", "b"): (1, 3), (1, "body", "b"): (1, 1), (2, "body", "b"): (2, 2)}




def test_sessions_and_sliding_counts_match_counting(spark):
    """Groups of bursts and gaps just at the limit, ties and a null group."""
    rng = np.random.default_rng(9)
    rows = [(g, int(t)) for g in ("a", "b", None) for t in np.cumsum(rng.choice([0, 1, 4999, 5000, 5001, 12_000], 150))] + [("one", 7)]
    df = spark.createDataFrame([(g, t, "x") for g, t in rows], "g string, t long, k string").select("g", F.timestamp_millis("t").alias("ts"), "k")
    got = sorted(((r["g"], r["s"], r["e"], r["n_events"]) for r in A.sessions(df, ["g"], "ts", 5).select("g", F.unix_millis("session_start").alias("s"), F.unix_millis("session_end").alias("e"), "n_events").collect()), key=repr)
    want = []
    for g in ("a", "b", None, "one"):
        runs = []
        for t in sorted(t for h, t in rows if h == g):
            if runs and t - runs[-1][-1] < 5000:
                runs[-1].append(t)
            else:
                runs.append([t])
        want += [(g, r[0], r[-1], len(r)) for r in runs]
    assert got == sorted(want, key=repr)
    counted = sorted(((r["g"], r["t"], r["n_recent"]) for r in A.sliding_count(df, ["g"], "ts", 5).select("g", F.unix_millis("ts").alias("t"), "n_recent").collect()), key=repr)
    assert counted == sorted(((g, t, sum(h == g and t - 5000 < u <= t for h, u in rows)) for g, t in rows), key=repr)


def test_medians_and_ranking_metrics(spark):
    rng = np.random.default_rng(10)
    groups = {"even": rng.integers(0, 9, 40).astype(float), "odd": rng.normal(0, 5, 41), "one": np.array([3.0])}
    df = spark.createDataFrame([(g, float(v)) for g, vs in groups.items() for v in vs], "g string, v double")
    assert {r["g"]: round(r["median"], 9) for r in A.median(df, ["g"], "v").collect()} == {g: round(float(np.median(v)), 9) for g, v in groups.items()}
    hits = [("a", 1, 0), ("a", 2, 1), ("a", 3, 3), ("b", 1, 0), ("b", 2, 0), ("c", 5, 2)]
    got = {r["g"]: (r["mrr"], r["precision"], round(r["ndcg"], 9)) for r in R.ranking_metrics(spark.createDataFrame(hits, "g string, d int, rel int"), "g", [F.col("d")], "rel", 2).collect()}
    ndcg = (1 / math.log2(3)) / (7 + 1 / math.log2(3))
    assert got == {"a": (0.5, 0.5, round(ndcg, 9)), "b": (0.0, 0.0, 0.0), "c": (1.0, 0.5, 1.0)}
