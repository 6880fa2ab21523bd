"""The written index against scans, and what it does not read."""

import math
import re
from collections import Counter
from zlib import crc32

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomwork.functions import questions as Q
from loomwork.operators import retrieval as R
from loomwork.operators.search_index import SearchIndex, build_index, field
from loomwork.plans import search
from loomwork.sources import store

FIELDS = [field("title", "title"), field("slug", "slug"), field("body", "body")]


def tokens(row, f):
    text = (row[f.name] or "").lower()
    if f.analyzer == "words":
        return re.findall("[a-zа-яё0-9]+", text)
    return ["~" + text[i : i + n] for n in (3, 4, 5) for i in range(len(text) - n + 1)]


def brute(rows, fields, weights, k):
    """[(key, score)]: BM25F by counting."""
    counts = [[Counter(tokens(r, f)) for f in fields] for r in rows]
    means = [sum(c[i].total() for c in counts) / len(rows) for i in range(len(fields))]
    scores = {}
    for term, w in weights.items():
        df = sum(any(c[term] for c in own) for own in counts)
        for r, own in zip(rows, counts, strict=True):
            if any(c[term] for c in own):
                f = sum(p.weight * c[term] / (1 - p.b + p.b * c.total() / m) for p, c, m in zip(fields, own, means, strict=True) if m)
                scores[r["id"]] = scores.get(r["id"], 0) + w * math.log(1 + (len(rows) - df + 0.5) / (df + 0.5)) * 2.2 * f / (1.2 + f)
    return sorted(((i, round(s, 6)) for i, s in scores.items()), key=lambda p: (-p[1], p[0]))[:k]


@pytest.fixture(scope="module")
def corpus():
    rng = np.random.default_rng(8)
    words = [f"w{i}" for i in range(60)] + ["дом", "ёж", "the"]
    p = 1 / np.arange(1, len(words) + 1)
    text = lambda n: " ".join(rng.choice(words, n, p=p / p.sum()))
    rows = [{"id": int(i) * 7919 - 10**6, "title": text(rng.integers(0, 5)), "slug": f"page-{i}.example", "body": text(rng.integers(0, 80))} for i in range(900)]
    rows[3] |= {"title": None, "slug": None, "body": None}
    rows[4] |= {"title": "THE Дом", "slug": "Ex", "body": "rare, rare! ré"}
    return rows


@pytest.fixture(scope="module")
def index(spark, corpus, tmp_path_factory):
    return build_index(spark.createDataFrame(corpus, "id long, title string, slug string, body string").repartition(5), "id", FIELDS, str(tmp_path_factory.mktemp("index")), buckets=16, docs_per_block=20)


@pytest.mark.parametrize("query", [{"the": 1.0}, {"rare": 1.0, "w0": 0.2}, {"дом": 0.5, "w7": 1.0, "w50": 0.8, "ёж": 1.0}, {"~page": 1.0, "~exam": 0.3, "w1": 1.0}, {"missing": 1.0, "w3": 1.0}])
@pytest.mark.parametrize("k", [1, 10, 100])
def test_search_equals_counting(index, corpus, query, k):
    for most_listed in (1000, 0):  # blocks named in the scan, or joined to it
        got = [(r["doc"], r["score"]) for r in index.search(query, k, most_listed=most_listed).collect()]
        assert got == brute(corpus, FIELDS, query, k)


def test_all_hits_without_k(index, corpus):
    got = sorted((r["doc"], r["score"]) for r in index.search({"w0": 1.0, "~ex": 1.0}, None).collect())
    assert got == sorted(brute(corpus, FIELDS, {"w0": 1.0}, None))


def test_blocks_that_cannot_hold_a_hit_are_not_read(index):
    rows = index.postings(["rare", "w0"])
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert {re.search("bucket=([0-9]+)", f)[1] for f in rows.inputFiles()} == {str(crc32(t) % 16) for t in (b"rare", b"w0")} and "In(term" in plan  # folders, and row groups within
    every = rows.select("block").distinct().count()
    found = index.search({"rare": 1.0, "w0": 0.01}, 1)
    listed = re.search(r"block#\d+L? IN \(([^)]*)\)|\(block#\d+ = (\d+)\)", found._jdf.queryExecution().optimizedPlan().toString())
    assert every > 20 and listed and len((listed[1] or listed[2]).split(",")) < every / 4


def test_a_frequent_term_is_spread_over_files(spark, tmp_path):
    df = spark.range(4000).select("id", F.lit("same").alias("body"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # a few rows count as many
    made = build_index(df, "id", [field("body", "body")], str(tmp_path), docs_per_block=50)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert made.postings(["same"]).select(F.input_file_name()).distinct().count() > 1
    assert made.blocks(["same"]).agg(F.sum("n")).first()[0] == 4000


def test_a_term_is_one_row_a_block(spark, tmp_path):
    """What is shuffled and written grows with the terms of a block, not with documents times terms; copies of a key in several blocks add up."""
    df = spark.range(4000).select((F.col("id") % 1999).alias("id"), F.lit("one two").alias("body")).coalesce(1)
    made = build_index(df, "id", [field("body", "body")], str(tmp_path))
    assert spark.read.parquet(f"{made.path}/postings").count() == 2 and made.postings().count() == 8000 and made.copies == 3
    small = build_index(df, "id", [field("body", "body")], str(tmp_path), docs_per_block=100)
    for index in (made, small):
        first, second, third = index.search(["one"], 3).collect()
        assert (first["doc"], second["doc"], third["doc"]) == (0, 1, 2) and abs(first["score"] * 2 / 3 - third["score"]) < 2e-6


def test_index_of_odd_rows(spark, tmp_path):
    schema = "id string, body string, doc int, term string, bucket int"
    rows = [("a", "x y", 1, "t", 2), ("a", "x", 1, "t", 2), ("b", None, 1, "t", 2), (None, "x", 1, "t", 2), ("c", "", 1, "t", 2), ("d", "long " * 200_000, 1, "t", 2), ("e", "x" * 300_000, 1, "t", 2)]
    fields = [field("body", "body")]
    made = build_index(spark.createDataFrame(rows, schema), "id", fields, str(tmp_path / "a"), docs_per_block=1)
    assert made.n == 6 and made.copies == 2
    assert [r["doc"] for r in made.search(["x"], 1).collect()] == ["a"] and made.search([]).count() == 0 and made.search(["none"]).count() == 0
    assert {r["doc"]: r["tf"] for r in made.postings(["long", "x" * 300_000]).collect()} == {"d": [200_000], "e": [1]}
    empty = build_index(spark.createDataFrame([], schema), "id", fields, str(tmp_path / "b"))
    assert empty.n == 0 and empty.search(["x"]).count() == 0 and empty.postings().count() == 0 and SearchIndex.open(spark, str(tmp_path / "b")) == empty


def test_one_text_index_equals_the_scan(spark, small):
    table = lambda name: spark.read.parquet(f"{small}/{name}.parquet")
    terms = ["the", "der", "les", "of"]
    got = {r["doc"]: r["score"] for r in search.document_index(table).search(terms, None).collect()}
    want = {r["doc_id"]: r["score"] for r in R.bm25(table("documents"), "doc_id", "text", terms).collect()}
    assert got.keys() == want.keys() and all(math.isclose(got[i], want[i], abs_tol=1e-6) for i in want)


def test_an_index_is_written_once_for_a_version_of_its_files(spark, tmp_path):
    table = lambda name: spark.read.parquet(f"{tmp_path}/{name}")
    rows = lambda *texts: spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows("one", "two").write.parquet(f"{tmp_path}/documents")
    first = search.document_index(table)
    assert search.document_index(table).path == first.path
    rows("three", "one").write.mode("overwrite").parquet(f"{tmp_path}/documents")
    second = search.document_index(table)
    assert second.path != first.path and [r["doc"] for r in second.search(["one"]).collect()] == [1]
    store.remove(spark, f"{second.path}/fields")  # as if the writer had been lost
    assert [r["doc"] for r in search.document_index(table).search(["three"]).collect()] == [0]


def test_question_terms(spark):
    texts = {
        1: 'Where is the "annual report" of Acme Corp in Berlin?', 2: "What is the price list", 3: None, 4: "the a an", 5: "price Price price. cost cost", 6: "Дай таблицу цен, Иван Петров",
        7: "one two three four five six seven eight nine ten", 8: 'say "the" and "x"',
    }
    rows = spark.createDataFrame([(i, t, "x", 1.0) for i, t in texts.items()], "id long, q string, term string, weight double")
    got = {r["id"]: list(zip(r["terms"], r["weights"], strict=True)) for r in Q.question_terms(rows, ["id"], "q").collect()}
    assert got[1] == [("annual report", 15.0), ("acme corp", 13.0), ("berlin", 10.0), ("of acme", 5.0), ("corp in", 5.0), ("in berlin", 5.0), ("annual", 2.0), ("report", 2.0)]
    assert got[2] == [("price", 2.0)] and got[3] == [] and got[4] == []
    assert got[5] == [("price", 14.0), ("price price", 10.0), ("cost cost", 5.0), ("cost", 4.0)]
    assert got[6][0] == ("иван петров", 13.0)
    assert [t for t, _ in got[7]] == ["one two", "two three", "three four", "four five", "five six", "six seven", "seven eight", "eight nine"]
    assert got[8] == [("say", 2.0)]
    m = {r["id"]: (r["table_mode"], r["quote_mode"], r["enumeration_mode"]) for r in rows.select("id", *(c.alias(n) for n, c in Q.modes(F.col("q")).items())).collect()}
    assert m[2] == (False, False, True) and m[3] == (False, False, False) and m[6][0]


def test_term_weights():
    assert Q.term_weights(["annual report", "report", "x-1"], [10.0, 2.0, 5.0], lambda t: re.findall("[a-z0-9]+", t)) == {"annual": 1.0, "report": 1.0, "x": 0.5, "1": 0.5}
