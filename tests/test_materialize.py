"""Builds write what has changed, once."""

import pytest
from pyspark.sql import functions as F

from loomwork.operators import chunking
from loomwork.operators import materialize as M
from loomwork.sources import store

SCHEMA = "id long, text string, policy string, build int"


@pytest.fixture
def at(spark, tmp_path):
    path = str(tmp_path / "chunks")

    def refresh(rows, rule=None, chunker=None):
        df = spark.createDataFrame([(*r, "clash", 7) for r in rows], SCHEMA)
        seen = []

        def words(docs):
            seen.extend(sorted(r["id"] for r in docs.collect()))
            return docs.select("id", F.explode(F.filter(F.split("text", " "), lambda w: w != "")).alias("word"))

        return M.refresh(df, "id", "text", rule if rule is not None else F.lit("all"), chunker or words, path), seen

    refresh.path = path
    return refresh


def now(spark, path):
    return sorted((r["id"], r["word"]) for r in M.current(spark, path, "id").collect())


def test_only_what_changed_is_written(spark, at):
    rows = [(1, "a b"), (2, "c"), (3, "d e f")]
    assert at(rows) == (3 + 6, [1, 2, 3])
    assert at(rows) == (0, []) and M.builds(spark, at.path) == [1]
    assert at([(1, "a b"), (2, "c x"), (3, " d e f​\n")]) == (1 + 2, [2])
    assert now(spark, at.path) == [(1, "a"), (1, "b"), (2, "c"), (2, "x"), (3, "d"), (3, "e"), (3, "f")]
    assert [r["id"] for r in spark.read.parquet(f"{at.path}/build-2/chunks").select("id").distinct().collect()] == [2]


def test_policy_gone_and_back(spark, at):
    rows = [(1, "a b"), (2, "c"), (4, None), (5, " ")]
    at(rows)
    assert at(rows) == (0, [])  # blank texts stay fresh without chunks
    assert at(rows, F.when(F.col("id") == 2, "other").otherwise("all"))[1] == [2]
    assert at([(1, "a b")], F.lit("all")) == (3, []) and now(spark, at.path) == [(1, "a"), (1, "b")]  # three are gone
    assert at(rows)[1] == [2, 4, 5] and now(spark, at.path) == [(1, "a"), (1, "b"), (2, "c")]
    assert at([]) == (4, []) and now(spark, at.path) == []
    M.compacted(spark, at.path, "id", at.path + "-new")
    assert M.builds(spark, at.path + "-new") == [1] and now(spark, at.path + "-new") == []


def test_a_lost_writer_leaves_nothing(spark, at):
    at([(1, "a b")])

    def fails(docs):
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError):
        at([(1, "a c")], chunker=fails)
    assert M.builds(spark, at.path) == [1] and now(spark, at.path) == [(1, "a"), (1, "b")]
    at([(1, "a c")])
    store.remove(spark, f"{at.path}/build-2/pages/_SUCCESS")  # chunks are there, but not all pages
    assert now(spark, at.path) == [(1, "a"), (1, "b")]
    assert at([(1, "a c")]) == (3, [1]) and now(spark, at.path) == [(1, "a"), (1, "c")]


def test_a_document_without_chunks_is_tried_again(spark, at):
    none = lambda docs: docs.select("id", F.lit("w").alias("word")).where("false")
    at([(1, "a")], chunker=none)
    assert at([(1, "a")]) == (2, [1]) and at([(1, "a")]) == (0, [])


def test_repeated_and_null_keys(spark, at):
    assert at([(1, "a"), (1, "a"), (1, "b"), (None, "x")])[1] == [1]
    assert at([(1, "b"), (1, "a")]) == (0, [])


def test_with_structured_chunks(spark, tmp_path):
    df = spark.createDataFrame([(1, "# One\n" + "word " * 50 + "\n| a | b |\n| - | - |\n| 1 | 2 |"), (2, "plain")], "id long, text string")
    chunk = lambda docs: chunking.structured_chunks(docs, "id", "text", most_tokens=20)
    path = str(tmp_path)
    assert M.refresh(df, "id", "text", F.lit("p"), chunk, path) > 4 and M.refresh(df, "id", "text", F.lit("p"), chunk, path) == 0
    assert M.current(spark, path, "id").where("id = 2").count() == 1
