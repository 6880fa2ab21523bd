"""Every sentence of a repeated passage goes."""

import numpy as np
import pytest
from brute import without_repeats

from loomwork.llm import substring_dedup


def left_by(spark, docs):
    rows = substring_dedup.remove_repeats(spark.createDataFrame(list(docs.items()), "doc_id long, text string")).collect()
    return {r["doc_id"]: (r["text"], r["n_removed"]) for r in rows}


@pytest.mark.parametrize("seed", range(3))
def test_two_spans_a_sentence_stand_for_all_runs(spark, seed):
    """Texts of a few short sentences in random order, so that runs of all lengths repeat, also in one text."""
    rng = np.random.default_rng(seed)
    pool = [" ".join(f"s{k}w{j}" for j in range(rng.integers(1, 9))) + ". " for k in range(12)]
    docs = {i: "".join(pool[k] for k in rng.integers(0, 12, rng.integers(0, 15))) for i in range(40)}
    assert left_by(spark, docs) == without_repeats(docs)


def test_the_tail_of_a_repeat_goes_and_a_lone_sentence_stays(spark):
    twelve, alone = "One two three four five six seven eight nine ten eleven twelve. ", " ".join(f"w{i}" for i in range(26)) + ". "
    docs = {i: f"Own{i} beginning here. {twelve}Short three words. Tail words here. Own{i} ending there." for i in range(2)} | {i: f"Some{i} text. {alone}Other{i} text." for i in (2, 3)}
    assert left_by(spark, docs) == {0: (docs[0], 0), 1: ("Own1 beginning here. Own1 ending there.", 3), 2: (docs[2], 0), 3: (docs[3], 0)}


def test_clashing_names_and_repeated_rows(spark):
    text = "One two three four five. Six seven eight nine ten. Eleven."
    names = ["rest", "repeats", "text_key", "of_doc", "of_text", "span", "place", "more", "_doc_id", "_text_key", "first_doc", "_"]
    df = spark.createDataFrame([(i, t, *names) for i, t in [(1, text), *[(None, text)] * 50, (2, None), (2, "")]], "doc_id long, text string, " + ", ".join(f"{n} string" for n in names))
    out = substring_dedup.remove_repeats(df)
    assert out.columns == [*df.columns, "n_sentences", "n_removed", "removed"]
    rows = out.collect()
    assert len(rows) == 53 and all(r[n] == n for r in rows for n in names)
    assert {(r["doc_id"], r["text"], r["n_removed"]) for r in rows} == {(None, text, 0), (1, "", 3), (2, "", 0)}


@pytest.mark.parametrize("lengths", [[30, 22], [20, 4, 4], [4, 4, 20], [5, 5], [6, 30, 3], [3, 3, 3, 3, 3]])
def test_repeats_go_to_the_last_sentence(spark, lengths):
    sentence = lambda name, n: " ".join(f"{name}{i}" for i in range(n)) + ". "
    passage = "".join(sentence(f"p{k}x", n) for k, n in enumerate(lengths))
    rows = [(d, sentence(f"a{d}x", 12) + passage + sentence(f"z{d}x", 12)) for d in range(3)] + [(3, passage)]
    left = {r["doc_id"]: r["text"] for r in substring_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert left == {0: rows[0][1], 3: ""} | {d: sentence(f"a{d}x", 12) + sentence(f"z{d}x", 12) for d in (1, 2)}


def test_places_are_gathered_as_lists(spark):
    """No row for each place: a passage that most texts share makes no more rows than it has spans."""
    df = spark.createDataFrame([(i, "One two three four five six. Seven eight nine ten eleven. " * 3) for i in range(4)], "doc_id long, text string")
    out = substring_dedup.remove_repeats(df)
    assert "Generate" not in out._jdf.queryExecution().executedPlan().toString() and sorted(r["n_removed"] for r in out.collect()) == [4, 6, 6, 6]
