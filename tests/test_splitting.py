"""Blocks and tables in parts: within the caps, everything once."""

import numpy as np
import pytest

from loomwork.operators import chunking
from loomwork.operators import splitting as S


def bodies(text, most):
    return [" ".join(text[a:b] for a, b in spans) for spans in S.split_block(text, most)]


@pytest.mark.parametrize("text, most, want", [
    ("", 5, []), (" \n ", 5, []), (" short ", 10, ["short"]), ("one two\n\nthree", 8, ["one two", "three"]), ("one two\n \n\n three four", 9, ["one two", "three", "four"]),
    ("A b. C d! E f? G", 9, ["A b. C d!", "E f? G"]), ("abcdefghij", 4, ["abcd", "efgh", "ij"]), ("ab cdefgh i", 4, ["ab", "cdef", "gh i"]), ("A. " + "x" * 9 + ". B. C.", 5, ["A.", "xxxxx", "xxxx.", "B. C."]),
    ("一。 二。 三。", 5, ["一。 二。", "三。"]), ("a b c d", 3, ["a", "b", "c d"]),
])
def test_parts_of_a_text(text, most, want):
    assert bodies(text, most) == want


@pytest.mark.parametrize("seed", range(30))
def test_parts_hold_everything_once_and_fit(seed):
    rng = np.random.default_rng(seed)
    text = "".join(rng.choice(["word", "a", " ", " ", ". ", "\n", "\n\n", "! ", "x" * 15, "é", "?\n"], rng.integers(0, 200)))
    spans = [s for part in S.split_block(text, 20) for s in part]
    assert all(len(b) <= 20 and b == b.strip() and b for b in bodies(text, 20))
    assert all(a < b for a, b in spans) and all(x[1] <= y[0] for x, y in zip(spans, spans[1:], strict=False))
    assert "".join("".join(text[a:b].split()) for a, b in spans) == "".join(text.split())


def test_a_long_text_is_cut_at_the_default(spark):
    text = "\n\n".join(["Sentence of words here. " * 5000, "short", "y" * 100_000])
    df = spark.createDataFrame([(1, text, "k"), (2, None, "k"), (3, " ", "k"), (1, "twice", "k")], "id long, t string, part string")
    rows = S.split_blocks(df, "id", "t").collect()
    assert {r["id"] for r in rows} == {1} and max(len(r["body"]) for r in rows) <= 48_000
    mine = [r for r in rows if r["body"] != "twice"]
    assert [r["part"] for r in mine] == list(range(len(mine))) and len(mine) == 3 + 1 + 3
    assert all(text[r["start"] : r["end"]].split() == r["body"].split() for r in mine)
    assert S.split_blocks(df.where("false"), "id", "t").count() == 0


def test_rows_repeat_the_header():
    table = "| a | b |\n| --- | --- |\n\n" + "\n".join(f"| {i} | {'w ' * (i % 3)}|" for i in range(40)) + "\n"
    count = lambda s: len(s.split())
    parts = list(S.split_rows(table, 30, count))
    lines = [line for line in table.splitlines() if line.strip()]
    assert [x for first, n, _ in parts for x in range(first, first + n)] == list(range(40))
    assert all(body.splitlines() == lines[:2] + lines[2 + first : 2 + first + n] and (count(body) <= 30 or n == 1) for first, n, body in parts)
    for (first, n, body), after in zip(parts, parts[1:], strict=False):
        assert count(body) + count(lines[2 + after[0]]) > 30  # no part could take one row more
    assert list(S.split_rows("| a |\n| - |", 1, count)) == [(0, 0, "| a |\n| - |")] and list(S.split_rows("h\nr\n" + "big " * 50, 3, count)) == [(0, 1, "h\nr\n" + "big " * 50)]


def test_tables_of_odd_rows(spark):
    df = spark.createDataFrame([(None, "h\n-\n1\n2\n3", 1), (2, None, 1), (2, "h\n-\n1", 1)], "id long, t string, body int")
    got = sorted(((r["id"], r["part"], r["first_row"], r["n_rows"], r["body"]) for r in S.split_tables(df, "id", "t", 4).collect()), key=repr)
    assert got == sorted([(None, 0, 0, 2, "h\n-\n1\n2"), (None, 1, 2, 1, "h\n-\n3"), (2, 0, 0, 0, ""), (2, 0, 0, 1, "h\n-\n1")], key=repr)


@pytest.mark.parametrize("tokens", [len, lambda w: -(-len(w) // 3)])
def test_long_words_are_cut_for_windows(tokens):
    words = ["abcdefghij", "kl", "m" * 25]
    cut = list(chunking.within(words, tokens, 4, 11))
    assert "".join(cut) == "".join(words) and all(tokens(w) <= 4 and len(w) <= 11 for w in cut)
    assert list(chunking.within(["abcdefghij"], len, 4, 100)) == ["abcd", "efgh", "ij"]
    assert list(chunking.within(["ab"], lambda w: 9, 4, 100)) == ["a", "b"]  # a character is never cut


def test_windows_are_within_both_caps(spark):
    df = spark.createDataFrame([(1, "word " * 10 + "z" * 100 + " end"), (2, None)], "id long, t string")
    rows = chunking.window_chunks(df, "id", "t", len, 12, 30, 4).collect()
    assert rows and all(r["n_tokens"] <= 12 and len(r["text"]) <= 30 for r in rows)
