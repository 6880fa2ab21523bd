"""Exact dedup, fill-in-the-middle and importance resampling, against plain versions."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from brute import UPPER
from pyspark.sql import functions as F

from loomwork.llm import exact_dedup, fill_in_middle, importance, queries


def texts(spark, sf):
    return {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}


# Exact dedup


def groups(rows):
    """[(doc_id, keep_id, group_size, kept)] for rows (doc_id, text), sorted."""
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]", "", t or "")
    claim = lambda i, t: (len(t or ""), i is not None, -(i or 0))
    out = []
    for i, t in rows:
        own = [(j, u) for j, u in rows if norm(u) == norm(t)]
        best = max(own, key=lambda r: claim(*r))
        out.append((i, best[0], len(own), claim(i, t) == claim(*best)))
    return sorted(out, key=repr)


def read(df):
    return sorted(((r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in df.collect()), key=repr)


ODD = [
    (1, "a b"), (2, "ab "), (3, "ab"), (4, None), (5, ""), (6, " \n\t\x0b\x0c\r"), (None, "ab  "), (None, "only"), (None, "only"), (7, "A b"), (8, "x" * 300_000 + " y"), (9, "x" * 300_000 + "y"),
    (3, "ab"), (1, "a b"), (-5, "a b"), (10, "a\xa0b"), (2**63 - 1, "far"), (-(2**63), "f ar"), (11, "é日本"), (12, "é 日本"), (13, "dup"), (14, "dup"),
]


@pytest.mark.parametrize("digest", [exact_dedup.sha256, lambda t: F.unhex(F.hex(F.length(t) % 3)), lambda t: F.unhex(F.lit("00"))], ids=["sha256", "few digests", "one digest"])
@pytest.mark.parametrize("most_hot", [10_000, 1])
def test_texts_are_compared_whole_at_each_step(spark, digest, most_hot):
    """Digests that collide join nothing; groups are found by broadcast and by shuffle."""
    df = spark.createDataFrame([(*r, "x", 1, "y") for r in ODD], "doc_id long, text string, digest string, salt int, claim string").repartition(7)
    assert read(exact_dedup.exact_duplicates(df, salts=3, digest=digest, most_hot=most_hot)) == groups(ODD)


def test_a_hot_text_is_combined_by_task_and_by_salt(spark):
    df = spark.range(3000).select("id", F.when(F.col("id") % 3 == 0, F.concat(F.lit("the same "), F.lit("te xt"))).otherwise(F.concat(F.lit("own "), "id")).alias("text")).withColumnRenamed("id", "doc_id").repartition(40)
    rows = exact_dedup.exact_duplicates(df, salts=8).collect()
    assert len(rows) == 3000 and all(r["group_size"] == (1000 if r["doc_id"] % 3 == 0 else 1) and r["keep_id"] == (0 if r["doc_id"] % 3 == 0 else r["doc_id"]) for r in rows)
    plan = exact_dedup.combine(df)._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and "ObjectHashAggregate" not in plan  # claims are combined in place


def test_exact_dedup_of_nothing_and_of_odd_rows(odd, none):
    assert exact_dedup.exact_duplicates(none).count() == 0
    assert len(read(exact_dedup.exact_duplicates(odd))) == 11


# Fill-in-the-middle


def brute_fim(doc_id, text, rate=100, spm=50):
    text = text or ""
    lines = re.findall(r"[^\n]*\n|[^\n]+", text)
    digits = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digits[i : i + 8], 16) for i in range(0, 32, 8)]
    a, b = sorted((h[0] % (len(lines) + 1), h[1] % (len(lines) + 1)))
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return len(lines), "plain", None, None, text
    p, m, s = "".join(lines[:a]), "".join(lines[a:b]), "".join(lines[b:])
    return (len(lines), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}") if h[3] % 100 < spm else (len(lines), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


@pytest.mark.parametrize("n", [0, 1, 7, 8, 9, 33, 1000, 20_000])
def test_skip_list_reaches_every_rank(n):
    widths = np.random.default_rng(n).integers(1, 50, n).tolist()
    lines, sums = fill_in_middle.SkipList(widths), np.cumsum([0, *widths])
    assert all(lines.offset(r) == sums[r] for r in (range(n + 1) if n < 2000 else [*range(0, n, 37), n - 1, n]))
    for (units, chars, _), (low_units, low_chars, _) in zip(lines.lanes[1:], lines.lanes, strict=False):
        assert sum(units) == sum(low_units) == n and sum(chars) == sum(low_chars) and len(units) < len(low_units)
    assert len(lines.lanes) <= 2 + math.log(n + 1, 2.5)
    with pytest.raises(IndexError):
        lines.offset(n + 1)


def test_skip_list_descends_in_few_steps():
    n = 200_000
    lines = fill_in_middle.SkipList([1] * n)
    for units, _, below in lines.lanes[1:]:
        assert max(np.diff([*below, below[-1] + 4])) <= 30  # no long stretch without a tower above
        assert sum(units) == n


def test_documents_are_cut_as_by_hand(spark, small):
    docs = texts(spark, small)
    rows = fill_in_middle.fill_in_middle(spark.read.parquet(f"{small}/documents.parquet")).collect()
    assert {r["doc_id"]: (r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) for r in rows} == {i: brute_fim(i, t) for i, t in docs.items()}
    assert {r["form"] for r in rows} >= {"psm", "spm"}


def test_texts_come_back(spark):
    parts = ["", "\n", "\n\n", "<P", "P>", "<S", "S>", "M>", "<", ">", "a\n", "é\r\n", "日本\n", "<<\n", "x"]
    rng = np.random.default_rng(5)
    rows = [(i, "".join(rng.choice(parts, rng.integers(0, 9)))) for i in range(400)] + [(None, "a\nb\nc"), (None, None), (401, "a <S> b\n"), (402, "line\n" * 50_000), (402, "line\n" * 50_000), (403, "z" * 100_000)]
    df = spark.createDataFrame([(*r, "clash", 3) for r in rows], "doc_id long, text string, output string, n int")
    out = fill_in_middle.fill_in_middle(df, rate=80, batch_chars=1000).withColumn("back", fill_in_middle.restored(F.col("output"), F.col("form")))
    got = [(r["doc_id"], r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) for r in out.collect()]
    key = lambda r: (r[0] is None, r[0] or 0, r[-1])
    assert sorted(got, key=key) == sorted(((i, *brute_fim(i, t, rate=80)) for i, t in rows), key=key)
    assert sorted(r["back"] for r in out.collect()) == sorted(t or "" for _, t in rows)
    assert fill_in_middle.fill_in_middle(df.where("false")).count() == 0


# Importance resampling


def brute_features(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(UPPER))
    return len(w), [zlib.crc32(f.encode()) % 10_000 for f in [*w, *(f"{a} {b}" for a, b in zip(w, w[1:], strict=False))]]


def brute_importance(docs, target, percent=25):
    """[(doc_id, n_features, weight, score, rank)] of rows (doc_id, text); ids not repeated."""
    s, t = Counter(), Counter()
    for _, text in docs:
        s.update(brute_features(text)[1])
    for text in target:
        t.update(brute_features(text)[1])
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (s.total() + 10_000) / ((s[b] + 1) * (t.total() + 10_000))))
    out = {}
    for i, text in docs:
        n, f = brute_features(text)
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(map(gain, f)) // len(f) if f else 0
        out[i] = (n, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))))
    order = sorted((i for i in out if out[i][0] >= 20), key=lambda i: (-out[i][3], i is None, i or 0))
    rank = {i: k for k, i in enumerate(order[: percent * len(order) // 100], 1)}
    return {i: (*v[1:], rank.get(i)) for i, v in out.items()}


def drawn(df):
    return {r["doc_id"]: (r["n_features"], r["weight"], r["score"], r["rank"]) for r in df.collect()}


def test_resampling_matches_counting(spark, small):
    target = [r["text"] for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    assert drawn(queries.op13_importance_resampling(spark, small)) == brute_importance(list(texts(spark, small).items()), target)


def test_resampling_of_odd_rows(spark, none):
    words = " ".join(f"w{i % 7}" for i in range(40))
    rows = [(i, f"{words} Own{i} É日本 x_y-z 7") for i in range(30)] + [(40, None), (41, ""), (42, "one"), (43, " \x00\x7f!"), (44, "deux MOTS"), (45, "long " * 100_000), (None, words), (46, " ".join("a" * 19)), (47, " ".join("a" * 20))]
    df = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], "doc_id long, text string, score int, rank string, bucket int").repartition(5)
    target = spark.createDataFrame([("w1 w2 own3",), (None,)], "text string")
    assert drawn(importance.importance_resample(df, target)) == brute_importance(rows, ["w1 w2 own3", ""])
    assert drawn(importance.importance_resample(df, target.where("false"), percent=100)) == brute_importance(rows, [], 100)
    assert importance.importance_resample(none, target).count() == 0


def test_repeated_rows_are_ranked_once_each(spark):
    text = " ".join(f"w{i}" for i in range(25))
    df = spark.createDataFrame([(7, text)] * 300 + [(None, text)] * 300 + [(8, "short")] * 100, "doc_id long, text string").repartition(6)
    rows = importance.importance_resample(df, df.select("text")).collect()
    assert len(rows) == 700 and sorted(r["rank"] for r in rows if r["rank"]) == list(range(1, 151))
    assert all(r["rank"] is None for r in rows if r["doc_id"] == 8)


@pytest.mark.parametrize("most_words", [1, 2, 4])
@pytest.mark.parametrize("size", [1, 3, 17, 1 << 20])
def test_blocks_of_a_text_give_the_features_of_the_whole(most_words, size):
    text = ("One two, THREE four é日本 five six" * 5).encode()
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.decode().translate(UPPER))
    want = Counter(zlib.crc32(" ".join(w[i : i + k]).encode()) % 999 for k in range(1, most_words + 1) for i in range(len(w) - k + 1))
    got = list(importance.features(text, most_words, 999, size))
    assert Counter(b for _, found in got for b in found) == want and sum(n for n, _ in got) == len(w)


@pytest.mark.parametrize("name", ["op11_exact_dedup", "op12_fill_in_middle", "op13_importance_resampling"])
def test_sql_gives_the_same_rows(spark, small, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"create view {t} as select * from '{small}/{t}.parquet'")
    want, got = con.sql(queries.ORACLE_SQL[name]), queries.QUERIES[name](spark, small)
    assert sorted(want.columns) == sorted(got.columns)
    assert sorted((dict(zip(want.columns, r, strict=True)) for r in want.fetchall()), key=lambda r: r["doc_id"]) == sorted((r.asDict() for r in got.collect()), key=lambda r: r["doc_id"])
