import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from brute import counts, near_components, without_repeats, words
from pyspark.sql import functions as F

from loomwork.llm import byte_cnn, lm_scoring, mixing, near_dup, packing, quality_rules, queries, substring_dedup


@pytest.fixture(scope="module")
def docs(spark, small):
    return {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{small}/documents.parquet").collect()}


def test_near_duplicates_match_brute_force(spark, small, docs):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in queries.op3_near_duplicates(spark, small).collect()}
    assert got == near_components(docs, 2)


def test_near_duplicates_join_chains_and_large_groups(spark):
    base = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(base[:i] + [f"new{i}"] + base[i + 1 :])) for i in range(60)]  # all alike, none equal
    rows += [(100 + i, " ".join(f"c{j}" for j in range(2 * i, 2 * i + 40))) for i in range(8)]  # each like the next ones only
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), k=2, block=16).collect()}
    assert got == near_components(dict(rows), 2)


def test_near_duplicates_odd_rows(odd, none):
    rows = near_dup.near_duplicates(odd, k=2).collect()
    assert len(rows) == 11
    of = {r["doc_id"]: (r["component_id"], r["kept"]) for r in rows}
    assert of[2] == (1, False) and of[9] == (1, False) and of[1] == (1, True) and of[4] == (4, True) and of[5] == (5, True) and of[None] == (None, True)
    assert [r["n_shingles"] for r in rows if r["doc_id"] in (3, 4, 5)] == [0, 0, 0]
    assert near_dup.near_duplicates(none).count() == 0


def test_superminhash_estimates_similarity():
    rng = np.random.default_rng(3)
    pool = rng.integers(0, 2**63, 300).astype(np.uint64)
    a, b = pool[:250], pool[50:]
    s = near_dup.superminhash(np.repeat([0, 1], 250), np.concatenate((a, b)), 2, 1024)
    assert abs((s[0] == s[1]).mean() - 200 / 300) < 0.06
    assert len(np.unique(s[0] >> np.uint64(32))) < 40  # few rounds are needed


def test_repeats_match_brute_force(spark, small, docs):
    got = {r["doc_id"]: (r["text"], r["n_removed"]) for r in queries.op1_substring_dedup(spark, small).collect()}
    assert got == without_repeats(docs)


def test_repeats_odd_rows(odd, none):
    out = substring_dedup.remove_repeats(odd)
    assert out.columns == [*odd.columns, "n_sentences", "n_removed", "removed"]
    rows = {}
    for r in out.collect():
        rows.setdefault(r["doc_id"], []).append(r)
    assert rows[1][0]["n_removed"] == 0 and [r["text"] for r in rows[2]] == ["", ""] and rows[3][0]["text"] == "" and rows[5][0]["text"] == " \n\t "
    assert rows[9][0]["text"] == "More." and rows[9][0]["u"] == "u" and rows[7][0]["n_removed"] == 0
    assert substring_dedup.remove_repeats(none).count() == 0


def test_rule_counts_match_brute_force(spark, small, docs):
    rows = queries.op6_quality_rules(spark, small).collect()
    assert {r["doc_id"]: (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) for r in rows} == {i: counts(t) for i, t in docs.items()}
    assert all(r["base_failed"] == (r["n_words"] < 10 or 100 * r["n_repeat_words"] > 20 * r["n_words"]) and not (r["kept"] and r["base_failed"]) for r in rows)


def test_rules_agree_with_labels(spark, small):
    labels = spark.read.parquet(f"{small}/labels.parquet")
    r = queries.op6_quality_rules(spark, small).join(labels.withColumnRenamed("quality", "label"), "doc_id").where("not base_failed")
    assert r.where("kept <> (label = 1)").count() <= 0.02 * r.count()


def test_rules_odd_rows(odd, none):
    rows = quality_rules.quality_rules(odd).collect()
    assert len(rows) == 11 and all(r["base_failed"] for r in rows if r["doc_id"] in (3, 4, 5, 6))
    assert quality_rules.quality_rules(none).count() == 0


def test_classifier_is_right_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    r = queries.op4_quality_classifier(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").collect()
    assert all(zlib.crc32(str(x["doc_id"]).encode()) % 4 == 2 and 0 <= x["score"] <= 1 and x["predicted"] == (x["score"] >= 0.7) for x in r)
    assert sum(x["predicted"] == x["quality"] for x in r) >= 0.93 * len(r)


def test_classifier_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(1, 1), (6, 0), (9, 1), (2, 0), (None, 1), (7, None), (1, 1)], "doc_id long, quality int")
    out = byte_cnn.classify_documents(odd.withColumn("score", F.lit("clash")), labels)
    assert len(rows := out.collect()) == 11 and all(0 <= r["score"] <= 1 for r in rows) and set(odd.columns) <= set(out.columns)
    assert byte_cnn.classify_documents(none, labels).count() == 0
    assert len({r["score"] for r in byte_cnn.classify_documents(odd, labels.where("quality = 1")).collect()}) == 1


def test_classifier_reads_whole_texts():
    rng = np.random.default_rng(0)
    prose = lambda n: bytes(rng.choice(np.frombuffer(b"abcdefgh ", np.uint8), n))
    texts = [prose(3000) for _ in range(40)] + [prose(2900) + b"####" * 25 for _ in range(40)]
    net = byte_cnn.train(texts, [1] * 40 + [0] * 40)
    data = [prose(100_000), prose(99_900) + b"####" * 25]
    scores = byte_cnn.score_block(np.array([0, 100_000, 200_000]), np.frombuffer(b"".join(data), np.uint8), net, net.pairs())
    assert scores[0] > scores[1]


@pytest.fixture(scope="module")
def scored(spark, small):
    return queries.op7_lm_scoring(spark, small).collect()


def test_base_scores_match_brute_force(docs, scored):
    tokens = {i: [*words(t), "\n"] for i, t in docs.items()}
    c = Counter(w for i, t in tokens.items() if zlib.crc32(str(i).encode()) % 7 != 2 for w in t)
    n, v = sum(c.values()), len(c)
    for r in scored:
        t = tokens[r["doc_id"]]
        assert r["n_tokens"] == len(t) and r["n_known"] == sum(c[w] > 0 for w in t) and r["train_tokens"] == n
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 7 == 2)
        assert math.isclose(r["base_score"], sum(math.log10((c[w] + 1) / (n + v + 1)) for w in t), rel_tol=1e-9)
        assert r["score"] < 0


def test_a_rare_head_gives_the_same_base_scores(spark, small, scored):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    few = lm_scoring.score_texts(docs, queries.tokenizer("byte_bpe_50k.tiktoken"), head=10).collect()
    assert {r["doc_id"]: (round(r["base_score"], 6), r["n_known"]) for r in few} == {r["doc_id"]: (round(r["base_score"], 6), r["n_known"]) for r in scored}


def test_lm_gradients_and_chances():
    rng = np.random.default_rng(1)
    counts_ = np.zeros(lm_scoring.VOCABULARY, np.int64)
    counts_[:3000] = rng.integers(1, 100, 3000)
    kinds = lm_scoring.groups(counts_, rng.random(lm_scoring.VOCABULARY) < 0.5, n=6, width=8)
    p = {k: w.astype(np.float64) for k, w in lm_scoring.new_model(kinds, d=4).items()}
    tokens, bounds = rng.integers(0, 60, 75), np.array([0, 1, 40, 75])
    x, y, text = lm_scoring.windows(tokens, bounds)
    assert sorted(y[y >= 0].tolist()) == sorted(tokens.tolist())  # each token is predicted once
    # The chances of all first tokens sum to one.
    tables = lm_scoring._tables(p)
    first = 10 ** lm_scoring.score_tokens(p, kinds, tables, np.arange(lm_scoring.VOCABULARY), np.arange(lm_scoring.VOCABULARY + 1))
    assert abs(first.sum() - 1) < 1e-4

    def loss(q):
        per = lm_scoring.score_tokens(q, kinds, lm_scoring._tables(q), tokens, bounds)
        tail = sum(kinds.tail[t] for t in tokens if kinds.of[t] == kinds.n - 1)
        return -(per.sum() * np.log(10) - tail) / len(tokens)

    g = lm_scoring.train_step(p, kinds, x, y)
    for name in ("embed", "q", "k", "v", "r", "out", "out2", "bias2", "ago"):
        at = np.unravel_index(np.abs(g[name]).argmax(), g[name].shape)
        up, down = ({k: w.copy() for k, w in p.items()} for _ in range(2))
        up[name][at] += 1e-2
        down[name][at] -= 1e-2
        assert abs((loss(up) - loss(down)) / 2e-2 - g[name][at]) < 0.02 * abs(g[name][at]) + 2e-4, name


def test_lm_tells_rare_ids_apart():
    counts_ = np.arange(lm_scoring.VOCABULARY)[::-1]
    kinds = lm_scoring.groups(counts_, np.ones(lm_scoring.VOCABULARY, bool))
    p = lm_scoring.new_model(kinds)
    a, b, c, d = 20_000, 20_001, 40_000, 50_000  # none of the 992 most frequent
    tokens, bounds = np.array([a, c, a, d, b, c, b, d]), np.arange(0, 9, 2)
    x, y, _ = lm_scoring.windows(np.array([a, c, b, d]), np.array([0, 2, 4]))
    for _ in range(300):
        for name, g in lm_scoring.train_step(p, kinds, x, y).items():
            p[name] -= 0.1 * g
    ac, ad, bc, bd = lm_scoring.score_tokens(p, kinds, lm_scoring._tables(p), tokens, bounds)
    assert ac - ad > 0.1 and bd - bc > 0.1


def test_lm_rare_gradients():
    rng = np.random.default_rng(1)
    kinds = lm_scoring.groups(np.zeros(lm_scoring.VOCABULARY, np.int64), rng.random(lm_scoring.VOCABULARY) < 0.5, n=6, width=8)
    p = {k: w.astype(np.float64) + (k in ("out3", "out4")) * rng.normal(0, 0.1, w.shape) for k, w in lm_scoring.new_model(kinds, d=4).items()}
    tokens, bounds = rng.integers(0, lm_scoring.VOCABULARY, 75), np.array([0, 1, 40, 75])
    x, y, _ = lm_scoring.windows(tokens, bounds)
    g = lm_scoring.train_step(p, kinds, x, y)
    loss = lambda q: -lm_scoring.score_tokens(q, kinds, lm_scoring._tables(q), tokens, bounds).sum() * np.log(10) / len(tokens)
    for name in ("embed", "q", "out", "out3", "bias3", "out4", "bias4"):
        at = np.unravel_index(np.abs(g[name]).argmax(), g[name].shape)
        up, down = ({k: w.copy() for k, w in p.items()} for _ in range(2))
        up[name][at] += 1e-2
        down[name][at] -= 1e-2
        assert abs((loss(up) - loss(down)) / 2e-2 - g[name][at]) < 0.02 * abs(g[name][at]) + 2e-4, name


def test_lm_logits_of_all_groups_at_once():
    """Segments of several groups give what each gives by itself, beyond the cut of logits too; so do none."""
    rng = np.random.default_rng(7)
    a, w, right = np.abs(rng.normal(0, 1, (30, 5))), rng.normal(0, 1, (3, 5, 8)), rng.integers(0, 8, 30)
    w[1] *= 1000
    segments = [(0, 0, 11), (2, 11, 12), (1, 12, 30)]
    e, mine = lm_scoring._exps(a, w, segments, right)
    for g, lo, hi in segments:
        z = np.clip(a[lo:hi] @ w[g], -60, 60)
        assert np.allclose(e[lo:hi], np.exp(z)) and np.allclose(mine[lo:hi], z[np.arange(hi - lo), right[lo:hi]])
    assert (np.abs(mine) == 60).any()
    e, mine = lm_scoring._exps(a[:0], w[:0], [], right[:0])
    assert e.shape == (0, 8) and mine.shape == (0,)


def test_lm_trains_on_every_text(spark):
    docs = [(i, f"w{i} only here") for i in range(6)] + [(None, "no id")]
    word_ids, counts_, rows = lm_scoring.WordIds(queries.tokenizer("byte_bpe_50k.tiktoken")), np.zeros(lm_scoring.VOCABULARY, np.int64), []
    for _, block in lm_scoring.blocks(pa.array([t for _, t in docs]), word_ids):
        tokens, bounds = block.tokens()
        counts_ += np.bincount(tokens, minlength=lm_scoring.VOCABULARY)
        rows += [(i, bytearray(tokens[a:b].astype(np.uint16).tobytes())) for i, (a, b) in enumerate(zip(bounds[:-1], bounds[1:], strict=True))]
    p, kinds = lm_scoring.fit(spark.createDataFrame(rows, "row long, tokens binary"), counts_, queries.tokenizer("byte_bpe_50k.tiktoken"))
    changed = (p["embed"] != lm_scoring.new_model(kinds)["embed"]).any(1)
    assert changed[np.setdiff1d(tokens, [lm_scoring.END])].all() and not changed[counts_.argmin()]


def test_lm_matches_plain_attention():
    """Each token by itself, in float64 and full softmaxes, from the definition of the model."""
    rng = np.random.default_rng(5)
    kinds = lm_scoring.groups(rng.integers(0, 50, lm_scoring.VOCABULARY), rng.random(lm_scoring.VOCABULARY) < 0.5, n=5, width=6)
    p = {k: w.astype(np.float64) + rng.normal(0, 0.1, w.shape) for k, w in lm_scoring.new_model(kinds, d=4).items()}
    n = [1, 7, 8, 9, 40]
    tokens, bounds = rng.integers(0, lm_scoring.VOCABULARY, sum(n)), np.cumsum([0, *n])
    got = lm_scoring.token_logs(p, kinds, lm_scoring._tables(p), tokens, bounds, batch=3)
    share = lambda z, i: z[i] - np.log(np.exp(z).sum())
    for text in range(len(n)):
        own = tokens[bounds[text] : bounds[text + 1]]
        inputs = np.concatenate((np.full(lm_scoring.CELL, lm_scoring.PAD), [lm_scoring.START], own[:-1]))
        for i, t in enumerate(own):
            at = i + lm_scoring.CELL
            seen = np.arange(i // lm_scoring.CELL * lm_scoring.CELL, at + 1)
            e = p["embed"][inputs]
            s = np.exp([e[at] @ p["q"] @ (e[j] @ p["k"]) / 2 + p["ago"][at - j] for j in seen])
            h = np.maximum((s / s.sum()) @ (e[seen] @ p["v"]) + e[at] @ p["r"], 0)
            want, g = share(h @ p["out"] + p["bias"], kinds.of[t]), kinds.of[t]
            if g < kinds.n - 1:
                want += share(h @ p["out2"][g] + p["bias2"][g], kinds.member[t])
            else:
                want += share(h @ p["out3"] + p["bias3"], kinds.rare_of[t]) + share(h @ p["out4"][kinds.rare_of[t]] + p["bias4"][kinds.rare_of[t]], kinds.rare_member[t])
            assert math.isclose(got[bounds[text] + i], want, rel_tol=1e-9), (text, i)


@pytest.mark.parametrize("cells", [2, 3, 4, 9])
def test_lm_pairs_of_cells(cells):
    """Cells attend by pairs; an odd one counts once, and windows do not reach further back than a cell."""
    rng = np.random.default_rng(3)
    kinds = lm_scoring.groups(rng.integers(0, 50, lm_scoring.VOCABULARY), rng.random(lm_scoring.VOCABULARY) < 0.5, n=5, width=6)
    p = {k: w.astype(np.float64) + rng.normal(0, 0.1, w.shape) for k, w in lm_scoring.new_model(kinds, d=4).items()}
    x, y = rng.integers(0, lm_scoring.VOCABULARY, (2, cells, lm_scoring.CELL))
    whole, n = lm_scoring.train_step(p, kinds, x, y), cells - 1
    each = [lm_scoring.train_step(p, kinds, x[i : i + 2], y[i : i + 2]) for i in range(n)]
    for name in p:
        assert np.allclose(whole[name], sum(g[name] for g in each) / n, rtol=1e-9, atol=1e-15), name
    pairs = lm_scoring._windowed(lm_scoring._paired(x, y)[0][:, :, None])
    assert pairs.shape[:2] == ((n + 1) // 2, 3 * lm_scoring.CELL) and (pairs[:, :, 0].ravel()[: 2 * lm_scoring.CELL] == x[:2].ravel()).all()


ODD_WORDS = ["\u00a0x a\u2028b x\u00a0", "x\u00a0 \u00a0x \u2003", "a\u2028b A\x1cB a\x1cb", "don't DON'T ' \x85 \x85", "\ufffd \u00ff", "日本 日 本 日本", "a" * 3000]


def test_lm_words_are_encoded_once():
    """A word met in an earlier block is looked up, and has the same ids as by itself."""
    ranks = queries.tokenizer("byte_bpe_50k.tiktoken")
    word_ids, asked = lm_scoring.WordIds(ranks), []
    encoded = word_ids.encoded
    word_ids.encoded = lambda starts, *rest: (asked.append(len(starts)), encoded(starts, *rest))[1]
    for texts in (ODD_WORDS, ODD_WORDS[::-1], ["new", *ODD_WORDS]):
        for text in texts:
            ((_, block),) = lm_scoring.blocks(pa.array([text]), word_ids)
            want = [i for w in words(text) for i in lm_scoring.WordIds(ranks, 0).encode(" " + w)]
            assert block.tokens()[0].tolist() == [*want, lm_scoring.END]
    n = len({w for t in ODD_WORDS for w in words(t)})
    assert sum(asked) == n + 1 and asked[-len(ODD_WORDS) - 1] == 1


def test_lm_base_scores_of_odd_words(spark):
    """Words with other white space, and bytes that are no UTF-8, count as what they are."""
    rows = [(i, bytearray(t.encode())) for i, t in enumerate(ODD_WORDS)] + [(i + 50, bytearray(b)) for i, b in enumerate([b"\xff a \xfe", b"\xfe \xff\xff", b"\xc3 \xc3\xa9 \xef\xbf\xbd"])]
    docs = spark.createDataFrame(rows, "doc_id long, raw binary").selectExpr("doc_id", "cast(raw as string) as text")
    got = lm_scoring.score_texts(docs, queries.tokenizer("byte_bpe_50k.tiktoken"), head=3).collect()
    tokens = {i: [*bytes(raw).lower().split(), b" "] for i, raw in rows}
    c = Counter(w for i, own in tokens.items() if zlib.crc32(str(i).encode()) % 7 != 2 for w in own)
    n, v = sum(c.values()), len(c)
    assert len(got) == len(rows)
    for r in got:
        own = tokens[r["doc_id"]]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(own), sum(c[w] > 0 for w in own), n)
        assert math.isclose(r["base_score"], sum(math.log10((c[w] + 1) / (n + v + 1)) for w in own), rel_tol=1e-9)


def test_lm_beats_add_one_counts(spark):
    """On held-out texts of 10,000 documents, on all and on those whose words are all known."""
    r = queries.op7_lm_scoring(spark, "/root/testdata/sf0.1").where("held_out").select("n_tokens", "n_known", "score", "base_score").toPandas()
    known = r[r.n_known == r.n_tokens]
    assert len(known) > 200 and r.score.sum() > r.base_score.sum() and known.score.sum() > known.base_score.sum()


def test_lm_odd_rows(odd, none):
    ranks = queries.tokenizer("byte_bpe_50k.tiktoken")
    rows = lm_scoring.score_texts(odd, ranks).collect()
    assert len(rows) == 11 and all(math.isfinite(r["score"]) and math.isfinite(r["base_score"]) for r in rows)
    assert [r["n_tokens"] for r in rows if r["doc_id"] in (3, 4, 5)] == [1, 1, 1]
    assert lm_scoring.score_texts(none, ranks).count() == 0


def test_packing_holds_every_token_once(spark, small, docs):
    from tokenizers import Tokenizer

    encode = Tokenizer.from_file(queries.tokenizer("byte_bpe_50k.json"))
    rows = queries.op10_best_fit_packing(spark, small).collect()
    pieces, sequences = {}, {}
    for r in rows:
        pieces.setdefault(r["doc_id"], []).append(r)
        sequences.setdefault(r["sequence_id"], []).append(r)
    assert set(pieces) == set(docs)
    for i, text in docs.items():
        ids = encode.encode(text or "", add_special_tokens=False).ids + [2]
        at = 0
        for n, r in enumerate(sorted(pieces[i], key=lambda r: r["piece"])):
            assert (r["piece"], r["start"]) == (n, at) and (r["length"] == 1024 or n == 0)
            assert r["ids_crc32"] == zlib.crc32(np.array(ids[at : at + r["length"]], "<u4").tobytes())
            at += r["length"]
        assert at == len(ids)
    for own in sequences.values():
        at = 0
        for r in sorted(own, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 1024
    assert len(sequences) <= 1.03 * sum(r["length"] for r in rows) / 1024 + 2


@pytest.mark.parametrize("text", ["", "a\x1c b", "  two  spaces \n\n x", "don't we'll 'tis", "naïve ½² x", "日本 語", "<|endoftext|> x", " x 1٣", "ʼn ß ẞ", "tab\t\tx \r\n y", " ", "\n", "a b c", "x" * 5000])
def test_ids_are_the_tokenizers(text):
    ids = packing.TextIds(queries.tokenizer("byte_bpe_50k.json"))
    assert np.frombuffer(ids.of(text), "<u4").tolist() == ids.tokenizer.encode(text, add_special_tokens=False).ids


def test_packing_merges_over_tasks(spark):
    pieces = spark.range(0, 3000, 1, 40).select(F.col("id").alias("doc_id"), F.lit(0).alias("piece"), F.lit(0).cast("long").alias("start"), (1 + F.col("id") * 7919 % 1000).alias("length"), F.lit(0).cast("long").alias("ids_crc32"))
    rows = packing.pack(pieces, 1024).groupBy("sequence_id").agg(F.sum("length").alias("n")).collect()
    total = sum(r["n"] for r in rows)
    assert max(r["n"] for r in rows) <= 1024 and len(rows) <= 1.01 * total / 1024 + 1


def test_packing_odd_rows(odd, none):
    rows = packing.best_fit_packing(odd, queries.tokenizer("byte_bpe_50k.json")).collect()
    assert Counter(r["doc_id"] for r in rows)[2] == 2 and [r["length"] for r in rows if r["doc_id"] in (3, 4)] == [1, 1]
    assert packing.best_fit_packing(none, queries.tokenizer("byte_bpe_50k.json")).count() == 0


def test_mixing_redistributes_to_siblings_first(spark):
    rows = [(i, "x " * 10, lang, source) for i, (lang, source) in enumerate([("en", "a")] * 2 + [("en", "b")] * 50 + [("de", "c")] * 50 + [("en", "d")] * 100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    tree = spark.createDataFrame([("p", "en", "a", 1, 1, 1), ("p", "en", "b", 1, 1, 1), ("p", "de", "c", 1, 1, 1), ("q", "en", "d", 1, 1, 1)], "domain string, lang string, source string, domain_weight long, lang_weight long, source_weight long")
    sizes = mixing.token_counts(docs)
    budgets = {r["source"]: r["budget"] for r in mixing.leaf_budgets(sizes, tree, 0.4, 1).collect()}
    # 808 tokens: 404 a domain, 202 a language; a has 20 only, so b takes 182.
    assert budgets == {"a": 20, "b": 182, "c": 202, "d": 404}
    out = mixing.mix_sources(docs, tree, max_epochs=1, share=0.4)
    taken = {r["source"]: r["n"] for r in out.where("copies > 0").groupBy("source").agg(F.sum(F.lit(10)).alias("n")).collect()}
    assert all(0 <= budgets[s] - taken.get(s, 0) < 10 for s in budgets)
    twice = mixing.mix_sources(docs.where("source = 'a'"), tree, max_epochs=3, share=2.5)
    assert sorted(r["copies"] for r in twice.collect()) == [2, 3]


def test_mixing_odd_rows(odd, none):
    out = mixing.mix_sources(odd.withColumn("copies", F.lit("clash")), queries.mixture(odd)).collect()
    assert len(out) == 11 and all(r["copies"] >= 0 and r["u"] == "u" for r in out)
    assert mixing.mix_sources(none, queries.mixture(none)).count() == 0


def test_oracle_sql(spark, small):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.sql(f"create view {t} as select * from '{small}/{t}.parquet'")
    for name, sql in queries.ORACLE_SQL.items():
        got = queries.QUERIES[name](spark, small)
        want = con.sql(sql)
        columns = sorted(got.columns)
        key = lambda rows: sorted(repr(r) for r in rows)
        assert sorted(want.columns) == columns
        assert key(tuple(r[c] for c in columns) for r in got.collect()) == key(tuple(r[want.columns.index(c)] for c in columns) for r in want.fetchall()), name


def test_pipeline_stages_keep_their_promises(spark, small, docs):
    import corpus_pipeline

    table = spark.read.parquet(f"{small}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:4]:
        before = {r["doc_id"]: r for r in table.collect()}
        table = spark.createDataFrame(stage(spark, table, small).collect(), table.schema)
        after = {r["doc_id"]: r for r in table.collect()}
        assert set(after) <= set(before) and table.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        if "near" in name:
            want = near_components({i: r["text"] for i, r in before.items()}, 5)
            assert set(after) == {i for i, (_, c) in want.items() if i == c}
        if "substring" in name:
            assert {i: r["text"] for i, r in after.items()} == {i: t for i, (t, _) in without_repeats({i: r["text"] for i, r in before.items()}).items()}
            assert all(r["n_chars"] == len(r["text"]) for r in after.values())
    packed = corpus_pipeline.STAGES[4][1](spark, table, small)
    assert {r["doc_id"] for r in packed.collect()} == set(after)
