import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomwork.llm import ann, chat_trie, queries, url_filter
from loomwork.llm.components import components

TURNS = "conv_id long, turn long, role string, text string"


def digests(turns):
    loss = "".join(t for r, t in turns if r == "assistant")
    return len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()


def read(df):
    return {r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for r in df.collect()}


def test_conversations_are_read_back(spark, small):
    want = {-1: [("user", "</s>[INST] ok [/INST]"), ("assistant", "</s>[INST] ok [/INST]")]}
    for r in spark.read.parquet(f"{small}/conversations.parquet").orderBy("conv_id", "turn").collect():
        want.setdefault(r["conv_id"], []).append((r["role"], r["text"] or ""))
    assert read(queries.op2_chat_formatting(spark, small)) == {c: digests(t) for c, t in want.items()}


@pytest.mark.parametrize("text", ["", "\\", "<s>", "<\\s>", "[INST][/INST]</s>", "a\\\\[INST", "<<SYS>>x<</SYS>>", "[\\INST]", "<", "é\n\t"])
def test_escaping_is_reversible(spark, text):
    row = spark.createDataFrame([(text,)], "t string").select(chat_trie.escape(F.col("t")).alias("e")).first()
    assert chat_trie.unescape(row["e"]) == text and not any(c in row["e"] for c in chat_trie.CONTROL)


def test_tree_layout(spark):
    rows = [(1, 0, "user", "a"), (1, 1, "assistant", "b"), (2, 0, "user", "a"), (2, 1, "assistant", "c"), (2, 2, "user", "d"), (3, 0, "user", "a"), (3, 1, "assistant", "b"), (3, 2, "user", "e"), (4, 0, "user", "z"), (5, 0, "user", "a"), (5, 1, "assistant", "b")]
    tree, paths = chat_trie.prefix_tree(spark.createDataFrame(rows, TURNS), None, 3)
    nodes = {r["node"]: r for r in tree.collect()}
    assert len(nodes) == 6  # a, ab, abe, ac, acd, z
    order = sorted(nodes.values(), key=lambda r: r["start"])
    assert [r["start"] for r in order] == np.cumsum([0] + [r["length"] for r in order[:-1]]).tolist()
    for path in paths.collect():
        seen = 0
        for n, node in enumerate(path["nodes"]):
            r = nodes[node]
            up = [nodes[x] for x in path["nodes"][:n]]
            assert r["position"] == seen and r["depth"] == n and r["parent"] == (up[-1]["node"] if up else None)
            covered = {i for a in r["ancestors"] for i in range(a["start"], a["end"])}
            assert covered == {i for u in up for i in range(u["start"], u["start"] + u["length"])}
            seen += r["length"]
    at = [n for n, r in enumerate(order) if r["depth"] == 0]  # depth-first: a subtree is contiguous
    assert all(order[i + 1]["parent"] in {r["node"] for r in order[: i + 1]} for i in range(len(order) - 1) if i + 1 not in at)


def test_conversations_odd_rows(spark):
    rows = [(1, 0, "user", "same"), (1, 0, "user", "same"), (1, None, None, None), (None, 1, "assistant", "x"), (2, 5, "odd </s> role", ""), (3, 0, "assistant", "long " * 20_000), (4, 1, "b", "tie"), (4, 1, "a", "tie")]
    df = spark.createDataFrame([(*r, "n", 1) for r in rows], TURNS + ", node string, depth int")
    got = read(chat_trie.conversation_digests(*chat_trie.prefix_tree(df)))
    assert got == {
        1: digests([("", ""), ("user", "same"), ("user", "same")]), None: digests([("assistant", "x")]), 2: digests([("odd </s> role", "")]), 3: digests([("assistant", "long " * 20_000)]), 4: digests([("a", "tie"), ("b", "tie")]),
    }
    assert chat_trie.conversation_digests(*chat_trie.prefix_tree(df.where("false"))).count() == 0


def exact(ids, x, query, k):
    s = ann.exact_scores(np.repeat(x[query : query + 1], len(x), 0), x)
    order = [i for i in np.lexsort((ids, -s)) if ids[i] != ids[query]][:k]
    return [(int(ids[i]), float(s[i])) for i in order]


def test_neighbours_recall(spark):
    e = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = e.orderBy("vec_id").collect()
    ids, x = np.array([r["vec_id"] for r in rows]), np.array([r["embedding"] for r in rows], np.float64)
    got = {}
    found = ann.nearest_neighbours(e, F.col("vec_id") % 20 == 0, rows_per_part=250, block=100)
    for r in found.collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = (r["vec_id"], r["score"])
    hits = total = 0
    for q in np.flatnonzero(ids % 20 == 0):
        want = exact(ids, x, q, 20)
        mine = [got[ids[q]][n] for n in range(1, 21)]
        assert mine == sorted(mine, key=lambda p: (-p[1], p[0])) and all(dict(mine)[i] == s for i, s in want if i in dict(mine))
        hits, total = hits + len(set(dict(mine)) & set(dict(want))), total + 20
    assert hits >= 0.9 * total


@pytest.mark.parametrize("with_", [{}, {"rows_per_part": 100, "most_coarse": 8}])
def test_clusters_are_routed(spark, with_):
    """Vectors in 24 clusters: nine tenths of the neighbours, from less than a third of the rows; also by two levels."""
    rng = np.random.default_rng(4)
    centres = rng.normal(0, 1, (24, 16))
    x = centres[rng.integers(0, 24, 4000)] + rng.normal(0, 0.15, (4000, 16))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got, scanned = {}, {}
    for r in ann.nearest_neighbours(df, F.col("vec_id") % 20 == 0, **with_).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
        scanned[r["query_id"]] = r["n_scanned"]
    hits = sum(len(got[q] & {i for i, _ in exact(np.arange(4000), x, q, 20)}) for q in range(0, 4000, 20))
    assert len(got) == 200 and hits >= 0.9 * 200 * 20 and np.mean(list(scanned.values())) < 4000 / 3


def test_neighbours_ties_and_odd_rows(spark):
    nan = float("nan")
    rows = [(i, [1.0, 2.0], "s") for i in range(60)] + [(60, [3.0, 3.0], "s"), (61, None, "s"), (62, [0.0, 0.0], "s"), (63, [1.0, None], "s"), (64, [nan, 1.0], "s"), (65, [float("inf"), 1.0], "s"), (66, [1.0], "s"), (None, [5.0, 5.0], "s"), (67, [], "s")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score string")
    got = ann.nearest_neighbours(df, F.col("vec_id") % 20 == 0, k=5, block=16).orderBy("query_id", "rank").collect()
    assert [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got[:5]] == [(0, 1, 60, 9.0), (0, 2, 1, 5.0), (0, 3, 2, 5.0), (0, 4, 3, 5.0), (0, 5, 4, 5.0)]
    assert {r["query_id"] for r in got} == {0, 20, 40, 60}
    own = ann.nearest_neighbours(df, F.col("vec_id") == 66, k=5).collect()
    assert own == []  # no other vector has its length
    pair = df.union(spark.createDataFrame([(68, [2.0], "s"), (69, [3.0], "s")], df.schema))
    assert [(r["vec_id"], r["score"]) for r in ann.nearest_neighbours(pair, F.col("vec_id") == 66, k=5).orderBy("rank").collect()] == [(69, 3.0), (68, 2.0)]
    few = ann.nearest_neighbours(df.where("vec_id < 3"), F.lit(True), k=20).collect()
    assert len(few) == 6
    assert ann.nearest_neighbours(df.where("false"), F.lit(True)).count() == 0


def test_parts_are_balanced():
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(c, 0.1, (200, 8)) for c in np.eye(8)[:5]])
    graph = ann.neighbour_graph(x, 10)
    label = ann.balanced_parts(x, graph, 5)
    assert np.bincount(label).max() <= 1.1 * 200 + 1 and (label[:, None] == label[graph]).mean() > 0.8


def test_cascade_is_exact(spark):
    keys = spark.range(20_000).select(F.concat(F.lit("k"), "id").alias("key"), (F.col("id") % 7 == 3).alias("listed"))
    for most in (64 << 20, 1000):
        cascades = url_filter.build_cascade(keys, bits_per_key=4.0, most_bytes=most)
        assert (len(cascades) > 1) == (most == 1000) and all(len(c.levels) > 1 for c in cascades)
        out = url_filter.listed(keys.withColumnRenamed("listed", "want"), "key", cascades)
        assert out.count() == 20_000 and out.where("want <> listed").count() == 0


def test_a_cascade_s_jobs_do_not_grow_with_partitions(spark):
    """Bitmaps come in one job a level, and small levels are read by few tasks."""
    held = {"spark.sql.shuffle.partitions": "60", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in held}
    keys = spark.range(2000).select(F.concat(F.lit("k"), "id").alias("key"), (F.col("id") % 7 == 3).alias("listed"))
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        spark.sparkContext.setJobGroup("cascade", "cascade")
        cascades = url_filter.build_cascade(keys)
        jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("cascade")
        spark.sparkContext.setJobGroup("", "")
        assert len(jobs) <= 6 * (len(cascades[0].levels) + 1)
        assert url_filter.listed(keys.withColumnRenamed("listed", "want"), "key", cascades).where("want <> listed").count() == 0
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


@pytest.mark.parametrize(
    "url, host, path, rule, verdict",
    [
        ("https://A.Example.NET/en/1?x", "a.example.net", "/en/1", "example.net/en/", "allow"), ("http://x.net", "x.net", "", None, "allow"), ("http://x.net/", "x.net", "/", "net/", "block"), ("http://xnet/", "xnet", "/", None, "block"),
        ("http://b.example.com/de/#t", "b.example.com", "/de/", "example.com/de/", "block"), ("no scheme", "", "", None, "allow"), (None, "", "", None, "allow"), ("", "", "", None, "allow"), ("ftp://org/fr/?a://b", "org", "/fr/", "org/fr/", "allow"),
    ],
)
def test_url_rules(spark, url, host, path, rule, verdict):
    pages = spark.createDataFrame([(1, url, "x"), (1, url, "x"), (None, url, "x")], "page_id long, url string, verdict string")
    block = spark.createDataFrame([("xnet",), (None,), ("unseen",), ("xnet",)], "host string")
    rows = url_filter.url_filter(pages, queries.URL_RULES, block).collect()
    assert len(rows) == 3 and {(r["host"], r["path"], r["rule"], r["verdict"]) for r in rows} == {(host, path, rule, verdict)}


@pytest.mark.parametrize("sf, levels", [("sf0.01", 2), ("sf0.1", 3)])
def test_the_query_s_cascade_decides_rows(spark, sf, levels):
    """The list of the registered query is not empty, takes several levels, and blocks pages that no rule fits."""
    pages = spark.read.parquet(f"/root/testdata/{sf}/pages.parquet")
    keys = url_filter.universe(pages, queries.thin_urls(pages), "url")
    assert keys.where("listed").count() >= 0.05 * pages.count()
    assert len(url_filter.build_cascade(keys)[0].levels) >= levels
    rows = queries.op9_url_filter(spark, f"/root/testdata/{sf}")
    assert rows.where("rule is null and verdict = 'block'").count() >= 0.02 * pages.count() and rows.where("rule is null and verdict = 'allow'").count() > 0


@pytest.mark.parametrize("by", ["host", "url"])
def test_url_lists_of_odd_rows(spark, by):
    urls = [None, "", "no scheme", "http://a.test/x", "http://a.test/x", "http://A.test/y", "http://b.test/" + "z" * 100_000, "http://b.test/"]
    pages = spark.createDataFrame([(i, u, "h", "k") for i, u in enumerate(urls)], "page_id long, url string, host string, key string")
    block = [("a.test", "http://a.test/x"), (None, None), ("b.test", "http://b.test/" + "z" * 100_000), ("unseen", "http://unseen/"), ("a.test", "http://a.test/x")]
    got = [r["verdict"] for r in url_filter.url_filter(pages, [], spark.createDataFrame(block, "host string, url string"), by).orderBy("page_id").collect()]
    assert got == (["allow"] * 3 + ["block"] * 5 if by == "host" else ["allow"] * 3 + ["block", "block", "allow", "block", "allow"])


def test_url_filter_empty(spark):
    pages = spark.createDataFrame([], "page_id long, url string")
    assert url_filter.url_filter(pages, queries.URL_RULES, spark.createDataFrame([], "host string")).count() == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 50)] + [(100, i) for i in range(101, 160)] + [(159, 200), (7, 7), (300, 300), (101, 100)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "u long, v long").repartition(5)).collect()}
    assert got == {i: 0 for i in range(51)} | {i: 100 for i in [*range(100, 160), 200]} | {300: 300}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0
