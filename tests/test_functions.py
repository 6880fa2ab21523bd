import datetime as dt
import time

from pyspark.sql import functions as F

from loomwork.functions import pii, url
from loomwork.functions import text as T
from loomwork.operators import chunking, hygiene, pages, retrieval, scheduling
from loomwork.sources import crawl, tables
from loomwork.streaming import events


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def cases():
    return [
        (T.normalized_words(F.lit("Ab é Привет x1")), ["ab", "привет", "x1"]), (T.trigrams(F.lit("a b")), []), (T.trigrams(F.lit("a b c d")), ["a b c", "b c d"]),
        (T.content_shingles(F.lit("One\ntwo")), ["one", "two"]), (T.normalized_lines(F.lit("Paid 12.03.2024 \n\n x  7")), ["paid <date>", "x <num>"]), (T.line_shingles(F.lit("a\n\nb\nc"), 2), ["a\nb", "b\nc"]),
        (T.low_content(F.lit("word " * 19)), True), (T.low_content(F.lit("word " * 120)), False), (T.low_content(F.lit(" ")), False), (T.safe_cell(F.lit("=1+1")), "'=1+1"), (T.safe_cell(F.lit("a=1")), "a=1"),
        (T.citations(F.lit("see [[citation:3]], [[citation:12]]")), [3, 12]), (T.uniqueness_percent(F.lit(1), F.lit(8)), 88), (T.uniqueness_percent(F.lit(0), F.lit(0)), 100), (T.bytes_text(F.lit(1536)), "1.5 KB"),
        (T.preview(F.lit("abcdef"), 3), "abc..."), (T.word_preview(F.lit("one two three"), 9), "one two"), (T.snippet(F.lit("User: a\n`b`")), 'a "b"'), (T.trivial_query(F.lit(" Hello!")), True), (T.trivial_query(F.lit("hello world of maps")), False),
        (T.entity_terms(F.lit("Python and BM25 or v1.2")), ["python", "bm25", "v1.2"]), (T.cache_question(F.lit("  What\n IS ")), "what is"), (T.effectively_unchanged(F.lit("a 1\nb\nc"), F.lit("a 2\nb\nc")), True), (T.effectively_unchanged(F.lit(""), F.lit("")), False),
        (url.queue_url(F.lit("http://Example.com/path/?utm_source=x&id=5#s")), "https://example.com/path/?id=5"), (url.canonical(F.lit("https://a.b/c//#t")), "https://a.b/c"), (url.host(F.lit("HTTPS://A.b.:80/x")), "a.b"), (url.document_type(F.lit("https://a/b.PDF?x")), "pdf"),
        (url.same_site(F.lit("x.a.b"), F.lit("a.b")), True), (url.same_site(F.lit("xa.b"), F.lit("a.b")), False), (url.slug(F.lit("https://Nav.X.ru/dir/?age=14-16#top")), "nav x ru dir age 14 16"),
        (pii.reasons(F.lit("call +7 999 123-45-67, id 12 34 567890")), ["phone", "passport_ru"]), (pii.masked(F.lit("a@b.cd or 1234567890123456")), "*** or ***"), (scheduling.next_interval(F.lit(14), F.lit(True)), 7), (scheduling.next_interval(F.lit(70), F.lit(False)), 90),
    ]


def test_functions(spark):
    for i, (column, want) in enumerate(cases()):
        assert value(spark, column) == want, (i, column)


def test_chunk_hash_ignores_zero_width(spark):
    assert value(spark, T.chunk_hash(F.lit("​  same text ﻿"))) == value(spark, T.chunk_hash(F.lit("same text")))


def test_windows_cover_and_respect_caps():
    words = ["aaaaa", "bbbbb", "ccccc", "ddddd"]
    assert list(chunking.windows(words, [1] * 4, 10, 11, 400)) == [(0, 2), (2, 4)]
    got = list(chunking.windows([f"w{i}" for i in range(1000)], [1] * 1000, 100, 10_000, 400))
    assert got[0] == (0, 100) and got[1][0] == 75 and got[-1][1] == 1000 and all(a < b for a, b in got)


def test_chunks_know_headings_and_tables():
    text = "# A\nintro\n## B\n| x | y |\n|---|---|\n| 1 | 2 |\n" + "word " * 30
    rows = list(chunking.chunks_of(text, chunking.one_token, 50, 1000, 10, True))
    assert [(r[1], r[4]) for r in rows] == [("text", "A"), ("table", "A > B"), ("section_summary", "A > B"), ("text", "A > B")]


def test_similar_by_lines_finds_pairs(spark):
    lines = [f"line {chr(97 + i)}" for i in range(20)]
    rows = [(1, "\n".join(lines)), (2, "\n".join(lines[:-1] + ["other"])), (3, "\n".join(reversed(lines))), (4, "\n".join(lines)), (5, None)]
    got = {(r["left"], r["right"]): r["similarity"] for r in hygiene.similar_by_lines(spark.createDataFrame(rows, "id long, text string"), "id", "text", 0.8, 100).collect()}
    assert got == {(1, 2): 17 / 19}


def test_exact_duplicates_canonical(spark):
    df = spark.createDataFrame([(1, "s", "/page/?a", "t"), (2, "s", "/page/", "t"), (3, "z", "/", "t"), (4, "s", "/q", None)], "id long, source string, uri string, text string")
    got = hygiene.exact_duplicates(df, ["source"], F.col("text"), [F.length("uri"), F.col("id")], "id").collect()
    assert [(r["id"], r["canonical"]) for r in got] == [(1, 2)]


def test_fusion_and_packing(spark):
    one = spark.createDataFrame([("a", 1), ("b", 2)], "k string, rank int")
    got = {r["k"]: (r["score"], r["origins"]) for r in retrieval.reciprocal_rank_fusion({"x": one, "y": one.where("k = 'b'")}, "k").collect()}
    assert got == {"a": (round(1 / 61, 6), "x"), "b": (round(2 / 62, 6), "x,y")}
    hits = spark.createDataFrame([(1, 9000), (2, 10), (3, 10)], "k int, n int")
    assert [r["k"] for r in retrieval.budget_pack(hits, [F.col("k")], F.col("n"), 5000, 6).collect()] == [1]


def test_html_to_markdown(spark):
    html = "<html><head><title> T &amp; x</title></head><body><nav>no</nav><h2>Head</h2><p>Some  text</p><ol><li>a</li><li>b</li></ol><script>x</script></body></html>"
    r = pages.extracted(spark.createDataFrame([(1, html), (2, None)], "id long, html string"), "id", "html").orderBy("id").collect()
    assert r[0]["title"] == "T & x" and r[0]["markdown"] == "## Head\n\nSome text\n\n1. a\n2. b" and r[1]["markdown"] == ""


def test_date_range():
    assert scheduling.date_range("2024") == ("2024-01-01", "2025-01-01") and scheduling.date_range("2024/12") == ("2024-12-01", "2025-01-01") and scheduling.date_range("2024/2/29") == ("2024-02-29", "2024-03-01") and scheduling.date_range("x") is None


def test_robots_and_sitemaps(spark):
    r = crawl.robots(spark.createDataFrame([(1, "User-agent: *\nCrawl-delay: 5\ncrawl-delay: 7\nSitemap: https://a/1.xml\nSITEMAP: https://a/2.xml # x"), (2, None)], "id long, body string"), "id", "body").orderBy("id").collect()
    assert r[0]["crawl_delay"] == 7 and r[0]["sitemaps"] == ["https://a/1.xml", "https://a/2.xml"] and r[1]["sitemaps"] == []
    xml = "<sitemapindex><sitemap><loc> https://a/1 </loc><lastmod>2024-01-01</lastmod></sitemap><sitemap><loc>https://a/2</loc></sitemap></sitemapindex>"
    rows = crawl.sitemap(spark.createDataFrame([(1, xml), (2, "no")], "id long, body string"), "id", "body").collect()
    assert {(x["id"], x["kind"], x["loc"], x["lastmod"], x["error"]) for x in rows} == {(1, "sitemapindex", "https://a/1", "2024-01-01", None), (1, "sitemapindex", "https://a/2", None, None), (2, None, None, None, "not a sitemap")}


def test_csv_round_trip_and_upserts(spark, tmp_path):
    df = spark.createDataFrame([(1, "=x"), (2, 'q"uote\nline')], "id int, t string")
    tables.write_csv(df, str(tmp_path / "out"))
    got = tables.read_csv_files(spark, str(tmp_path / "out" / "*.csv"), "id int, t string").orderBy("id").collect()
    assert [r["t"] for r in got] == ["'=x", 'q"uote\nline']
    assert tables.read_json_lines(spark, str(tmp_path / "none.json"), "a int").count() == 0
    new = spark.createDataFrame([(2, "n"), (3, "n")], "id int, t string")
    assert {(r["id"], r["t"]) for r in tables.replace_by_key(df, new, ["id"]).collect()} == {(1, "=x"), (2, "n"), (3, "n")}
    assert {r["id"] for r in tables.get_or_create(df, new, ["id"]).collect()} == {1, 2, 3}


def test_rate_limit_stream(spark, tmp_path):
    t0 = dt.datetime(2024, 1, 1)
    rows = [("a", t0 + dt.timedelta(seconds=s)) for s in (0, 1, 2, 3, 61)] + [("b", t0)]
    spark.createDataFrame(rows, "k string, ts timestamp").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("k string, ts timestamp").parquet(str(tmp_path / "in"))
    q = events.rate_limited(stream, "k", "ts", limit=2, seconds=60).writeStream.format("memory").queryName(f"r{int(time.time())}").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {(r["k"], int((r["ts"] - t0).total_seconds())): r["accepted"] for r in spark.table(q.name).collect()}
    assert got == {("a", 0): True, ("a", 1): True, ("a", 2): False, ("a", 3): False, ("a", 61): True, ("b", 0): True}


def test_windows_and_sessions(spark):
    t0 = dt.datetime(2024, 1, 1)
    df = spark.createDataFrame([("a", t0 + dt.timedelta(minutes=m)) for m in (0, 1, 9, 30)], "k string, ts timestamp")
    assert sorted(r["count"] for r in events.windowed_counts(df, "ts", ["k"], "10 minutes").collect()) == [1, 3]
    assert sorted(r["count"] for r in events.session_counts(df, "ts", ["k"], "10 minutes").collect()) == [1, 3]


def test_texts_without_digits_or_signs_are_not_searched(spark):
    """The same kinds as by every pattern on every text, and the patterns stand under a condition."""
    texts = ["", None, "no digits here", "one 1 two 2", "8 999 123 45 67", "+7 (999) 123-45-67x", "12 34 567890", "112-233-445 95", "1" * 16, "1" * 10, "1" * 12, "1" * 11, "a@b", "a@b.cd 12", "x a@b.cd", "12 a@b.c", "8(999)1234567\n"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    every = F.array_compact(F.array(*(F.when(F.coalesce("t", F.lit("")).rlike(p), name) for name, p in pii.PATTERNS.items())))
    got = df.select(pii.reasons(F.col("t")).alias("got"), every.alias("want"))
    assert all(r["got"] == r["want"] for r in got.collect())
    assert "[0-9]{2}) THEN" in df.select(pii.reasons(F.col("t")))._jdf.queryExecution().optimizedPlan().toString()
