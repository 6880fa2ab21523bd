"""Sitemaps are followed once each, through circles, and by their state."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from loomwork.operators import sitemaps as S

ENTRIES = "array<struct<loc:string,lastmod:timestamp>>"
NOW = "2026-01-10 12:00:00"
DAY = dt.datetime(2026, 1, 10, 12)


@pytest.fixture(scope="module")
def tables(spark):
    e = lambda *locs: [(x, None) for x in locs]
    at = "https://a.test/"
    files = [
        (at + "0.xml", 200, "sitemapindex", "h0", e(at + "1.xml", at + "2.xml", at + "1.xml#again", "http://a.test/3.xml", "https://b.test/4.xml", "ftp://a.test/5.xml", at + "fresh.xml", at + "gone.xml", at + "moved.xml", at + "same.xml", at + "empty.xml", at + "old.xml", at + "many.xml", None)),
        (at + "1.xml", 200, "sitemapindex", "h1", e(at + "0.xml", at + "1.xml", at + "deep.xml")),
        (at + "2.xml", 200, "urlset", "h2", [(at + "p1", dt.datetime(2026, 1, 1)), (at + "p1?utm_source=x", dt.datetime(2026, 1, 5)), (at + "p2", None), ("https://b.test/p3", None), (at + "p4", dt.datetime(2025, 1, 1))]),
        (at + "3.xml", 200, "urlset", None, e()), (at + "fresh.xml", 200, "urlset", "hf", e(at + "p9")), (at + "moved.xml", 302, "urlset", "x", e()), (at + "same.xml", 304, None, None, None), (at + "empty.xml", 200, "urlset", "", e()),
        (at + "old.xml", 200, "urlset", "hold", e(at + "p2")), (at + "many.xml", 200, "urlset", "m", e(*["x"] * 50_001)), (at + "deep.xml", 500, "urlset", "d", e()), (at + "2.xml", 200, "urlset", "h2", e()),
    ]
    known = [("a", at + "fresh.xml", DAY - dt.timedelta(hours=23), "hf"), ("a", at + "old.xml", DAY - dt.timedelta(hours=24), "hold"), ("a", at + "2.xml", None, "other"), ("z", at + "1.xml", DAY, "h1")]
    files = spark.createDataFrame(files[:-1], f"url string, status int, kind string, body_hash string, entries {ENTRIES}")
    return files, spark.createDataFrame(known, "site string, url string, last_fetched_at timestamp, last_hash string")


def visited(spark, tables, *roots):
    roots = spark.createDataFrame(roots, "site string, host string, url string, rehydrate boolean")
    return S.follow(roots, *tables, NOW)


def test_each_sitemap_once(spark, tables):
    at = "https://a.test/"
    got = visited(spark, tables, ("a", "a.test", at + "0.xml", False), ("a", "a.test", at + "0.xml", False)).collect()
    want = {
        "0.xml": (0, None, 14, False), "1.xml": (1, None, 3, False), "2.xml": (1, None, 5, False), "3.xml": (1, "empty_body", None, None), "fresh.xml": (1, "fresh", None, None), "gone.xml": (1, "http_error_404", None, None), "moved.xml": (1, "redirect", None, None),
        "same.xml": (1, "unchanged", None, None), "empty.xml": (1, "empty_body", None, None), "old.xml": (1, None, 1, True), "many.xml": (1, "too_many_entries", None, None), "deep.xml": (2, "http_error_500", None, None),
    }
    mine = {r["url"].removeprefix(at): (r["round"], r["reason"], r["n_entries"], r["same_hash"]) for r in got}
    assert mine == want | {"https://b.test/4.xml": (1, "wrong_address", None, None)} and len(got) == len(mine)


def test_sites_are_apart_and_may_be_read_again(spark, tables):
    got = visited(spark, tables, ("a", "a.test", "https://a.test/fresh.xml", True), ("z", "a.test", "https://a.test/1.xml", False), ("n", "a.test", None, False), ("w", "w.test", "https://a.test/2.xml", None)).collect()
    assert {(r["site"], r["url"], r["reason"]) for r in got} == {("a", "https://a.test/fresh.xml", None), ("z", "https://a.test/1.xml", "fresh"), ("w", "https://a.test/2.xml", "wrong_address")}
    assert visited(spark, tables).count() == 0


def test_listed_pages_and_their_changes(spark, tables):
    visits = visited(spark, tables, ("a", "a.test", "https://a.test/0.xml", False))
    listed = S.listed_pages(visits, spark.createDataFrame([("a", "a.test")], "site string, host string"))
    assert {r["url"]: r["lastmod"] for r in listed.collect()} == {"https://a.test/p1": dt.datetime(2026, 1, 5), "https://a.test/p2": None, "https://a.test/p4": dt.datetime(2025, 1, 1)}
    pages = spark.createDataFrame([("https://a.test/p1", dt.datetime(2026, 1, 2)), ("https://a.test/p4", dt.datetime(2025, 6, 1)), ("https://a.test/p4", dt.datetime(2025, 6, 1))], "url string, last_modified_at timestamp")
    change = {r["url"][-2:]: r["change"] for r in S.page_changes(listed, pages).collect()}
    assert change == {"p1": "sooner", "p2": "new", "p4": "same"}
    unknown = pages.withColumn("last_modified_at", F.lit(None).cast("timestamp"))
    assert {r["url"][-2:]: r["change"] for r in S.page_changes(listed, unknown).collect()} == {"p1": "sooner", "p2": "new", "p4": "sooner"}
