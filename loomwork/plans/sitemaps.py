"""Sitemap synchronisation over the sites that pages name.

No table holds sitemaps, so each host's are made of its pages: an index that leads to one for each language and to a strange host, each of these
to one for each third of each thousand page_ids and back to the start; what an address answers follows from its checksum.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import url as U
from ..operators import sitemaps as S
from .registry import query

NOW = "2024-06-01 12:00:00"
_ENTRY = "struct<loc:string,lastmod:timestamp>"


def _pages(table) -> DataFrame:
    u = F.col("url")
    lang = F.coalesce(F.nullif(F.regexp_extract(U.path(u), "^/([a-z]{2})/", 1), F.lit("")), F.lit("xx"))
    lastmod = F.when(F.col("page_id") % 5 > 0, F.timestamp_seconds(F.lit(1_700_000_000) + F.col("page_id") * 3600))
    return table("pages").select("page_id", "url", U.host(u).alias("host"), lang.alias("lang"), (F.floor(F.col("page_id") / 1000) * 3 + F.col("page_id") % 3).cast("string").alias("third"), lastmod.alias("lastmod"))


def _files(pages: DataFrame) -> DataFrame:
    base = F.concat(F.lit("https://"), F.col("host"))
    part = F.concat(base, F.lit("/"), F.col("lang"), F.lit("/"), F.col("third"), F.lit(".xml"))
    of_lang = F.concat(base, F.lit("/"), F.col("lang"), F.lit("/sitemap.xml"))
    root = F.concat(base, F.lit("/sitemap.xml"))
    entry = lambda loc, at=None: F.struct(loc.alias("loc"), (at if at is not None else F.lit(None).cast("timestamp")).alias("lastmod"))
    # What is gathered is bounded: a file lists pages of a thousand ids.
    sets = pages.groupBy(part.alias("url")).agg(F.lit("urlset").alias("kind"), F.collect_list(entry(F.col("url"), F.col("lastmod"))).alias("entries"))
    langs = pages.groupBy(of_lang.alias("url"), root.alias("root")).agg(F.collect_set(entry(part)).alias("entries")).select("url", F.lit("sitemapindex").alias("kind"), F.concat("entries", F.array(entry(F.col("root")))).alias("entries"))
    roots = pages.groupBy(root.alias("url")).agg(F.lit("sitemapindex").alias("kind"), F.concat(F.collect_set(entry(of_lang)), F.array(entry(F.lit("https://elsewhere.test/x.xml")))).alias("entries"))
    c = F.crc32(F.col("url")) % 16
    status = F.when((F.col("kind") == "urlset") & (c == 0), 404).when((F.col("kind") == "urlset") & (c == 1), 301).when((F.col("kind") == "urlset") & (c == 2), 304).otherwise(200)
    body_hash = F.when((F.col("kind") == "urlset") & (c == 3), "").otherwise(F.sha2("url", 256))
    return sets.unionByName(langs).unionByName(roots).select("url", "kind", status.alias("status"), body_hash.alias("body_hash"), F.col("entries").cast(f"array<{_ENTRY}>").alias("entries"))


def _known(files: DataFrame) -> DataFrame:
    """Earlier visits of some sitemaps: lately, or long ago with the same hash."""
    c = F.crc32(F.col("url")) % 16
    at = F.when(c == 4, F.lit("2024-06-01 00:00:00")).when(c == 5, F.lit("2024-05-31 12:00:00")).when(c == 6, F.lit("2024-05-01 00:00:00"))
    return files.where(at.isNotNull()).select(U.host(F.col("url")).alias("site"), "url", at.cast("timestamp").alias("last_fetched_at"), F.when(c == 6, F.sha2("url", 256)).alias("last_hash"))


def visits(table) -> DataFrame:
    pages = _pages(table)
    files = _files(pages)
    roots = pages.select(F.col("host").alias("site"), "host", F.concat(F.lit("https://"), F.col("host"), F.lit("/sitemap.xml")).alias("url"), (F.length("host") % 7 == 0).alias("rehydrate")).distinct()
    return S.follow(roots, files, _known(files), NOW)


_C = "(h % 16)"
#: DuckDB has no crc32: the checksums of the addresses are made bit by bit, over a table that follows from the polynomial.
_CRC = """crc_table AS (SELECT list(list_reduce(range(8), lambda c, i: CASE WHEN c % 2 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END, b) ORDER BY b) AS crcs FROM range(256) t(b))"""
_CRC_OF = "xor(4294967295, list_reduce(list_transform(range(octet_length(encode(url))), lambda i: CAST('0x' || hex(encode(url))[2 * i + 1:2 * i + 2] AS BIGINT)), lambda c, byte: xor(c >> 8, crcs[(xor(c, byte) & 255) + 1]), 4294967295))"
_SITES = f"""{_CRC}, p AS (SELECT page_id, url, rtrim(lower(coalesce(regexp_extract(url, '^[a-zA-Z]+://([^/?#:]*)', 1), '')), '.') AS host, coalesce(nullif(regexp_extract(coalesce(regexp_extract(url, '^[a-zA-Z]+://[^/?#]*([^?#]*)', 1), ''), '^/([a-z]{{2}})/', 1), ''), 'xx') AS lang, page_id // 1000 * 3 + page_id % 3 AS third,
  CASE WHEN page_id % 5 > 0 THEN make_timestamp((1700000000 + page_id * 3600) * 1000000) END AS lastmod FROM pages),
e AS (SELECT 'https://' || host || '/' || lang || '/' || third || '.xml' AS parent, 'urlset' AS kind, url AS loc, lastmod FROM p UNION ALL
  SELECT DISTINCT 'https://' || host || '/' || lang || '/sitemap.xml', 'sitemapindex', 'https://' || host || '/' || lang || '/' || third || '.xml', NULL::TIMESTAMP FROM p UNION ALL SELECT DISTINCT 'https://' || host || '/' || lang || '/sitemap.xml', 'sitemapindex', 'https://' || host || '/sitemap.xml', NULL FROM p UNION ALL
  SELECT DISTINCT 'https://' || host || '/sitemap.xml', 'sitemapindex', 'https://' || host || '/' || lang || '/sitemap.xml', NULL FROM p UNION ALL SELECT DISTINCT 'https://' || host || '/sitemap.xml', 'sitemapindex', 'https://elsewhere.test/x.xml', NULL FROM p),
f0 AS (SELECT parent AS url, kind, count(*) AS n FROM e GROUP BY 1, 2), f AS (SELECT url, kind, n, {_CRC_OF} % 16 AS c FROM f0, crc_table),
sites AS (SELECT DISTINCT host, length(host) % 7 = 0 AS again FROM p),
judged AS (SELECT host, again, f.*, CASE WHEN c IN (4) AND NOT again THEN 'fresh' WHEN kind = 'urlset' AND c = 2 THEN CASE WHEN again THEN 'redirect' ELSE 'unchanged' END
  WHEN kind = 'urlset' AND c = 1 THEN 'redirect' WHEN kind = 'urlset' AND c = 0 THEN 'http_error_404' WHEN kind = 'urlset' AND c = 3 THEN 'empty_body' WHEN n > 50000 THEN 'too_many_entries' END AS reason
  FROM f JOIN sites ON rtrim(lower(regexp_extract(f.url, '^https://([^/?#:]*)', 1)), '.') = host),
r AS (WITH RECURSIVE r AS (SELECT host AS site, 'https://' || host || '/sitemap.xml' AS url FROM sites UNION
  SELECT r.site, e.loc FROM r JOIN judged j ON j.host = r.site AND j.url = r.url AND j.reason IS NULL AND j.kind = 'sitemapindex' JOIN e ON e.parent = r.url AND e.kind = 'sitemapindex') SELECT * FROM r),
v AS (SELECT r.site, r.url, CASE WHEN j.url IS NULL THEN 'wrong_address' ELSE j.reason END AS reason, CASE WHEN j.reason IS NULL THEN j.kind END AS kind, CASE WHEN j.reason IS NULL THEN j.n END AS n_entries, CASE WHEN j.url IS NOT NULL AND j.reason IS NULL THEN j.c = 6 END AS same_hash
  FROM r LEFT JOIN judged j ON j.host = r.site AND j.url = r.url)"""


@query(f"WITH {_SITES} SELECT * FROM v")
def sitemap_visits(table):
    """Every sitemap that each site's index leads to, and why it is read or not."""
    return visits(table).select("site", "url", "reason", "kind", "n_entries", "same_hash")


@query(f"""WITH {_SITES}, l AS (SELECT v.site, 'https://' || rtrim(lower(regexp_extract(loc, '^[a-zA-Z]+://([^/?#:]*)', 1)), '.') || coalesce(regexp_extract(loc, '^[a-zA-Z]+://[^/?#]*([^?#]*)', 1), '') || CASE WHEN len(q) > 0 THEN '?' || array_to_string(q, '&') ELSE '' END AS url, max(lastmod) AS lastmod
  FROM (SELECT *, list_filter(string_split(coalesce(regexp_extract(loc, '^[^?#]*[?]([^#]*)', 1), ''), '&'), lambda x: x <> '' AND string_split(x, '=')[1] NOT IN ({", ".join(f"'{p}'" for p in U.IGNORED)})) AS q FROM e WHERE kind = 'urlset') e JOIN v ON v.url = e.parent AND v.kind = 'urlset' GROUP BY ALL)
SELECT site, l.url, CASE WHEN max(k.page_id) IS NULL THEN 'new' WHEN any_value(l.lastmod) IS NOT NULL AND (any_value(k.stored) IS NULL OR any_value(k.stored) < any_value(l.lastmod)) THEN 'sooner' ELSE 'same' END AS change
FROM l LEFT JOIN (SELECT url, min(page_id) AS page_id, CASE WHEN min(page_id) % 4 > 0 THEN make_timestamp((1700000000 + (min(page_id) % 4) * 3600 * 400) * 1000000) END AS stored FROM p GROUP BY 1) k ON k.url = l.url GROUP BY 1, 2""")
def sitemap_changes(table):
    """Pages that sitemaps list: new ones, and those to visit sooner as they say to have changed."""
    pages = _pages(table)
    listed = S.listed_pages(visits(table), pages.select(F.col("host").alias("site"), "host").distinct())
    first = pages.groupBy("url").agg(F.min("page_id").alias("id"))
    stored = F.when(F.col("id") % 4 > 0, F.timestamp_seconds(F.lit(1_700_000_000) + (F.col("id") % 4) * 3600 * 400))
    return S.page_changes(listed, first.select("url", stored.alias("last_modified_at")))
