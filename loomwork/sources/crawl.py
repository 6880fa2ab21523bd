"""robots.txt and sitemap files as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def robots(files: DataFrame, key: str, body: str) -> DataFrame:
    """(key, crawl_delay, sitemaps): the largest delay and all sitemaps of each robots.txt."""
    lines = F.transform(F.split(F.coalesce(body, F.lit("")), "\r?\n"), lambda s: F.trim(F.regexp_replace(s, "#.*$", "")))
    name = lambda s: F.lower(F.trim(F.substring_index(s, ":", 1)))
    value = lambda s: F.trim(F.regexp_replace(s, "^[^:]*:", ""))
    delays = F.transform(F.filter(lines, lambda s: name(s) == "crawl-delay"), lambda s: value(s).try_cast("double"))
    return files.select(key, F.array_max(delays).alias("crawl_delay"), F.array_distinct(F.transform(F.filter(lines, lambda s: name(s) == "sitemap"), value)).alias("sitemaps"))


def sitemap(files: DataFrame, key: str, body: str, most: int = 50_000) -> DataFrame:
    """(key, kind, loc, lastmod, error): the entries of each sitemap (kind urlset or sitemapindex); too many are an error row."""
    entry = F.regexp_extract_all(body, F.lit(r"(?s)<(?:\w+:)?(?:url|sitemap)>(.*?)</(?:\w+:)?(?:url|sitemap)>"), 1)
    tag = lambda s, t: F.trim(F.regexp_extract(s, rf"(?s)<(?:\w+:)?{t}>\s*(.*?)\s*</(?:\w+:)?{t}>", 1))
    kind = F.when(F.col(body).rlike(r"<(?:\w+:)?sitemapindex"), "sitemapindex").when(F.col(body).rlike(r"<(?:\w+:)?urlset"), "urlset")
    found = files.select(key, kind.alias("kind"), entry.alias("e"))
    error = F.when(F.col("kind").isNull(), "not a sitemap").when(F.size("e") > most, "too many entries")
    rows = found.withColumn("error", error).select(key, "kind", "error", F.explode_outer(F.when(error.isNull(), F.col("e"))).alias("x"))
    return rows.select(key, "kind", F.nullif(tag(F.col("x"), "loc"), F.lit("")).alias("loc"), F.nullif(tag(F.col("x"), "lastmod"), F.lit("")).alias("lastmod"), "error")
