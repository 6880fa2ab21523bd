"""Sitemaps and indexes of sitemaps, followed round by round from where sites begin, and the pages that they list."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import url as U
from ..sources import store
from .policy import first_match

#: Entries that a sitemap may have; hours in which one is not fetched again.
MOST_ENTRIES, FRESH_HOURS = 50_000, 24


def _site_host(url: Column) -> Column:
    return F.when(F.lower(url).rlike("^https?://[^/?#:]"), U.host(url))


def _reason(now: str | Column, rehydrate: Column) -> Column:
    """Why a sitemap is not read; null where it is. The first of an ordered chain."""
    fresh = F.col("last_fetched_at") > F.lit(now).cast("timestamp") - F.expr(f"INTERVAL {FRESH_HOURS} HOURS")
    status = F.col("status")
    return first_match([
        (_site_host(F.col("url")).isNull() | (_site_host(F.col("url")) != F.col("host")), "wrong_address"), (fresh & ~rehydrate, "fresh"), (status.isNull(), "http_error_404"), ((status == 304) & ~rehydrate, "unchanged"), (status.between(300, 399), "redirect"),
        (status != 200, F.concat(F.lit("http_error_"), status.cast("string"))), (F.coalesce(F.col("body_hash"), F.lit("")) == "", "empty_body"), (F.size(F.coalesce(F.col("entries"), F.array())) > MOST_ENTRIES, "too_many_entries"),
    ])


def follow(roots: DataFrame, files: DataFrame, known: DataFrame, now: str) -> DataFrame:
    """(site, url, round, reason, kind, n_entries, same_hash, entries) of every sitemap that roots lead to, each once for a site.

    roots: (site, host, url, rehydrate) where sites begin, of sites of that host; rehydrate: read what has been read lately too.
    files: (url, status, kind, body_hash, entries), what each address answers; kind is sitemapindex or urlset, entries has structs of
    loc and lastmod. known: (site, url, last_fetched_at, last_hash) of earlier visits.

    Each round joins its sitemaps to their files, and explodes the entries of indexes into the next round: addresses not yet
    seen, by an anti-join, so that circles end. A round is written before the next one, so that no plan grows with the depth and a
    lost executor costs a part of a round. Only whether a round is empty comes to the driver. An address that belongs to another
    host is a row with its reason and leads nowhere; so is one that has no file or is not read. Repeated roots count once, repeated
    files of an address are one of them; null addresses are left out.
    """
    files = files.dropDuplicates(["url"])
    known = known.dropDuplicates(["site", "url"])
    next_ = roots.where(F.col("url").isNotNull()).select("site", "host", "rehydrate", "url").dropDuplicates(["site", "url"])
    rounds: list[DataFrame] = []
    while True:
        visit = next_.join(files, "url", "left").join(known, ["site", "url"], "left").withColumn("reason", _reason(now, F.coalesce("rehydrate", F.lit(False))))
        read = F.col("reason").isNull()
        visit = visit.select(
            "site", "host", "rehydrate", "url", F.lit(len(rounds)).alias("round"), "reason", F.when(read, F.col("kind")).alias("kind"), F.when(read, F.size(F.coalesce("entries", F.array())).cast("long")).alias("n_entries"),
            F.when(read, F.coalesce(F.col("body_hash") == F.col("last_hash"), F.lit(False))).alias("same_hash"), F.when(read, F.col("entries")).alias("entries"),
        )
        rounds.append(store.written(visit, "sitemap-round"))
        seen = rounds[0].select("site", "url")
        for done in rounds[1:]:
            seen = seen.unionByName(done.select("site", "url"))
        found = rounds[-1].where("kind = 'sitemapindex'").select("site", "host", "rehydrate", F.explode("entries").alias("e"))
        found = found.select("site", "host", "rehydrate", U.queue_url(F.col("e")["loc"], []).alias("url"), _site_host(F.col("e")["loc"]).alias("valid")).where("valid is not null").drop("valid")
        next_ = found.dropDuplicates(["site", "url"]).join(seen, ["site", "url"], "left_anti")
        next_ = store.written(next_, "sitemap-next")
        if next_.isEmpty():
            break
    out = rounds[0]
    for more in rounds[1:]:
        out = out.unionByName(more)
    return out.drop("host", "rehydrate")


def listed_pages(visits: DataFrame, hosts: DataFrame, ignored: list[str] = U.IGNORED) -> DataFrame:
    """(site, url, lastmod) of the pages that the urlsets among visits list, on the site's own host (hosts: site, host); of an address that is listed twice the latest lastmod."""
    rows = visits.where("kind = 'urlset'").select("site", F.explode("entries").alias("e")).select("site", F.col("e")["loc"].alias("loc"), F.col("e")["lastmod"].alias("lastmod"))
    rows = rows.join(hosts, "site").where(_site_host(F.col("loc")) == F.col("host"))
    return rows.groupBy("site", U.queue_url(F.col("loc"), ignored).alias("url")).agg(F.max("lastmod").alias("lastmod"))


def page_changes(listed: DataFrame, pages: DataFrame) -> DataFrame:
    """(site, url, change): new for listed addresses that pages (url, last_modified_at, interval) lacks; sooner where lastmod is later than what is
    stored or nothing is, so that the interval becomes a day; same otherwise. A listed page without lastmod is the same."""
    old = pages.select("url", "last_modified_at", F.lit(True).alias("_known")).dropDuplicates(["url"])
    later = F.col("lastmod").isNotNull() & (F.col("last_modified_at").isNull() | (F.col("last_modified_at") < F.col("lastmod")))
    change = F.when(F.col("_known").isNull(), "new").when(later, "sooner").otherwise("same")
    return listed.join(old, "url", "left").select("site", "url", change.alias("change"))
